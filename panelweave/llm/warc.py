"""Content-addressed web archive.

An archive is a folder of two tables. ``payloads`` holds the bytes of every
distinct payload once, under its SHA-256. ``records`` holds one row per WARC
record: its exact header bytes (WARC and HTTP) and the digest of its payload. The
original record is header, payload and two line ends; joins rebuild it. Digests
are verified when the archive is read: a payload whose bytes do not give its
digest, or whose length or SHA-1 is not what a header says, raises.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more, the one with the
largest page id is the response and the others are revisits of it (their block is
the HTTP header alone, their payload is the response's); smaller payloads are all
responses, though stored once as well.

Skew: a payload that a third of all pages share is one row of ``payloads``; its
pages are narrow rows, and the joins leave skewed keys to adaptive execution.
Payload bytes are moved only to pick each distinct one, by its holder's id and digest.

Defined results: a null payload is the empty one, one of any length is stored whole;
a null url becomes an empty target (line ends in urls are percent-encoded); a null
page id comes after all others, and ids of any type are named as text; a page id that
repeats has a record for each of its rows, whatever their payloads (of records with
equal payloads and the holder's id all are responses). Extra columns of any name are
ignored; an empty table gives an archive without records.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelweave.llm.common import arrow_map
from panelweave.session import scratch, table

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _header(kind: Column, uri: Column, record: Column, size: Column, sha1: Column, refers: Column, date: str) -> tuple[Column, Column]:
    """WARC and HTTP header of a record, as text."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2))
    block = F.octet_length(http) + F.when(kind == "response", size).otherwise(F.lit(0))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), record, F.lit(">")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers, F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)), http


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE) -> None:
    """Write the archive of ``pages`` to ``folder``. ``payload`` is text (stored in UTF-8) or binary."""
    body = F.col(f"`{payload}`") if dict(pages.dtypes)[payload] == "binary" else _bytes(F.col(f"`{payload}`"))
    body = F.coalesce(body, _bytes(F.lit("")))
    uri = F.replace(F.replace(F.coalesce(F.col(f"`{url}`"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(f"`{key}`").alias("k"), uri.alias("uri"), body.alias("payload"))
    narrow = rows.select("k", "uri", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    narrow.write.parquet(f"{folder}/digests")
    narrow = pages.sparkSession.read.schema(narrow.schema).parquet(f"{folder}/digests")

    # the largest id of each payload holds its bytes; nulls come last, so a payload may have only null ids
    holders = narrow.groupBy("digest").agg(F.max("k").alias("holder"))
    rows = rows.select("k", "payload", F.sha2("payload", 256).alias("digest"))
    held = rows.join(holders.select(F.col("holder").alias("k"), "digest").where("k is not null"), ["k", "digest"], "left_semi").dropDuplicates(["k", "digest"])
    unnamed = rows.where("k is null").dropDuplicates(["digest"]).join(holders.where("holder is null").select("digest"), "digest", "left_semi")
    payloads = held.select("digest", "payload").unionByName(unnamed.select("digest", "payload"))
    payloads.write.option("compression", "zstd").parquet(f"{folder}/payloads")

    named = narrow.join(holders, "digest")
    revisit = (F.col("size") >= MIN_REVISIT) & ~F.col("k").eqNullSafe(F.col("holder"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    record, refers = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("k", "holder"))
    warc, http = _header(kind, F.col("uri"), record, F.col("size"), F.col("sha1"), refers, date)
    named.select("k", "digest", _bytes(warc).alias("warc_header"), _bytes(http).alias("http_header")).write.option("compression", "zstd").parquet(f"{folder}/records")


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, rebuilt by a join: parsed header fields, ``payload`` (the full one, also of revisits) and ``record`` (exact bytes).

    ``record_bytes`` is the length of ``record``; asking for it rebuilds the record and raises where its length, or the
    digest of the payload within it, is not what its header says. Columns that are not asked for are not moved: digests and lengths are taken
    from the payloads before the join, so they come without the bytes.
    """
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads").select(
        "digest",
        "payload",
        F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("long").alias("size"),
        (F.sha2("payload", 256) == F.col("digest")).alias("intact"),
    )
    records = spark.read.schema("digest string, warc_header binary, http_header binary").parquet(f"{folder}/records")
    warc, http = F.decode("warc_header", "UTF-8"), F.decode("http_header", "UTF-8")
    records = records.select(
        "digest",
        "warc_header",
        "http_header",
        _field(warc, "WARC-Type").alias("record_type"),
        _field(warc, "WARC-Target-URI").alias("uri"),
        F.regexp_extract(_field(warc, "WARC-Record-ID"), "<urn:page:(.*)>", 1).alias("record_id"),
        F.regexp_extract(_field(warc, "WARC-Refers-To"), "<urn:page:(.*)>", 1).alias("refers_to"),
        F.regexp_extract(_field(warc, "WARC-Payload-Digest"), "sha1:(.*)", 1).alias("told_sha1"),
        F.regexp_extract(http, r"\r\nContent-Length: (\d+)\r\n", 1).cast("long").alias("told_size"),
        _field(warc, "Content-Length").cast("int").alias("told_block"),
    )
    found = records.join(payloads, "digest", "left")
    good = F.coalesce(F.col("intact") & (F.col("sha1") == F.col("told_sha1")) & (F.col("size") == F.col("told_size")), F.lit(False))
    fault = F.raise_error(F.concat(F.lit("the archive's payload does not fit its record "), F.col("record_id")))
    checked = F.when(good, F.col("size")).otherwise(fault.cast("long"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(_bytes(F.lit("")))
    record = F.concat("warc_header", "http_header", body, _bytes(F.lit(CRLF * 2)))
    before, http_size = F.octet_length("warc_header"), F.octet_length("http_header")
    held = F.sha1(F.substring(record, before + http_size + 1, F.col("told_block") - http_size))
    told = F.when(F.col("record_type") == "response", F.col("told_sha1")).otherwise(F.sha1(_bytes(F.lit(""))))
    whole = F.coalesce((F.octet_length(record) == before + F.col("told_block") + 4) & (held == told), F.lit(False))
    broken = F.raise_error(F.concat(F.lit("the rebuilt record does not fit its header: "), F.col("record_id")))
    return found.select(
        "record_id",
        "uri",
        "record_type",
        "refers_to",
        "digest",
        checked.alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        "payload",
        record.alias("record"),
        F.when(whole, F.octet_length(record)).otherwise(broken.cast("int")).cast("long").alias("record_bytes"),
    )


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file, plain or compressed (one member a record or one for all)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {a: b for a, _, b in (x.partition(": ") for x in lines[1:])}
        start, size = end + 4, int(fields["Content-Length"])
        yield fields, data[start : start + size]
        at = start + size + 4


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``.warc`` or ``.warc.gz`` files, read by Spark: ``path, fields, block``. A file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for fields, block in parse_records(data):
                    columns = ([name], [list(fields.items())], [block])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kind)], ["path", "fields", "block"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return arrow_map(files, run, "path string, fields map<string,string>, block binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), folder)
    # asking for the length of every record rebuilds it, so a digest is given only for one that is whole
    return read_archive(spark, folder).select(
        F.when(F.col("record_id") != "", F.col("record_id").cast("long")).alias("page_id"),
        "payload_bytes",
        F.when(F.col("record_bytes") > 0, F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to") != "", F.col("refers_to").cast("long")).alias("refers_to"),
    )


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
r AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> holder THEN holder END AS refers_to
FROM r
"""
