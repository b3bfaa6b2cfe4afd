import gzip
import hashlib

import pytest

from panelweave.llm import warc

LONG = "é" * 700
PAGES = [(1, "http://a/", LONG), (2, "http://b/\r\nX: y", LONG), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "n", LONG + "z"), (7, "u", LONG), (8, "", "x" * 999), (9, "", "x" * 999), (10, "", "x" * 1000), (11, "", "x" * 1000)]


def plain(pages):
    out = []
    for k, _, html in pages:
        data = (html or "").encode()
        holder = max(p for p, _, h in pages if (h or "") == (html or "") and p is not None) if k is not None else None
        revisit = len(data) >= 1000 and k != holder
        out.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", holder if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(k, u, h, "x", 1) for k, u, h in PAGES], "page_id long, url string, html string, digest string, k int")
    warc.write_archive(df, str(tmp_path / "a"))
    rows = warc.read_archive(spark, str(tmp_path / "a")).collect()
    found = [(int(r["record_id"]) if r["record_id"] else None, r["payload_bytes"], r["payload_digest"], r["record_type"], int(r["refers_to"]) if r["refers_to"] else None) for r in rows]
    assert sorted(found, key=str) == plain(PAGES)
    texts = {k: (h or "").encode() for k, _, h in PAGES}
    for r in rows:
        key = int(r["record_id"]) if r["record_id"] else None
        assert bytes(r["payload"]) == texts[key]
        ((fields, block),) = warc.parse_records(bytes(r["record"]))
        head, _, body = block.partition(b"\r\n\r\n")
        assert body == (texts[key] if r["record_type"] == "response" else b"")
        assert f"Content-Length: {len(texts[key])}".encode() in head and fields["WARC-Payload-Digest"] == f"sha1:{r['payload_digest']}"
    # every distinct payload is stored once
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    assert stored.count() == len({h for h in texts.values()}) == stored.select("digest").distinct().count()


def test_files_of_records(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"))
    records = [bytes(r["record"]) for r in warc.read_archive(spark, str(tmp_path / "a")).select("record").collect()]
    (tmp_path / "one.warc").write_bytes(b"".join(records))
    (tmp_path / "two.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    found = warc.read_warc_files(spark, str(tmp_path / "*.warc*")).collect()
    assert len(found) == 2 * len(PAGES) and {r["fields"]["WARC-Type"] for r in found} == {"response", "revisit"}
    with pytest.raises(ValueError):
        list(warc.parse_records(b"nothing\r\n\r\n"))


def test_damage_is_noticed(spark, tmp_path):
    from pyspark.sql import functions as F

    warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), str(tmp_path / "a"))
    folder = str(tmp_path / "a" / "payloads")
    bad = spark.read.parquet(folder).withColumn("payload", F.encode(F.lit("other"), "UTF-8"))
    spark.createDataFrame(bad.collect(), bad.schema).write.mode("overwrite").parquet(folder)
    with pytest.raises(Exception, match="does not fit"):
        warc.read_archive(spark, str(tmp_path / "a")).select("payload_bytes").collect()


def test_empty_and_repeated(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:3] + PAGES[:3], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 6
    warc.write_archive(df.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).collect() == []


def test_one_id_with_two_payloads_and_a_long_one(spark, tmp_path):
    a, b, long = "a" * 1500, "b" * 1500, "é" * 3_000_000
    df = spark.createDataFrame([(1, "u", a), (1, "u", b), (2, "v", a), (3, "w", long), (None, "x", b), (None, "x", None)], "page_id long, url string, html string")
    for key, frame in (("page_id", df), ("name", df.withColumn("name", df["page_id"].cast("string")).withColumnRenamed("page_id", "k"))):
        folder = str(tmp_path / key)
        warc.write_archive(frame, folder, key=key)
        rows = warc.read_archive(spark, folder).select("record_id", "record_type", "refers_to", "payload", "record_bytes").collect()
        found = sorted((r["record_id"], r["record_type"], r["refers_to"] or None, bytes(r["payload"]).decode()) for r in rows)
        want = [("1", "response", None, b), ("1", "revisit", "2", a), ("2", "response", None, a), ("3", "response", None, long), ("", "revisit", "1", b), ("", "response", None, "")]
        assert found == sorted(want)


def test_query_rebuilds_every_record(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    found = warc.op6_warc(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == plain(PAGES)
    warc.write_archive(df, str(tmp_path / "a"))
    rows = warc.read_archive(spark, str(tmp_path / "a")).select("record", "record_bytes").collect()
    assert len(rows) == len(PAGES) and all(len(r["record"]) == r["record_bytes"] for r in rows)

    write = warc.write_archive

    def damage(pages, folder):  # the header of page 8 tells another block length; its payload stays right
        write(pages, folder)
        told = F.decode("warc_header", "UTF-8")
        bad = F.when(F.col("k") == 8, F.encode(F.regexp_replace(told, "Content-Length: ", "Content-Length: 1"), "UTF-8")).otherwise(F.col("warc_header"))
        records = spark.read.parquet(f"{folder}/records").withColumn("warc_header", bad)
        spark.createDataFrame(records.collect(), records.schema).write.mode("overwrite").parquet(f"{folder}/records")

    monkeypatch.setattr(warc, "write_archive", damage)
    with pytest.raises(Exception, match="rebuilt record does not fit"):
        warc.op6_warc(spark, str(tmp_path)).collect()
