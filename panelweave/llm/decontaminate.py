"""Benchmark decontamination by winnowing, with built-in functions only.

Every item becomes windows of ten words. Of a window's six five-word grams the
one with the least hash is its fingerprint. A text keeps the least hash of each
of *its* ten-word windows, so a shared window leaves the same fingerprint at the
same offset on both sides: the join of fingerprints misses no shared window. A
hit is extended to the ten words around it, and the words themselves are
compared, so no collision of hashes gets into the result. Items of fewer words
are one shorter window; their grams are joined directly.

Defined results: null or wordless texts have no hits; a text of any length is read
whole; a wordless item has no window; items without an id count as hits but not as
items; items that repeat, and windows that items share, count once each; rows that
repeat a ``doc_id`` are judged each by their own text; extra columns of any name
pass through untouched; empty tables give no hits.

Skew: a text's fingerprints are rows, joined to at most ten rows of the list per
fingerprint whatever number of items share it; the ids of items are joined last, to
the windows that were hit. The fingerprints, the windows and the ids are each
broadcast only where their counted rows (and the windows' counted bytes) are few,
otherwise they are shuffled and adaptive execution splits frequent ones. Where few
texts have a fingerprint in common with an item, only those texts are shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelweave.llm.common import numbered
from panelweave.session import materialise, table

WINDOW, GRAM = 10, 5

#: Counted rows up to which a table is broadcast (numbers, or short texts whose bytes are counted too), and bytes of texts.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20

#: Values of ``fp`` that rows of size 0 have, so that no one value is frequent.
COUNTS = 1024

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z in lower case; ``translate`` only where other scripts forbid the fast ``lower``."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _gram(h: str, first: Column, i: Column, size: int) -> Column:
    return F.xxhash64(first, *[F.get(h, i + k) for k in range(1, size)])


def _grams(h: str, size: int) -> Column:
    """Hashes of all grams of this size, by position."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (size - 1), F.lit(0))), lambda x, i: _gram(h, x, i, size))


def fingerprints(words: DataFrame, keys: list[str], short: tuple[int, ...] = ()) -> DataFrame:
    """``keys, size, fp, at``: the winnowed five-word grams (size 10) and all grams of the sizes in ``short``.

    Every row also gives one of size 0, with the number of words as ``at`` and a small number as ``fp``.
    """
    step = words.select(*keys, F.transform("words", lambda x: F.xxhash64(x)).alias("h"))
    step = step.select(*keys, F.size("h").alias("n"), *(["h"] if short else []), _grams("h", GRAM).alias("g"))
    span = WINDOW - GRAM + 1
    least = F.transform(
        F.slice("g", 1, F.greatest(F.size("g") - (span - 1), F.lit(0))),
        lambda x, i: F.least(x, *[F.get("g", i + k) for k in range(1, span)]),
    )
    step = step.select(*keys, "n", *(["h"] if short else []), "g", least.alias("m"))

    def chosen(x: Column, i: Column) -> Column:
        found = F.coalesce(F.get("m", i) == x, F.lit(False))
        for k in range(1, span):
            found = found | F.coalesce(F.get("m", i - k) == x, F.lit(False))
        return F.when(found, F.struct(F.lit(WINDOW).alias("size"), x.alias("fp"), i.alias("at")))

    rows = F.filter(F.transform("g", chosen), lambda e: e.isNotNull())
    for size in short:
        sized = F.lit(size).alias("size")
        rows = F.concat(rows, F.transform(_grams("h", size), lambda x, i: F.struct(sized, x.alias("fp"), i.alias("at"))))  # noqa: B023
    count = F.struct(F.lit(0).alias("size"), F.pmod(F.xxhash64(*keys, "n"), F.lit(COUNTS)).alias("fp"), F.col("n").alias("at"))
    rows = F.concat(F.array(count), rows)
    return step.select(*keys, F.explode(rows).alias("e")).select(*keys, "e.size", "e.fp", "e.at")


def item_windows(items: DataFrame, text: str = "text", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """The distinct windows, ``wid, window`` (its words, joined by a space) ``, size, words``; and ``wid, item`` for the items with an id that have them."""
    base = items.select(F.col(f"`{item}`").cast("string").alias("item"), words_of(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    rows = base.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("words")).distinct()
    rows = materialise(rows, "item-windows")
    # the number of a window is fixed by writing it down
    windows = rows.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), F.concat_ws(" ", "words").alias("window"), F.size("words").alias("size"), "words")
    windows = materialise(windows, "windows")
    return windows, materialise(rows.where("item is not null").join(windows.select("wid", "words"), "words").select("wid", "item"), "window-items")


def _item_fingerprints(windows: DataFrame, short: tuple[int, ...]) -> DataFrame:
    """Distinct ``size, fp, offset``: the fingerprint of each window and where in the window it is."""
    found = fingerprints(windows.select("words"), [], short)
    # a window of ten words is also a text, and holds shorter grams: only grams at offset 0 of windows of that size count
    rows = found.where(F.col("size") == WINDOW)
    for size in short:
        own = windows.where(F.col("size") == size).select("words")
        rows = rows.unionByName(fingerprints(own, [], (size,)).where(F.col("size") == size))
    return rows.select("size", "fp", F.col("at").alias("offset")).distinct()


def _few(df: DataFrame, size: Column | None = None) -> bool:
    """Whether the counted rows, and the bytes of a column, are few enough for a broadcast."""
    rows, volume = df.agg(F.count("*"), F.sum(F.octet_length(size).cast("long")) if size is not None else F.lit(0)).first()
    return rows <= BROADCAST_ROWS and (volume or 0) <= BROADCAST_BYTES


def _bounded(df: DataFrame, size: Column | None = None) -> DataFrame:
    return F.broadcast(df) if _few(df, size) else df


def _hits(docs: DataFrame, items: DataFrame, text: str, key: str, item: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``base``: ``k, th, t`` of every row; ``near``: ``k, th, places, n_words``; ``hits``: ``k, th, at, size, wid``, equal word by word; and the ids ``wid, item``."""
    windows, ids = item_windows(items, text="text", item=item)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # ten values at most
    short = tuple(s for s in sizes if s < WINDOW)
    counts = docs.sparkSession.range(COUNTS).select(F.lit(0).alias("size"), F.col("id").alias("fp"), F.lit(0).alias("offset"))
    marks = materialise(_item_fingerprints(windows, short).unionByName(counts), "marks")

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(t).alias("th"), t.alias("t"))
    prints = fingerprints(base.select("k", "th", words_of(F.col("t")).alias("words")), ["k", "th"], short)
    near = prints.join(_bounded(marks), ["size", "fp"]).select("k", "th", F.struct("size", (F.col("at") - F.col("offset")).alias("at")).alias("c"))
    near = near.where("c.at >= 0").groupBy("k", "th")
    near = near.agg(F.collect_set(F.when(F.col("c.size") > 0, F.col("c"))).alias("places"), F.max(F.when(F.col("c.size") == 0, F.col("c.at"))).alias("n_words"))
    near = materialise(near, "places")
    places = near.where(F.size("places") > 0).select(F.col("k").alias("pk"), F.col("th").alias("pth"), "places")

    # extend: the words at each place against the words of the windows; of all texts only those with a place go on, if they are few
    candidates, kept = base, places.select("pth").distinct()
    if _few(kept):
        candidates = base.join(F.broadcast(kept), F.col("th") == F.col("pth"), "left_semi")
    found = candidates.join(places, F.col("k").eqNullSafe(F.col("pk")) & (F.col("th") == F.col("pth")))
    found = found.select("k", "th", words_of(F.col("t")).alias("w"), "places")
    at = F.transform("places", lambda c: F.struct(c["at"].alias("at"), c["size"].alias("size"), F.concat_ws(" ", F.slice("w", c["at"] + 1, c["size"])).alias("window")))
    found = found.select("k", "th", F.explode(at).alias("e")).select("k", "th", "e.at", "e.size", "e.window")
    known = windows.select("window", "wid")
    return base, near, materialise(found.join(_bounded(known, F.col("window")), "window").select("k", "th", "at", "size", "wid").distinct(), "hits"), ids


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Per row of ``docs``: its key, ``th`` (hash of the text), ``n_words``, ``n_hit``, ``items`` (sorted distinct ids as strings), ``spans`` (start, end of hit words).

    ``key`` may repeat or be null: a row is known by its key and the hash of its text.
    """
    base, near, hits, ids = _hits(docs, items, text, key, item)
    spans = F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("end")))).alias("spans")
    spans = hits.groupBy("k", "th").agg(spans).select(F.col("k").alias("pk"), F.col("th").alias("pth"), "spans")
    own = hits.select("k", "th", "wid").distinct().join(_bounded(ids, F.col("item")), "wid").select("k", "th", "item").distinct()
    own = own.groupBy("k", "th").agg(F.array_sort(F.collect_list("item")).alias("items")).select(F.col("k").alias("ik"), F.col("th").alias("ith"), "items")

    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["at"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    counted = near.select(F.col("k").alias("nk"), F.col("th").alias("nth"), F.col("n_words").cast("long").alias("n_words"))
    every = base.select("k", "th").join(counted, F.col("k").eqNullSafe(F.col("nk")) & (F.col("th") == F.col("nth")))
    every = every.join(spans, F.col("k").eqNullSafe(F.col("pk")) & (F.col("th") == F.col("pth")), "left")
    every = every.join(own, F.col("k").eqNullSafe(F.col("ik")) & (F.col("th") == F.col("ith")), "left")
    return every.select(
        F.col("k").alias(key),
        "th",
        "n_words",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<at:int,end:int>>")).alias("spans"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """The rows of ``docs`` without any hit. Texts are not shuffled where few have one."""
    found = materialise(_hits(docs, items, text, key, item)[2].select("k", "th").distinct(), "contaminated")
    rows = numbered(docs)
    own = lambda name: F.col(f"c{docs.columns.index(name)}")
    same = own(key).eqNullSafe(F.col("k")) & (F.xxhash64(F.coalesce(own(text), F.lit(""))) == F.col("th"))
    return rows.join(_bounded(found), same, "left_anti").toDF(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), hit AS (
  SELECT DISTINCT doc_id, item, size, i FROM dw JOIN bw USING (size, win)
), n AS (
  SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, size, i FROM hit)) GROUP BY doc_id
), it AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
