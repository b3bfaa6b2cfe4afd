"""Quality rules: a threshold table compiled into Spark projections.

Counts of words, symbols, lines, stop words and repeated five-word windows come
from built-in functions only; the table of rules is compiled into one boolean
expression over them. Rules compare integers (``100 * count > limit * base``),
so no rounding decides. There is no shuffle: each row is judged by itself.

Null text: no word, hence rejected by the base rule. Empty texts likewise. A text
of any length is counted whole; a count that ties with its limit breaks no rule.
Repeated rows are judged alike, extra columns of any name are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelweave.session import table

#: Frequent function words of the four languages of the corpus, in lower case.
STOP_WORDS = tuple(
    "the of and to in a is that for it was on with as be by this at from are or an "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "le la de et les des que du en un une est dans qui par pour au sur il ce "
    "el los y del se las por con no su para al lo como más o pero sus".split()
)


@dataclass(frozen=True)
class Rule:
    """Reject where ``100 * count`` is above (or below) ``percent * base`` and there are ``least`` words at least."""

    name: str
    count: str
    base: str
    percent: int
    above: bool = True
    least: int = 0


#: The threshold table.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 25),
    Rule("long_words", "word_chars", "n_words", 1500),
    Rule("short_words", "word_chars", "n_words", 200, above=False),
    Rule("stop_words", "n_stop_words", "n_words", 2, above=False, least=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 50),
)

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def compile_rules(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """One boolean column per rule, true where the row breaks it."""
    out = {}
    for r in rules:
        have, limit = 100 * F.col(r.count), r.percent * F.col(r.base)
        broken = have > limit if r.above else have < limit
        out[r.name] = broken & (F.col("n_words") >= r.least) if r.least else broken
    return out


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts that rules may use, beside the columns in ``keep`` (a count takes the place of a column of its name)."""
    words = F.regexp_extract_all("t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("row")
    step = docs.select(held, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).select(
        "row",
        words.alias("w"),
        lines.alias("l"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    counts = ("n_words", "n_lines", "word_chars", "n_symbols", "n_stop_words", "n_dup_lines")
    step = step.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.size("l").cast("long").alias("n_lines"),
        "word_chars",
        "n_symbols",
        F.size(F.filter("w", lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # a window is known by the hash of its words' hashes; only texts in which a hash comes twice are sorted
    hashes = F.transform(
        F.slice("h", 1, F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)]),
    )
    step = step.select("row", *counts, hashes.alias("g"))
    ordered = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    step = step.select("row", *counts, F.when(F.size(F.array_distinct("g")) < F.size("g"), ordered).alias("s"))
    twice = F.filter("s", lambda e, j: (e.x == F.get("s", j - 1).x) | (e.x == F.get("s", j + 1).x))
    step = step.select("row", *counts, F.sort_array(F.transform(twice, lambda e: e.i)).alias("p"))
    covered = F.aggregate(
        F.transform("p", lambda at, j: F.least(F.lit(WINDOW), F.coalesce(F.get("p", j + 1) - at, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    results = [*counts, "n_repeat_words"]
    step = step.select("row", *counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return step.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(keep) if c not in results], *results)


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``base_failed``, one ``broke_<rule>`` per rule and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    broken = compile_rules(rules)
    none = reduce(lambda a, b: a & b, [~x for x in broken.values()], F.lit(True))
    return measured.withColumns({"base_failed": base} | {f"broke_{k}": v for k, v in broken.items()} | {"kept": ~base & none})


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(measure(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    checks = []
    for r in RULES:
        broken = f"100 * {r.count} {'>' if r.above else '<'} {r.percent} * {r.base}"
        checks.append(f"NOT ({broken}" + (f" AND n_words >= {r.least})" if r.least else ")"))
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), c AS (
  SELECT doc_id, words, CAST(len(words) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(words, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words
  FROM w
), g AS (
  SELECT doc_id, i, words[i:i + 4] AS win
  FROM (SELECT doc_id, words, unnest(range(1, greatest(n_words - 3, 1))) AS i FROM c)
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1
), r AS (
  SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id
), m AS (
  SELECT c.*, coalesce(r.n, 0) AS n_repeat_words FROM c LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(checks)} AS kept
FROM b
"""


SQL = _sql()
