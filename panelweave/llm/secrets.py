"""Secret scans, with built-in functions only.

Three patterns give the base spans. The method adds runs of key characters that
look random: two character Markov models (order one), of random strings and of
ordinary identifiers, are trained from labelled samples, and a run whose
log-likelihood ratio is high enough is a span of kind ``markov``.

Labelled samples: random are the values that the patterns find in a bounded
sample of documents (``SAMPLE_DOCS``, by the digest of their id), and digests
made here (``SYNTHETIC``); ordinary are all other runs of the sample. What is
fitted is one table of 67 x 67 integers (thousandths of a nat), whatever the
size of the corpus; scanning covers every text whole.

Positions are code points: ``\\G.*?pattern`` cuts a text into pieces that end with
a match each, so ends are running sums of lengths. Each pattern is one pass; running
sums, the meeting of runs with base spans (running greatest end, running least
start), a run's ratio and the cutting of a text at its spans all cost time in
proportion to the text and its matches (and the sorting of the matches).

Defined results: null text is empty and has no span; a text of any length is scanned
whole, also one that is a single run; spans that tie in start are in the order of
their kinds; repeated rows are scanned each; extra columns of any name pass through
untouched; on an empty table the models rest on the made digests.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelweave.session import materialise, table

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Kind, pattern. Runs of hexadecimal digits and AKIA keys are maximal, so their least length may stand in the pattern.
PATTERNS = (("assign", _ASSIGN), ("access", r"AKIA[A-Z0-9]{16,}"), ("hex", r"[0-9a-f]{24,}"))
LEAST_VALUE = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KIND = "markov"

#: A run is judged if it has so many characters, with a letter and a digit. It is a span from this ratio on, in thousandths of a nat, in all and a character.
LEAST_RUN, LEAST_RATIO, LEAST_MEAN = 16, 12_000, 500
RUN = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"

SAMPLE_DOCS, SYNTHETIC = 5_000, 1_000


#: Elements of an array whose running values are made at once, and code points of a text that are one element.
BLOCK, TEXT_BLOCK = 256, 1024


def running(df: DataFrame, zero: Column, step, **arrays: str) -> DataFrame:
    """``df`` with running values (inclusive) of integer array columns: ``new=old``, ``step`` being associative.

    Appending to an array copies it, so values are made block by block, and what
    comes before a block is added to it. The arrays are columns of the plan before,
    referred to more than once: so the optimizer does not put them into a lambda.
    """
    none = F.array().cast("array<int>")

    def blocks(old: str) -> Column:
        one = lambda at: F.aggregate(F.slice(old, at, BLOCK), none, lambda seen, x: F.concat(seen, F.array(step(F.coalesce(F.try_element_at(seen, F.lit(-1)), zero), x))))
        return F.when(F.size(old) > 0, F.transform(F.sequence(F.lit(1), F.size(old), F.lit(BLOCK)), one)).otherwise(F.array().cast("array<array<int>>"))

    def whole(new: str) -> Column:
        before = F.aggregate(f"{new}_blocks", F.array(zero), lambda seen, b: F.concat(seen, F.array(step(F.element_at(seen, -1), F.element_at(b, -1)))))
        both = F.arrays_zip(F.slice(before, 1, F.size(f"{new}_blocks")).alias("before"), F.col(f"{new}_blocks").alias("block"))
        return F.flatten(F.transform(both, lambda z: F.transform(z["block"], lambda x: step(z["before"], x))))

    names = df.columns
    df = df.select(*names, *[blocks(old).alias(f"{new}_blocks") for new, old in arrays.items()])
    return df.select(*names, *[whole(new).alias(new) for new in arrays])


def _pieces(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{pattern})"), F.lit(0))


def _ends(df: DataFrame, *pieces: str) -> DataFrame:
    """Ends of the pieces in the text: running sums of their lengths."""
    names = df.columns
    df = df.select(*names, *[F.transform(p, lambda x: F.length(x)).alias(f"{p}_size") for p in pieces])
    return running(df, F.lit(0), lambda x, y: x + y, **{f"{p}_end": f"{p}_size" for p in pieces}).drop(*[f"{p}_size" for p in pieces])


def _placed(pieces: str, pattern: str, rank: int) -> Column:
    """Structs ``start, rank, end, value`` of the matches that end the pieces."""

    def one(z: Column) -> Column:
        match = F.regexp_extract(z["piece"], pattern, 0)
        value = F.regexp_extract(z["piece"], pattern, 1) if rank == 0 else match
        return F.struct((z["end"] - F.length(match)).alias("start"), F.lit(rank).alias("rank"), z["end"].alias("end"), value.alias("value"))

    spans = F.transform(F.arrays_zip(F.col(pieces).alias("piece"), F.col(f"{pieces}_end").alias("end")), one)
    return F.filter(spans, lambda s: F.length(s["value"]) >= LEAST_VALUE) if rank == 0 else spans


def _held(docs: DataFrame, text: str) -> DataFrame:
    """``row`` (all columns) and ``t`` (the text, null: empty): names that no column of ``docs`` can clash with."""
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return own.select(F.struct(*own.columns).alias("row"), F.coalesce(F.col(f"c{docs.columns.index(text)}"), F.lit("")).alias("t"))


def _base(held: DataFrame) -> DataFrame:
    """``row, t`` and ``base``: structs ``start, rank, end, value`` in order."""
    access = F.when(F.contains("t", F.lit("AKIA")), _pieces("t", PATTERNS[1][1])).otherwise(F.array().cast("array<string>"))
    step = held.select("row", "t", _pieces("t", PATTERNS[0][1]).alias("p0"), access.alias("p1"), _pieces("t", PATTERNS[2][1]).alias("p2"))
    step = _ends(step, "p0", "p1", "p2")
    return step.select("row", "t", F.sort_array(F.concat(*[_placed(f"p{k}", pattern, k) for k, (_, pattern) in enumerate(PATTERNS)])).alias("base"))


def samples(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = SAMPLE_DOCS, synthetic: int = SYNTHETIC) -> DataFrame:
    """Labelled strings, ``s`` and ``random``: of a bounded sample of documents, and made digests."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # ids first, so that no task keeps texts to choose from; an id that many rows share adds its least text
    ids = rows.select("k").distinct().orderBy(F.md5(F.coalesce(F.col("k").cast("string"), F.lit(""))), "k").limit(limit)
    chosen = rows.join(F.broadcast(ids.withColumnRenamed("k", "_k")), F.col("k").eqNullSafe(F.col("_k"))).groupBy("k").agg(F.min("text").alias("text"))
    chosen = materialise(chosen, "secrets-sample")
    found = _base(_held(chosen, "text"))
    positive = found.select(F.explode("base.value").alias("s"), F.lit(True).alias("random"))
    rest = F.col("t")
    for _, pattern in PATTERNS:
        rest = F.regexp_replace(rest, F.lit(pattern), F.lit(" "))
    ordinary = F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))
    negative = found.select(F.explode(ordinary).alias("s"), F.lit(False).alias("random"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = docs.sparkSession.range(synthetic, numPartitions=1).select(F.explode(F.array(digest, F.base64(F.unhex(digest)))).alias("s"), F.lit(True).alias("random"))
    return positive.unionByName(negative).unionByName(made)


def train(labelled: DataFrame) -> list[int]:
    """The table of log-likelihood ratios, row by row: thousandths of ln P(next | this, random) / P(next | this, ordinary)."""
    chars = labelled.where(F.length("s") >= 2).select("random", F.split("s", "").alias("a"))
    pairs = F.zip_with("a", F.slice("a", 2, F.size("a")), lambda x, y: F.concat(x, y))  # the last has no next: null
    rows = chars.select("random", F.explode(pairs).alias("pair"))
    counts = rows.groupBy("random", "pair").count().where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect()  # 2 x 67 x 67 at most
    size = len(ALPHABET)
    seen = {True: [0] * size * size, False: [0] * size * size}
    for r in counts:
        seen[r["random"]][ALPHABET.index(r["pair"][0]) * size + ALPHABET.index(r["pair"][1])] = r["count"]
    out = []
    for a in range(size):
        total = {k: sum(v[a * size : (a + 1) * size]) for k, v in seen.items()}
        for b in range(size):
            p, q = ((2 * seen[k][a * size + b] + 1) / (2 * total[k] + size) for k in (True, False))
            out.append(round(1000 * math.log(p / q)))
    return out


def _scan(docs: DataFrame, ratios: list[int], text: str) -> DataFrame:
    """``row, t, base, spans``; ``spans`` holds the base and what the models add."""
    found = _base(_held(docs, text))
    found = _ends(found.select("row", "t", "base", _pieces("t", RUN).alias("p3")), "p3")
    found = found.select("row", "t", "base", _placed("p3", RUN, 3).alias("runs"))
    # runs that meet a base span: in the order of starts, a base span before ends after the run's start, or one after starts before its end
    none = F.filter("base", lambda s: F.lit(False))
    found = found.select("row", "t", "base", F.when(F.size("runs") > 0, F.sort_array(F.concat("base", "runs"))).otherwise(none).alias("both"))
    last = F.lit(2**31 - 1)
    ends = F.transform("both", lambda s: F.when(s["rank"] < 3, s["end"]).otherwise(F.lit(0)))
    starts = F.transform(F.reverse("both"), lambda s: F.when(s["rank"] < 3, s["start"]).otherwise(last))
    found = found.select("row", "t", "base", "both", ends.alias("ends"), starts.alias("starts"))
    found = running(found, F.lit(0), lambda x, y: F.greatest(x, y), before="ends")
    found = running(found, last, lambda x, y: F.least(x, y), after="starts")
    placed = F.arrays_zip(F.col("both").alias("r"), F.col("before").alias("before"), F.reverse("after").alias("after"))
    free = F.filter(placed, lambda z: (z["r"]["rank"] == 3) & (z["before"] <= z["r"]["start"]) & (z["after"] >= z["r"]["end"]))
    size, table_of = len(ALPHABET), F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")  # one folded literal

    def ratio(s: Column) -> Column:
        places = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        start = F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("sum"))
        step = lambda a, x: F.struct(x.alias("at"), (a["sum"] + F.when(a["at"] >= 0, F.get(table_of, a["at"] * size + x)).otherwise(F.lit(0))).alias("sum"))
        return F.aggregate(places, start, step, lambda a: a["sum"])

    scored = F.transform(free, lambda z: F.struct(z["r"].alias("r"), ratio(z["r"]["value"]).alias("ratio")))
    high = F.filter(scored, lambda x: (x["ratio"] >= LEAST_RATIO) & (x["ratio"] >= LEAST_MEAN * F.length(x["r"]["value"]).cast("long")))
    return found.select("row", "t", "base", F.sort_array(F.concat("base", F.transform(high, lambda x: x["r"]))).alias("spans"))


def scan(docs: DataFrame, ratios: list[int], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, and ``base`` and ``spans`` (in place of columns of these names): structs ``start, rank, end, value``; ``spans`` holds the base and what the models add."""
    kept = [F.col("row")[f"c{docs.columns.index(c)}"].alias(c) for c in keep if c not in ("base", "spans")]
    return _scan(docs, ratios, text).select(*kept, "base", "spans")


def listed(spans: str) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k, _ in PATTERNS], F.lit(KIND))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", mark: str = "[SECRET]", ratios: list[int] | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (overlapping spans by one). Other texts stay as they are, null stays null."""
    ratios = train(samples(docs, text, key)) if ratios is None else ratios
    found = _scan(docs, ratios, text).select("row", "t", "spans", F.transform("spans", lambda s: s["end"]).alias("ends"))
    found = running(found, F.lit(0), lambda x, y: F.greatest(x, y), upto="ends")
    # the text in blocks, so that a place is found without a walk from its start
    parts = F.when(F.size("spans") > 0, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = found.select("row", "t", "spans", "upto", parts.alias("parts"))

    def piece(a: Column, b: Column) -> Column:
        first, last = F.floor(a / TEXT_BLOCK).cast("int"), F.floor(b / TEXT_BLOCK).cast("int")
        at = lambda k: F.coalesce(F.get("parts", k), F.lit(""))
        inner = F.substring(at(first), a % TEXT_BLOCK + 1, b - a)
        middle = F.array_join(F.slice("parts", first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        outer = F.concat(F.substring(at(first), a % TEXT_BLOCK + 1, F.lit(TEXT_BLOCK)), middle, F.substring(at(last), F.lit(1), b % TEXT_BLOCK))
        return F.when(first == last, inner).otherwise(outer)

    before = F.slice(F.concat(F.array(F.lit(0)), "upto"), 1, F.size("upto"))
    spans = F.arrays_zip(F.col("spans").alias("s"), before.alias("before"))
    cut = F.transform(spans, lambda z: F.when(z["s"]["start"] >= z["before"], F.concat(piece(z["before"], z["s"]["start"]), F.lit(mark))).otherwise(F.lit("")))
    clean = F.concat(F.array_join(cut, ""), piece(F.element_at("upto", -1), F.length("t")))
    at = docs.columns.index(text)
    clean = F.when(F.size("spans") > 0, clean).otherwise(F.col("row")[f"c{at}"])
    found = found.select("row", clean.alias("clean"))
    return found.select(*[F.col("clean") if i == at else F.col("row")[f"c{i}"] for i in range(len(docs.columns))]).toDF(*docs.columns)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(samples(docs)))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, (kind, _) in enumerate(PATTERNS)],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
