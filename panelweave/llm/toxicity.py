"""Toxicity: maximal scoring segments over token log-odds.

Tokens are the words and the first four, five and six characters of longer ones.
Their log-odds between toxic and other labelled texts are smoothed by an
informative Dirichlet prior (the frequencies in both together); only tokens whose
log-odds are significant score, every other word costs the same small amount. A
linear scan (Ruzzo and Tompa) finds all maximal scoring segments of a text. In a
random sequence the best segment follows an extreme-value law, so each segment
has an expected number of equals by chance, ``K * n * exp(-lambda * S)``; those
below ``CHANCE`` are toxic passages, and what they exceed chance by adds up to the
text's evidence. A logistic curve over the evidence gives the score.

Fitted on a bounded sample: ``TRAIN_DOCS`` labelled texts at most (by digest of
the id), never from rows held out (crc32 of the id modulo 3 is 1). An occurrence
counts once per pair of neighbouring words, so copies do not count again. Labels,
language, source and id are no inputs of a score. Scoring covers every text whole
and is a narrow map.

Defined results: null and empty texts have no passage and get the score of no
evidence; a text of any length is scanned whole; of segments that tie all are
passages; repeated rows score alike, of labels that repeat for one id the greatest
counts; columns of any name pass through, but for those of the results, which are
replaced; without both labels in the sample the score is the share of toxic labels
(zero without labels).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelweave.llm.common import arrow_map, numbered, strings, with_results
from panelweave.session import materialise, table

TRAIN_DOCS, TOKENS = 8_000, 4_000
PREFIXES = (4, 5, 6)

#: Weight of the prior as a share of all words, and what makes a token's log-odds significant.
PRIOR_SHARE, LEAST_Z, LEAST_COUNT, LEAST_ODDS, MOST_ODDS = 0.02, 2.0, 5, 1.5, 6.0
CHANCE = 0.5
REJECT_FROM = 0.7

_words = re.compile(r"[^\W_]+").findall

#: Words whose score is kept by a scorer before it starts anew.
CACHE_ENTRIES = 200_000


def held_out(key: Column) -> Column:
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1


def maximal_segments(positions: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments: first and last position, score. Every place between positions costs ``cost``.

    Ruzzo and Tompa's scan over the places that score; linear, as each place is
    merged once.
    """
    begin: list[int] = []  # per candidate: first place, last place, total before it, total with it
    end: list[int] = []
    before: list[float] = []
    upto: list[float] = []
    link: list[int] = []  # candidate to the left with a smaller total before it
    total, last = 0.0, -1
    for at, score in zip(positions, scores):
        total -= cost * (at - last - 1)
        last = at
        low, total = total, total + score
        first = at
        while True:
            j = len(begin) - 1
            while j >= 0 and before[j] >= low:
                j = link[j]
            if j < 0 or upto[j] >= total:
                break
            first, low = begin[j], before[j]
            del begin[j:], end[j:], before[j:], upto[j:], link[j:]
        link.append(j)
        begin.append(first)
        end.append(at)
        before.append(low)
        upto.append(total)
    return [(a, b, u - l) for a, b, l, u in zip(begin, end, before, upto)]


@dataclass
class Model:
    """What is fitted: token scores, cost of another word, extreme-value and logistic parameters."""

    tokens: dict[str, float] = field(default_factory=dict)
    cost: float = 0.05
    rate: float = 1.0  # lambda
    k: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0
    _cache: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        """Score of a word, zero if none of its tokens scores."""
        get = self.tokens.get
        return max(get(word, 0.0), *(get(f"{word[:n]}*", 0.0) for n in PREFIXES if len(word) > n), 0.0)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and maximal segments by word position."""
        words = _words(text.lower())
        cache = self._cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        out = list(map(cache.get, words))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    w = words[i]
                    out[i] = cache[w] = self.word(w)
        at = [i for i, x in enumerate(out) if x]
        return len(words), maximal_segments(at, [out[i] for i in at], self.cost) if at else []

    def surprise(self, n: int, score: float) -> float:
        """How far, as a logarithm, the expected number of segments as good in a text of ``n`` words is below ``CHANCE``."""
        return math.log(CHANCE) - math.log(self.k * max(n, 1)) + self.rate * score

    def passages(self, n: int, segments: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        return [s for s in segments if self.surprise(n, s[2]) > 0]

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        return sum(max(0.0, self.surprise(n, s[2])) for s in segments)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, self.intercept + self.slope * math.log1p(evidence)))))


def _features(word: str) -> Column:
    return F.array_compact(F.array(F.col(word), *[F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in PREFIXES]))


def token_scores(sample: DataFrame) -> dict[str, float]:
    """Significant log-odds of a sample ``text, toxic``; ``TOKENS`` at most."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    near = F.transform(F.col("w"), lambda w, i: F.struct(w.alias("w"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("near")))
    rows = sample.select("toxic", words.alias("w")).select("toxic", F.explode(near).alias("e")).select("toxic", "e.w", "e.near").distinct()
    counts = rows.select("toxic", F.explode(_features("w")).alias("token")).groupBy("token")
    counts = counts.agg(F.sum("toxic").cast("double").alias("n1"), F.sum(1 - F.col("toxic")).cast("double").alias("n0"))
    totals = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not totals[0] or not totals[1]:
        return {}
    t1, t0 = float(totals[0]), float(totals[1])
    weight = PRIOR_SHARE * (t1 + t0)
    prior = weight * (F.col("n1") + F.col("n0")) / (t1 + t0)
    odds = lambda n, total: F.log((n + prior) / (total + weight - n - prior))
    scored = counts.where(F.col("n1") >= LEAST_COUNT).withColumn("odds", odds(F.col("n1"), t1) - odds(F.col("n0"), t0))
    scored = scored.withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior)))
    best = scored.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "token").limit(TOKENS)
    return {r["token"]: min(r["odds"], MOST_ODDS) for r in best.select("token", "odds").collect()}


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TRAIN_DOCS) -> DataFrame:
    """``text, toxic`` of at most ``limit`` labelled rows that are not held out."""
    keys = labels.select(F.col(f"`{key}`").alias("labelled"), "toxic")
    keys = keys.where(F.col("labelled").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("labelled")))
    keys = keys.groupBy("labelled").agg(F.max("toxic").cast("int").alias("toxic"))
    keys = F.broadcast(keys.orderBy(F.md5(F.col("labelled").cast("string"))).limit(limit))
    # an id that many rows share adds its text once
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(keys, F.col("k") == F.col("labelled"))
    return rows.groupBy("k").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _solve_rate(values: np.ndarray, weights: np.ndarray, cost: float) -> float:
    """The positive root of sum p(s) exp(rate * s) = 1, if the mean is negative."""
    p = weights / weights.sum()
    scores = np.where(values == 0, -cost, values)
    if (p * scores).sum() >= 0 or scores.max() <= 0:
        return 0.5
    low, high = 1e-6, 1.0
    while (p * np.exp(high * scores)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(middle * scores)).sum() < 1 else (low, middle)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a slight ridge."""
    design, beta = np.column_stack((np.ones_like(x), x)), np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        w = p * (1 - p) + 1e-9
        step = np.linalg.solve(design.T @ (design * w[:, None]) + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TRAIN_DOCS) -> Model:
    """The model of a corpus and its labels ``key, toxic``. What comes to the driver is bounded by the sample."""
    sample = materialise(training_sample(docs, labels, key, text, limit), "toxicity-sample")
    model = Model(tokens=token_scores(sample))
    shares = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not shares[0]:
        model.intercept = -60.0
        return model
    base = (shares[1] + 0.5) / (shares[0] + 1)
    model.intercept = math.log(base / (1 - base))
    if not model.tokens:
        return model
    # places that score, by label: the cost of another word is the log-odds of its kind
    bare = Model(tokens=model.tokens)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in strings(batch.column(0)):
                scores = [bare.word(w) for w in _words(text.lower())]
                at = [i for i, x in enumerate(scores) if x]
                rows.append((len(scores), at, [scores[i] for i in at]))
            n, at, scores = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["toxic", "n", "places", "scores"])

    rows = arrow_map(sample, places, "toxic int, n bigint, places array<bigint>, scores array<double>").collect()  # a row for each text of the sample
    words, hits = [1.0, 1.0], [1.0, 1.0]
    for r in rows:
        words[r["toxic"]] += r["n"]
        hits[r["toxic"]] += len(r["places"])
    share = [min(0.9, h / w) for h, w in zip(hits, words)]
    model.cost = max(0.02, math.log((1 - share[0]) / (1 - share[1])) if share[1] > share[0] else 0.02)
    clean = [s for r in rows if not r["toxic"] for s in r["scores"]]
    values, weights = np.unique(np.round(np.array([0.0, *clean]), 3), return_counts=True)
    weights = weights.astype(float)
    weights[0] = max(1.0, words[0] - len(clean))
    model.rate = _solve_rate(values, weights, model.cost)
    found = [(r["toxic"], r["n"], maximal_segments(r["places"], r["scores"], model.cost)) for r in rows]
    # K from texts that are not toxic: most have no segment at all, so by the share whose best one is above a level
    best = sorted(model.rate * max(s[2] for s in segs) - math.log(max(n, 1)) for y, n, segs in found if not y and segs)
    n_clean = sum(1 for y, _, _ in found if not y)
    if best:
        level = best[len(best) // 2]
        above = sum(b >= level for b in best) / n_clean
        model.k = min(10.0, max(1e-3, -math.log(max(1e-9, 1 - min(above, 0.999))) * math.exp(level)))
    x = np.array([math.log1p(model.evidence(n, segs)) for _, n, segs in found])
    model.intercept, model.slope = _logistic(x, np.array([float(y) for y, _, _ in found]))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``passages`` (first word, word after the last, segment score). A narrow map."""
    at, rows = docs.columns.index(text), numbered(docs)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for x in strings(batch.column(at)):
                n, segments = model.scan(x)
                scores.append(model.score(model.evidence(n, segments)))
                passages.append([{"first": a, "stop": b + 1, "score": s} for a, b, s in model.passages(n, segments)])
            arrays = [*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "toxicity", "passages"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    found = arrow_map(rows, run, f"{fields}, toxicity double, passages array<struct<first:bigint,stop:bigint,score:double>>")
    return with_results(found, docs.columns, {c: F.col(c) for c in ("toxicity", "passages")})


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = REJECT_FROM) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns and no others."""
    found = score(numbered(docs), model, f"c{docs.columns.index(text)}").where(F.col("toxicity") < threshold)
    return found.drop("toxicity", "passages").toDF(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    found = score(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= REJECT_FROM).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
