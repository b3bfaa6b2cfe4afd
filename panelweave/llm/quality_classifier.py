"""Quality classifier from weak labels.

Several heuristics vote on every text: good, bad, or nothing. No one knows their
accuracies; expectation-maximisation (Dawid and Skene) finds them, and the
posterior of each text, from how often the votes agree. The whole corpus is
counted, as a table of vote patterns whose size the number of heuristics bounds.
The posteriors then label a bounded sample (``TRAIN_DOCS`` texts and
``TRAIN_FEATURES`` features of them, by digest of the id) on which a linear scorer
over hashed words and word shapes is trained; it scores every text whole. No gold
label is used anywhere.

Defined results: null and empty texts get no vote but that of length, and the
score of the intercept; a text of any length is measured and scored whole; a vote
that ties with its threshold is cast; repeated rows score alike; extra columns of
any name do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.llm.common import arrow_map, strings
from panelweave.llm.quality_rules import STOP_WORDS
from panelweave.session import materialise, table

TRAIN_DOCS, TRAIN_FEATURES, DIMENSIONS, CACHE_ENTRIES = 6_000, 4_000_000, 1 << 15, 200_000
KEEP_FROM = 0.5

_STOP = frozenset(STOP_WORDS)

#: Name; value at or above (or below) which it votes bad, and good; least number of words.
VOTERS = (
    ("symbols", 0.25, 0.05, 1),
    ("stop_words", 0.03, 0.10, 20),
    ("capitals", 0.60, 0.20, 8),
    ("distinct_words", 0.15, 0.30, 40),
    ("same_neighbours", 0.20, 0.02, 5),
    ("repeated_lines", 0.50, 0.20, 10),
    ("clean_ends", 0.60, 0.75, 5),
    ("length", 0.0, 30.0, 0),
)
_LOW_IS_BAD = {"stop_words", "distinct_words", "clean_ends", "length"}


def measures(text: str) -> dict[str, float]:
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    per = 1 / n if n else 0.0
    return {
        "symbols": sum(map(text.count, "#*$%&|<>")) * per,
        "stop_words": sum(map(_STOP.__contains__, words)) * per,
        "capitals": sum(map(str.isupper, words)) * per,
        "distinct_words": len(set(words)) * per,
        "same_neighbours": sum(map(str.__eq__, words, words[1:])) * per,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "clean_ends": sum(w.rstrip(".,;:").isalnum() for w in words) * per,
        "length": float(n),
    }


def votes(text: str) -> int:
    """The pattern of votes as one number: a digit to the base 3 for each voter (0 nothing, 1 bad, 2 good)."""
    found, pattern = measures(text), 0
    for name, bad, good, least in VOTERS:
        value, vote = found[name], 0
        if found["length"] >= least:
            sign = -1 if name in _LOW_IS_BAD else 1
            vote = 1 if sign * value >= sign * bad else 2 if sign * value <= sign * good else 0
        pattern = pattern * 3 + vote
    return pattern


#: Prior of EM: a heuristic rarely calls a good text bad. Share of such votes, and weight of the prior against all texts.
FALSE_ALARM, PRIOR_WEIGHT = 0.002, 0.2


def posteriors(counts: dict[int, int], voters: int = len(VOTERS), rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """Probability of good per pattern, ``P(good vote | class, voted)`` per voter, and the share of good texts, by EM.

    A voter that abstains says nothing: only votes that were cast enter.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, np.full((voters, 2), 0.5), 0.5
    digits = np.array([[p // 3 ** (voters - 1 - k) % 3 for k in range(voters)] for p in patterns])
    weight = np.array([counts[p] for p in patterns], float)
    good, bad = digits == 2, digits == 1
    q = np.clip((good.sum(1) + 1) / (good.sum(1) + 8 * bad.sum(1) + 1.5), 0.02, 0.98)
    share, prior = np.full((voters, 2), 0.5), 0.5
    extra = PRIOR_WEIGHT * weight.sum()
    for _ in range(rounds):
        prior = float((weight * q).sum() + 1) / float(weight.sum() + 2)
        for c, r in enumerate((1 - q, q)):
            yes, no = (weight * r) @ good, (weight * r) @ bad
            share[:, c] = (yes + extra * (1 - FALSE_ALARM)) / (yes + no + extra) if c else (yes + 0.5) / (yes + no + 1)
        odds = math.log(prior / (1 - prior)) + good @ np.log(share[:, 1] / share[:, 0]) + bad @ np.log((1 - share[:, 1]) / (1 - share[:, 0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return dict(zip(patterns, q.tolist())), share, prior


def shape(word: str) -> str:
    """The word with runs of letters as A, a, or Aa, and runs of digits as 0; runs of other characters lose repeats."""
    letters = re.sub(r"[^\W\d_]+", lambda m: "A" if m.group().isupper() else "a" if m.group().islower() else "Aa", word)
    return re.sub(r"([^\w])\1+", r"\1", re.sub(r"\d+", "0", letters))


def features(word: str) -> tuple[int, int]:
    """Places of a word and of its shape."""
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % DIMENSIONS, zlib.crc32(b"\x00" + shape(word).encode("utf-8", "surrogatepass")) % DIMENSIONS


SAME = zlib.crc32(b"\x01same") % DIMENSIONS


@dataclass
class Scorer:
    """Weights of hashed features, relative to the number of words, and an intercept."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS))
    intercept: float = 0.0
    _cache: dict[str, float] = field(default_factory=dict, repr=False)

    def score(self, text: str) -> float:
        words = text.split()
        total = self.intercept
        if words:
            cache = self._cache
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            out = list(map(cache.get, words))
            if None in out:
                for i, x in enumerate(out):
                    if x is None:
                        a, b = features(words[i])
                        out[i] = cache[words[i]] = float(self.weights[a] + self.weights[b])
            same = sum(map(str.__eq__, words, words[1:]))
            total += (math.fsum(out) + same * float(self.weights[SAME])) / len(words)
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, total))))


def train(rows: list[tuple[list[int], list[int], int, float]], rounds: int = 300, rate: float = 2.0, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on ``places, counts, words, target`` by accelerated full gradients (Adagrad)."""
    if not rows:
        return Scorer()
    at = np.concatenate([np.array(p, np.int64) for p, *_ in rows])
    value = np.concatenate([np.array(c, float) / max(1, n) for _, c, n, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(p) for p, *_ in rows])
    y = np.array([t for *_, t in rows])
    base = min(0.999, max(0.001, float(y.mean())))
    scorer = Scorer(np.zeros(DIMENSIONS), math.log(base / (1 - base)))
    w, b = scorer.weights, scorer.intercept
    seen, seen_b = np.full(DIMENSIONS, 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(owner, weights=value * w[at], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(rows)
        gradient = np.bincount(at, weights=value * error[owner], minlength=DIMENSIONS) + ridge * w / len(rows)
        seen += gradient**2
        w -= rate * gradient / np.sqrt(seen)
        g = error.sum()
        seen_b += g * g
        b -= 0.1 * g / math.sqrt(seen_b)
    scorer.intercept = float(b)
    return scorer


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TRAIN_DOCS, features_most: int = TRAIN_FEATURES) -> tuple[Scorer, dict[int, float]]:
    """The scorer, and the posterior of each vote pattern.

    The driver gets the patterns (3 ** voters at most), and ``features_most`` features
    of 8 bytes at most: texts enter in the order of their ids' digests until either
    bound is reached (at least one, which has ``2 * DIMENSIONS`` at most).
    """
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(map(votes, strings(batch.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    patterns = arrow_map(docs.select("text"), vote, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    good, _, _ = posteriors({r["pattern"]: r["n"] for r in patterns})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64())
        for batch in batches:
            rows = []
            for digest, x in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                words = x.split()
                seen = Counter(p for w in words for p in features(w))
                seen[SAME] += sum(map(str.__eq__, words, words[1:]))
                places = sorted(seen)
                packed = (np.array(v, "<i4").tobytes() for v in (places, [seen[p] for p in places]))
                rows.append((digest, *packed, len(places), len(words), good[votes(x)]))
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "places", "counts", "size", "n", "target"])

    # ids first, so that texts are only read for the sample
    digest = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))
    ids = docs.select("key").distinct().select("key", digest.alias("digest"), F.col("key").isNull().alias("missing")).orderBy("digest", "missing", "key").limit(limit)
    ids = F.broadcast(ids.select(F.col("key").alias("k"), "digest"))
    sample = docs.join(ids, F.col("key").eqNullSafe(F.col("k"))).groupBy("digest", "k").agg(F.min("text").alias("t")).select("digest", "t")
    schema = "digest string, places binary, counts binary, size bigint, n bigint, target double"
    described = materialise(arrow_map(sample, describe, schema), "features")
    sizes = sorted(map(tuple, described.select("digest", "size").collect()))  # ``limit`` rows at most
    total = np.cumsum([size for _, size in sizes])
    last = sizes[max(0, int(np.searchsorted(total, features_most, "right")) - 1)][0] if sizes else ""
    rows = sorted(described.where(F.col("digest") <= last).drop("size").collect(), key=lambda r: (r["digest"], r["n"]))
    return train([(np.frombuffer(r["places"], "<i4"), np.frombuffer(r["counts"], "<i4"), r["n"], r["target"]) for r in rows]), good


def classify(docs: DataFrame, scorer: Scorer, good: dict[int, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``score`` (0 to 1), ``weak_label`` (posterior of its votes), ``kept``. A narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            scores = [scorer.score(x) for x in texts]
            weak = [good.get(votes(x), 0.5) for x in texts]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array(weak, pa.float64()), pa.array([s >= KEEP_FROM for s in scores], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "score", "weak_label", "kept"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"))
    return arrow_map(rows, run, f"key {docs.schema[key].dataType.simpleString()}, score double, weak_label double, kept boolean").toDF(key, "score", "weak_label", "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, *fit(docs))
