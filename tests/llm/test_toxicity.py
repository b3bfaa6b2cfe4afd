import random
import zlib

from panelweave.llm import toxicity
from panelweave.session import table


def plain_segments(scores):
    """All maximal scoring segments by definition: the best segment, then the same on either side of it."""
    if not scores or max(scores) <= 0:
        return []
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if best is None or total > best[2] + 1e-9:
                best = (i, j, total)
    a, b, _ = best
    left, right = plain_segments(scores[:a]), plain_segments(scores[b + 1 :])
    return left + [best] + [(x + b + 1, y + b + 1, s) for x, y, s in right]


def test_segments_by_definition():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-0.5] * 5 + [0.7, 1.9, 3.1]) for _ in range(rng.randint(0, 25))]
        at = [i for i, s in enumerate(scores) if s > 0]
        found = toxicity.maximal_segments(at, [scores[i] for i in at], 0.5)
        want = plain_segments(scores)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(found, want))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, folder).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect()}
    assert len(found) == table(spark, folder, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found.values())
    held = [(found[k]["predicted"], y) for k, y in labels.items() if k in found and found[k]["held_out"]]
    hits = sum(p and y for p, y in held)
    assert hits >= 0.9 * sum(y for _, y in held)
    assert hits >= 0.97 * sum(p for p, _ in held)


def test_labels_of_held_out_rows_do_not_matter(spark, small):
    from pyspark.sql import functions as F

    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, other)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "a b " * 20000, "z")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, None), (77, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (toxicity.fit(docs, labels), toxicity.fit(docs, labels.limit(0)), toxicity.fit(docs.limit(0), labels), toxicity.Model(tokens={"b": 2.0}, slope=1.0)):
        out = toxicity.score(docs, model).collect()
        assert len(out) == 4 and all(0 <= r["toxicity"] <= 1 for r in out) and out[0]["toxicity"] == out[1]["toxicity"]
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_query_against_plain_python(spark):
    """Counts, log-odds, extreme-value law, curve and scores of the whole table, with loops; segments by definition."""
    import hashlib
    import math
    from collections import Counter

    import numpy as np
    import regex

    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, folder, "documents").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect() if r["toxic"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    chosen = sorted(labels, key=lambda k: hashlib.md5(str(k).encode()).hexdigest())[: toxicity.TRAIN_DOCS]
    sample = [(docs[k], labels[k]) for k in chosen if k in docs]

    occurrences = set()
    for text, y in sample:
        words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
        for i, w in enumerate(words):
            near = tuple(x for x in (words[i - 1] if i else None, words[i + 1] if i + 1 < len(words) else None) if x is not None)
            occurrences.add((y, w, near))
    counts = Counter((y, token) for y, w, _ in occurrences for token in [w, *[w[:n] + "*" for n in (4, 5, 6) if len(w) > n]])
    t1, t0 = sum(y for y, *_ in occurrences), sum(1 - y for y, *_ in occurrences)
    weight, scored = 0.02 * (t1 + t0), {}
    for token in {t for _, t in counts}:
        n1, n0 = counts[1, token], counts[0, token]
        prior = weight * (n1 + n0) / (t1 + t0)
        odds = math.log((n1 + prior) / (t1 + weight - n1 - prior)) - math.log((n0 + prior) / (t0 + weight - n0 - prior))
        z = odds / math.sqrt(1 / (n1 + prior) + 1 / (n0 + prior))
        if n1 >= 5 and z >= 2 and odds >= 1.5:
            scored[token] = (z, min(odds, 6.0))
    tokens = {t: scored[t][1] for t in sorted(scored, key=lambda t: (-scored[t][0], t))[: toxicity.TOKENS]}
    assert tokens

    def word(w):
        return max([0.0, tokens.get(w, 0.0), *[tokens.get(w[:n] + "*", 0.0) for n in (4, 5, 6) if len(w) > n]])

    def places(text):
        return [word(w) for w in regex.findall(r"[^\W_]+", text.lower())]

    texts = [(y, places(t)) for t, y in sample]
    words, hits = ([1.0 + sum(len(s) for y, s in texts if y == c) for c in (0, 1)], [1.0 + sum(sum(x > 0 for x in s) for y, s in texts if y == c) for c in (0, 1)])
    share = [min(0.9, h / w) for h, w in zip(hits, words)]
    cost = max(0.02, math.log((1 - share[0]) / (1 - share[1])) if share[1] > share[0] else 0.02)
    clean = Counter(round(x, 3) for y, s in texts if not y for x in s if x > 0)
    none = max(1.0, words[0] - sum(clean.values()))
    total = none + sum(clean.values())
    law = lambda rate: (none * math.exp(-rate * cost) + sum(n * math.exp(rate * x) for x, n in clean.items())) / total
    if not clean or sum(n * x for x, n in clean.items()) - none * cost >= 0:
        rate = 0.5
    else:
        low, high = 1e-6, 1.0
        while law(high) < 1 and high < 64:
            high *= 2
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if law(middle) < 1 else (low, middle)
        rate = high

    def segments(scores):
        """Maximal segments by definition, where far places without score cannot matter to one another."""
        at = [i for i, x in enumerate(scores) if x > 0]
        out, group = [], []
        bound = max(tokens.values())
        for i in at:  # a gap that costs more than all scores before it splits the text
            if group and cost * (i - group[-1]) > bound * len(group):
                out += [(a + group[0], b + group[0], s) for a, b, s in plain_segments([scores[k] or -cost for k in range(group[0], group[-1] + 1)])]
                group = []
            group.append(i)
        if group:
            out += [(a + group[0], b + group[0], s) for a, b, s in plain_segments([scores[k] or -cost for k in range(group[0], group[-1] + 1)])]
        return out

    found = [(y, len(s), segments(s)) for y, s in texts]
    best = sorted(rate * max(x[2] for x in segs) - math.log(max(n, 1)) for y, n, segs in found if not y and segs)
    k = 1.0
    if best:
        level = best[len(best) // 2]
        above = sum(b >= level for b in best) / sum(1 for y, *_ in found if not y)
        k = min(10.0, max(1e-3, -math.log(max(1e-9, 1 - min(above, 0.999))) * math.exp(level)))
    evidence = lambda n, segs: sum(max(0.0, math.log(0.5) - math.log(k * max(n, 1)) + rate * s) for _, _, s in segs)
    x = np.array([math.log1p(evidence(n, segs)) for _, n, segs in found])
    y = np.array([float(y) for y, *_ in found])
    a = b = 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a + b * x)))
        w = p * (1 - p) + 1e-9
        step = np.linalg.solve([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]], [(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 1e-3 * b])
        a, b = a + step[0], b + step[1]
    rows = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, folder).collect()}
    assert set(rows) == set(docs)
    for key, text in docs.items():
        scores = places(text)
        own = segments(scores)
        want = 1 / (1 + math.exp(-(a + b * math.log1p(evidence(len(scores), own)))))
        assert abs(rows[key]["score"] - want) < 1e-4, key
        assert rows[key]["n_passages"] == sum(math.log(0.5) - math.log(k * max(len(scores), 1)) + rate * s > 0 for _, _, s in own)
