import random

import numpy as np

from panelweave.llm import quality_classifier as qc
from panelweave.session import table


def test_accuracy_on_labels_it_never_saw(spark):
    folder = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in qc.op10_quality_classifier(spark, folder).collect()}
    assert len(found) == table(spark, folder, "documents").count()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    good = [found[k]["kept"] for k, y in labels.items() if y == 1]
    bad = [found[k]["kept"] for k, y in labels.items() if y == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05


def test_em_finds_planted_accuracies():
    rng = random.Random(2)
    says_good = [(0.97, 0.1), (0.95, 0.3), (0.99, 0.4), (0.9, 0.2)]  # P(good vote | good), P(good vote | bad)
    counts, truth = {}, {}
    for _ in range(20000):
        y = rng.random() < 0.8
        pattern = 0
        for a, b in says_good:
            vote = 0 if rng.random() < 0.2 else 2 if rng.random() < (a if y else b) else 1
            pattern = pattern * 3 + vote
        counts[pattern] = counts.get(pattern, 0) + 1
        truth.setdefault(pattern, []).append(y)
    good, share, prior = qc.posteriors(counts, voters=4)
    right = sum((good[p] >= 0.5) == y for p, ys in truth.items() for y in ys)
    assert right / 20000 > 0.93 and abs(prior - 0.8) < 0.08
    assert all(abs(share[k, 1] - a) < 0.06 and share[k, 0] < 0.6 for k, (a, _) in enumerate(says_good))


def test_shapes_and_scorer():
    assert [qc.shape(w) for w in ("Hello,", "HELLO!!", "a1b22", "***", "éÈ")] == ["Aa,", "A!", "a0a0", "*", "Aa"]
    rows = [([1, 2], [3, 1], 4, 1.0), ([2, 3], [1, 3], 4, 0.0)] * 20
    s = qc.train(rows)
    assert s.weights[1] > 0 > s.weights[3]
    assert qc.train([]).score("a b") == 0.5


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (1, None, 0.1), (None, "", 0.1), (2, "the of and to a " * 9000, 0.2), (3, "x퟿ y", 0.0)], "doc_id long, text string, score double")
    out = qc.classify(docs, *qc.fit(docs)).collect()
    assert [r["doc_id"] for r in out] == [1, 1, None, 2, 3] and out[0]["score"] == out[1]["score"] == out[2]["score"]
    assert all(0 <= r["score"] <= 1 for r in out)
    assert qc.classify(docs.limit(0), *qc.fit(docs.limit(0))).collect() == []


def test_shape_of_a_long_word_is_that_of_all_of_it():
    assert qc.shape("a" * 64 + "9") == "a0" and qc.shape("A" * 64 + "b!!") == "Aa!"
    one, other = "x" * 80, "x" * 80 + "7" * 2000
    assert qc.features(one)[1] != qc.features(other)[1]
    s = qc.Scorer()
    s.weights[qc.features(other)[1]] = 3.0
    assert s.score(other) > s.score(one) == 0.5


def plain_votes(text):
    """The votes, each from the text anew."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda k: k / n if n else 0.0
    stop = set(qc.STOP_WORDS)
    values = {
        "symbols": (share(sum(c in "#*$%&|<>" for c in text)), False),
        "stop_words": (share(len([w for w in words if w in stop])), True),
        "capitals": (share(len([w for w in words if w.isupper()])), False),
        "distinct_words": (share(len(set(words))), True),
        "same_neighbours": (share(len([1 for a, b in zip(words, words[1:]) if a == b])), False),
        "repeated_lines": (1 - len(set(lines)) / len(lines) if lines else 0.0, False),
        "clean_ends": (share(len([w for w in words if w.rstrip(".,;:").isalnum()])), True),
        "length": (float(n), True),
    }
    out = []
    for name, bad, good, least in qc.VOTERS:
        value, low_is_bad = values[name]
        if n < least:
            out.append(None)
        elif low_is_bad:
            out.append(False if value <= bad else True if value >= good else None)
        else:
            out.append(False if value >= bad else True if value <= good else None)
    return tuple(out)


def plain_posteriors(voted):
    """EM text by text, with loops."""
    import math
    from collections import Counter

    counts = Counter(voted)
    total = sum(counts.values())
    q = {p: min(0.98, max(0.02, (p.count(True) + 1) / (p.count(True) + 8 * p.count(False) + 1.5))) for p in counts}
    for _ in range(200):
        prior = (sum(counts[p] * q[p] for p in counts) + 1) / (total + 2)
        rate = []
        for k in range(len(qc.VOTERS)):
            yes = [sum(counts[p] * (q[p] if c else 1 - q[p]) for p in counts if p[k] is True) for c in (0, 1)]
            no = [sum(counts[p] * (q[p] if c else 1 - q[p]) for p in counts if p[k] is False) for c in (0, 1)]
            extra = qc.PRIOR_WEIGHT * total
            rate.append(((yes[0] + 0.5) / (yes[0] + no[0] + 1), (yes[1] + extra * (1 - qc.FALSE_ALARM)) / (yes[1] + no[1] + extra)))
        new = {}
        for p in counts:
            odds = math.log(prior / (1 - prior))
            for (b, g), vote in zip(rate, p):
                if vote is not None:
                    odds += math.log(g / b) if vote else math.log((1 - g) / (1 - b))
            new[p] = 1 / (1 + math.exp(-max(-40, min(40, odds))))
        change = max(abs(new[p] - q[p]) for p in counts)
        if change < 1e-9:
            break
        q = new
    return q


def test_query_against_plain_python(spark, small):
    """Votes, posteriors, training and scores of the whole table, with loops and dictionaries."""
    import hashlib
    import math
    import zlib
    from collections import Counter

    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, small, "documents").collect()}
    voted = {k: plain_votes(t) for k, t in docs.items()}
    good = plain_posteriors(list(voted.values()))

    def features(text):
        words = text.split()
        seen = Counter()
        for w in words:
            seen[zlib.crc32(w.lower().encode()) % qc.DIMENSIONS] += 1
            seen[zlib.crc32(b"\x00" + qc.shape(w).encode()) % qc.DIMENSIONS] += 1
        seen[zlib.crc32(b"\x01same") % qc.DIMENSIONS] += sum(a == b for a, b in zip(words, words[1:]))
        return {p: c / max(1, len(words)) for p, c in seen.items()}

    order = sorted(docs, key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    data = [(features(docs[k]), good[voted[k]]) for k in order]
    base = min(0.999, max(0.001, sum(y for _, y in data) / len(data)))
    w, b, seen, seen_b = Counter(), math.log(base / (1 - base)), Counter(), 1e-8
    for _ in range(300):
        gradient, g = Counter(), 0.0
        for x, y in data:
            z = b + sum(v * w[p] for p, v in x.items())
            error = (1 / (1 + math.exp(-max(-40, min(40, z)))) - y) / len(data)
            g += error
            for p, v in x.items():
                gradient[p] += v * error
        for p in gradient:
            d = gradient[p] + 1e-4 * w[p] / len(data)
            seen[p] += d * d
            w[p] -= 2.0 * d / math.sqrt(1e-8 + seen[p])
        seen_b += g * g
        b -= 0.1 * g / math.sqrt(seen_b)
    found = {r["doc_id"]: r for r in qc.op10_quality_classifier(spark, small).collect()}
    assert set(found) == set(docs)
    for k, text in docs.items():
        z = b + sum(v * w[p] for p, v in features(text).items()) if text.split() else b
        assert abs(found[k]["weak_label"] - good[voted[k]]) < 1e-6
        assert abs(found[k]["score"] - 1 / (1 + math.exp(-max(-60, min(60, z))))) < 1e-4
        assert found[k]["kept"] == (found[k]["score"] >= 0.5)


def test_training_gathers_no_more_features_than_told(spark, small, monkeypatch):
    docs = table(spark, small, "documents")
    taken = []
    train = qc.train
    monkeypatch.setattr(qc, "train", lambda rows: taken.append([len(p) for p, *_ in rows]) or train(rows))
    qc.fit(docs, features_most=2000)
    qc.fit(docs, features_most=1)
    qc.fit(docs)
    assert 0 < sum(taken[0]) <= 2000 and len(taken[1]) == 1 and len(taken[2]) == docs.select("doc_id").distinct().count()
