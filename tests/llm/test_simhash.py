import random

import numpy as np
import pytest
import xxhash

from panelweave.llm import simhash
from panelweave.session import table


def plain_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_lanes(text, lanes):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    out = []
    for lane in range(lanes):
        hashes = []
        for g in grams:
            x = xxhash.xxh64_intdigest(g, 42)
            if lane:
                x = (x + lane * 0x9E3779B97F4A7C15) % 2**64
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                x ^= x >> 31
            hashes.append(x)
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def plain_lane_groups(rows):
    """rows: list of (key, fingerprints of the lanes). The least key of each group, by comparing all pairs in all lanes."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    array = np.array([f for _, f in rows], np.uint64).reshape(len(rows), -1)
    for i in range(len(rows)):
        for j in np.flatnonzero((np.bitwise_count(array[i + 1 :] ^ array[i]) <= 3).any(axis=1)):
            a, b = find(i), find(i + 1 + int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, least.get(find(i))) for i, (k, _) in enumerate(rows)]


def plain_components(fps):
    """fps: list of (key, fp). The least key of each component, by comparing all pairs."""
    values = sorted({f for _, f in fps})
    array = np.array(values, np.uint64)
    root = {f: f for f in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 3):
            a, b = find(f), find(values[i + 1 + j])
            if a != b:
                root[max(a, b)] = min(a, b)
    least = {}
    for k, f in fps:
        if k is not None:
            least[find(f)] = min(k, least.get(find(f), k))
    return [(k, f"{f:016x}", least.get(find(f))) for k, f in fps]


def rows(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_fingerprint_is_the_plain_one():
    for text in ("", " \t", "A", "a b", "A B c", "a b c d", "Été É é x y z", "a " * 200, "x y z " * 30000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_query_against_all_pairs(spark, middle):
    docs = [(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in table(spark, middle, "documents").collect()]
    found = rows(simhash.op1_simhash(spark, middle))
    assert found == sorted(plain_components(docs), key=str)
    assert len({r[2] for r in found}) < len(found)


def test_lanes_are_the_plain_ones():
    for text in ("", "A", "a b", "A B c d e f", "Été É é x y z", "x y z " * 30000):
        assert simhash.lane_fingerprints(text, lanes=4) == plain_lanes(text, 4)
        assert plain_lanes(text, 1) == [plain_fingerprint(text)]


@pytest.mark.parametrize("hot_from", [20_000, 3])
def test_lanes_against_all_pairs(spark, hot_from):
    rng = random.Random(8)
    texts = []
    for _ in range(15):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))]
        for _ in range(12):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randint(0, 3)):
                copy[at] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(copy))
    texts += ["", None, " ", "a", "a"] + [" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(100)]
    rng.shuffle(texts)
    docs = [(None if i % 50 == 49 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = plain_lane_groups([(k, plain_lanes(t or "", 4)) for k, t in docs])
    found = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df, lanes=4, hot_from=hot_from).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    single = {c for _, _, c in plain_components([(k, plain_fingerprint(t or "")) for k, t in docs])}
    assert len({c for _, c in want}) < len(single)
    kept = {r["doc_id"] for r in simhash.deduplicate(df, lanes=4, hot_from=hot_from).collect()}
    assert kept == {c for _, c in want}


@pytest.mark.parametrize("hot_from", [20_000, 3])
def test_components_of_crowded_segments(spark, hot_from):
    rng = random.Random(5)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    half = rng.getrandbits(32) << 32
    fps |= {half | rng.getrandbits(32) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)} | {0}
    keyed = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(k, int(np.uint64(f).view(np.int64))) for k, f in keyed], "k long, fp long")
    roots = {r["fp"] % 2**64: r["root"] for r in simhash.components(df.select("fp"), hot_from=hot_from).collect()}
    groups = {}
    for k, f in keyed:
        groups.setdefault(roots.get(f, ("alone", f)), []).append(k)
    plain = {}
    for k, _, c in plain_components(keyed):
        plain.setdefault(c, []).append(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_large_variant_is_cut():
    rng = random.Random(1)
    fps = np.array(sorted({(7 << 32) | rng.getrandbits(14) << 8 for _ in range(3000)}), np.uint64)
    whole = simhash.stars(*simhash.forest(fps))
    cut = simhash.stars(*simhash.run_links(0, fps, direct=100))
    assert sorted(zip(*map(list, whole))) == sorted(zip(*map(list, cut)))


def test_nulls_copies_and_clashing_columns(spark):
    schema = "doc_id long, text string, fp string, root string"
    docs = spark.createDataFrame([(5, None, "x", "r"), (3, "", "x", "r"), (None, " ", "x", "r"), (9, "a b c d", "x", "r"), (9, "a b c d", "x", "r"), (None, "q r s t u v", "x", "r")], schema)
    keyed = [(5, 0), (3, 0), (None, 0), (9, plain_fingerprint("a b c d")), (9, plain_fingerprint("a b c d")), (None, plain_fingerprint("q r s t u v"))]
    assert rows(simhash.near_duplicates(docs)) == sorted(plain_components(keyed), key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
