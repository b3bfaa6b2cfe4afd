import random

import pytest

from panelweave.llm import substring_dedup
from panelweave.llm.substring_dedup import remove_repeats


def plain(docs, window):
    """docs: (key, text). What stays of each, by comparing all windows."""
    split = [(k, (t or "").encode().split()) for k, t in docs]
    order = lambda k: float("inf") if k is None else k
    least = {}
    for k, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, (float("inf"), float("inf"))), (order(k), i))
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (order(k), i):
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((k, len(w), len(gone), kept))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [200, 8 << 20])
def test_against_all_windows(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    rng = random.Random(chunk)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 40))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice("abcé") + str(rng.randint(0, 4)) for _ in range(rng.randint(0, 30))) for _ in range(4)]
        docs.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    docs += [(100, "x " * 700), (101, "x " * 700 + "y"), (102, None), (103, ""), (104, " \n"), (None, "x " * 30), (7, docs[3][1]), (7, docs[3][1])]
    df = spark.createDataFrame([(k, t, "z", 1) for k, t in docs], "doc_id long, text string, k string, spans int").repartition(3)
    assert found(remove_repeats(df, window=5, gram=2)) == plain(docs, 5)


def test_equal_hashes_are_told_apart():
    import numpy as np

    words = substring_dedup.Words(b"a b c a b d a b c ", np.array([9]))
    words.grams = lambda size: np.zeros(9 - size + 1, np.uint64)
    at = words.windows(3)
    later = substring_dedup.earliest(words, at, (np.zeros(len(at), np.int64), at), 3)
    assert list(at[later]) == [6]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).collect() == []


def test_one_phrase_in_all_texts_fills_no_bucket():
    """One gram ten times in each of 3,000 texts, no window twice: its windows go by rarer grams."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    # a phrase whose hash is so low that by hash alone it is the minimiser wherever it stands
    low = next(w for i in range(10**6) if substring_dedup.Words(f"the same four {(w := f'words{i}')} ".encode(), np.array([4])).grams(4)[0] < np.uint64(2**64 // 2000))
    texts = []
    for i in range(3000):
        words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        for at in range(10):
            words[at * 30 + 5 : at * 30 + 9] = ["the", "same", "four", low]
        texts.append(" ".join(words))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(range(3000), pa.int64()), pa.array(texts)], ["k", "th", "t"])
    (counts,) = substring_dedup._counted(1 << 16, 20, 4)(iter([batch]))
    cells = np.zeros(1 << 16, np.int64)
    cells[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    levels = substring_dedup.rarity_levels(cells)

    def sizes(levels):
        out = {}
        for part in substring_dedup._split(400, 20, 4, 64, levels)(iter([batch])):
            for bucket, kind, blob in zip(*(part.column(i).to_pylist() for i in range(3))):
                columns, _ = substring_dedup._unpack(blob, 4)
                out[bucket] = out.get(bucket, 0) + int((columns[3] - 19).sum())
        return out

    def most(found):
        assert sum(found.values()) == 3000 * 281
        return max(found.values()) / np.median(list(found.values()))

    assert most(sizes(None)) > 50 and most(sizes(levels)) < 2


@pytest.mark.parametrize("kind", ["long", "string", "int"])
def test_thinned_buckets_ids_and_long_texts(spark, monkeypatch, kind):
    """Buckets thinned out all the time, ids that are no long integers, a text of 60,000 words, columns with the names used inside."""
    monkeypatch.setattr(substring_dedup, "THIN_BYTES", 50)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 300)
    monkeypatch.setattr(substring_dedup, "SAMPLE_BYTES", 100)
    rng = random.Random(3)
    shared = [" ".join(rng.choice("abcd") for _ in range(40)) for _ in range(3)]
    texts = [" ".join(rng.choice(shared) if rng.random() < 0.6 else " ".join(rng.choice("efgh") for _ in range(12)) for _ in range(4)) for _ in range(40)]
    texts.append(" ".join(f"{i % 977} {i % 13}" for i in range(30_000)))
    ids = [i * 7 % 41 for i in range(41)] if kind != "string" else [f"id {i * 7 % 41}" for i in range(41)]
    df = spark.createDataFrame([(k, t, 1, "x", 2, 3) for k, t in zip(ids, texts)], f"doc_id {kind}, text string, k int, t string, th int, ranked int").repartition(2)
    rank = {k: i for i, k in enumerate(sorted(ids))}
    want = sorted((rank[k], n, gone, kept) for (i, n, gone, kept), k in ((r, sorted(ids)[r[0]]) for r in plain([(rank[k], t) for k, t in zip(ids, texts)], 6)))
    got = sorted((rank[k], n, gone, kept) for k, n, gone, kept in found(remove_repeats(df, window=6, gram=2)))
    assert got == want and sum(r[2] for r in got)
