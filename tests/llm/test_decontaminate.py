import random
import re

import pytest

from panelweave.llm import decontaminate
from panelweave.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=10):
    windows = {}
    for i, text in items:
        w = words(text)
        for j in range(max(1, len(w) - size + 1)):
            if w:
                windows.setdefault(tuple(w[j : j + size]), set()).add(i)
    out = []
    for k, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    found |= {str(i) for i in own if i is not None}
        out.append((k, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("broadcast", [500_000, 1])
@pytest.mark.parametrize("short", [True, False])
def test_against_all_windows(spark, monkeypatch, broadcast, short):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(9)
    vocabulary = ["the", "Of", "é", "ÉA", "x1", "日本", "b", "c", "D"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(10, 30))) for i in range(25)] + [(25, "Wholly, own-words; here"), (26, "ß"), (27, None), (28, "..."), (3, items_text := text(12)), (None, text(14))]
    if not short:
        items = [(i, t) for i, t in items if len(words(t)) >= 10 or not words(t)]
    docs = []
    for k in range(50):
        parts = [text(rng.randint(0, 20)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 10))
            parts.insert(rng.randint(0, 3), rng.choice([" ", ", ", "\n", "-"]).join(w[a : a + rng.randint(8, 14)]).upper())
        docs.append((k, " . ".join(parts)))
    docs += [(60, None), (61, ""), (None, items_text), (None, "wholly own words here"), (7, items_text), (7, items_text), (62, "a b " * 3000 + items_text), (63, "ß"), (64, items_text + " " + items_text)]
    left = spark.createDataFrame([(k, t, "z", 1) for k, t in docs], "doc_id long, text string, k string, item int")
    right = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    want = plain(docs, items)
    assert found(contamination(left, right)) == want
    clean = decontaminate.remove_contaminated(left.selectExpr("doc_id", "text", "k", "item as th", "k as c0", "k as pk"), right)
    assert clean.columns == ["doc_id", "text", "k", "th", "c0", "pk"]
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((k for k, _, hits, _ in want if not hits), key=str)


def test_a_window_of_very_many_items_and_more_windows_than_marks(spark, monkeypatch):
    """20,000 items share one window; 3,000 templated items share fingerprints: ids and windows are counted, not only marks."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 3500)
    shared = "one two three four five six seven eight nine ten"
    items = [(i, shared) for i in range(20_000)] + [(20_000 + i, f"alpha beta gamma delta epsilon zeta eta theta iota {i}") for i in range(3000)]
    docs = [(1, f"x {shared} y"), (2, "alpha beta gamma delta epsilon zeta eta theta iota 77 z"), (3, "none of it"), (4, shared.upper())]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in contamination(left, right).collect()}
    assert {k: (r["n_words"], r["n_hit"], len(r["items"])) for k, r in rows.items()} == {1: (12, 10, 20_000), 2: (11, 10, 1), 3: (3, 0, 0), 4: (10, 10, 20_000)}
    assert rows[1]["items"] == sorted(map(str, range(20_000))) and rows[2]["items"] == ["20077"]


def test_empty(spark):
    left = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    right = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert found(contamination(left, right)) == [(1, 2, 2, ["1"])]
    assert found(contamination(left, right.limit(0))) == [(1, 2, 0, [])]
    assert contamination(left.limit(0), right).collect() == []
