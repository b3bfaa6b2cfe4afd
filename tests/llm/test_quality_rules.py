import random
import re
from collections import Counter

import pytest

from panelweave.llm import quality_rules as q
from panelweave.session import table


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = {
        "n_words": n,
        "n_lines": len(lines),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_stop_words": sum(w in q.STOP_WORDS for w in words),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }
    base = n < 10 or 100 * len(covered) > 20 * n
    broken = {r.name: (100 * counts[r.count] > r.percent * counts[r.base] if r.above else 100 * counts[r.count] < r.percent * counts[r.base]) and n >= r.least for r in q.RULES}
    return counts | {"base_failed": base, "kept": not base and not any(broken.values())}


def found(df):
    return [r.asDict() for r in q.judge(q.measure(df)).collect()]


def test_against_plain(spark):
    rng = random.Random(5)
    vocabulary = ["the", "a", "x", "Y#", "**", "é", "日本", "of", "<b>", "\U0001f600", "\x1c", "\xa0z"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t\r", "\n\n "]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " \n\t", "a b c d e " * 3, "a " * 9, "a " * 10, "line one\nline one\n \nline one", "x " * 30000, "w" * 90000, "a b c d e f g h i j k l m n o p q r s t u"]
    df = spark.createDataFrame([(i, t, 7, "s") for i, t in enumerate(texts)], "doc_id long, text string, w int, g string")
    for r in found(df):
        want = plain(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = found(df)
    assert len(rows) == 3 and rows[0] == rows[1] and all(r["base_failed"] and not r["kept"] for r in rows)
    assert found(df.limit(0)) == []


def test_good_texts_are_kept(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    rows = {r["doc_id"]: r for r in q.op4_quality_rules(spark, folder).collect()}
    good = [rows[k] for k, y in labels.items() if y == 1 and not rows[k]["base_failed"]]
    bad = [rows[k] for k, y in labels.items() if y == 0]
    assert sum(r["kept"] for r in good) >= 0.995 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.1 * len(bad)


@pytest.mark.parametrize("above", [True, False])
def test_rules_compile(spark, above):
    df = spark.createDataFrame([(10, 5), (10, 6), (2, 2)], "n_words long, c long")
    rule = q.compile_rules((q.Rule("r", "c", "n_words", 50, above=above, least=5),))
    assert [r["r"] for r in df.select(rule["r"].alias("r")).collect()] == ([False, True, False] if above else [False, False, False])
