"""Every operator and stage on odd rows, with extra columns that have the names used inside."""

import hashlib

import corpus_pipeline
import pytest

from panelweave.llm import bpe, common, decontaminate, quality_classifier, quality_rules, secrets, simhash, substring_dedup, toxicity, url_filter, warc

#: Names that operators use for themselves, and the results' names.
INSIDE = """
_k _th _hash _text_hash th t k key fp root least component_id fingerprint c0 c1 c2 row base spans runs both ends starts before after upto parts
places n_words n_hit items pk pth ik ith nk nth wid window size at labelled toxicity passages token_ids decoded n_tokens ids_sha256 decoded_sha256
n_removed kept n_words w l g h sk sh first stop ranked rank bucket kind blob digest holder payload record sha1 score weak_label target u time host path slice
interval blocked entry entry_kind entry_since best value pattern n unique text_hash
""".split()
INSIDE = list(dict.fromkeys(INSIDE))

LONG = " ".join(f"w{i % 4999}" for i in range(120_000))
TEXTS = ["a plain text of some words", "a plain text of some words", None, "", LONG, "password=abcdefgh and more", "x" * 200_000, "tie tie tie tie", "tie tie tie tie"]


def documents(spark, texts=TEXTS, kind="long"):
    ids = [1, 1, 2, 3, 4, 5, 6, 7, None]
    rows = [(None if k is None else str(k) if kind == "string" else k, t, None if k == 3 else "en", "s", None, *[f"{c}-{i}" for c in INSIDE]) for i, (k, t) in enumerate(zip(ids, texts))]
    schema = f"doc_id {kind}, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in INSIDE)
    return spark.createDataFrame(rows, schema)


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_stages_keep_columns_and_values(spark, small, stage, kind):
    docs = documents(spark, kind=kind)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, small)
    assert out.columns == docs.columns
    given = {r["row"]: r for r in rows(docs)}
    found = rows(out)
    assert found and all(r[c] == given[r["row"]][c] for r in found for c in INSIDE)
    if stage == "near_dedup":
        assert {r["doc_id"] for r in found} == {type(next(iter(found))["doc_id"])(k) for k in (1, 2, 4, 5, 6, 7)}
    else:
        assert len(found) == len(TEXTS)
    texts = {r["row"]: r["text"] for r in found}
    assert all(x == (given[k]["text"] if stage != "secrets" or "password" not in (x or given[k]["text"] or "") + (given[k]["text"] or "") else "[SECRET] and more") for k, x in texts.items())
    assert rows(dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), small)) == []


@pytest.mark.parametrize("kind", ["long", "string"])
def test_operators_of_a_row_each(spark, small, kind):
    docs = documents(spark, kind=kind)
    items = spark.createDataFrame([(None, "tie tie tie", "x"), (1, None, "y"), (1, "tie tie tie", "z")], "item_id long, text string, th string")
    model = toxicity.Model(tokens={"tie": 2.0}, slope=1.0)
    made = {
        "simhash": simhash.near_duplicates(docs),
        "bpe": bpe.digests(docs, ids=True),
        "encode": bpe.encode_documents(docs),
        "repeats": substring_dedup.remove_repeats(docs),
        "rules": quality_rules.judge(quality_rules.measure(docs, keep=("doc_id", "t", "w", "row", "n_words"))),
        "toxicity": toxicity.score(docs, model),
        "secrets": secrets.scan(docs, [0] * len(secrets.ALPHABET) ** 2),
        "contamination": decontaminate.contamination(docs, items),
        "quality": quality_classifier.classify(docs, *quality_classifier.fit(docs)),
    }
    for name, df in made.items():
        found = rows(df)
        assert len(found) == len(TEXTS), name
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r["doc_id"]) for r in rows(docs)), name
        assert len(df.columns) == len(set(df.columns)), name
    encoded = {r["row"]: r for r in rows(made["encode"])}
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["passages"].startswith("passages-") for r in encoded.values())
    hits = sorted((str(r["doc_id"]), r["n_hit"]) for r in rows(made["contamination"]) if r["n_hit"])
    assert hits == [("7", 4), ("None", 4)]
    (long,) = (r for r in rows(made["repeats"]) if str(r["doc_id"]) == "4")
    assert long["n_words"] == 120_000 and long["n_removed"] == 120_000 - 4999 and long["kept"] == " ".join(LONG.split()[:4999])  # windows from word 4999 on repeat


def test_archive_and_url_list(spark, tmp_path):
    docs = documents(spark).withColumnRenamed("text", "html").selectExpr("*", "'http://a.b/c' as url", "timestamp '2024-01-02' as fetched_at")
    warc.write_archive(docs, str(tmp_path / "a"), key="doc_id")
    found = warc.read_archive(spark, str(tmp_path / "a")).select("record_id", "payload", "record_bytes").collect()
    assert sorted(hashlib.md5(bytes(r["payload"])).hexdigest() for r in found) == sorted(hashlib.md5((t or "").encode()).hexdigest() for t in TEXTS)
    entries = spark.createDataFrame([("domain", "b", "block", "2024-01-01", "x")], "kind string, value string, action string, at string, since string")
    out = url_filter.judge(docs, entries)
    assert all(r["blocked"] is True and r["entry"] == "b" and r["time"].startswith("time-") for r in out.collect()) and out.count() == len(TEXTS)


def test_numbered_columns_may_even_have_one_name_twice(spark):
    twice = spark.range(1).selectExpr("id as a", "id + 1 as a")
    assert common.numbered(twice).collect()[0].asDict() == {"c0": 0, "c1": 1}
