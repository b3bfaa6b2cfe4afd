import hashlib
import struct

import corpus_pipeline
import pytest
from panelweave.llm import secrets, toxicity
from panelweave.session import table

from tests.llm import test_decontaminate, test_secrets, test_simhash
from tests.llm.test_bpe import library  # noqa: F401


def plain(spark, folder, library):  # noqa: F811
    """The stages one after the other in plain Python, but for the two fitted models."""
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    model = toxicity.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    docs = {k: t for k, t in docs.items() if model.score(model.evidence(*model.scan(t))) < 0.7}
    rows = test_simhash.plain_lane_groups([(k, test_simhash.plain_lanes(t or "", 4)) for k, t in docs.items()])
    docs = {k: docs[k] for k, c in rows if k == c}
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    docs = {k: docs[k] for k, _, hits, _ in test_decontaminate.plain(list(docs.items()), items) if not hits}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    ratios = secrets.train(secrets.samples(frame))
    out = []
    for k, text in docs.items():
        clean, at = "", 0
        for span in filter(None, test_secrets.plain(text, ratios)[4].split(",")):
            a, e = map(int, span.split(":")[1:])
            if a >= at:
                clean += text[at:a] + "[SECRET]"
            at = max(at, e)
        clean += text[at:]
        ids = library.encode_ordinary(clean)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        out.append((k, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(clean.encode()).hexdigest(), packed))
    return sorted(out)


def test_against_plain_python(spark, middle, library):  # noqa: F811
    found = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["token_ids"])) for r in corpus_pipeline.run(spark, middle).collect())
    want = plain(spark, middle, library)
    assert found == want and 0.6 * table(spark, middle, "documents").count() < len(found)


@pytest.mark.parametrize("empty", [True, False])
def test_nulls_and_repeated_rows(spark, small, empty):
    schema = table(spark, small, "documents").select("doc_id", "text", "lang", "source", "n_chars").schema
    docs = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "alone and null", "en", None, 3), (None, "token=abcdefgh", None, None, None), (3, "plain text here", "en", "s", 15)], schema)
    docs = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "bpe":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
    rows = out.collect()
    assert len(rows) == (0 if empty else 4)
    if not empty:
        assert {r["doc_id"] for r in rows} == {1, None, 3}
        assert hashlib.sha256(b"[SECRET]").hexdigest() in {r["decoded_sha256"] for r in rows}
