import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from panelweave.llm import bpe
from panelweave.session import table

ODD = ["a", "b", "the", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "ß", "日本", "😀", "'s", "'ll", "1", "²", "!", "...", "​", "﻿", "\x00", "ing", " '", "́", "क्ष", "İ"]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    return list(memoryview(bpe.codec().encode(text)).cast("I"))


def test_odd_texts(library):
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 14)))
        assert ids(text) == library.encode_ordinary(text)
        assert bpe.codec().decode(bpe.codec().encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000, "the" * 8000, "x!?" * 5000, " " * 9000, "日" * 6000, "<|endoftext|> x"])
def test_long_pieces(library, text):
    assert ids(text) == library.encode_ordinary(text)


def test_query_against_the_library(spark, small, library):
    want = {}
    for r in table(spark, small, "documents").collect():
        own = library.encode_ordinary(r["text"] or "")
        packed = struct.pack(f"<{len(own)}I", *own)
        want[r["doc_id"]] = (len(own), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op2_bpe(spark, small).collect()} == want


def test_nulls_copies_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (2, "", "z")], "doc_id long, text string, ids string")
    out = bpe.encode_documents(df).collect()
    assert [(r["doc_id"], bytes(r["decoded"]), r["ids"]) for r in out] == [(1, b"", "x"), (1, b"", "x"), (None, b"a b", "y"), (2, b"", "z")]
    assert bpe.encode_documents(df.limit(0)).collect() == [] and bpe.digests(df.limit(0)).collect() == []
    out = bpe.encode_documents(df.withColumnRenamed("ids", "decoded"))
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"] and {bytes(r["decoded"]) for r in out.collect()} == {b"", b"a b"}


def test_caches_that_run_over(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 8)
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    bpe.codec.cache_clear()
    text = " ".join(f"word{i % 37}ing" for i in range(400))
    assert ids(text) == library.encode_ordinary(text)
    bpe.codec.cache_clear()
