import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import codes, columns as c, text


def values(spark, rows, schema, *out):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*out).collect()]


def test_synonyms(spark):
    df = spark.createDataFrame([(1, None, 3)], "a int, NU_NOTA_CN int, nota_cn int")
    assert c.resolve_first(df, ["x", "NOTA_CN", "NU_NOTA_CN"]) == "nota_cn"
    with pytest.raises(ValueError, match="none of"):
        c.resolve_first(df, ["x", "y"])
    assert df.select(c.coalesce_existing(df, ["NU_NOTA_CN", "zzz", "NOTA_CN"])).first()[0] == 3
    assert df.select(c.coalesce_existing(df, ["zzz"])).first()[0] is None


def test_casts_do_not_throw(spark):
    rows = [(x,) for x in ["2.5", "7", " 7 ", "x", "", None, "1d", "-3.9", "1e3", "0x1", "NaN"]]
    assert [r[0] for r in values(spark, rows, "x string", c.to_int(F.col("x")))] == [2, 7, 7, None, None, None, None, -3, 1000, None, None]
    rows = [(x,) for x in ["2010", " 1999 ", "2010-05-06", "2010-05-06 10:00", "x", None, "20100506"]]
    assert [r[0] for r in values(spark, rows, "x string", c.year_of(F.col("x")))] == [2010, 1999, 2010, 2010, None, None, None]


def test_shares_are_doubles_and_nulls_drop_out(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1)], "a int, b int")
    out = df.agg(c.share(F.col("a") != F.col("b")).alias("s"), c.count_if(F.col("a") != F.col("b")).alias("n"), c.distinct_with_null(F.col("a")).alias("d"), c.ratio(F.lit(1), F.lit(3)).alias("r"), c.ratio(F.lit(1), F.lit(0)).alias("z"))
    assert dict(out.dtypes)["s"] == "double"
    assert tuple(out.first()) == (0.5, 1, 2, 1 / 3, None)


def test_ids_are_normalised(spark):
    rows = [(x,) for x in ["12.0", "12.0 ", " 7", "", "NA", "NULL", "null", None, "1.50", "3.000"]]
    assert [r[0] for r in values(spark, rows, "x string", c.normal_id(F.col("x")))] == ["12", "12.0", "7", None, None, None, "null", None, "1.50", "3"]
    assert values(spark, [(12000000000.0,)], "x double", c.normal_id(F.col("x"), numeric=True)) == [("12000000000",)]
    assert values(spark, [("1234567",), ("1",), ("",)], "x string", c.left_except_last(F.col("x"))) == [("123456",), ("",), ("",)]


def test_flags_codes_and_buckets(spark):
    df = spark.createDataFrame([(0,), (2,), (None,)], "x int")
    assert [r[0] for r in df.select(c.flag(F.col("x") > 0)).collect()] == [0, 1, 0]
    stages = spark.createDataFrame([(s,) for s in (7, 8, 11, 12, 18, 19, 38, 39, 41)], "s int")
    assert [r[0] for r in stages.where(c.code_in(F.col("s"), codes.TOTAL_STAGES)).collect()] == [8, 11, 19, 38, 41]
    assert [r[0] for r in stages.select(c.mapped(F.col("s"), codes.ONE_YEAR_BACK)).collect()] == [None, None, 10, None, None, None, None, None, 21]
    buckets = spark.range(1000).select(c.bucket(F.col("id"), 7).alias("b")).distinct()
    assert sorted(r["b"] for r in buckets.collect()) == list(range(1, 8))


NAMES = ["  José  da Silva ", "D'Ávila", "ß Æ Ø Straße", "ÇÃO ÑÚ", "", "123 45", None, "a  b   c", "Ǖ ǹ Ẽ", "é"]


def test_names_are_cleaned_as_duckdb_does(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(NAMES)))
    want = con.execute("SELECT lower(trim(regexp_replace(regexp_replace(strip_accents(x), '[^a-zA-Z ]', '', 'g'), ' +', ' ', 'g'))) FROM t ORDER BY i").fetchall()
    found = values(spark, [(x,) for x in NAMES], "x string", text.clean_name(F.col("x")))
    assert found == want and found[0] == ("jose da silva",) and found[1] == ("davila",)
    assert values(spark, [("maria jose",), ("",)], "x string", text.first_word(F.col("x")), text.first_initial(F.col("x"))) == [("maria", "m"), ("", "")]


def test_jaro_is_duckdbs():
    rng = random.Random(7)
    pairs = [("".join(rng.choice("abcde ") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 12)))) for _ in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE p (i INT, a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    want = [r[0] for r in con.execute("SELECT jaro_similarity(a, b) FROM p ORDER BY i").fetchall()]
    assert all(abs(text.jaro(a, b) - w) < 1e-12 for (a, b), w in zip(pairs, want))
    odd = [("ß" * 5 + "𝄞x", "x𝄞ß"), ("a" * 300, "a" * 299 + "b"), ("\0", "a")]
    batch = text.jaro_batch(*map(list, zip(*pairs, *odd)))
    assert np.allclose(batch, [text.jaro(a, b) for a, b in [*pairs, *odd]], atol=1e-12)
    assert text.jaro_batch([], []).tolist() == []


def test_length_test_loses_no_pair(spark):
    rng = random.Random(8)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 14))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))) for _ in range(2000)]
    df = spark.createDataFrame(pairs, "a string, b string").where(text.jaro_possible(F.col("a"), F.col("b"), 0.9))
    kept = {tuple(r) for r in df.collect()}
    assert all(p in kept for p in pairs if text.jaro(*p) >= 0.9)
    for least in (0.9, 0.75, 0.6):
        a, b = F.col("a"), F.col("b")
        df = spark.createDataFrame(pairs, "a string, b string")
        close = df.where(text.jaro_possible(a, b, least, text.letters(a), text.letters(b)) & F.array_contains(text.length_bands(b, least)[1], text.length_bands(a, least)[0]))
        kept = {tuple(r) for r in close.collect()}
        assert all(p in kept for p in pairs if text.jaro(*p) >= least)
    assert spark.createDataFrame([("a", None), (None, None), ("ab", "ab")], "a string, b string").select(text.jaro_similarity("a", "b").alias("s")).collect()[0]["s"] is None
