import gzip

import pytest
from pyspark.sql import functions as F

from panelweave.sources import io


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_years_with_drifting_columns(spark, tmp_path):
    a = write(tmp_path / "a.csv", "CPF_MASC;NU_NOTA_CN;NOTA_CH;NU_NT_LC;NOTA_MT;NU_NOTA_REDACAO\np1;1;2;3;4;5\np2;1;2;;4;5\n;1;2;3;4;5\n")
    b = write(tmp_path / "b.csv", "NU_NOTA_REDACAO;NOTA_CN;NU_NOTA_CH;NOTA_LC;NU_NOTA_MT;CPF_MASC;extra\n10;10;10;10;20;p1;z\nNA;1;1;1;1;p3;z\n")
    df = io.read_exams(spark, {2009: a, 2010: b}, sep=";")
    assert sorted(map(tuple, df.collect())) == [("p1", 2009, 3.0), ("p1", 2010, 12.0)]
    with pytest.raises(ValueError, match="none of"):
        io.read_years(spark, {2009: a}, {"x": ["nothing"]}, sep=";")
    assert io.read_years(spark, {2009: a}, {"x": ["nothing"]}, optional=["x"], sep=";").dtypes[0] == ("x", "string")


def test_stacking_by_name_with_missing_columns(spark, tmp_path):
    a = write(tmp_path / "a.csv", "id,name\n1,x\n")
    b = write(tmp_path / "b.csv", "name,id,more\ny,2,m\n")
    rows = io.read_years(spark, {1: a, 2: b}).orderBy("year").collect()
    assert [(r["id"], r["name"], r["more"], r["year"]) for r in rows] == [("1", "x", None, 1), ("2", "y", "m", 2)]


def test_encodings_nulls_and_compression(spark, tmp_path):
    path = write(tmp_path / "l.csv", "id,name\n1,São João\n2,NA\n3,NULL\n4,\n", "latin-1")
    rows = io.read_csv(spark, path, encoding="ISO-8859-1", nulls=("NA", "NULL", "")).orderBy("id").collect()
    assert [r["name"] for r in rows] == ["São João", None, None, None]
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"id\n1\n"))
    assert io.read_any(spark, str(tmp_path / "z.csv.gz"), ["id"]).count() == 1


def test_formats_and_validation(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    for name in ("a.parquet", "b.csv", "folder"):
        io.write_any(df, str(tmp_path / name))
        back = io.read_any(spark, str(tmp_path / name), ["id", "v"])
        assert sorted((int(r["id"]), r["v"]) for r in back.collect()) == [(1, None), (2, "x")]
    assert "1,NA" in "".join(p.read_text() for p in (tmp_path / "b.csv").glob("part-*"))
    io.write_any(df, str(tmp_path / "a.parquet"), mode="append")
    assert io.read_any(spark, str(tmp_path / "a.parquet")).count() == 4
    with pytest.raises(ValueError, match="lacks"):
        io.read_any(spark, str(tmp_path / "a.parquet"), ["zzz"])
    with pytest.raises(ValueError, match="unknown format"):
        io.format_of("x.rds")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        io.read_any(spark, str(tmp_path / "missing.parquet"))


def test_buckets_hold_all_years_and_are_pruned(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 50).cast("string").alias("k"), (F.col("id") % 4).alias("year"))
    io.write_buckets(df, str(tmp_path / "b"), "k", 8)
    parts = [io.read_bucket(spark, str(tmp_path / "b"), i) for i in range(1, 9)]
    assert sum(p.count() for p in parts) == 200
    assert "PartitionFilters: [isnotnull(bucket" in parts[0]._jdf.queryExecution().toString()


def test_names_files_and_schemas(spark, tmp_path):
    write(tmp_path / "x1.csv", "a\n1\n")
    write(tmp_path / "x2.txt", "a\n1\n")
    assert io.list_files(spark, str(tmp_path), "*.csv").count() == 1
    drop = io.register(spark, one=spark.range(3))
    assert spark.sql("SELECT count(*) FROM one").first()[0] == 3
    drop()
    assert not spark.catalog.tableExists("one")
    assert io.empty(spark, "id string, n int").dtypes == [("id", "string"), ("n", "int")]
    assert [r["name"] for r in io.schema_of(spark.range(1)).collect()] == ["id"]


def test_bucketed_tables_join_without_a_shuffle(spark):
    for name in ("left_b", "right_b"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        io.save_bucketed(spark.range(100).withColumnRenamed("id", "k"), name, "k", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("left_b").join(spark.table("right_b"), "k")
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE left_b")
        spark.sql("DROP TABLE right_b")
