"""Reading and writing: formats by extension, schema drift over years, buckets, named relations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelweave.functions.codes import SCORE_SYNONYMS
from panelweave.functions.columns import bucket, coalesce_existing, resolve_first, to_double

CSV_ENDS, PARQUET_ENDS = (".csv", ".csv.gz", ".txt", ".tsv"), (".parquet", ".pq")


def format_of(path: str) -> str:
    """``csv`` or ``parquet`` by extension; a path without one is a Parquet folder. Error for another."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.endswith(CSV_ENDS):
        return "csv"
    if name.endswith(PARQUET_ENDS) or "." not in name or "=" in name or "*" in name:
        return "parquet"
    raise ValueError(f"unknown format: {path}")


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", nulls: Sequence[str] = ("NA",), schema: str | T.StructType | None = None, infer: bool = False) -> DataFrame:
    """One CSV layout. Without a schema all columns are text (or inferred if asked); each null token becomes null."""
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, inferSchema=infer)
    first, *rest = nulls or ("",)
    reader = reader.option("nullValue", first)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if rest:
        df = df.select([F.when(~F.col(f"`{f.name}`").isin(*rest), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])
    return df


def read_any(spark: SparkSession, path: str, required: Iterable[str] = (), **csv) -> DataFrame:
    """Read by extension; error if the path is missing or lacks a required column."""
    kind = format_of(path)
    df = read_csv(spark, path, **csv) if kind == "csv" else spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df


def write_any(df: DataFrame, path: str, mode: str = "overwrite", null: str = "NA") -> None:
    """Write by extension. CSV has a header and a token for null."""
    if format_of(path) == "csv":
        df.write.mode(mode).options(header=True, nullValue=null, emptyValue="").csv(path)
    else:
        df.write.mode(mode).parquet(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length, modified`` of the files of a folder, by Spark's reader (any file system), without their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def as_text(df: DataFrame) -> DataFrame:
    """Every column cast to text, as frames whose types differ by year need before they are stacked."""
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def read_years(spark: SparkSession, paths: Mapping[int, str], synonyms: Mapping[str, Sequence[str]] | None = None, optional: Iterable[str] = (), year: str = "year", **csv) -> DataFrame:
    """One frame of yearly files whose columns drift.

    Each file is read alone (a reader over many CSV files would apply one header
    to all), projected to the canonical names, and stacked by name with its year.
    ``synonyms`` maps a canonical name to the names it goes by; one that a file
    lacks altogether is an error unless it is ``optional``.
    """
    frames = []
    for y, path in sorted(paths.items()):
        df = read_any(spark, path, **csv)
        if synonyms:
            chosen = []
            for name, names in synonyms.items():
                if name in optional:
                    chosen.append(coalesce_existing(df, names).cast("string").alias(name))
                else:
                    chosen.append(F.col(f"`{resolve_first(df, names)}`").cast("string").alias(name))
            df = df.select(chosen)
        else:
            df = as_text(df)
        frames.append(df.withColumn(year, F.lit(y)))
    return union_by_name(frames)


def read_exams(spark: SparkSession, paths: Mapping[int, str], person: Sequence[str] = ("CPF_MASC",), **csv) -> DataFrame:
    """``person, year, mean_score`` of exams with all five scores and a person, whatever the scores are called that year."""
    raw = read_years(spark, paths, {"person": person, **SCORE_SYNONYMS}, **csv)
    scores = [to_double(F.col(c)) for c in SCORE_SYNONYMS]
    rows = raw.select("person", "year", (reduce(lambda a, b: a + b, scores) / 5).alias("mean_score"))
    return rows.where("person is not null and mean_score is not null")


def write_buckets(df: DataFrame, path: str, key: str, n: int, mode: str = "overwrite") -> None:
    """Folders ``bucket=1..n`` by the hash of a key, all years in one write (a later year never replaces an earlier)."""
    df.withColumn("bucket", bucket(F.col(key), n)).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, number: int) -> DataFrame:
    """One bucket, by a filter that prunes the other folders."""
    return spark.read.parquet(path).where(F.col("bucket") == number)


def save_bucketed(df: DataFrame, name: str, key: str, n: int) -> None:
    """A table whose joins on ``key`` with another of ``n`` buckets need no shuffle."""
    df.write.mode("overwrite").bucketBy(n, key).sortBy(key).saveAsTable(name)


def register(spark: SparkSession, **frames: DataFrame) -> Callable[[], None]:
    """Name frames as temporary views; the result drops them."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)

    def drop() -> None:
        for name in frames:
            spark.catalog.dropTempView(name)

    return drop


def keep_local(spark: SparkSession, rows: Sequence[tuple], schema: str, path: str) -> DataFrame:
    """A frame of the driver, kept as a table: written (an older one is replaced) and read back, so that it outlives the session."""
    write_any(spark.createDataFrame(list(rows), schema), path)
    return spark.read.schema(schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A typed relation without rows."""
    return spark.createDataFrame([], schema)


def schema_of(df: DataFrame) -> DataFrame:
    """``position, name, type`` of the columns, as a relation."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")
