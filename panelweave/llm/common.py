"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelweave.session import importable

#: Rows and bytes of a slice of an Arrow batch that a function works on at once.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20

#: ASCII white space, the separator of words: space and 0x09-0x0D. ``bytes.split()`` splits on the same six bytes.
SPACE = r"\x20\x09-\x0D"


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` by workers that find this package wherever the session was started.

    Spark bounds a batch by bytes, and reads the bound when the plan is executed: so where the session has Spark's own
    64 MB, it is set to ``SLICE_BYTES`` for good; another value is left alone. The function gets a batch in slices of
    ``SLICE_ROWS`` rows and ``SLICE_BYTES`` at most (or one row), so what it makes of them is small in any case.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(SLICE_BYTES))
    importable(spark)
    return df.mapInArrow(lambda batches: fn(sliced(batches)), schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices bounded by rows and, where rows are of like size, by bytes."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would also change other scripts)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def strings(column: pa.Array) -> list:
    """Python strings of an Arrow column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """For what is executed inside: rows of an Arrow batch. For numbers a large batch is best."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def numbered(df: DataFrame) -> DataFrame:
    """The rows under names ``c0, c1, …``, by position: nothing an operator adds can clash with them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def with_results(df: DataFrame, names: list[str], results: dict[str, Column]) -> DataFrame:
    """A frame made by :func:`numbered` from columns ``names``, under these names again, with results beside them; a result takes the place of a column of its name."""
    kept = [(f"c{i}", n) for i, n in enumerate(names) if n.lower() not in {r.lower() for r in results}]
    return df.select(*[F.col(c) for c, _ in kept], *results.values()).toDF(*[n for _, n in kept], *results)
