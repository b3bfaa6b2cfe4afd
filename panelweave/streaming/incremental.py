"""Incremental forms for sources that keep growing (an extension; the yearly loops of a batch run need none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_counts(stream: DataFrame, at: str, group: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and mean value per time window and group of a stream; rows later than ``late`` are left out."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width), group).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def match_stream(stream: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a stream whose key is among a static list, marked."""
    known = ids.select(key).dropna().distinct().withColumn("_found", F.lit(1))
    return stream.join(known, key, "left").withColumn("matched", F.coalesce("_found", F.lit(0))).drop("_found")
