"""Data quality: null shares, duplication classes, distributions, checks as one tidy table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelweave.functions.columns import share
from panelweave.operators.relational import shares_within


def null_profile(df: DataFrame, percent: bool = True) -> DataFrame:
    """``column, null_share`` of every column, largest first; NaN counts as missing. One aggregate over one scan."""

    def missing(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()

    scale = 100.0 if percent else 1.0
    row = df.agg(*[(F.avg(missing(f).cast("double")) * scale).alias(f.name) for f in df.schema])
    return row.unpivot([], row.columns, "column", "null_share").orderBy(F.desc_nulls_last("null_share"), "column")


def one_or_many(df: DataFrame, person: Sequence[str], period: str, thing: str) -> DataFrame:
    """Per period: persons, and the shares of them with one and with several different things."""
    per = df.groupBy(*person, period).agg(F.count_distinct(thing).alias("n"))
    return per.groupBy(period).agg(F.count("*").alias("persons"), share(F.col("n") == 1).alias("share_one"), share(F.col("n") > 1).alias("share_many"))


def duplication_classes(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Per period the shares of keys with one, two, and three or more rows."""
    per = df.groupBy(*keys, period).agg(F.count("*").alias("k"))
    kind = F.when(F.col("k") == 1, "1").when(F.col("k") == 2, "2").otherwise("3+")
    counts = per.groupBy(period, kind.alias("class")).agg(F.count("*").alias("n"))
    return shares_within(counts, [period])


def distribution(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Counts of a value per group and their shares; null is a value."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return shares_within(counts, group) if group else counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).first()[0])


def checks(metrics: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """``check, value`` (double): each metric is an aggregate over a frame. Metrics of one frame share one scan."""
    frames: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for name, (df, column) in metrics.items():
        frames.setdefault(id(df), (df, []))[1].append((name, column))
    out = None
    for df, columns in frames.values():
        row = df.agg(*[c.cast("double").alias(n) for n, c in columns])
        tidy = row.unpivot([], row.columns, "check", "value")
        out = tidy if out is None else out.unionByName(tidy)
    return out


def replication_checks(before: DataFrame, after: DataFrame, person: str, school: str, stage: str, age: str, state: str | None = None) -> DataFrame:
    """The standard checks of a back-cast against the year it comes from, as ``check, value``.

    Rows, missing schools, mean ages, persons in both years, ages that do not fit,
    and the share that moved; per stage the rows of either year and the share with a
    school (``rows_before:9``, ``match_rate:9``; a null stage is ``null``). With
    ``state`` also missing states and the share that moved between states.
    """
    kept = [school, age, *([state] if state else [])]
    a = after.select(F.col(person).alias("_person"), *[F.col(c).alias(f"_{c}") for c in kept])
    pairs = before.select(person, *kept).join(a, F.col(person) == F.col("_person"))
    other = lambda c: F.col(f"_{c}") != F.col(c)
    metrics = {
        "rows_before": (before, F.count("*")),
        "rows_after": (after, F.count("*")),
        "missing_school_before": (before, share(F.col(school).isNull())),
        "mean_age_before": (before, F.avg(age)),
        "mean_age_after": (after, F.avg(age)),
        "paired": (pairs, F.count("*")),
        "age_violations": (pairs, F.sum(F.when(F.col(f"_{age}") != F.col(age) + 1, 1).otherwise(0))),
        "moved": (pairs, share(other(school))),
    }
    if state:
        metrics["missing_state_before"] = (before, share(F.col(state).isNull()))
        metrics["moved_state"] = (pairs, share(other(state)))
    out = checks(metrics)
    name = lambda kind: F.concat(F.lit(f"{kind}:"), F.coalesce(F.col(stage).cast("string"), F.lit("null")))
    own = before.groupBy(stage).agg(F.count("*").cast("double").alias("n"), share(F.col(school).isNotNull()).alias("rate"))
    later = after.groupBy(stage).agg(F.count("*").cast("double").alias("n"))
    for rows, kind, value in ((own, "rows_before", "n"), (own, "match_rate", "rate"), (later, "rows_after", "n")):
        out = out.unionByName(rows.select(name(kind).alias("check"), F.col(value).alias("value")))
    return out
