"""As-of matching: the latest observation strictly before an event."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelweave.operators.relational import distinct_on


def by_month(at: Column) -> Column:
    return F.trunc(at.cast("date"), "month")


def by_thousand(at: Column) -> Column:
    return F.floor(at / 1000)


def asof_window(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, values: Sequence[str], tie: Sequence[str] = (), slice_of: Callable[[Column], Column] | None = by_month) -> DataFrame:
    """``left`` with the ``values`` of the latest right row of the same keys with ``right_at < at``; null without one.

    One union and one window: nothing multiplies. Of right rows at one time the
    last by ``tie`` counts, then by the values. Null keys or times match nothing.

    A key with very many rows is cut in time: ``slice_of`` maps a time column to a
    coarser one (by default the month of a time, the thousand of a number; none
    where it is None). Windows then run per key and slice, and the last row of the
    slices before is carried in over one row per slice.
    """
    if slice_of is by_month and isinstance(left.schema[at].dataType, T.NumericType):
        slice_of = by_thousand
    payload = F.struct(F.col(right_at).alias("_t"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)], *[F.col(c).alias(c) for c in values])
    latest = right.dropna(subset=[*keys, right_at]).groupBy(*keys, F.col(right_at).alias("_at")).agg(F.max(payload).alias("_value"))
    rows = left.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in left.columns])).select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), "_row")
    both = rows.unionByName(latest.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    part: list[Column] = [F.col(k) for k in keys]
    if slice_of is not None:
        both = both.withColumn("_slice", slice_of(F.col("_at")))
        part.append(F.col("_slice"))
    # at one time the left rows come first, so they never see a right row of their own time
    order = Window.partitionBy(*part).orderBy("_at", F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(order))
    if slice_of is not None:
        last = both.where("_side = 0").groupBy(*keys, "_slice").agg(F.max_by("_value", "_at").alias("_last"))
        slices = both.select(*keys, "_slice").distinct().join(last, [*keys, "_slice"], "left")
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = slices.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
        on = [found[k].eqNullSafe(carried[k]) for k in [*keys, "_slice"]]
        carried_in = on[0]
        for o in on[1:]:
            carried_in = carried_in & o
        found = found.join(carried, carried_in, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.where("_side = 1").select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in values])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, values: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The same by a range join and an aggregate; for few right rows per key. Left rows must be distinct."""
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(F.col(right_at).alias("_t"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)], *[F.col(c).alias(c) for c in values]).alias("_value"))
    on = F.col("_value._t") < F.col(at)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    best = left.join(right, on, "left").groupBy(*left.columns).agg(F.max("_value").alias("_value"))
    return best.select(*left.columns, *[F.col(f"_value.{c}").alias(c) for c in values])


def course_ranking(entrants: DataFrame, groups: Sequence[str], score: str = "mean_score", via: str | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Per group the mean score (unmatched entrants do not enter it), all entrants, and those with ``via`` = 1.

    With ``key`` (say person, year of entry, institution and course) an entrant
    that comes in several rows counts once: the least row stays.
    """
    if key:
        entrants = distinct_on(entrants, key)
    out = [F.avg(score).alias("mean_score"), F.count("*").alias("n_entrants"), F.count(score).alias("n_scored")]
    if via:
        out.append(F.sum(F.when(F.col(via) == 1, 1).otherwise(0)).cast("long").alias("n_via_exam"))
    return entrants.groupBy(*groups).agg(*out)
