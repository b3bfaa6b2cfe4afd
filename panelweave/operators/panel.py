"""Entity-by-period panels: participation, spells, stops, cohorts, levels, merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelweave.functions.columns import code_in, distinct_with_null, flag, left_except_last, ratio, share
from panelweave.operators.relational import mark_join, null_safe_join


def participation(df: DataFrame, registered: str, out: str = "took_part") -> DataFrame:
    """1 where the number registered is above zero, 0 where it is not or is missing."""
    return df.withColumn(out, flag(F.col(registered) > 0))


def first_period(df: DataFrame, entity: Sequence[str], period: str, dummy: str, out: str = "first_period") -> DataFrame:
    """Per entity the first period with the dummy at 1; null for entities that never have it."""
    return df.groupBy(*entity).agg(F.min(F.when(F.col(dummy) == 1, F.col(period))).alias(out))


#: Periods that one slice of an entity's timeline covers, where a period is a number.
SLICE = 64


def _slice(df: DataFrame, period: str) -> Column:
    """A coarser period, so that an entity with very many rows is many tasks' work."""
    kind = df.schema[period].dataType
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(period) / SLICE)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.trunc(F.col(period).cast("date"), "month")
    return F.lit(0)


def _carried(rows: DataFrame, entity: Sequence[str], slices: DataFrame) -> DataFrame:
    """``rows`` with what the slices before carry into theirs; null entities are entities like any other."""
    names = {k: f"_on{i}" for i, k in enumerate([*entity, "_slice"])}
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(n)) for k, n in names.items()])
    return rows.join(slices.withColumnsRenamed(names), on, "left").drop(*names.values())


def in_order(df: DataFrame, entity: Sequence[str], period: str, value: str) -> DataFrame:
    """``entity, period, value`` with ``_rn`` (place in the entity's timeline, from 1) and ``_before`` (the value before), and ``_slice``, ``_own`` (place in the slice).

    Windows run per entity and slice of time; one row per slice carries the count
    and the last value on. So no entity's rows meet in one task.
    """
    rows = df.select(*entity, period, value, _slice(df, period).alias("_slice"))
    own = Window.partitionBy(*entity, "_slice").orderBy(period, value)
    rows = rows.withColumns({"_own": F.row_number().over(own), "_lag": F.lag(value).over(own)})
    slices = rows.groupBy(*entity, "_slice").agg(F.count("*").alias("_n"), F.max_by(value, "_own").alias("_last"))
    across = Window.partitionBy(*entity).orderBy("_slice")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*entity, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"), F.lag("_last").over(across).alias("_carry"))
    rows = _carried(rows, entity, slices)
    before = F.when(F.col("_own") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return rows.select(*entity, period, value, "_slice", "_own", (F.col("_own") + F.col("_offset")).alias("_rn"), before.alias("_before"))


def histories(df: DataFrame, entity: Sequence[str], period: str, dummy: str) -> DataFrame:
    """Per entity: ``periods``, ``ever``, ``first_on``, ``stops`` (changes from 1 to 0), ``first_spell`` (periods of the first run of 1).

    The run counts observed rows: a missing period is no gap, two rows in one
    period are two places. The first run ends at the first 0 after the first 1. All
    comes from one row per slice of time, so no entity's rows meet in one task.
    """
    on, off = F.col(dummy) == 1, F.col(dummy) == 0
    own = Window.partitionBy(*entity, "_slice").orderBy("_own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = in_order(df, entity, period, dummy).withColumn("_had", F.max(flag(on)).over(own))
    slices = rows.groupBy(*entity, "_slice").agg(
        F.count("*").alias("n"),
        F.max(flag(on)).alias("on"),
        F.min(F.when(on, F.col(period))).alias("when"),
        F.sum(flag((F.col("_before") == 1) & off)).cast("long").alias("stops"),
        F.min(F.when(on, F.col("_rn"))).alias("first"),
        F.min(F.when(off, F.col("_rn"))).alias("zero"),
        F.min(F.when(off & (F.col("_had") == 1), F.col("_rn"))).alias("zero_after"),
    )
    slices = slices.withColumn("start", F.min("first").over(Window.partitionBy(*entity)))
    # in the slice of the first 1 a 0 must follow it; in later slices any 0 does
    end = F.when(F.col("first") == F.col("start"), F.col("zero_after")).when(F.col("zero") > F.col("start"), F.col("zero"))
    out = slices.groupBy(*entity).agg(
        F.sum("n").alias("periods"), F.max("on").alias("ever"), F.min("when").alias("first_on"), F.sum("stops").alias("stops"), F.min("start").alias("_start"), F.min(end).alias("_end")
    )
    spell = F.coalesce(F.col("_end"), F.col("periods") + 1) - F.col("_start")
    return out.select(*entity, "periods", "ever", "first_on", "stops", spell.cast("long").alias("first_spell"))


def ordered_series(df: DataFrame, entity: Sequence[str], period: str, value: str, out: str = "series") -> DataFrame:
    """Per entity the values in order of period, as an array."""
    rows = df.groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).alias("v")))).alias("_rows"))
    return rows.select(*entity, F.transform("_rows", lambda r: r["v"]).alias(out))


def runs(df: DataFrame, entity: Sequence[str], period: str, value: str) -> DataFrame:
    """Run-length encoding: ``run`` (from 1), ``value``, ``length``, ``start``, ``stop`` per entity. Runs go on across slices of time."""
    new = (~F.col(value).eqNullSafe(F.col("_before")) | (F.col("_rn") == 1)).cast("int")
    step = in_order(df, entity, period, value).withColumn("_new", new)
    own = Window.partitionBy(*entity, "_slice").orderBy("_own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = step.withColumn("_run", F.sum("_new").over(own))
    earlier = Window.partitionBy(*entity).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = step.groupBy(*entity, "_slice").agg(F.sum("_new").alias("_n"))
    slices = slices.select(*entity, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_runs"))
    step = _carried(step, entity, slices).withColumn("run", F.col("_run") + F.col("_runs"))
    return step.groupBy(*entity, "run").agg(F.max(value).alias("value"), F.count("*").alias("length"), F.min(period).alias("start"), F.max(period).alias("stop"))


def spell_group(length: Column) -> Column:
    """Group of a first spell's length: one period, two, three or more; null for none."""
    return F.when(length == 1, "1").when(length == 2, "2").when(length >= 3, "3+")


def cohort_shares(history: DataFrame, cohort: str = "first_on") -> DataFrame:
    """Per period of first treatment: entities, and the shares whose first spell lasts one, two, and three or more periods."""
    spell = F.col("first_spell")
    kinds = {"share_1": spell == 1, "share_2": spell == 2, "share_3_or_more": spell >= 3}
    return history.where(F.col(cohort).isNotNull()).groupBy(cohort).agg(F.count("*").alias("entities"), *[share(c).alias(n) for n, c in kinds.items()])


def stop_shares(history: DataFrame, most: int = 3) -> DataFrame:
    """One row: entities that were ever treated, and the shares of them with at least 1 to ``most`` stops."""
    shares = [share(F.col("stops") >= k).alias(f"share_stops_{k}") for k in range(1, most + 1)]
    return history.where("ever = 1").agg(F.count("*").alias("entities"), *shares)


def never_stops(df: DataFrame, entity: Sequence[str], period: str, dummy: str) -> DataFrame:
    """Per entity whether it is ever at 1 and never falls from 1 to 0 (``monotone``)."""
    return histories(df, entity, period, dummy).select(*entity, ((F.col("ever") == 1) & (F.col("stops") == 0)).alias("monotone"))


def level_counts(df: DataFrame, group: Sequence[str], person: str, stage: str, levels: Mapping[str, Sequence[int]], total: Sequence[int] | None = None, fill: bool = False) -> DataFrame:
    """Distinct persons per group and level in one pass, and ``level_III = total - the named levels``.

    A level without persons is null, as after an outer merge of one count per
    level, and then so is the rest; ``fill`` makes both numbers.
    """
    distinct = {name: F.count_distinct(F.when(code_in(F.col(stage), codes), F.col(person))) for name, codes in levels.items()}
    whole = F.count_distinct(F.when(code_in(F.col(stage), total), F.col(person)) if total else F.col(person))
    out = df.groupBy(*group).agg(*[c.alias(n) for n, c in distinct.items()], whole.alias("total"))
    if not fill:
        out = out.withColumns({n: F.nullif(F.col(n), F.lit(0)) for n in [*levels, "total"]})
    rest = F.col("total")
    for name in levels:
        rest = rest - F.col(name)
    return out.withColumn("level_III", rest)


def participation_panel(participants: DataFrame, census: DataFrame, entity: str, period: str) -> DataFrame:
    """Full outer merge of participants and census by entity and period, null keys matching.

    ``missing_census`` (only among participants), ``participant``, and
    ``any_participation`` of the entity in any period. Values that both sides
    have keep the participants' name; the census' get ``_census``.
    """
    keys = [entity, period]
    right = census.withColumnsRenamed({c: f"{c}_census" for c in census.columns if c not in keys and c in participants.columns})
    merged = null_safe_join(participants.withColumn("_p", F.lit(1)), right.withColumn("_c", F.lit(1)), keys, "full")
    merged = merged.withColumn("participant", flag(F.col("_p") == 1)).withColumn("missing_census", flag(F.col("_c").isNull())).drop("_p", "_c")
    ever = merged.groupBy(entity).agg(F.max("participant").alias("any_participation"))
    return null_safe_join(merged, ever, [entity], "left")


def coverage_by_period(panel: DataFrame, entity: str, period: str, where: Column) -> DataFrame:
    """Distinct entities (null counting as one) per period among the rows that fulfil a condition."""
    return panel.where(where).groupBy(period).agg(distinct_with_null(F.col(entity)).alias("entities"))


def finish_panel(panel: DataFrame, enrolled: str, participant: str, members: DataFrame | None = None, entity: str = "school", flag_name: str = "part_first_edition") -> DataFrame:
    """Rows with enrolment or participation, and a mark for the entities in a list."""
    kept = panel.where((F.col(participant) == 1) | F.col(enrolled).isNotNull())
    return mark_join(kept, members, [entity], flag_name) if members is not None else kept


def join_by_short_key(df: DataFrame, other: DataFrame, key: str, short: str, extra: Sequence[str] = ()) -> DataFrame:
    """Inner join on a code whose last digit (a check digit) the other side lacks."""
    coded = df.withColumn("_short", left_except_last(F.col(key).cast("string")))
    named = other.withColumnRenamed(short, "_short").withColumn("_short", F.col("_short").cast("string"))
    return coded.join(named, ["_short", *extra]).withColumnRenamed("_short", short)


def shares_by_period(df: DataFrame, entity: str, period: str, eligible: Column, took_part: Column) -> DataFrame:
    """Per period the distinct eligible entities (null counting as one), those of them that took part, and these in percent.

    Several rows of one entity count once. A period without an eligible entity does
    not appear; where none took part, that number and the share are null.
    """
    both = eligible & took_part
    out = df.groupBy(period).agg(distinct_with_null(F.col(entity), eligible).alias("eligible"), F.nullif(distinct_with_null(F.col(entity), both), F.lit(0)).alias("participating"))
    return out.where("eligible > 0").withColumn("percent", 100 * ratio(F.col("participating"), F.col("eligible")))


def outcome_panel(enrolment: DataFrame, outcome: DataFrame, schools: DataFrame, keys: Sequence[str], school: str) -> DataFrame:
    """Enrolments with their year-end outcome and the attributes of the school at year end.

    Left joins on the enrolment's keys, then on the outcome's ``school``; several
    outcomes or several versions of a school give several rows, as they are.
    All years go through at once if the year is among the keys.
    """
    return enrolment.join(outcome, list(keys), "left").join(schools, school, "left")


def units_by_level(df: DataFrame, group: Sequence[str], levels: Sequence[str], name: str = "level", out: str = "n") -> DataFrame:
    """Per group and level the number of rows whose count in that level's column is above zero (missing is zero)."""
    wide = df.select(*group, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in levels])
    long = wide.unpivot(list(group), list(levels), name, "_count")
    return long.where("_count > 0").groupBy(*group, name).agg(F.count("*").alias(out))
