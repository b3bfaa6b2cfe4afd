"""Imputing a panel's past: modal transitions and back-casting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.functions.columns import code_in, mapped
from panelweave.operators.relational import distinct_on


def modal_partner(pairs: DataFrame, key: Sequence[str], partner: str, n: str = "n") -> DataFrame:
    """Per key the most frequent partner and its count; of equally frequent ones the least.

    Two aggregates with partial sums, no window: a key with very many rows
    arrives as one row per partner and task.
    """
    counts = pairs.groupBy(*key, partner).agg(F.count("*").alias(n))
    best = F.min(F.struct((-F.col(n)).alias("m"), F.col(partner).alias("p")))
    return counts.groupBy(*key).agg(best.alias("_b")).select(*key, F.col("_b.p").alias(partner), (-F.col("_b.m")).alias(n))


def modal_previous(current: DataFrame, previous: DataFrame, student: str, school: str, stage: str, stages: Sequence[int], out: str = "school_before") -> DataFrame:
    """Per school of ``current`` (students in ``stages``) the modal school of these students the year before, in another stage.

    Students without a school on either side, and repeaters, do not count. Of
    several rows of one student the least counts.
    """
    now = distinct_on(current.where(code_in(F.col(stage), stages)).select(student, school), [student]).dropna()
    before = distinct_on(previous.select(student, F.col(stage).alias("_stage"), F.col(school).alias(out)), [student])
    before = before.where(~code_in(F.col("_stage"), stages)).dropna()
    return modal_partner(now.join(before, student), [school], out)


def backcast(df: DataFrame, years: int, stage_map: Mapping[int, int], lookup: DataFrame, group_of: Mapping[int, str], *, year: str = "year", stage: str = "stage", school: str = "school", ages: Sequence[str] = (), attributes: DataFrame | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Records of ``years`` earlier: only mapped stages, year and ages shifted, stage mapped back, school imputed.

    ``lookup`` holds ``grade, school, school_before`` (one row each);
    ``group_of`` names the grade of a stage. A school without a lookup row
    becomes null. ``attributes`` of the imputed school replace those that ``df``
    carries. ``drop`` names columns that make no sense for the past.
    """
    rows = df.where(code_in(F.col(stage), list(stage_map))).drop(*drop)
    grade = F.lit(None).cast("string")
    for code, name in group_of.items():
        grade = F.when(F.col(stage) == code, name).otherwise(grade)
    guess = lookup.select(F.col("grade").alias("_grade"), F.col("school").alias("_school"), F.col("school_before").alias("_before"))
    rows = rows.withColumn("_g", grade)
    rows = rows.join(guess, (F.col("_g") == F.col("_grade")) & (F.col(school) == F.col("_school")), "left")
    rows = rows.withColumns({year: F.col(year) - years, stage: mapped(F.col(stage), dict(stage_map)), school: F.col("_before")} | {a: F.col(a) - years for a in ages})
    rows = rows.drop("_g", "_grade", "_school", "_before")
    if attributes is not None:
        rows = rows.drop(*[c for c in attributes.columns if c != school]).join(attributes, school, "left")
    return rows


def dimension(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Distinct key and attributes; a key with two versions stays twice, as a plain distinct has it."""
    return df.select(key, *attributes).distinct()


def age_shift_ok(age_now: Column, age_before: Column) -> Column:
    return age_now == age_before + 1
