"""Staggered difference-in-differences: group-time effects and their dynamic aggregate.

Callaway and Sant'Anna (2021), universal base period (the one before treatment),
controls not yet treated. Unconditional effects are differences of means; with
covariates the doubly robust estimator of Sant'Anna and Zhao (2020) is used. All
sums are distributed aggregates by cell; only cell parameters (a few numbers per
group and period) pass the driver. Standard errors come from influence functions,
which are sums by cell too: no bootstrap.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def _changes(panel: DataFrame, y: str, t: str, unit: str, g: str, covariates: Sequence[str]) -> DataFrame:
    """``u, group, period, d, dy`` and covariates at the base period, for every unit that is in a cell.

    The rows are made and summed up in the stage that joins a unit's periods to its
    base periods; they are not shuffled.
    """
    rows = panel.where(F.col(y).isNotNull()).select(F.col(unit).alias("u"), F.col(t).alias("period"), F.col(g).alias("own"), F.col(y).cast("double").alias("y"), *covariates)
    periods = panel.select(F.col(t).alias("period")).distinct()
    groups = panel.select(F.col(g).alias("group")).where("group is not null").distinct()
    first = periods.agg(F.min("period").alias("p0"))
    # a group treated from the first period on has no base
    groups = groups.join(F.broadcast(first), F.col("group") > F.col("p0")).select("group")
    base = rows.select("u", F.col("period").alias("base"), F.col("y").alias("y0"), *covariates)
    base = base.join(F.broadcast(groups), F.col("base") == F.col("group") - 1)  # one row per unit and group
    now = rows.select("u", "period", "own", "y")
    cells = now.join(base, "u")
    later = F.greatest("period", "base")
    member = F.col("own") == F.col("group")
    control = F.col("own").isNull() | (F.col("own") > later)
    cells = cells.where(F.coalesce(member, F.lit(False)) | (control & ~F.coalesce(member, F.lit(False))))
    return cells.select("u", "group", "period", F.coalesce(member, F.lit(False)).cast("int").alias("d"), (F.col("y") - F.col("y0")).alias("dy"), *covariates)


def att_gt(panel: DataFrame, y: str, t: str, unit: str, g: str, covariates: Sequence[str] = (), steps: int = 12) -> DataFrame:
    """``group, period, att, se, treated, controls``; the base period is 0 by construction, without ``se``. Cells without controls are null.

    Periods are consecutive integers; ``g`` is null for units never treated.
    """
    return estimate(panel, y, t, unit, g, covariates, steps)[0]


def estimate(panel: DataFrame, y: str, t: str, unit: str, g: str, covariates: Sequence[str] = (), steps: int = 12) -> tuple[DataFrame, DataFrame]:
    """The effects of :func:`att_gt`, and their influence functions ``group, period, u, psi`` (the squares of a cell add up to ``se`` squared)."""
    cells = _changes(panel, y, t, unit, g, covariates)
    if covariates:
        return _doubly_robust(cells, list(covariates), steps)
    one, none = F.when(F.col("d") == 1, F.col("dy")), F.when(F.col("d") == 0, F.col("dy"))
    out = cells.groupBy("group", "period").agg(
        F.avg(one).alias("m1"),
        F.avg(none).alias("m0"),
        F.var_pop(one).alias("v1"),
        F.var_pop(none).alias("v0"),
        F.sum("d").cast("long").alias("treated"),
        F.sum(1 - F.col("d")).cast("long").alias("controls"),
    )
    out = out.where("treated > 0")
    se = F.sqrt(F.col("v1") / F.col("treated") + F.col("v0") / F.nullif("controls", F.lit(0)))
    effects = out.select("group", "period", (F.col("m1") - F.col("m0")).alias("att"), _no_base(se).alias("se"), "treated", "controls")
    psi = F.when(F.col("d") == 1, (F.col("dy") - F.col("m1")) / F.col("treated")).otherwise((F.col("m0") - F.col("dy")) / F.nullif("controls", F.lit(0)))
    return effects, cells.join(F.broadcast(out), ["group", "period"]).select("group", "period", "u", psi.alias("psi"))


def _no_base(se: Column) -> Column:
    return F.when(F.col("period") != F.col("group") - 1, se)


def _doubly_robust(cells: DataFrame, covariates: list[str], steps: int) -> tuple[DataFrame, DataFrame]:
    from panelweave.session import materialise

    spark = cells.sparkSession
    cells = materialise(cells.dropna(), "cells")
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]
    k = len(x)
    key = ["group", "period"]
    kinds = [f"{n} {cells.schema[n].dataType.simpleString()}" for n in key]

    def sums(frame: DataFrame, weight: Column, **targets: Column) -> dict:
        """Per cell the matrix sum w x x', and per target its sum times x (of which the first is its plain sum)."""
        parts = [F.sum(weight * x[i] * x[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        parts += [F.sum(x[i] * target).alias(f"{name}{i}") for name, target in targets.items() for i in range(k)]
        out = {}
        for r in frame.groupBy(*key).agg(*parts).collect():  # one row per cell
            m = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    m[i, j] = m[j, i] = r[f"m{i}_{j}"] or 0.0
            out[r["group"], r["period"]] = m, {name: np.array([r[f"{name}{i}"] or 0.0 for i in range(k)]) for name in targets}
        return out

    def joined(frame: DataFrame, values: dict, prefix: str) -> DataFrame:
        rows = [(*c, *map(float, v)) for c, v in values.items()]
        width = max((len(v) for v in values.values()), default=0)
        given = spark.createDataFrame(rows, ", ".join([*kinds, *[f"{prefix}{i} double" for i in range(width)]]))
        return frame.join(F.broadcast(given), key)

    def linear(prefix: str) -> Column:
        total = F.lit(0.0)
        for i in range(k):
            total = total + F.col(f"{prefix}{i}") * x[i]
        return total

    d, dy = F.col("d"), F.col("dy")
    ridge = 1e-9 * np.eye(k)
    controls = {c: (m + ridge, v["v"]) for c, (m, v) in sums(cells.where("d = 0"), F.lit(1.0), v=dy).items()}
    outcome = {c: np.linalg.solve(m, v) for c, (m, v) in controls.items()}
    if not outcome:
        effects = spark.createDataFrame([], ", ".join([*kinds, "att double, se double, treated bigint, controls bigint"]))
        return effects, cells.select(*key, "u", F.lit(None).cast("double").alias("psi")).limit(0)
    beta = {c: np.zeros(k) for c in outcome}
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), linear("b")))))
    for _ in range(steps):
        frame = joined(cells, beta, "b").withColumn("_p", chance)
        change = 0.0
        for c, (m, v) in sums(frame, F.col("_p") * (1 - F.col("_p")), v=d - F.col("_p")).items():
            step = np.linalg.solve(m + 1e-6 * np.eye(k), v["v"])
            beta[c] = beta[c] + step
            change = max(change, float(np.abs(step).max()))
        if change < 1e-8:
            break
    frame = joined(joined(cells, beta, "b"), outcome, "o").withColumn("_p", chance).withColumn("_r", dy - linear("o"))
    frame = frame.withColumn("_w0", F.when(d == 0, F.col("_p") / (1 - F.col("_p"))).otherwise(0.0))
    w0, r = F.col("_w0"), F.col("_r")
    found = sums(frame, F.col("_p") * (1 - F.col("_p")), t=d, tr=d * r, c=w0, cr=w0 * r, n=F.lit(1.0))
    # what each unit adds: its own residual, and what the estimated outcome and chance of treatment owe to it
    given, effects = {}, []
    for c, (hessian, v) in found.items():
        treated, weight, n = v["t"][0], v["c"][0], v["n"][0]
        if not treated:
            continue
        a1, a0 = v["tr"][0] / treated, v["cr"][0] / weight if weight else float("nan")
        if weight:
            through_outcome = np.linalg.solve(controls[c][0], v["c"] / weight - v["t"] / treated)
            through_chance = np.linalg.solve(hessian + 1e-6 * np.eye(k), (v["cr"] - a0 * v["c"]) / weight)
            given[c] = (treated, weight, a1, a0, *through_outcome, *through_chance)
        effects.append((*c, float(a1 - a0) if weight else None, int(treated), int(n - treated)))
    table = spark.createDataFrame(effects, ", ".join([*kinds, "att double, treated bigint, controls bigint"]))
    rows = joined(frame, given, "q")
    apart = lambda first: sum((F.col(f"q{first + i}") * x[i] for i in range(k)), F.lit(0.0))
    own = d * (r - F.col("q2")) / F.col("q0") - w0 * (r - F.col("q3")) / F.col("q1")
    psi = own + (1 - d) * r * apart(4) - (d - F.col("_p")) * apart(4 + k)
    influence = rows.select(*key, "u", psi.alias("psi"))
    errors = influence.groupBy(*key).agg(F.sqrt(F.sum(F.col("psi") * F.col("psi"))).alias("_se"))
    effects = table.join(errors, key, "left").select(*key, "att", _no_base(F.col("_se")).alias("se"), "treated", "controls")
    return effects, influence


def dynamic(effects: DataFrame, sizes: DataFrame, influence: DataFrame | None = None, panel: DataFrame | None = None, unit: str = "unit", g: str = "g") -> DataFrame:
    """``event_time, att, groups``: effects by periods since treatment, weighted by group size; null effects are left out.

    ``sizes`` holds ``group, size``. With the ``influence`` of the effects and the
    ``panel`` (for the units of each group, whose number is estimated too) also
    ``se`` and the 95 % interval ``low``, ``high``: null where nothing varies.
    """
    rows = effects.where(F.col("att").isNotNull()).join(sizes, "group")
    rows = rows.withColumn("event_time", (F.col("period") - F.col("group")).cast("int"))
    out = rows.groupBy("event_time").agg(F.sum(F.col("att") * F.col("size")).alias("s"), F.sum("size").cast("double").alias("w"), F.count("*").alias("groups"))
    out = out.select("event_time", (F.col("s") / F.col("w")).alias("att"), "groups", "w")
    if influence is None:
        return out.drop("w")
    # effects, sizes and their sums have a row per cell
    cells = F.broadcast(rows.select("group", "period", "event_time", F.col("att").alias("own"), "size").join(out, "event_time"))
    through = influence.join(cells, ["group", "period"]).select("event_time", "u", (F.col("psi") * F.col("size") / F.col("w")).alias("psi"))
    members = panel.where(F.col(g).isNotNull()).select(F.col(unit).alias("u"), F.col(g).alias("group")).distinct()
    sized = members.join(cells, "group").select("event_time", "u", ((F.col("own") - F.col("att")) / F.col("w")).alias("psi"))
    units = through.unionByName(sized).groupBy("event_time", "u").agg(F.sum("psi").alias("psi"))
    errors = units.groupBy("event_time").agg(F.sqrt(F.sum(F.col("psi") * F.col("psi"))).alias("se"))
    out = out.join(errors, "event_time", "left").withColumn("se", F.when(F.col("event_time") != -1, F.col("se")))
    half = 1.96 * F.col("se")
    return out.select("event_time", "att", "groups", "se", (F.col("att") - half).alias("low"), (F.col("att") + half).alias("high"))


def group_sizes(panel: DataFrame, unit: str, g: str) -> DataFrame:
    """``group, size``: units per period of first treatment."""
    return panel.where(F.col(g).isNotNull()).groupBy(F.col(g).alias("group")).agg(F.count_distinct(unit).alias("size"))
