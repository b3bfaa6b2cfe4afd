"""Relational building blocks beyond the plain DataFrame verbs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelweave.session import materialise


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order`` (then by all columns, nulls first): a total order, so the survivor is certain.

    An aggregate, not a window: each task keeps one row per key before the
    shuffle, so a key that holds a third of all rows is no burden.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    rank = F.struct(*[F.col(f"`{c}`") for c in order], *[F.col(f"`{c}`") for c in rest if c not in order])
    best = df.groupBy(*keys).agg(F.min(rank).alias("_best"))
    return best.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_best.`{c}`") for c in df.columns])


def distinct_on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, with a certain survivor: the least row."""
    return keep_first(df, keys, [])


def suffix_join(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_1", how: str = "inner") -> DataFrame:
    """Join that keeps all columns of both sides; names that the left has too get a suffix on the right."""
    names = {c: f"{c}{suffix}" if c in left.columns else c for c in right.columns}
    renamed = right.withColumnsRenamed(names)
    on = reduce(lambda a, b: a & b, [left[k] == renamed[names[k]] for k in keys])
    return left.join(renamed, on, how)


def suffix_columns(df: DataFrame, suffix: str, keep: Iterable[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in set(keep)})


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which null keys match each other; the keys come once, whichever side has them."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_{k}"]) for k in keys])
    joined = left.join(other, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    named = {k: F.coalesce(left[k], other[f"_{k}"]) for k in keys}
    rest = [F.col(f"`{c}`") for c in joined.columns if c not in keys and c not in {f"_{k}" for k in keys}]
    return joined.select(*[named[k].alias(k) for k in keys], *rest)


def full_merge(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of several frames on the same keys, null keys matching each other."""
    return reduce(lambda a, b: null_safe_join(a, b, keys, "full"), frames)


def _looked_up(df: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` left-joined to ``values``, whose keys are ``_key0`` and so on; null keys match each other."""
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return df.join(values, on, "left")


def mark_join(df: DataFrame, members: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """``df`` with 1 where its keys are among ``members``, else 0. A null key is among them if they hold a null key."""
    marks = members.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)]).distinct().withColumn("_mark", F.lit(1))
    out = _looked_up(df, marks, keys).withColumn(flag, F.coalesce("_mark", F.lit(0)))
    return out.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*df.columns, flag])])


def update_join(df: DataFrame, other: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``df`` with ``column`` replaced by the other side's value where the keys match, null keys matching each other (one value per key: the least)."""
    values = other.groupBy(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.min(f"`{column}`").alias("_new"), F.lit(True).alias("_there"))
    now = F.col(f"`{column}`") if column in df.columns else F.lit(None)
    out = _looked_up(df, values, keys).withColumn(column, F.when(F.col("_there"), F.col("_new")).otherwise(now))
    return out.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*df.columns, column])])


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose keys come more than once: an aggregate joined back, so a hot key is split by adaptive execution."""
    many = df.groupBy(*keys).count().where("count > 1").select(*keys)
    return df.join(many, list(keys), "left_semi")


def cast_columns(df: DataFrame, names: Iterable[str], cast) -> DataFrame:
    """``cast`` (Column to Column) over a set of columns."""
    return df.withColumns({c: cast(F.col(f"`{c}`")) for c in names})


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from one column to another, by position."""
    at = df.columns.index
    return df.columns[at(first) : at(last) + 1]


def columns_starting(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def frequency(df: DataFrame, *columns: str, drop_null: bool = True) -> DataFrame:
    """Counts of value combinations; nulls are left out as in a frequency table."""
    rows = df.dropna(subset=list(columns)) if drop_null else df
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def sample_n(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows at random: a sampling operator, bounded by ``n``."""
    return df.orderBy(F.rand(seed)).limit(n)


def shares_within(counts: DataFrame, group: Sequence[str], n: str = "n", out: str = "share") -> DataFrame:
    """Counts as shares of their group's total (totals by an aggregate joined back); null is a group like any other."""
    totals = counts.groupBy(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(group)]).agg(F.sum(n).alias("_total"))
    return _looked_up(counts, totals, group).withColumn(out, F.col(n).cast("double") / F.col("_total")).select(*dict.fromkeys([*counts.columns, out]))


def row_numbers(df: DataFrame, order: Sequence[str], out: str = "row") -> DataFrame:
    """``df`` with the number of each row, from 1, in this order over all rows.

    No window over the whole table: rows are dealt by range and sorted, each part
    is numbered by itself, and the number of rows in the parts before is added.
    Rows that tie in ``order`` are told apart by all other columns; equal rows get
    different numbers. The numbered parts are written once, so numbers are certain.
    """
    rest = [c for c in df.columns if c not in order]
    ranged = df.orderBy(*[F.col(f"`{c}`") for c in [*order, *_orderable(df, rest)]]).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "row-numbers")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))  # a row per part
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    rows = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return rows.withColumn(out, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("_offset")).select(*dict.fromkeys([*df.columns, out]))


def _orderable(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [c for c in names if df.schema[c].dataType.typeName() not in ("map", "variant")]


def order_numeric(x: Column) -> list[Column]:
    """Sort keys for ids: numbers by value first, other ids after them, then by text."""
    from panelweave.functions.columns import as_number

    return [as_number(x).asc_nulls_last(), x.asc_nulls_last()]
