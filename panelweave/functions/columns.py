"""Column helpers: synonyms, tolerant casts, shares, ids as text. All native expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def resolve_first(df: DataFrame, names: Sequence[str]) -> str:
    """The first of several synonymous column names that ``df`` has (case matters not); error if none."""
    have = {c.lower(): c for c in df.columns}
    for name in names:
        if name.lower() in have:
            return have[name.lower()]
    raise ValueError(f"none of {list(names)} is a column; there are {df.columns}")


def coalesce_existing(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-null of the synonyms that exist; null if none exists."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None)


def to_int(x: Column, kind: str = "int") -> Column:
    """Text or number to integer by way of double: ``'2.5'`` gives 2, what is no plain number gives null."""
    text = F.trim(x.cast("string"))
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(plain, text.try_cast("double").try_cast(kind))


def to_double(x: Column) -> Column:
    text = F.trim(x.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def year_of(x: Column) -> Column:
    """A bare year, or the year of an ISO date; null otherwise."""
    text = x.cast("string")
    return F.coalesce(F.when(text.rlike(r"^\s*\d{4}\s*$"), F.trim(text).try_cast("int")), F.year(F.left(text, F.lit(10)).try_cast("date")))


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds, as a double; rows where it is null drop out."""
    return F.avg(condition.cast("double"))


def count_if(condition: Column) -> Column:
    """Rows for which a condition holds, null counting as no."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as doubles, null where ``b`` is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is null."""
    return F.when(condition, 1).otherwise(0)


def distinct_with_null(x: Column, where: Column | None = None) -> Column:
    """Number of distinct values, null counting as one, of all rows or of those that fulfil a condition."""
    if where is None:
        where = F.lit(True)
    return (F.count_distinct(F.when(where, x)) + F.max(flag(where & x.isNull()))).cast("long")


#: Tokens that stand for a missing id.
NULL_IDS = ("", "NA", "NULL")


def normal_id(x: Column, numeric: bool = False) -> Column:
    """Id as text: a trailing ``.0`` goes first, then blanks; the null tokens become null. Numbers never get an exponent."""
    text = x.cast("decimal(38,0)").cast("string") if numeric else x
    text = F.trim(F.regexp_replace(text, r"\.0+$", ""))
    return F.when(~text.isin(*NULL_IDS), text)


def as_number(x: Column) -> Column:
    """Number of an id made of digits, else null (``'1d'`` is no number here)."""
    return F.when(x.rlike(r"^[+-]?\d+(\.\d+)?$"), x.try_cast("double"))


def left_except_last(x: Column) -> Column:
    """The text without its last character (a check digit)."""
    return F.left(x, F.length(x) - 1)


def bucket(x: Column, n: int) -> Column:
    """Bucket 1 to ``n`` of a key. Physical only: the value differs between engines."""
    return (F.pmod(F.xxhash64(x), F.lit(n)) + 1).cast("int")


def code_in(x: Column, codes: Iterable[int]) -> Column:
    return x.isin(*codes)


def mapped(x: Column, table: dict[int, int]) -> Column:
    """Code map with null for what is not in it."""
    out = F.lit(None).cast("int")
    for a, b in table.items():
        out = F.when(x == a, b).otherwise(out)
    return out
