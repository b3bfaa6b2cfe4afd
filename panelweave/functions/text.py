"""Names: accent stripping, cleaning, blocking keys and Jaro similarity."""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@lru_cache
def _accents() -> tuple[str, str]:
    """Latin letters with marks and the plain letters they decompose to, one to one."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(x: Column) -> Column:
    """Latin letters without their marks; letters that do not decompose (as ß, Æ, Ø) stay."""
    return F.translate(x, *_accents())


def clean_name(x: Column) -> Column:
    """Without accents, only the letters a-z and single blanks, in lower case. Null stays null."""
    letters = F.regexp_replace(strip_accents(x), "[^a-zA-Z ]", "")
    return F.lower(F.trim(F.regexp_replace(letters, " +", " ")))


def first_word(x: Column) -> Column:
    return F.split_part(x, F.lit(" "), F.lit(1))


def first_initial(x: Column) -> Column:
    return F.substring(x, 1, 1)


def jaro(a: str, b: str) -> float:
    """Jaro similarity; half the transpositions are rounded down. An empty side gives 0."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(mine, theirs)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


#: Cells of the tables in which a batch of pairs is compared at once.
CELLS = 1 << 22


def _codes(names: list[str], width: int) -> np.ndarray:
    """A row of code points per name, filled up with zero."""
    joined = "".join(x.ljust(width, "\0") for x in names)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(names), width)


def jaro_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro similarities of pairs of names, by columns of code points: a step per character, over all pairs at once."""
    la, lb = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    width_a, width_b = max(int(la.max(initial=0)), 1), max(int(lb.max(initial=0)), 1)
    a, b = _codes(left, width_a), _codes(right, width_b)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    place = np.arange(width_b)
    free = place < lb[:, None]
    mine = np.zeros(a.shape, bool)
    rows = np.arange(len(left))
    for i in range(width_a):
        lower, upper = i - reach, i + reach
        near = free & (b == a[:, i : i + 1]) & (place >= lower[:, None]) & (place <= upper[:, None]) & (i < la)[:, None]
        at = near.argmax(axis=1)
        found = near[rows, at]
        mine[found, i] = True
        free[rows[found], at[found]] = False
    theirs = (place < lb[:, None]) & ~free
    m = mine.sum(axis=1)
    # the matched characters of either side, in order
    first, second = (np.zeros((len(left), int(m.max(initial=0)) + 1), np.uint32) for _ in range(2))
    for codes, used, out in ((a, mine, first), (b, theirs, second)):
        row, column = np.nonzero(used)
        out[row, (np.cumsum(used, axis=1) - 1)[row, column]] = codes[row, column]
    t = (first != second).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (m / la + m / lb + (m - t) / m) / 3
    return np.where(m > 0, score, 0.0)


@F.pandas_udf(T.DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow batches of pairs, compared column by column; apply it after :func:`jaro_possible`. Null gives null."""
    given = (a.notna() & b.notna()).to_numpy()
    left, right = a[given].tolist(), b[given].tolist()
    step = max(1, CELLS // max([1, *map(len, left), *map(len, right)]))
    parts = [jaro_batch(left[i : i + step], right[i : i + step]) for i in range(0, len(left), step)]
    out = np.full(len(a), np.nan)
    out[given] = np.concatenate(parts) if parts else []
    return pd.Series(out, dtype="float64").astype(object).where(given, None) if not given.all() else pd.Series(out)


def letters(x: Column) -> Column:
    """How often each of 32 classes of characters comes in a text (the classes of code points modulo 32)."""
    chars = F.transform(F.split(x, ""), lambda c: F.ascii(c) % 32)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.size(F.filter(chars, lambda c: c == k)))


def jaro_possible(a: Column, b: Column, least: float, letters_a: Column | None = None, letters_b: Column | None = None) -> Column:
    """Native test that no pair of at least this similarity fails.

    The shorter length bounds the matches, and so do the letters (:func:`letters`) that both have, where they are given.
    """
    la, lb = F.length(a).cast("double"), F.length(b).cast("double")
    low, high = F.least(la, lb), F.greatest(la, lb)
    possible = (low > 0) & (low / high >= 3 * least - 2 - 1e-9)
    if letters_a is not None:
        common = F.aggregate(F.zip_with(letters_a, letters_b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
        possible = possible & (common / la + common / lb + 1 >= 3 * least - 1e-9)
    return possible


def length_bands(x: Column, least: float) -> tuple[Column, Column]:
    """The band of a text's length, and the bands in which texts of at least this similarity can be (an array).

    Bands grow by the ratio of lengths that :func:`jaro_possible` allows, so those are the own band and its neighbours; one band for all where any ratio is allowed.
    """
    ratio = 3 * least - 2
    if ratio <= 0.05:
        return F.lit(0), F.array(F.lit(0))
    band = F.floor(F.log(F.length(x).cast("double")) / math.log(1 / min(ratio, 0.95)) + 1e-6).cast("int")
    return band, F.array(band - 1, band, band + 1)
