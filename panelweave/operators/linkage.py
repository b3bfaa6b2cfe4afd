"""Record linkage: exact by key, approximate by blocked Jaro similarity, and reports on both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelweave.functions.columns import count_if, ratio
from panelweave.functions.text import first_initial, first_word, jaro_possible, jaro_similarity, length_bands, letters
from panelweave.operators.relational import suffix_join


def link_exact(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_1", distinct: bool = True) -> DataFrame:
    """Inner join of two sources on a masked id. Rows without the id never match; columns that both have get a suffix.

    One shuffle on the key does what a loop over hash buckets does on one
    machine; a hot key is split by adaptive execution.
    """
    left, right = left.dropna(subset=list(keys)), right.dropna(subset=list(keys))
    if distinct:
        left, right = left.distinct(), right.distinct()
    return suffix_join(left, right, keys, suffix)


def discrepancies(linked: DataFrame, person: str, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row: ``matched`` persons, and per pair the persons with differing values (null never differs)."""
    counts = [F.count_distinct(F.when(F.col(a) != F.col(b), F.col(person))).alias(name) for name, (a, b) in pairs.items()]
    return linked.agg(F.count_distinct(person).alias("matched"), *counts)


def coverage(df: DataFrame, columns: Sequence[str], base: str) -> DataFrame:
    """Distinct values of several columns in one pass, and each as a share of those of ``base``."""
    row = df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
    return row.select("*", *[ratio(F.col(f"n_{c}"), F.col(f"n_{base}")).alias(f"share_{c}") for c in columns if c != base])


def first_seen(df: DataFrame, keys: Sequence[str], when: str) -> DataFrame:
    """Distinct keys and the least value of ``when``; rows with a null key are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.min(when).alias(f"first_{when}"))


def match_share(entrants: DataFrame, ids: DataFrame, key: str, period: str) -> DataFrame:
    """Per period the distinct entrants, those found among ``ids``, and the share (0 where none is found)."""
    people = entrants.select(period, key).dropna().distinct()
    known = ids.select(key).dropna().distinct().withColumn("_found", F.lit(1))
    out = people.join(known, key, "left").groupBy(period)
    out = out.agg(F.count("*").alias("entrants"), F.count("_found").alias("matched"))
    return out.withColumn("share", ratio(F.col("matched"), F.col("entrants")))


def blocking_keys(df: DataFrame, name: str) -> DataFrame:
    """Add ``initial``, the first letter of the first word of a cleaned name."""
    return df.withColumn("initial", first_initial(first_word(F.col(name))))


def candidate_pairs(left: DataFrame, right: DataFrame, block: Sequence[str], id: str = "id", name: str = "name") -> DataFrame:
    """``id_left, id_right, name_left, name_right`` that share all blocking keys; empty names match nothing."""
    a = left.where(F.length(name) > 0).select(F.col(id).alias("id_left"), F.col(name).alias("name_left"), *block)
    b = right.where(F.length(name) > 0).select(F.col(id).alias("id_right"), F.col(name).alias("name_right"), *block)
    return a.join(b, list(block)).drop(*block)


def link_fuzzy(left: DataFrame, right: DataFrame, block: Sequence[str], id: str = "id", name: str = "name", least: float = 0.9) -> DataFrame:
    """Best right id per left id among blocked pairs of similarity ``least`` or more (ties: the least id).

    The blocks are joined over distinct names, and within bands of length, so
    names whose lengths differ too much never meet. Pairs that the letters in common
    rule out go at once, natively; the others are scored where they arise, and only
    the best by name is shuffled. Ids are attached last, so a name that very many
    rows share multiplies nothing. One right id may serve several left ids.
    """
    a = left.where(F.length(name) > 0).groupBy(*block, F.col(name).alias("name_left")).agg(F.lit(1).alias("_a"))
    b = right.where(F.length(name) > 0).groupBy(*block, F.col(name).alias("name_right")).agg(F.min(id).alias("id_right"))
    band, near = length_bands(F.col("name_left"), least)[0], length_bands(F.col("name_right"), least)[1]
    a = a.select(*block, "name_left", letters(F.col("name_left")).alias("_la"), band.alias("_band"))
    b = b.select(*block, "name_right", "id_right", letters(F.col("name_right")).alias("_lb"), F.explode(near).alias("_band"))
    pairs = a.join(b, [*block, "_band"]).where(jaro_possible(F.col("name_left"), F.col("name_right"), least, F.col("_la"), F.col("_lb")))
    pairs = pairs.select(*block, "name_left", "name_right", "id_right")
    kept = pairs.withColumn("similarity", jaro_similarity("name_left", "name_right")).where(F.col("similarity") >= least)
    rank = F.struct((-F.col("similarity")).alias("s"), F.col("id_right").alias("id_right"), F.col("name_right").alias("n"))
    best = kept.groupBy(*block, "name_left").agg(F.min(rank).alias("_best"))
    rows = left.where(F.length(name) > 0).select(F.col(id).alias("id_left"), F.col(name).alias("name_left"), *block)
    out = rows.join(best, [*block, "name_left"])
    return out.select("id_left", F.col("_best.id_right").alias("id_right"), "name_left", F.col("_best.n").alias("name_right"), (-F.col("_best.s")).alias("similarity"))
