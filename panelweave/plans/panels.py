"""Queries on panels, imputation, quality, effects and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.operators import classify as classes, did, impute, panel, quality
from panelweave.operators.relational import frequency, full_merge, shares_within
from panelweave.session import table
from panelweave.sources.io import schema_of, union_by_name


def _year(c: str):
    return F.year(c)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order's customer and year."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", _year("o_orderdate").alias("year"))
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey")


def modal_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier the modal supplier that its customers' lines of 1997 had in 1996, by line number as the stage."""
    lines = _lines(spark, sf_dir).select("o_custkey", "l_suppkey", "l_linenumber", "year")
    found = impute.modal_previous(lines.where("year = 1997"), lines.where("year = 1996"), "o_custkey", "l_suppkey", "l_linenumber", [1, 2])
    return found.withColumnRenamed("n", "students")


MODAL_SQL = """
WITH l AS (SELECT o_custkey, l_suppkey, l_linenumber, year(o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT o_custkey, min(l_suppkey) AS l_suppkey FROM l WHERE y = 1997 AND l_linenumber IN (1, 2) GROUP BY 1),
p AS (SELECT o_custkey, l_linenumber AS stage, l_suppkey AS school_before, row_number() OVER (PARTITION BY o_custkey ORDER BY l_linenumber, l_suppkey) AS n FROM l WHERE y = 1996),
n AS (SELECT l_suppkey, school_before, count(*) AS students FROM c JOIN p USING (o_custkey) WHERE p.n = 1 AND stage NOT IN (1, 2) GROUP BY 1, 2)
SELECT l_suppkey, school_before, students FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY students DESC, school_before) AS k FROM n) WHERE k = 1
"""


def one_or_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per year the shares of customers with one and with several suppliers."""
    return quality.one_or_many(_lines(spark, sf_dir), ["o_custkey"], "year", "l_suppkey")


ONE_SQL = """
WITH p AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT year, count(*) AS persons, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS share_one, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS share_many FROM p GROUP BY 1
"""


def duplication_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per customer and year, in classes; one year is missing, and is a year of its own."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.nullif(_year("o_orderdate"), F.lit(1997)).alias("year"))
    return quality.duplication_classes(orders, ["o_custkey"], "year")


CLASSES_SQL = """
WITH p AS (SELECT o_custkey, CAST(nullif(year(o_orderdate), 1997) AS INTEGER) AS year, count(*) AS k FROM orders GROUP BY 1, 2),
c AS (SELECT year, CASE WHEN k = 1 THEN '1' WHEN k = 2 THEN '2' ELSE '3+' END AS class, count(*) AS n FROM p GROUP BY 1, 2)
SELECT year, class, n, n / sum(n) OVER (PARTITION BY year) AS share FROM c
"""


def full_outer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by year: returned lines against all others, of any part and quantity."""
    lines = _lines(spark, sf_dir)
    count = lambda kept: lines.where(kept).groupBy("l_suppkey", "year").agg(F.count("*").alias("n"))
    return panel.participation_panel(count("l_returnflag = 'R'"), count("l_returnflag is distinct from 'R'"), "l_suppkey", "year")


FULL_SQL = """
WITH l AS (SELECT l_suppkey, CAST(year(o_orderdate) AS INTEGER) AS year, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT l_suppkey, year, count(*) AS n FROM l WHERE l_returnflag = 'R' GROUP BY 1, 2),
b AS (SELECT l_suppkey, year, count(*) AS n FROM l WHERE l_returnflag IS DISTINCT FROM 'R' GROUP BY 1, 2),
m AS (SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.year, b.year) AS year, a.n, b.n AS n_census,
        CASE WHEN a.n IS NOT NULL THEN 1 ELSE 0 END AS participant, CASE WHEN b.n IS NULL THEN 1 ELSE 0 END AS missing_census
      FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.year = b.year)
SELECT *, max(participant) OVER (PARTITION BY l_suppkey) AS any_participation FROM m
"""


def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all lines per supplier and year by return flag, merged outer on both keys."""
    lines = _lines(spark, sf_dir)
    part = lambda flag, name: lines.where(F.col("l_returnflag") == flag).groupBy("l_suppkey", "year").agg(F.count("*").alias(name))
    return full_merge([part("R", "n_r"), part("A", "n_a"), part("N", "n_n")], ["l_suppkey", "year"])


MERGE_SQL = """
SELECT l_suppkey, CAST(year(o_orderdate) AS INTEGER) AS year, nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS n_r,
       nullif(count(*) FILTER (l_returnflag = 'A'), 0) AS n_a, nullif(count(*) FILTER (l_returnflag = 'N'), 0) AS n_n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A', 'N') GROUP BY 1, 2
"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct orders per supplier and year in line-number levels I and II, in all, and the rest."""
    return panel.level_counts(_lines(spark, sf_dir), ["l_suppkey", "year"], "l_orderkey", "l_linenumber", {"level_I": (1, 2), "level_II": (3, 4)}, total=range(1, 8))


LEVELS_SQL = """
SELECT l_suppkey, CAST(year(o_orderdate) AS INTEGER) AS year, nullif(count(DISTINCT CASE WHEN l_linenumber IN (1, 2) THEN l_orderkey END), 0) AS level_I,
       nullif(count(DISTINCT CASE WHEN l_linenumber IN (3, 4) THEN l_orderkey END), 0) AS level_II, nullif(count(DISTINCT l_orderkey), 0) AS total,
       nullif(count(DISTINCT l_orderkey), 0) - nullif(count(DISTINCT CASE WHEN l_linenumber IN (1, 2) THEN l_orderkey END), 0)
         - nullif(count(DISTINCT CASE WHEN l_linenumber IN (3, 4) THEN l_orderkey END), 0) AS level_III
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User by day: whether there was a purchase."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), (F.col("event_type") == "purchase").cast("int").alias("p"))
    return events.groupBy("user_id", "day").agg(F.max("p").alias("bought"))


def user_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panel.histories(_days(spark, sf_dir), ["user_id"], "day", "bought")
    return found.withColumn("first_on", F.date_format("first_on", "yyyy-MM-dd")).withColumn("spell_group", panel.spell_group(F.col("first_spell")))


_HISTORY = """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS x FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER w AS rn, lag(x) OVER w AS b FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
f AS (SELECT user_id, count(*) AS periods, max(x) AS ever, min(CASE WHEN x = 1 THEN day END) AS first_on,
        CAST(sum(CASE WHEN b = 1 AND x = 0 THEN 1 ELSE 0 END) AS BIGINT) AS stops, min(CASE WHEN x = 1 THEN rn END) AS r1 FROM o GROUP BY 1),
z AS (SELECT f.user_id, min(o.rn) AS r0 FROM f JOIN o ON o.user_id = f.user_id AND o.x = 0 AND o.rn > f.r1 GROUP BY 1),
h AS (SELECT f.user_id, periods, ever, first_on, stops, coalesce(z.r0, periods + 1) - r1 AS first_spell FROM f LEFT JOIN z ON f.user_id = z.user_id)
"""
HISTORY_SQL = (
    _HISTORY
    + """SELECT user_id, periods, ever, strftime(first_on, '%Y-%m-%d') AS first_on, stops, first_spell,
  CASE WHEN first_spell = 1 THEN '1' WHEN first_spell = 2 THEN '2' WHEN first_spell >= 3 THEN '3+' END AS spell_group FROM h"""
)


def cohort_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panel.cohort_shares(panel.histories(_days(spark, sf_dir), ["user_id"], "day", "bought"))
    return found.withColumn("first_on", F.date_format("first_on", "yyyy-MM-dd"))


COHORT_SQL = (
    _HISTORY
    + """SELECT strftime(first_on, '%Y-%m-%d') AS first_on, count(*) AS entities, avg(CAST(first_spell = 1 AS DOUBLE)) AS share_1,
  avg(CAST(first_spell = 2 AS DOUBLE)) AS share_2, avg(CAST(first_spell >= 3 AS DOUBLE)) AS share_3_or_more FROM h WHERE first_on IS NOT NULL GROUP BY first_on"""
)


def stop_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that ever bought, and the shares of them that stopped once, twice and three times at least."""
    return panel.stop_shares(panel.histories(_days(spark, sf_dir), ["user_id"], "day", "bought"))


STOPS_SQL = (
    _HISTORY
    + """SELECT count(*) AS entities, avg(CAST(stops >= 1 AS DOUBLE)) AS share_stops_1, avg(CAST(stops >= 2 AS DOUBLE)) AS share_stops_2,
  avg(CAST(stops >= 3 AS DOUBLE)) AS share_stops_3 FROM h WHERE ever = 1"""
)


def user_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length encoding of each user's days: number of runs, longest run with a purchase."""
    found = panel.runs(_days(spark, sf_dir), ["user_id"], "day", "bought")
    return found.groupBy("user_id").agg(F.count("*").alias("runs"), F.max(F.when(F.col("value") == 1, F.col("length"))).alias("longest"))


RUNS_SQL = """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS x FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - row_number() OVER (PARTITION BY user_id, x ORDER BY day) AS g FROM d),
r AS (SELECT user_id, x, g, count(*) AS n FROM o GROUP BY 1, 2, 3)
SELECT user_id, count(*) AS runs, max(CASE WHEN x = 1 THEN n END) AS longest FROM r GROUP BY 1
"""


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panel.ordered_series(_days(spark, sf_dir), ["user_id"], "day", "bought")
    return found.select("user_id", F.array_join(F.transform("series", lambda x: x.cast("string")), "").alias("series"), F.exists("series", lambda x: x == 1).alias("ever"))


SERIES_SQL = """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS x FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(CAST(x AS VARCHAR), '' ORDER BY day) AS series, max(x) = 1 AS ever FROM d GROUP BY 1
"""


def never_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by week: a signup of value over 250, never left again."""
    weeks = table(spark, sf_dir, "events").select("user_id", F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).alias("week"), F.when((F.col("event_type") == "signup") & (F.col("value") > 250), 1).otherwise(0).alias("x"))
    return panel.never_stops(weeks.groupBy("user_id", "week").agg(F.max("x").alias("x")), ["user_id"], "week", "x")


NEVER_SQL = """
WITH w AS (SELECT user_id, (CAST(ts AS DATE) - DATE '2024-01-01') // 7 AS week, max(CASE WHEN event_type = 'signup' AND value > 250 THEN 1 ELSE 0 END) AS x FROM events GROUP BY 1, 2),
o AS (SELECT user_id, x, lag(x) OVER (PARTITION BY user_id ORDER BY week) AS b FROM w)
SELECT user_id, max(x) = 1 AND max(CASE WHEN b = 1 AND x = 0 THEN 1 ELSE 0 END) = 0 AS monotone FROM o GROUP BY 1
"""


def unpivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, discount and tax as long rows: how many are above zero, per status and flag, missing counted as zero."""
    return panel.units_by_level(table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "measure")


UNPIVOT_SQL = """
SELECT l_linestatus, l_returnflag, measure, count(*) AS n FROM (
  SELECT l_linestatus, l_returnflag, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem
  UNION ALL SELECT l_linestatus, l_returnflag, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_linestatus, l_returnflag, 'l_tax', l_tax FROM lineitem
) WHERE amount > 0 GROUP BY 1, 2, 3
"""


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing shares of customers joined outer to their urgent orders."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderstatus")
    found = quality.null_profile(customers.join(urgent, "c_custkey", "left"))
    return found.withColumn("null_share", F.round("null_share", 6))


NULL_SQL = """
WITH j AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, o_totalprice, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
SELECT 'c_custkey' AS column, round(100.0 * avg(CAST(c_custkey IS NULL AS INTEGER)), 6) AS null_share FROM j
UNION ALL SELECT 'segment', round(100.0 * avg(CAST(segment IS NULL AS INTEGER)), 6) FROM j
UNION ALL SELECT 'o_totalprice', round(100.0 * avg(CAST(o_totalprice IS NULL AS INTEGER)), 6) FROM j
UNION ALL SELECT 'o_orderstatus', round(100.0 * avg(CAST(o_orderstatus IS NULL AS INTEGER)), 6) FROM j
"""


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status per year: counts and shares; one year is missing, and is a year of its own."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.nullif(_year("o_orderdate"), F.lit(1997)))
    return shares_within(frequency(orders, "year", "o_orderstatus", drop_null=False), ["year"])


DISTRIBUTION_SQL = """
SELECT CAST(y AS INTEGER) AS year, o_orderstatus, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY y) AS share FROM (SELECT nullif(year(o_orderdate), 1997) AS y, o_orderstatus FROM orders) GROUP BY y, o_orderstatus
"""

_MAP1, _MAP2 = {7: 6, 6: 5, 5: 4, 4: 3}, {7: 5, 6: 4, 5: 3}
_GRADES = {7: "late", 6: "late", 5: "middle", 4: "early"}


def backcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 1998 cast back by one and two years: line number mapped, supplier imputed, its attributes refreshed."""
    lines = _lines(spark, sf_dir).where("year = 1998").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "year", F.col("l_quantity").alias("age"), "l_returnflag")
    previous = _lines(spark, sf_dir).where("year = 1997").select("l_suppkey", F.col("l_linenumber").alias("stage"), F.col("l_partkey"))
    pairs = previous.withColumn("grade", F.when(F.col("stage").isin(6, 7), "late").when(F.col("stage") == 5, "middle").when(F.col("stage") == 4, "early")).where("grade is not null")
    pairs = pairs.withColumn("before", F.col("l_partkey") % 97)
    lookup = impute.modal_partner(pairs, ["grade", "l_suppkey"], "before").select("grade", F.col("l_suppkey").alias("school"), F.col("before").alias("school_before"))
    attributes = impute.dimension(table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey", ["s_nationkey"])
    options = {"year": "year", "stage": "l_linenumber", "school": "l_suppkey", "ages": ["age"], "attributes": attributes, "drop": ["l_returnflag"]}
    both = [impute.backcast(lines, k, m, lookup, _GRADES, **options) for k, m in ((1, _MAP1), (2, _MAP2))]
    return union_by_name(both).groupBy("year", "l_linenumber", "l_suppkey", "s_nationkey").agg(F.count("*").alias("n"), F.sum("age").cast("long").alias("ages"))


BACKCAST_SQL = """
WITH l AS (SELECT lineitem.*, CAST(year(o_orderdate) AS INTEGER) AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT CASE WHEN l_linenumber IN (6, 7) THEN 'late' WHEN l_linenumber = 5 THEN 'middle' WHEN l_linenumber = 4 THEN 'early' END AS grade, l_suppkey, l_partkey % 97 AS before, count(*) AS n
  FROM l WHERE year = 1997 AND l_linenumber BETWEEN 4 AND 7 GROUP BY 1, 2, 3),
k AS (SELECT grade, l_suppkey, before FROM (SELECT *, row_number() OVER (PARTITION BY grade, l_suppkey ORDER BY n DESC, before) AS r FROM g) WHERE r = 1),
c AS (SELECT l.*, d.back, CASE WHEN l_linenumber IN (6, 7) THEN 'late' WHEN l_linenumber = 5 THEN 'middle' ELSE 'early' END AS grade
  FROM l CROSS JOIN (SELECT 1 AS back UNION ALL SELECT 2) d WHERE l.year = 1998 AND l_linenumber BETWEEN 3 + back AND 7),
b AS (SELECT c.year - back AS year, CAST(c.l_linenumber - back AS INTEGER) AS l_linenumber, k.before AS l_suppkey, c.l_quantity - back AS age FROM c LEFT JOIN k ON k.grade = c.grade AND k.l_suppkey = c.l_suppkey)
SELECT b.year, b.l_linenumber, b.l_suppkey, s_nationkey, count(*) AS n, CAST(sum(age) AS BIGINT) AS ages FROM b LEFT JOIN supplier ON s_suppkey = b.l_suppkey GROUP BY 1, 2, 3, 4
"""


def replication_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First orders of customers as if they were two years of one person: school, stage, age and state from the order's number."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.min("o_orderkey").alias("k"))
    k = F.col("k")
    before = first.select("person", F.nullif(k % 5, F.lit(0)).alias("school"), F.nullif(k % 3, F.lit(1)).alias("stage"), (k % 40).alias("age"), F.nullif(k % 7, F.lit(0)).alias("state"))
    after = first.select("person", (k % 4).alias("school"), (k % 3).alias("stage"), (k % 40 + k % 2).alias("age"), (k % 6).alias("state"))
    return quality.replication_checks(before, after, "person", "school", "stage", "age", "state").withColumn("value", F.round("value", 6))


CHECKS_SQL = """
WITH f AS (SELECT o_custkey AS person, min(o_orderkey) AS k FROM orders GROUP BY 1),
b AS (SELECT person, nullif(k % 5, 0) AS school, nullif(k % 3, 1) AS stage, k % 40 AS age, nullif(k % 7, 0) AS state FROM f),
a AS (SELECT person, k % 4 AS school, k % 3 AS stage, k % 40 + k % 2 AS age, k % 6 AS state FROM f),
p AS (SELECT b.school, b.age, b.state, a.school AS school2, a.age AS age2, a.state AS state2 FROM b JOIN a USING (person))
SELECT 'rows_before' AS check, CAST(count(*) AS DOUBLE) AS value FROM b
UNION ALL SELECT 'rows_after', count(*) FROM a
UNION ALL SELECT 'missing_school_before', round(avg(CAST(school IS NULL AS INTEGER)), 6) FROM b
UNION ALL SELECT 'mean_age_before', round(avg(age), 6) FROM b
UNION ALL SELECT 'mean_age_after', round(avg(age), 6) FROM a
UNION ALL SELECT 'paired', count(*) FROM p
UNION ALL SELECT 'age_violations', sum(CASE WHEN age2 <> age + 1 THEN 1 ELSE 0 END) FROM p
UNION ALL SELECT 'moved', round(avg(CAST(school2 <> school AS INTEGER)), 6) FROM p
UNION ALL SELECT 'missing_state_before', round(avg(CAST(state IS NULL AS INTEGER)), 6) FROM b
UNION ALL SELECT 'moved_state', round(avg(CAST(state2 <> state AS INTEGER)), 6) FROM p
UNION ALL SELECT 'rows_before:' || coalesce(CAST(stage AS VARCHAR), 'null'), count(*) FROM b GROUP BY stage
UNION ALL SELECT 'match_rate:' || coalesce(CAST(stage AS VARCHAR), 'null'), round(avg(CAST(school IS NOT NULL AS INTEGER)), 6) FROM b GROUP BY stage
UNION ALL SELECT 'rows_after:' || coalesce(CAST(stage AS VARCHAR), 'null'), count(*) FROM a GROUP BY stage
"""


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User by week: mean value in whole cents, and the first week with a signup of value over 200."""
    events = table(spark, sf_dir, "events").withColumn("week", F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("int"))
    hit = F.when((F.col("event_type") == "signup") & (F.col("value") > 200), F.col("week"))
    treated = events.groupBy("user_id").agg(F.min(hit).alias("g"))
    mean = F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / F.count("*")
    return events.groupBy("user_id", "week").agg(mean.alias("y")).join(treated, "user_id")


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect per group and week, not yet treated users as controls."""
    found = did.att_gt(_weeks(spark, sf_dir), "y", "week", "user_id", "g")
    return found.withColumns({"att": F.round("att", 4), "se": F.round("se", 3)})


_DID = """
WITH e AS (SELECT user_id, CAST((CAST(ts AS DATE) - DATE '2024-01-01') // 7 AS INTEGER) AS week, event_type, value FROM events),
t AS (SELECT user_id, min(CASE WHEN event_type = 'signup' AND value > 200 THEN week END) AS g FROM e GROUP BY 1),
p AS (SELECT e.user_id, e.week, t.g, sum(CAST(round(value * 100) AS BIGINT)) / count(*) AS y FROM e JOIN t USING (user_id) GROUP BY 1, 2, 3),
q AS (SELECT DISTINCT g FROM t WHERE g > (SELECT min(week) FROM e)),
c AS (SELECT a.user_id, q.g AS grp, a.week, CASE WHEN a.g = q.g THEN 1 ELSE 0 END AS d, a.y - b.y AS dy FROM q JOIN p b ON b.week = q.g - 1 JOIN p a ON a.user_id = b.user_id
      WHERE a.g = q.g OR a.g IS NULL OR a.g > greatest(a.week, q.g - 1)),
m AS (SELECT grp, week, avg(CASE WHEN d = 1 THEN dy END) AS m1, avg(CASE WHEN d = 0 THEN dy END) AS m0, var_pop(CASE WHEN d = 1 THEN dy END) AS v1, var_pop(CASE WHEN d = 0 THEN dy END) AS v0,
        CAST(sum(d) AS BIGINT) AS treated, CAST(sum(1 - d) AS BIGINT) AS controls FROM c GROUP BY 1, 2 HAVING sum(d) > 0),
f AS (SELECT *, m1 - m0 AS att, CASE WHEN week <> grp - 1 THEN sqrt(v1 / treated + v0 / nullif(controls, 0)) END AS se FROM m)
"""
EFFECTS_SQL = _DID + 'SELECT grp AS "group", week AS period, round(att, 4) AS att, round(se, 3) AS se, treated, controls FROM f'


def robust_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubly robust effects per group and week, with errors: covariates are the user's events and mean value of the first week.

    Fitted step by step, which SQL cannot express: the tests hold the estimator
    against a plain one.
    """
    weeks = _weeks(spark, sf_dir)
    events = table(spark, sf_dir, "events").where(F.datediff("ts", F.lit("2024-01-01")) < 7)
    first = events.groupBy("user_id").agg(F.count("*").cast("double").alias("events"), (F.avg("value") / 100).alias("mean_value"))
    found = did.att_gt(weeks.join(first, "user_id"), "y", "week", "user_id", "g", ["events", "mean_value"])
    return found.withColumns({"att": F.round("att", 4), "se": F.round("se", 3)})


def dynamic_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = _weeks(spark, sf_dir)
    effects, influence = did.estimate(weeks, "y", "week", "user_id", "g")
    found = did.dynamic(effects, did.group_sizes(weeks, "user_id", "g"), influence, weeks, "user_id", "g")
    return found.withColumns({"att": F.round("att", 4)} | {c: F.round(c, 3) for c in ("se", "low", "high")})


DYNAMIC_SQL = (
    _DID
    + """, s AS (SELECT g, count(*) AS n FROM t WHERE g IS NOT NULL GROUP BY 1),
k AS (SELECT f.*, CAST(week - grp AS INTEGER) AS e, s.n FROM f JOIN s ON s.g = f.grp WHERE att IS NOT NULL),
a AS (SELECT e, sum(att * n) / sum(n) AS att, sum(n) AS w, count(*) AS groups FROM k GROUP BY 1),
i AS (
  SELECT k.e, c.user_id, CASE WHEN d = 1 THEN (dy - m1) / treated ELSE (m0 - dy) / controls END * n / w AS psi FROM c JOIN k USING (grp, week) JOIN a ON a.e = k.e
  UNION ALL SELECT k.e, t.user_id, (k.att - a.att) / w FROM t JOIN k ON k.grp = t.g JOIN a ON a.e = k.e
),
u AS (SELECT e, user_id, sum(psi) AS psi FROM i GROUP BY 1, 2),
z AS (SELECT e, CASE WHEN e <> -1 THEN sqrt(sum(psi * psi)) END AS se FROM u GROUP BY 1)
SELECT e AS event_time, round(att, 4) AS att, groups, round(se, 3) AS se, round(att - 1.96 * se, 3) AS low, round(att + 1.96 * se, 3) AS high FROM a JOIN z USING (e)"""
)


def classify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest part per type, classed by the offline rules."""
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("label"), F.col("p_size").alias("year"), F.col("p_brand").alias("brand"))
    found = classes.catalogue([parts.where("year <= 25"), parts.where("year > 25")], "label", "year")
    return classes.classify(found, "label").select("label", "year", "field")


CLASSIFY_SQL = """
SELECT label, year, CASE WHEN l LIKE '%engen%' OR l LIKE '%engin%' OR l LIKE '%mecan%' OR l LIKE '%eletr%' OR l LIKE '%civil%' THEN 'engineering'
  WHEN l LIKE '%econom%' OR l LIKE '%admin%' OR l LIKE '%contab%' OR l LIKE '%negoc%' OR l LIKE '%gest%' THEN 'business' ELSE 'other' END AS field
FROM (SELECT p_type AS label, lower(p_type) AS l, min(p_size) AS year FROM part GROUP BY 1, 2)
"""


def stacked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers and parts stacked by name under common columns, with missing ones null."""
    named = lambda name, key, label, extra=(): table(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(label).alias("label"), *extra)
    frames = [
        named("customer", "c_custkey", "c_name", [F.col("c_acctbal").alias("balance")]),
        named("supplier", "s_suppkey", "s_name", [F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")]),
        named("part", "p_partkey", "p_name", [F.col("p_size").alias("size")]),
    ]
    return union_by_name(frames)


STACKED_SQL = """
SELECT c_custkey AS id, c_name AS label, c_acctbal AS balance, CAST(NULL AS INTEGER) AS nation, CAST(NULL AS INTEGER) AS size FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, s_nationkey, NULL FROM supplier UNION ALL SELECT p_partkey, p_name, NULL, NULL, p_size FROM part
"""


def outcome_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines' outcomes and the supplier of the outcome: fan-out stays; flags by year. Orders without lines have no flag."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", _year("o_orderdate").alias("year"))
    outcome = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_returnflag")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = panel.outcome_panel(orders, outcome, suppliers, ["o_orderkey"], "l_suppkey")
    return rows.groupBy("year", "l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("s_nationkey").alias("nations"))


OUTCOME_SQL = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, l_returnflag, count(*) AS n, count(DISTINCT o_orderkey) AS orders, count(DISTINCT s_nationkey) AS nations
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2
"""


def participation_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per year: eligible are those with a large order, participating those whose large order is urgent. A customer has a row per order, and counts once; one id is missing."""
    orders = table(spark, sf_dir, "orders").select(F.nullif("o_custkey", F.lit(7)).alias("customer"), _year("o_orderdate").alias("year"), "o_totalprice", "o_orderpriority")
    found = panel.shares_by_period(orders, "customer", "year", F.col("o_totalprice") > 300000, F.col("o_orderpriority") == "1-URGENT")
    return found.withColumn("percent", F.round("percent", 6))


PARTICIPATION_SQL = """
WITH o AS (SELECT coalesce(nullif(o_custkey, 7), -1) AS c, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority = '1-URGENT' AS urgent FROM orders WHERE o_totalprice > 300000)
SELECT year, count(DISTINCT c) AS eligible, nullif(count(DISTINCT c) FILTER (urgent), 0) AS participating, round(100.0 * nullif(count(DISTINCT c) FILTER (urgent), 0) / count(DISTINCT c), 6) AS percent FROM o GROUP BY 1
"""


def schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the order table, by position."""
    return schema_of(table(spark, sf_dir, "orders")).select("position", "name")


SCHEMA_SQL = "SELECT CAST(row_number() OVER () AS INTEGER) AS position, column_name AS name FROM (DESCRIBE orders)"

QUERIES = {
    "q04_modal_previous": modal_previous,
    "q05_one_or_many": one_or_many,
    "q06_duplication_classes": duplication_classes,
    "q08_full_outer_panel": full_outer_panel,
    "q08b_three_way_merge": three_way_merge,
    "q09_levels_one_pass": levels,
    "q10_histories": user_histories,
    "q10b_cohort_shares": cohort_shares,
    "q10c_runs": user_runs,
    "q10e_stop_shares": stop_shares,
    "q10d_series": user_series,
    "q14_unpivot_counts": unpivot_counts,
    "q15_null_profile": null_profile,
    "q17_backcast": backcast,
    "q18_replication_checks": replication_checks,
    "q18b_distributions": distributions,
    "q19_never_stops": never_stops,
    "q21_effects": effects,
    "q21b_dynamic_effects": dynamic_effects,
    "q21c_robust_effects": robust_effects,
    "q22_classify": classify_names,
    "q23_stacked_sources": stacked_sources,
    "q26_outcome_panel": outcome_panel,
    "q27_participation_by_year": participation_by_year,
    "q28_schema": schema_rows,
}
ORACLE_SQL = {
    "q04_modal_previous": MODAL_SQL,
    "q05_one_or_many": ONE_SQL,
    "q06_duplication_classes": CLASSES_SQL,
    "q08_full_outer_panel": FULL_SQL,
    "q08b_three_way_merge": MERGE_SQL,
    "q09_levels_one_pass": LEVELS_SQL,
    "q10_histories": HISTORY_SQL,
    "q10b_cohort_shares": COHORT_SQL,
    "q10c_runs": RUNS_SQL,
    "q10e_stop_shares": STOPS_SQL,
    "q10d_series": SERIES_SQL,
    "q14_unpivot_counts": UNPIVOT_SQL,
    "q15_null_profile": NULL_SQL,
    "q17_backcast": BACKCAST_SQL,
    "q18_replication_checks": CHECKS_SQL,
    "q18b_distributions": DISTRIBUTION_SQL,
    "q19_never_stops": NEVER_SQL,
    "q21_effects": EFFECTS_SQL,
    "q21b_dynamic_effects": DYNAMIC_SQL,
    "q22_classify": CLASSIFY_SQL,
    "q23_stacked_sources": STACKED_SQL,
    "q26_outcome_panel": OUTCOME_SQL,
    "q27_participation_by_year": PARTICIPATION_SQL,
    "q28_schema": SCHEMA_SQL,
}
