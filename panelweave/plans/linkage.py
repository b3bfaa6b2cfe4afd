"""Queries on linkage, as-of matching and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.functions.columns import ratio
from panelweave.functions.text import clean_name
from panelweave.operators import asof, graph, linkage, panel
from panelweave.operators.relational import duplicated, keep_first, mark_join, update_join
from panelweave.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def asof_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases get the value of the user's latest earlier view; then means by user group. Every purchase comes twice and counts once."""
    events = _events(spark, sf_dir)
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    bought = bought.union(bought)
    seen = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("seen_id"), "value")
    found = asof.asof_window(bought, seen, ["user_id"], "ts", "seen_at", ["value"], tie=["seen_id"])
    groups = asof.course_ranking(found.withColumn("user_group", F.col("user_id") % 10), ["user_group"], "value", key=["event_id"])
    return groups.withColumn("mean_score", F.round("mean_score", 6))


ASOF_SQL = """
WITH b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
m AS (
  SELECT b.event_id, b.user_id, v.value, row_number() OVER (PARTITION BY b.event_id ORDER BY v.ts DESC, v.event_id DESC) AS n
  FROM b LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = b.user_id AND v.ts < b.ts
)
SELECT user_id % 10 AS user_group, round(avg(value), 6) AS mean_score, count(*) AS n_entrants, count(value) AS n_scored
FROM m WHERE n = 1 GROUP BY 1
"""


def asof_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches row by row, with the timeline cut by day so that no user is one task's."""
    events = _events(spark, sf_dir)
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("seen_id"))
    found = asof.asof_window(bought, seen, ["user_id"], "ts", "seen_at", ["seen_id"], slice_of=lambda t: F.to_date(t))
    return found.select("event_id", "user_id", "seen_id")


ASOF_ROWS_SQL = """
WITH m AS (
  SELECT b.event_id, b.user_id, v.event_id AS seen_id, row_number() OVER (PARTITION BY b.event_id ORDER BY v.ts DESC, v.event_id DESC) AS n
  FROM events b LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = b.user_id AND v.ts < b.ts WHERE b.event_type = 'purchase'
)
SELECT event_id, user_id, seen_id FROM m WHERE n = 1
"""


def link_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines linked to their supplier and order's customer: matched orders, and those whose nations differ."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("suppkey"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    bought = linkage.link_exact(lines, suppliers, ["suppkey"])
    named = linkage.link_exact(orders, customers, ["o_custkey"]).drop("o_custkey_1")
    linked = linkage.link_exact(bought.drop("suppkey_1"), named, ["l_orderkey"])
    return linkage.discrepancies(linked, "l_orderkey", {"nation_differs": ("nation", "nation_1"), "balance_differs": ("balance", "balance_1")})


LINK_SQL = """
SELECT count(DISTINCT l_orderkey) AS matched,
       count(DISTINCT CASE WHEN s_nationkey <> c_nationkey THEN l_orderkey END) AS nation_differs,
       count(DISTINCT CASE WHEN s_acctbal <> c_acctbal THEN l_orderkey END) AS balance_differs
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
"""


def id_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct orders, parts and suppliers of all lines in one pass, and the orders with a line shipped in three years, as shares of the orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.when(F.col("l_shipdate").between("1996-01-01", "1998-12-31"), F.col("l_orderkey")).alias("shipped"))
    return linkage.coverage(lines, ["l_orderkey", "l_partkey", "l_suppkey", "shipped"], "l_orderkey")


COVERAGE_SQL = """
SELECT count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT shipped) AS n_shipped,
       count(DISTINCT l_partkey) / count(DISTINCT l_orderkey) AS share_l_partkey, count(DISTINCT l_suppkey) / count(DISTINCT l_orderkey) AS share_l_suppkey,
       count(DISTINCT shipped) / count(DISTINCT l_orderkey) AS share_shipped
FROM (SELECT *, CASE WHEN l_shipdate BETWEEN '1996-01-01' AND '1998-12-31' THEN l_orderkey END AS shipped FROM lineitem)
"""


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First year of each customer and status."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return linkage.first_seen(orders, ["o_custkey", "o_orderstatus"], "year")


FIRST_SEEN_SQL = "SELECT o_custkey, o_orderstatus, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year FROM orders GROUP BY 1, 2"


def match_share_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per year the customers with orders, and the share of them among ids from two sources stacked."""
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_custkey").cast("string").alias("id"))
    users = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("id"))
    rich = table(spark, sf_dir, "customer").where("c_acctbal >= 9000").select(F.col("c_custkey").cast("string").alias("id"))
    return linkage.match_share(orders, users.union(rich), "id", "year").orderBy("year")


MATCH_SQL = """
WITH ids AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal >= 9000),
p AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey AS VARCHAR) AS id FROM orders)
SELECT year, count(*) AS entrants, count(ids.id) AS matched, count(ids.id) / count(*) AS share FROM p LEFT JOIN ids ON p.id = ids.id GROUP BY year
"""


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, cleaned as a name is."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean_name(F.col("text")).cast("binary")).alias("cleaned"))


CLEAN_SQL = "SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(strip_accents(text), '[^a-zA-Z ]', '', 'g'), ' +', ' ', 'g')))) AS cleaned FROM documents"


def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of even keys to the most similar name of odd keys of the same size and initial."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), clean_name(F.concat_ws(" ", "p_name", "p_type")).alias("name"), "p_size")
    parts = linkage.blocking_keys(parts, "name")
    found = linkage.link_fuzzy(parts.where("id % 2 = 0"), parts.where("id % 2 = 1"), ["p_size", "initial"])
    return found.withColumn("similarity", F.round("similarity", 6))


FUZZY_SQL = """
WITH p AS (
  SELECT p_partkey AS id, p_size, lower(trim(regexp_replace(regexp_replace(strip_accents(p_name || ' ' || p_type), '[^a-zA-Z ]', '', 'g'), ' +', ' ', 'g'))) AS name FROM part
), s AS (
  SELECT a.id AS id_left, b.id AS id_right, a.name AS name_left, b.name AS name_right, jaro_similarity(a.name, b.name) AS similarity
  FROM p a JOIN p b ON a.p_size = b.p_size AND substr(split_part(a.name, ' ', 1), 1, 1) = substr(split_part(b.name, ' ', 1), 1, 1) AND a.id % 2 = 0 AND b.id % 2 = 1
)
SELECT id_left, id_right, name_left, name_right, round(similarity, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY id_left ORDER BY similarity DESC, id_right) AS n FROM s WHERE similarity >= 0.9) WHERE n = 1
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts that meet in a line, as ids in pairs."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.concat(F.lit(" "), F.col("l_suppkey").cast("string")).alias("x"), F.concat((F.col("l_partkey") + 100000).cast("string"), F.lit(".0")).alias("y"))


def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical id of every supplier and part that a chain of lines links."""
    return graph.consolidate_ids(_pairs(spark, sf_dir), "x", "y")[0]


def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the suppliers and parts of all lines, with their members."""
    return graph.consolidate_ids(_pairs(spark, sf_dir), "x", "y")[1]


def _components_sql(rounds: int = 16) -> str:
    """Least labels passed on along the edges, a fixed number of times: more than the longest way between two ids of the tables."""
    steps = ["l0 AS (SELECT DISTINCT a AS node, a AS label FROM u)"]
    for k in range(rounds):
        steps.append(f"l{k + 1} AS (SELECT l.node, least(min(l.label), min(n.label)) AS label FROM l{k} l JOIN u ON u.a = l.node JOIN l{k} n ON n.node = u.b GROUP BY l.node)")
    return f"""
WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 100000 AS b FROM lineitem),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
{", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
m AS (SELECT node, label AS root, CAST(count(*) OVER (PARTITION BY label) AS INTEGER) AS cluster_size FROM l{rounds})
"""


_COMPONENTS = _components_sql()
ID_MAP_SQL = _COMPONENTS + "SELECT CAST(node AS VARCHAR) AS id, CAST(root AS VARCHAR) AS canonical_id, CAST(root AS VARCHAR) AS cluster_id, cluster_size FROM m"
SUMMARY_SQL = (
    _COMPONENTS
    + "SELECT CAST(root AS VARCHAR) AS cluster_id, CAST(root AS VARCHAR) AS canonical_id, cluster_size, string_agg(CAST(node AS VARCHAR), '|' ORDER BY node) AS member_ids FROM m GROUP BY root, cluster_size"
)


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order and line number come more than once."""
    return duplicated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


DUPLICATES_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
"""


def keep_first_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First part per name by size, then key."""
    parts = table(spark, sf_dir, "part").select("p_name", "p_size", "p_partkey", "p_brand")
    return keep_first(parts, ["p_name"], ["p_size", "p_partkey"])


KEEP_FIRST_SQL = "SELECT p_name, p_size, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) AS n FROM part) WHERE n = 1"


def short_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to the users whose id is the customer's without its last digit."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("code"))
    users = _events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("user")).agg(F.count("*").alias("n"))
    return panel.join_by_short_key(customers, users, "code", "user").select("c_custkey", "user", "n")


SHORT_KEY_SQL = """
SELECT c_custkey, u.user_id AS user, n FROM customer
JOIN (SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM events GROUP BY 1) u ON u.user_id = left(CAST(c_custkey AS VARCHAR), length(CAST(c_custkey AS VARCHAR)) - 1)
"""


def mark_and_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers marked where they ordered in 1995, their segment replaced where they are users. Id 7 is missing everywhere: missing ids match each other."""
    known = lambda c: F.nullif(F.col(c), F.lit(7)).alias("c_custkey")
    customers = table(spark, sf_dir, "customer").select(known("c_custkey"), "c_mktsegment")
    early = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1995).select(known("o_custkey"))
    users = _events(spark, sf_dir).select(known("user_id"), F.lit("USER").alias("c_mktsegment"))
    return update_join(mark_join(customers, early, ["c_custkey"], "early"), users, ["c_custkey"], "c_mktsegment")


MARK_SQL = """
WITH c AS (SELECT nullif(c_custkey, 7) AS k, c_mktsegment FROM customer),
u AS (SELECT DISTINCT nullif(user_id, 7) AS k FROM events), e AS (SELECT DISTINCT nullif(o_custkey, 7) AS k FROM orders WHERE year(o_orderdate) = 1995)
SELECT c.k AS c_custkey, CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.k IS NOT DISTINCT FROM c.k) THEN 'USER' ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.k IS NOT DISTINCT FROM c.k) THEN 1 ELSE 0 END AS early
FROM c
"""


def semi_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers that have an urgent one, by priority: counts and shares."""
    orders = table(spark, sf_dir, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    kept = orders.join(urgent, "o_custkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return kept.withColumn("per_customer", F.round(ratio(F.col("n"), F.col("customers")), 6))


SEMI_SQL = """
SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(count(*) / count(DISTINCT o_custkey), 6) AS per_customer
FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1
"""

QUERIES = {
    "q01_asof_group_mean": asof_group_mean,
    "q01b_asof_rows": asof_rows,
    "q02_link_discrepancies": link_discrepancies,
    "q02b_id_coverage": id_coverage,
    "q02c_first_seen": first_seen,
    "q03_match_share_year": match_share_year,
    "q07_duplicate_rows": duplicate_rows,
    "q11_clean_name": clean_names,
    "q12_fuzzy_best": fuzzy_best,
    "q13_id_map": id_map,
    "q13b_cluster_summary": cluster_summary,
    "q16_keep_first": keep_first_part,
    "q20_short_key_join": short_key_join,
    "q24_mark_and_update": mark_and_update,
    "q25_semi_restrict": semi_restrict,
}
ORACLE_SQL = {
    "q01_asof_group_mean": ASOF_SQL,
    "q01b_asof_rows": ASOF_ROWS_SQL,
    "q02_link_discrepancies": LINK_SQL,
    "q02b_id_coverage": COVERAGE_SQL,
    "q02c_first_seen": FIRST_SEEN_SQL,
    "q03_match_share_year": MATCH_SQL,
    "q07_duplicate_rows": DUPLICATES_SQL,
    "q11_clean_name": CLEAN_SQL,
    "q12_fuzzy_best": FUZZY_SQL,
    "q13_id_map": ID_MAP_SQL,
    "q13b_cluster_summary": SUMMARY_SQL,
    "q16_keep_first": KEEP_FIRST_SQL,
    "q20_short_key_join": SHORT_KEY_SQL,
    "q24_mark_and_update": MARK_SQL,
    "q25_semi_restrict": SEMI_SQL,
}
