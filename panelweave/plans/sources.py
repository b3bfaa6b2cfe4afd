"""Queries on reading and writing, column tools, row numbers and samples.

What they write goes to the shared folder and is read back: the result must be the
table it came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.functions.columns import as_number, bucket, normal_id, to_double, to_int, year_of
from panelweave.operators import classify as classes, graph, panel
from panelweave.operators.relational import cast_columns, columns_between, columns_starting, order_numeric, row_numbers, sample_n, suffix_columns
from panelweave.plans.panels import CLASSIFY_SQL
from panelweave.session import scratch, table
from panelweave.sources import io


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV with a token for missing, read back by extension with a schema and required columns."""
    path = scratch(spark, "customers.csv")
    customers = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    io.write_any(customers, path)
    return io.read_any(spark, path, customers.columns, schema=customers.schema)


CSV_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer"


def delimited_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in Latin-1 with semicolons, read from a folder of files with two tokens for missing; types are inferred for one copy and cast for the other."""
    path = scratch(spark, "parts.csv")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("peça "), "p_name").alias("p_name"), F.when(F.col("p_size") < 10, "NULL").when(F.col("p_size") < 20, "NA").otherwise(F.col("p_size").cast("string")).alias("p_size"))
    parts.write.options(header=True, sep=";", encoding="ISO-8859-1").csv(path)
    options = {"sep": ";", "encoding": "ISO-8859-1", "nulls": ("NA", "NULL")}
    text = io.read_csv(spark, path, **options).select(F.col("p_partkey").cast("long"), "p_name", to_int(F.col("p_size")).alias("p_size"))
    inferred = io.read_csv(spark, path, infer=True, **options).groupBy(F.col("p_partkey").cast("long").alias("p_partkey")).agg(F.count("p_size").alias("sized"))
    return text.join(inferred, "p_partkey")


DELIMITED_SQL = "SELECT p_partkey, 'peça ' || p_name AS p_name, CASE WHEN p_size >= 20 THEN p_size END AS p_size, CAST(p_size >= 20 AS BIGINT) AS sized FROM part"


def _years(orders: DataFrame) -> list[int]:
    return sorted(r["year"] for r in orders.select("year").distinct().collect())  # a few years


def drifting_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in one CSV folder per year; the customer goes by three names, the priority is missing in every third year."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("year"))
    paths = {}
    for y in _years(orders):
        rows = orders.where(F.col("year") == y).drop("year").withColumnRenamed("o_custkey", ("CUSTOMER", "cust_id", "NU_CLIENTE")[y % 3])
        paths[y] = scratch(spark, f"orders-{y}.csv")
        io.write_any(rows.drop("o_orderpriority") if y % 3 == 0 else rows, paths[y])
    names = {"order": ["o_orderkey"], "customer": ["customer", "CUST_ID", "NU_CLIENTE"], "price": ["o_totalprice"], "priority": ["o_orderpriority"]}
    raw = io.read_years(spark, paths, names, optional=["priority"])
    return raw.select(to_int(F.col("order"), "long").alias("o_orderkey"), to_int(F.col("customer"), "long").alias("o_custkey"), to_double(F.col("price")).alias("o_totalprice"), F.col("priority").alias("o_orderpriority"), "year")


DRIFT_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN year(o_orderdate) % 3 <> 0 THEN o_orderpriority END AS o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
"""


def exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as exams of five scores, in a CSV folder per year whose score names drift: mean scores where all five and the person are there."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    lines = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey")
    scores = ["l_quantity", "l_extendedprice", F.nullif("l_discount", F.lit(0.0)), "l_tax", F.col("l_linenumber").cast("double")]
    subjects = ("CN", "CH", "LC", "MT", "REDACAO")
    paths = {}
    for y in _years(orders):
        prefix = "NU_NOTA_" if y % 2 else "NOTA_"
        names = [("NU_NOTA_" if s == "REDACAO" else prefix) + s for s in subjects]
        rows = lines.where(F.col("year") == y).select(F.nullif("l_suppkey", F.lit(1)).alias("CPF_MASC"), *[(F.col(s) if isinstance(s, str) else s).alias(n) for s, n in zip(scores, names)])
        paths[y] = scratch(spark, f"exams-{y}.csv")
        io.write_any(rows, paths[y])
    found = io.read_exams(spark, paths)
    return found.groupBy(to_int(F.col("person"), "long").alias("person"), "year").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("mean_score") * 1000).cast("long")) / F.count("*"), 3).alias("mean_score"))


EXAMS_SQL = """
SELECT l_suppkey AS person, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n,
       round(sum(CAST(round((l_quantity + l_extendedprice + l_discount + l_tax + l_linenumber) / 5 * 1000) AS BIGINT)) / count(*), 3) AS mean_score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount <> 0 AND l_suppkey <> 1 GROUP BY 1, 2
"""


def bucket_join(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """Lines and orders written in buckets of the order's hash, then joined bucket by bucket, each from its folders alone."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    at = [scratch(spark, name) for name in ("orders", "lines")]
    for df, path in zip((orders, lines), at):
        io.write_buckets(df, path, "o_orderkey", n)
    parts = []
    for k in range(1, n + 1):
        a, b = (io.read_bucket(spark, path, k) for path in at)
        parts.append(a.join(b.drop("bucket"), "o_orderkey"))
    joined = io.union_by_name(parts).withColumn("own", (F.col("bucket") == bucket(F.col("o_orderkey"), n)).cast("int"))
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.count_distinct("o_custkey").alias("customers"), F.min("own").alias("all_in_own_bucket"))


BUCKET_SQL = """
SELECT o_orderstatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(DISTINCT o_custkey) AS customers, 1 AS all_in_own_bucket
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
"""


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written year by year, each year appended to the same Parquet folder."""
    path = scratch(spark, "appended.parquet")
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    for y in _years(orders):
        io.write_any(orders.where(F.col("year") == y), path, mode="append")
    return io.read_any(spark, path, ["o_orderkey", "year"]).select("o_orderkey", "o_custkey", "o_totalprice", "year")


APPENDED_SQL = "SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders"


def local_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a frame of the driver, kept as a table; named relations joined by SQL, then their names dropped."""
    nations = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]  # 25 rows by definition
    kept = io.keep_local(spark, nations, "n_nationkey int, n_name string", scratch(spark, "nations.parquet"))
    drop = io.register(spark, kept_nations=kept, all_suppliers=table(spark, sf_dir, "supplier"))
    out = spark.sql("SELECT n_name, count(*) AS suppliers, max(s_acctbal) AS most FROM all_suppliers JOIN kept_nations ON s_nationkey = n_nationkey GROUP BY n_name")
    drop()
    return out


LOCAL_SQL = "SELECT n_name, count(*) AS suppliers, max(s_acctbal) AS most FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the tables whose files the folder holds."""
    found = io.list_files(spark, sf_dir, "*.parquet").select(F.regexp_extract("path", r"/([a-z]+)\.parquet", 1).alias("name"), "length")
    return found.where("name != ''").groupBy("name").agg((F.sum("length") > 0).alias("filled"))


FILES_SQL = "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name, true AS filled"


def no_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidation of suppliers paired only with themselves or with nothing: typed, and without rows."""
    pairs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("x"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).alias("y"))
    return graph.consolidate_ids(pairs.unionByName(io.empty(spark, "x string, y string")), "x", "y")[0]


NO_PAIRS_SQL = "SELECT CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS canonical_id, CAST(NULL AS VARCHAR) AS cluster_id, CAST(NULL AS INTEGER) AS cluster_size WHERE false"


def column_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a range of columns as text and a suffix on all but the key, then cast back where they are numbers."""
    parts = table(spark, sf_dir, "part")
    chosen = ["p_partkey", *columns_between(parts, "p_type", "p_retailprice")]
    as_text = cast_columns(parts.select(chosen), [c for c in chosen if c != "p_partkey"], lambda c: c.cast("string"))
    renamed = suffix_columns(as_text, "_text", keep=["p_partkey"])
    assert columns_starting(renamed, "p_") == renamed.columns
    return renamed.select("*", to_int(F.col("p_retailprice_text")).alias("whole"), to_double(F.col("p_type_text")).alias("no_number"), year_of(F.concat(F.lit("19"), F.lpad("p_size_text", 2, "0"), F.lit("-05-01"))).alias("year"))


COLUMNS_SQL = """
SELECT p_partkey, p_type AS p_type_text, CAST(p_size AS VARCHAR) AS p_size_text, CAST(p_retailprice AS VARCHAR) AS p_retailprice_text,
       CAST(trunc(p_retailprice) AS INTEGER) AS whole, CAST(NULL AS DOUBLE) AS no_number, CAST(1900 + p_size AS INTEGER) AS year
FROM part
"""


def finished_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by year with or without an enrolment or participation; those that stay, marked if they ordered in the first year: distinct ones per year."""
    orders = table(spark, sf_dir, "orders").select(F.nullif("o_custkey", F.lit(7)).alias("customer"), F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderpriority")
    rows = orders.withColumns({"enrolled": F.when(F.col("o_orderstatus") == "F", 1), "participant": (F.col("o_orderpriority") == "1-URGENT").cast("int")})
    first = orders.where("year = 1995").select("customer")
    final = panel.finish_panel(rows, "enrolled", "participant", first, "customer", "in_first_year")
    kept = final.groupBy("year").agg(F.count("*").alias("rows"), F.sum("in_first_year").alias("rows_of_first"))
    return kept.join(panel.coverage_by_period(final, "customer", "year", F.col("participant") == 1).withColumnRenamed("entities", "participants"), "year", "left")


FINISHED_SQL = """
WITH o AS (SELECT coalesce(nullif(o_custkey, 7), -1) AS c, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus = 'F' AS enrolled, o_orderpriority = '1-URGENT' AS part FROM orders)
SELECT year, count(*) AS rows, CAST(sum(CASE WHEN c IN (SELECT c FROM o WHERE year = 1995) THEN 1 ELSE 0 END) AS BIGINT) AS rows_of_first, nullif(count(DISTINCT c) FILTER (part), 0) AS participants
FROM o WHERE enrolled OR part GROUP BY year
"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its number by price, then key, over the whole table."""
    return row_numbers(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"])


NUMBERED_SQL = "SELECT o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row FROM orders"


def top_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten distinct supplier and nation ids as text: numbers by value, then other ids."""
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id")).union(table(spark, sf_dir, "nation").select("n_name"))
    ids = ids.distinct()
    return ids.orderBy(*order_numeric(F.col("id"))).limit(10).select("id", as_number(F.col("id")).alias("number"))


TOP_SQL = """
SELECT id, TRY_CAST(id AS DOUBLE) AS number FROM (SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier UNION SELECT n_name FROM nation)
ORDER BY TRY_CAST(id AS DOUBLE) NULLS LAST, id LIMIT 10
"""


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty parts at random: how many there are, how many differ, how many are parts."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    drawn = sample_n(parts, 50, 1914)
    known = parts.withColumnRenamed("p_partkey", "k")
    return drawn.join(known, F.col("p_partkey") == F.col("k"), "left").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("distinct"), F.count("k").alias("known"))


SAMPLED_SQL = "SELECT least(count(*), 50) AS n, least(count(*), 50) AS distinct, least(count(*), 50) AS known FROM part"


def long_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers times ten to the ten as floating numbers, to ids without an exponent."""
    big = F.col("o_orderkey").cast("double") * 1e10
    return table(spark, sf_dir, "orders").select("o_orderkey", normal_id(big, numeric=True).alias("id"))


LONG_SQL = "SELECT o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) * 10000000000 AS VARCHAR) AS id FROM orders"


def classify_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of the part types, asked for by four tasks at most."""
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("label"), F.col("p_size").alias("year"))
    return classes.classify(classes.catalogue([parts], "label", "year"), "label", workers=4).select("label", "year", "field")


QUERIES = {
    "q29_csv_round_trip": csv_round_trip,
    "q29b_delimited_folder": delimited_folder,
    "q30_drifting_years": drifting_years,
    "q31_exams": exams,
    "q32_bucket_join": bucket_join,
    "q33_appended": appended,
    "q34_local_table": local_table,
    "q35_files": files,
    "q36_no_pairs": no_pairs,
    "q37_column_tools": column_tools,
    "q38_finished_panel": finished_panel,
    "q39_row_numbers": numbered,
    "q40_top_ids": top_ids,
    "q41_sampled": sampled,
    "q42_long_ids": long_ids,
    "q43_classify_parallel": classify_parallel,
}
ORACLE_SQL = {
    "q29_csv_round_trip": CSV_SQL,
    "q29b_delimited_folder": DELIMITED_SQL,
    "q30_drifting_years": DRIFT_SQL,
    "q31_exams": EXAMS_SQL,
    "q32_bucket_join": BUCKET_SQL,
    "q33_appended": APPENDED_SQL,
    "q34_local_table": LOCAL_SQL,
    "q35_files": FILES_SQL,
    "q36_no_pairs": NO_PAIRS_SQL,
    "q37_column_tools": COLUMNS_SQL,
    "q38_finished_panel": FINISHED_SQL,
    "q39_row_numbers": NUMBERED_SQL,
    "q40_top_ids": TOP_SQL,
    "q41_sampled": SAMPLED_SQL,
    "q42_long_ids": LONG_SQL,
    "q43_classify_parallel": CLASSIFY_SQL,
}
