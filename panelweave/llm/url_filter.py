"""URL filters by temporal list join, with built-in functions only.

A list is a history: dated entries (``kind, value, action, at``) switch a domain
or a path prefix to ``block``, ``allow`` or ``off``. Per value they become validity
intervals, from an entry to the next. A capture is judged by the intervals that
hold at its fetch time: its host, every parent domain and every path prefix are
looked up by equality, the interval by time. The most specific active entry wins
(a prefix over a domain, then the longer value); without one a capture passes.

Times are those of the captures: a capture with a time of day is judged to the
microsecond, one with a date alone by the entries of that date and before.

The intervals of a value are kept in slices of ``SLICE`` entries in order of time, a
row each; a value of several slices also has a directory of their first times, by
which a capture finds its one slice. So a capture meets at most one row for each of
its keys, however often a value was switched and however far its time is from the
list's. Verdicts are made once per distinct url and time, so a page fetched again
and again costs nothing more. Slices and directories are broadcast only where their
counted entries are few; otherwise they are shuffled and adaptive execution splits
hot hosts.

Defined results: null or unparsable urls and null times pass; urls of any length are
parsed whole; entries with null fields are ignored; of entries of one value at one
time the last action by name counts; repeated captures are judged each; columns of
any name pass through, but for those of the results, which are replaced; an empty
list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from panelweave.llm.common import numbered, with_results
from panelweave.session import materialise, table

#: Counted entries (of intervals or of directories) up to which they are broadcast.
BROADCAST_ROWS = 200_000

#: Entries of a value that are one row.
SLICE = 256


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def validity(entries: DataFrame, kind: str = "timestamp") -> DataFrame:
    """``kind, value, action, since, until``: disjoint intervals per value, ``until`` exclusive and null if open; ``off`` is left out. Times are cast to ``kind``."""
    good = entries.select("kind", F.lower("value").alias("value"), "action", F.col("at").cast(kind).alias("since")).dropna()
    good = good.groupBy("kind", "value", "since").agg(F.max("action").alias("action"))
    order = Window.partitionBy("kind", "value").orderBy("since")
    return good.withColumn("until", F.lead("since").over(order)).where("action != 'off'")


def slices(intervals: DataFrame, size: int | None = None) -> DataFrame:
    """One row per value and slice of its history: ``kind, value, slice, starts_at, intervals``."""
    order = Window.partitionBy("kind", "value").orderBy("since")
    number = F.floor((F.row_number().over(order) - 1) / (size or SLICE)).cast("int")
    rows = intervals.select("kind", "value", number.alias("slice"), F.struct("since", "until", "action").alias("i"))
    return rows.groupBy("kind", "value", "slice").agg(F.min("i.since").alias("starts_at"), F.collect_list("i").alias("intervals"))


def _bounded(df: DataFrame, entries: str) -> DataFrame:
    """The table, for broadcast if the entries of its arrays are few."""
    return F.broadcast(df) if (df.agg(F.sum(F.size(entries).cast("long"))).first()[0] or 0) <= BROADCAST_ROWS else df


def _keys(depth: int) -> Column:
    """Array of ``kind, value, rank`` of a capture: parent domains by labels, prefixes of at most ``depth`` segments."""
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")),
    )
    if depth <= 0:
        return domains
    none = F.array().cast("array<struct<kind:string,value:string>>")
    prefixes = F.transform(
        F.sequence(F.lit(2), F.least(F.size(parts), F.lit(depth + 1))),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", "host", F.array_join(F.slice(parts, 2, i - 1), "/")).alias("value")),
    )
    return F.concat(domains, F.when(F.size(parts) >= 2, prefixes).otherwise(none))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``blocked``, and the deciding entry's ``entry_kind``, ``entry`` and ``entry_since`` (null without one)."""
    kind = captures.schema[at].dataType
    kind = kind.simpleString() if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "timestamp"
    history = materialise(slices(validity(entries, kind)), "intervals")
    depth = history.where("kind = 'prefix'").agg(F.max(F.size(F.split("value", "/")) - 1).alias("d")).first()["d"] or 0
    directory = history.groupBy("kind", "value").agg(F.array_sort(F.collect_list("starts_at")).alias("starts")).where(F.size("starts") > 1)

    names, rows = captures.columns, numbered(captures)
    own_url, own_at = (F.col(f"c{names.index(c)}") for c in (url, at))
    own_at = own_at.cast(kind)
    distinct = rows.select(own_url.alias("u"), own_at.alias("time")).dropna().distinct()
    parsed = distinct.select("u", "time", host_of(F.col("u")).alias("host"), F.lower(path_of(F.col("u"))).alias("path")).where("host != ''")
    keyed = parsed.select("u", "time", F.explode(F.array_distinct(_keys(depth))).alias("key")).select("u", "time", "key.kind", "key.value", F.lit(0).alias("slice"))
    if directory.limit(1).count():
        directory = materialise(directory, "directory")
        keyed = keyed.drop("slice").join(_bounded(directory, "starts"), ["kind", "value"], "left")
        place = F.size(F.filter("starts", lambda s: s <= F.col("time"))) - 1
        keyed = keyed.select("u", "time", "kind", "value", F.when(F.col("starts").isNull(), 0).otherwise(place).alias("slice"))
    met = keyed.join(_bounded(history.drop("starts_at"), "intervals"), ["kind", "value", "slice"])
    active = F.filter("intervals", lambda i: (i["since"] <= F.col("time")) & (i["until"].isNull() | (F.col("time") < i["until"])))
    met = met.select("u", "time", "kind", "value", F.get(active, 0).alias("i")).where("i is not null")
    # 'prefix' comes after 'domain', so the greatest struct is the most specific
    best = met.groupBy("u", "time").agg(F.max(F.struct("kind", F.length("value").alias("size"), "value", "i")).alias("best"))
    found = rows.join(best, (own_url == F.col("u")) & (own_at == F.col("time")), "left")
    results = {
        "blocked": F.coalesce(F.col("best.i.action") == "block", F.lit(False)),
        "entry_kind": F.col("best.kind"),
        "entry": F.col("best.value"),
        "entry_since": F.col("best.i.since"),
    }
    return with_results(found, names, results)


FIRST_DAY = "2024-01-01"


def demo_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: the tables hold none, so dates follow from the digest of each host."""
    hosts = pages.select(host_of(F.col("url")).alias("h")).where("h != ''").distinct()
    hosts = hosts.withColumn("n", F.conv(F.substring(F.md5("h"), 1, 7), 16, 10).cast("long"))
    n = F.col("n")
    # a day, and the hour of it that follows from the digest too
    day = lambda days: F.date_add(F.lit(FIRST_DAY).cast("date"), days.cast("int")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (n % 24).cast("int"))

    def entry(kind: str, value: Column, action: str, at: Column, where: Column) -> Column:
        return F.when(where, F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(action).alias("action"), at.alias("at")))

    made = F.array_compact(
        F.array(
            entry("domain", F.col("h"), "block", day(n % 366), n % 3 == 0),
            entry("domain", F.col("h"), "off", day(n % 366 + 30 + n % 90), n % 3 == 0),
            entry("domain", F.col("h"), "block", day(n % 366 + 200), n % 6 == 0),
            entry("prefix", F.concat("h", F.lit("/en")), "allow", day(n % 200), n % 2 == 0),
            entry("prefix", F.concat("h", F.lit("/de")), "block", day(n % 100), n % 5 == 0),
        )
    )
    fixed = [
        ("domain", "free-bets.example.com", "block", "2024-03-01 06:00:00"),
        ("domain", "free-bets.example.com", "off", "2024-09-01 18:30:00"),
        ("domain", "cheap-pills.example.com", "block", "2024-02-01 12:00:00"),
        ("domain", "example.net", "block", "2024-06-15 15:00:00"),
        ("domain", "example.net", "off", "2024-06-30 09:00:00"),
    ]
    values = ", ".join(f"('{k}', '{v}', '{a}', TIMESTAMP_NTZ '{t}')" for k, v, a, t in fixed)
    literal = pages.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(kind, value, action, at)")
    return hosts.select(F.explode(made).alias("e")).select("e.*").unionByName(literal)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    k = F.col("page_id")
    fetched = F.date_add(F.lit(FIRST_DAY).cast("date"), (k % 366).cast("int")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"), (k % 60).cast("int"))
    told = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return judge(pages.withColumn("fetched_at", fetched), demo_list(pages)).select("page_id", told("fetched_at"), "blocked", "entry_kind", "entry", told("entry_since"))


SQL = rf"""
WITH c AS (
  SELECT page_id, url, CAST(DATE '{FIRST_DAY}' + CAST(page_id % 366 AS INTEGER) AS TIMESTAMP) + to_hours(page_id % 24) + to_minutes(page_id % 60) AS day,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1) AS host,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path
  FROM pages
), h AS (
  SELECT DISTINCT host AS h, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS n FROM c WHERE host <> ''
), e AS (
  SELECT 'domain' AS kind, h AS value, 'block' AS action, CAST(DATE '{FIRST_DAY}' + CAST(n % 366 AS INTEGER) AS TIMESTAMP) + to_hours(n % 24) AS d FROM h WHERE n % 3 = 0
  UNION ALL SELECT 'domain', h, 'off', CAST(DATE '{FIRST_DAY}' + CAST(n % 366 + 30 + n % 90 AS INTEGER) AS TIMESTAMP) + to_hours(n % 24) FROM h WHERE n % 3 = 0
  UNION ALL SELECT 'domain', h, 'block', CAST(DATE '{FIRST_DAY}' + CAST(n % 366 + 200 AS INTEGER) AS TIMESTAMP) + to_hours(n % 24) FROM h WHERE n % 6 = 0
  UNION ALL SELECT 'prefix', h || '/en', 'allow', CAST(DATE '{FIRST_DAY}' + CAST(n % 200 AS INTEGER) AS TIMESTAMP) + to_hours(n % 24) FROM h WHERE n % 2 = 0
  UNION ALL SELECT 'prefix', h || '/de', 'block', CAST(DATE '{FIRST_DAY}' + CAST(n % 100 AS INTEGER) AS TIMESTAMP) + to_hours(n % 24) FROM h WHERE n % 5 = 0
  UNION ALL SELECT 'domain', 'free-bets.example.com', 'block', TIMESTAMP '2024-03-01 06:00:00'
  UNION ALL SELECT 'domain', 'free-bets.example.com', 'off', TIMESTAMP '2024-09-01 18:30:00'
  UNION ALL SELECT 'domain', 'cheap-pills.example.com', 'block', TIMESTAMP '2024-02-01 12:00:00'
  UNION ALL SELECT 'domain', 'example.net', 'block', TIMESTAMP '2024-06-15 15:00:00'
  UNION ALL SELECT 'domain', 'example.net', 'off', TIMESTAMP '2024-06-30 09:00:00'
), v AS (
  SELECT kind, value, action, d AS since, lead(d) OVER (PARTITION BY kind, value ORDER BY d) AS until
  FROM (SELECT kind, value, d, max(action) AS action FROM e GROUP BY ALL)
), m AS (
  SELECT c.page_id, v.kind, v.value, v.action, v.since,
         row_number() OVER (PARTITION BY c.page_id ORDER BY v.kind DESC, length(v.value) DESC, v.value DESC) AS n
  FROM c JOIN v ON v.action <> 'off' AND v.since <= c.day AND (v.until IS NULL OR c.day < v.until)
   AND ((v.kind = 'domain' AND (c.host = v.value OR ends_with(c.host, '.' || v.value)))
     OR (v.kind = 'prefix' AND (c.host || c.path = v.value OR starts_with(c.host || c.path, v.value || '/'))))
)
SELECT c.page_id, strftime(c.day, '%Y-%m-%d %H:%M') AS fetched_at, coalesce(m.action = 'block', false) AS blocked,
       m.kind AS entry_kind, m.value AS entry, strftime(m.since, '%Y-%m-%d %H:%M') AS entry_since
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.n = 1
"""
