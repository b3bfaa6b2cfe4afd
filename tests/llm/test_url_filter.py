import datetime
import random

from panelweave.llm import url_filter

DAY = datetime.date(2024, 1, 1)


def plain(url, day, entries):
    import re

    if url is None or day is None:
        return (False, None, None, None)
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/:?#]*)[^/?#]*([^?#]*)", url)
    if not m or not m.group(2):
        return (False, None, None, None)
    host, path = m.group(2).lower(), m.group(3).lower()
    history = {}
    for kind, value, action, at in entries:
        if None not in (kind, value, action, at):
            now = history.setdefault((kind, value.lower()), {})
            now[at] = max(action, now.get(at, ""))
    best = None
    for (kind, value), dated in history.items():
        if kind == "domain" and not (host == value or host.endswith("." + value)) or kind == "prefix" and not (host + path == value or (host + path).startswith(value + "/")):
            continue
        since = max((d for d in dated if d <= day), default=None)
        if since and dated[since] != "off":
            best = max(best or ("",), (kind, len(value), value, since, dated[since]))
    return (best[4] == "block", best[0], best[2], best[3]) if best else (False, None, None, None)


def test_against_python(spark):
    rng = random.Random(4)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "localhost", "a.com.b.org"]
    paths = ["", "/", "/p", "/p/q", "/P/q/r.html", "/pq", "?x=/p", "#p", "/p?x"]
    entries = [(rng.choice(["domain", "prefix"]), None, rng.choice(["block", "allow", "off"]), DAY + datetime.timedelta(rng.randint(0, 400))) for _ in range(150)]
    entries = [(k, rng.choice(hosts + ["com", "A.com"]) + (rng.choice(["/p", "/p/q", "/p/q/r.html"]) if k == "prefix" else ""), a, d) for k, _, a, d in entries] + [("domain", None, "block", DAY), ("domain", "b.org", "block", None)]
    captures = [(i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u:p@'])}{rng.choice(hosts)}{rng.choice(['', ':80'])}{rng.choice(paths)}", DAY + datetime.timedelta(rng.randint(-5, 420)), "k") for i in range(400)]
    captures += [(1000, None, DAY, "k"), (1001, "nonsense", DAY, "k"), (1002, "http://a.com/p", None, "k"), (None, "http://a.com/p", DAY, "k"), (None, "http://a.com/p", DAY, "k")]
    left = spark.createDataFrame(captures, "page_id long, url string, fetched_at date, kind string")
    right = spark.createDataFrame(entries, "kind string, value string, action string, at date")
    for broadcast, size in ((200_000, 256), (1, 256), (200_000, 2), (1, 3)):
        url_filter.BROADCAST_ROWS, url_filter.SLICE = broadcast, size
        rows = url_filter.judge(left, right).collect()
        found = sorted(((r["page_id"], r["url"], r["blocked"], r["entry_kind"], r["entry"], r["entry_since"]) for r in rows), key=str)
        assert found == sorted(((k, u, *plain(u, d, entries)) for k, u, d, _ in captures), key=str)
    url_filter.BROADCAST_ROWS, url_filter.SLICE = 200_000, 256
    assert any(r[2] for r in found) and any(r[3] == "prefix" for r in found)


def test_empty(spark):
    left = spark.createDataFrame([(1, "http://a.com/p", DAY)], "page_id long, url string, fetched_at date")
    right = spark.createDataFrame([("domain", "a.com", "block", DAY)], "kind string, value string, action string, at date")
    assert [r["blocked"] for r in url_filter.judge(left, right).collect()] == [True]
    assert [r["blocked"] for r in url_filter.judge(left, right.limit(0)).collect()] == [False]
    assert url_filter.judge(left.limit(0), right).collect() == []


def test_entries_count_from_their_time_on(spark):
    at = lambda hour, minute=0, day=5: datetime.datetime(2024, 3, day, hour, minute)
    entries = [("domain", "a.com", "block", at(15)), ("domain", "a.com", "off", at(18)), ("prefix", "a.com/p", "allow", at(16, 30))]
    captures = [(i, f"http://a.com/{path}", t) for i, (path, t) in enumerate([("x", at(9)), ("x", at(14, 59)), ("x", at(15)), ("x", at(17)), ("p/q", at(16)), ("p/q", at(16, 30)), ("x", at(18)), ("x", at(9, 0, 6))])]
    for kind in ("timestamp", "timestamp_ntz"):
        left = spark.createDataFrame(captures, f"page_id long, url string, fetched_at {kind}")
        for told in ("timestamp", "timestamp_ntz"):
            right = spark.createDataFrame(entries, f"kind string, value string, action string, at {told}")
            found = {r["page_id"]: (r["blocked"], r["entry_since"]) for r in url_filter.judge(left, right).collect()}
            assert [found[i][0] for i in range(8)] == [False, False, True, True, True, False, False, False]
            assert found[2][1] == at(15) and found[5][1] == at(16, 30) and found[6][1] is None


def test_far_times_long_urls_many_switches_and_clashing_names(spark):
    """A capture of the year 9999 with 1,000 open entries, a value switched 5,000 times, a url of a megabyte, and result names among the columns."""
    entries = [("domain", f"h{i}.org", "block", datetime.datetime(2020, 1, 1)) for i in range(1000)]
    entries += [("domain", "s.org", ("block", "off")[i % 2], datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=i)) for i in range(5000)]
    far = datetime.datetime(9999, 12, 31)
    captures = [(1, "http://h7.org/x", far, "u"), (2, "http://s.org/" + "p/" * 500_000, datetime.datetime(2020, 1, 1, 4, 30), "u"), (3, "http://s.org", datetime.datetime(2020, 1, 2, 5, 30), "u"), (4, "http://s.org", datetime.datetime(2019, 1, 1), "u")]
    left = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp, blocked string").selectExpr("*", "1 as u", "2 as time", "3 as c0", "4 as best")
    out = url_filter.judge(left, spark.createDataFrame(entries, "kind string, value string, action string, at timestamp"))
    assert out.columns == ["page_id", "url", "fetched_at", "u", "time", "c0", "best", "blocked", "entry_kind", "entry", "entry_since"]
    assert {r["page_id"]: r["blocked"] for r in out.collect()} == {1: True, 2: True, 3: False, 4: False}
