import random

import pytest
from pyspark.sql import functions as F

from panelweave.functions.text import jaro
from panelweave.operators import asof, graph, linkage
from panelweave.operators import relational as rel
from panelweave.sources.io import write_buckets, read_bucket


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_exact_linkage_and_discrepancies(spark):
    a = spark.createDataFrame([("m1", "1990", 1), ("m1", "1990", 1), ("m2", "1991", None), (None, "1", 1), ("m3", "x", 3)], "m string, birth string, city int")
    b = spark.createDataFrame([("m1", "1990", 2), ("m2", "1992", 5), (None, "1", 1)], "m string, birth string, city int")
    linked = linkage.link_exact(a, b, ["m"])
    assert linked.columns == ["m", "birth", "city", "m_1", "birth_1", "city_1"] and linked.count() == 2
    out = linkage.discrepancies(linked, "m", {"birth": ("birth", "birth_1"), "city": ("city", "city_1")}).first()
    assert tuple(out) == (2, 1, 1)


def test_bucket_by_bucket_is_the_plain_join(spark, tmp_path):
    left = spark.range(300).select((F.col("id") % 40).cast("string").alias("k"), "id")
    right = spark.range(60).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    write_buckets(left, str(tmp_path / "l"), "k", 5)
    write_buckets(right, str(tmp_path / "r"), "k", 5)
    parts = [read_bucket(spark, str(tmp_path / "l"), i).drop("bucket").join(read_bucket(spark, str(tmp_path / "r"), i).drop("bucket"), "k") for i in range(1, 6)]
    assert sorted(sum((rows(p) for p in parts), []), key=repr) == rows(left.join(right, "k"))


def test_match_share_keeps_years_without_a_match(spark):
    people = spark.createDataFrame([(2009, "a"), (2009, "a"), (2009, "b"), (2010, "c"), (2010, None)], "year int, id string")
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert rows(linkage.match_share(people, ids, "id", "year")) == [(2009, 2, 1, 0.5), (2010, 1, 0, 0.0)]


def test_fuzzy_linkage_against_all_pairs(spark):
    rng = random.Random(3)
    names = ["maria silva", "maria silvq", "marta silva", "mario silva", "maria s", "jose souza", "josé", "", "jose sousa", "m"]
    left = [(i, rng.choice(names), rng.choice("xy")) for i in range(60)]
    right = [(100 + i, rng.choice(names), rng.choice("xy")) for i in range(60)]
    frames = [linkage.blocking_keys(spark.createDataFrame(r, "id int, name string, uf string"), "name") for r in (left, right)]
    want = []
    for i, n, u in left:
        best = min(((-jaro(n, m), j, m) for j, m, v in right if v == u and n and m and n[0] == m[0] and jaro(n, m) >= 0.9), default=None)
        if best:
            want.append((i, best[1], n, best[2], -best[0]))
    found = linkage.link_fuzzy(*frames, ["uf", "initial"])
    assert rows(found) == sorted(want, key=repr)
    pairs = linkage.candidate_pairs(*frames, ["uf", "initial"])
    assert pairs.columns == ["id_left", "name_left", "id_right", "name_right"] and pairs.where("name_left = ''").count() == 0


def test_asof_forms_agree(spark):
    rng = random.Random(6)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(20)])) for i in range(200)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(20)]), rng.choice([None, 1.5, 2.5]), n) for n in range(60)]
    a = spark.createDataFrame(left, "id int, k string, year int")
    b = spark.createDataFrame(right, "k string, seen int, score double, n int")
    args = (["k"], "year", "seen", ["score", "n"])
    window = rows(asof.asof_window(a, b, *args, tie=["n"]))
    assert window == rows(asof.asof_join(a, b, *args, tie=["n"])) == rows(asof.asof_window(a, b, *args, tie=["n"], slice_of=lambda t: F.floor(t / 4)))
    for i, k, year, score, n in window:
        best = max(((s, m, v) for q, s, v, m in right if q is not None and q == k and s is not None and year is not None and s < year), key=lambda x: x[:2], default=None)
        assert (score, n) == ((best[2], best[1]) if best else (None, None))


def test_ranking_counts_those_without_a_score(spark):
    df = spark.createDataFrame([("c", 1.0, 1), ("c", None, None), ("c", 2.0, 0)], "course string, mean_score double, via int")
    assert tuple(asof.course_ranking(df, ["course"], via="via").first()) == ("c", 1.5, 3, 2, 1)


def local_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted(((n, find(n)) for n in root), key=repr)


def test_components_against_union_find(spark):
    rng = random.Random(9)
    chain = [(1000 + i, 1001 + i) for i in range(120)]
    star = [(5000, 5001 + i) for i in range(80)]
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + chain + star + [(7, 7), (None, 3), (2000, 2001), (2001, 2000)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert rows(graph.connected_components(df)) == local_components(edges)
    assert rows(graph.connected_components(df, hub_degree=10)) == local_components(edges)
    assert rows(graph.connected_components(df.limit(0))) == []


def test_id_consolidation(spark):
    pairs = [("12.0", " 7"), ("7", "100"), ("b", "a"), ("a", "9"), ("12", "12.0"), ("", "5"), ("NA", "6"), ("NULL", "4"), ("200", "200"), ("7", "12.0"), ("30", "4")]
    df = spark.createDataFrame(pairs, "x string, y string")
    id_map, summary = graph.consolidate_ids(df, "x", "y")
    assert rows(id_map) == sorted([("7", "7", "7", 3), ("12", "7", "7", 3), ("100", "7", "7", 3), ("9", "9", "9", 3), ("a", "9", "9", 3), ("b", "9", "9", 3), ("4", "4", "4", 2), ("30", "4", "4", 2)], key=repr)
    assert rows(summary) == sorted([("7", "7", 3, "7|12|100"), ("9", "9", 3, "9|a|b"), ("4", "4", 2, "4|30")], key=repr)
    assert id_map.dtypes == [("id", "string"), ("canonical_id", "string"), ("cluster_id", "string"), ("cluster_size", "int")]
    empty = graph.consolidate_ids(df.where("x = 'zzz'"), "x", "y")
    assert [e.collect() for e in empty] == [[], []] and empty[1].columns == ["cluster_id", "canonical_id", "cluster_size", "member_ids"]
    numbers = spark.createDataFrame([(12000000000.0, 3.0)], "x double, y double")
    assert rows(graph.consolidate_ids(numbers, "x", "y", numeric=True)[0]) == [("12000000000", "3", "3", 2), ("3", "3", "3", 2)]


def test_relational_blocks(spark):
    df = spark.createDataFrame([("a", 2, "p"), ("a", 1, "q"), ("b", None, "r"), (None, 5, "s"), (None, 4, "t")], "k string, o int, v string")
    assert rows(rel.keep_first(df, ["k"], ["o"])) == sorted([("a", 1, "q"), ("b", None, "r"), (None, 4, "t")], key=repr)
    assert rel.distinct_on(df, ["k"]).count() == 3 and rows(rel.distinct_on(df.select("k"), ["k"])) == sorted([("a",), ("b",), (None,)], key=repr)
    other = spark.createDataFrame([("a", "X"), (None, "Y"), ("z", "Z")], "k string, v string")
    assert rows(rel.null_safe_join(df, other.withColumnRenamed("v", "w"), ["k"], "full").select("k", "o", "w")) == sorted([("a", 2, "X"), ("a", 1, "X"), ("b", None, None), (None, 5, "Y"), (None, 4, "Y"), ("z", None, "Z")], key=repr)
    assert rows(rel.mark_join(df, other, ["k"], "m").select("k", "m")) == sorted([("a", 1), ("a", 1), ("b", 0), (None, 1), (None, 1)], key=repr)  # missing ids match each other
    assert rows(rel.update_join(df, other, ["k"], "v").select("k", "v")) == sorted([("a", "X"), ("a", "X"), ("b", "r"), (None, "Y"), (None, "Y")], key=repr)
    assert rows(rel.mark_join(df, other.where("k is not null"), ["k"], "o").select("k", "o")) == sorted([("a", 1), ("a", 1), ("b", 0), (None, 0), (None, 0)], key=repr)
    assert rel.duplicated(df, ["k"]).count() == 2
    assert rel.suffix_columns(df, "_x", ["k"]).columns == ["k", "o_x", "v_x"]
    assert rel.columns_between(df, "k", "o") == ["k", "o"] and rel.columns_starting(df, "v") == ["v"]
    assert rows(rel.frequency(df, "k")) == [("a", 2), ("b", 1)]
    assert rel.sample_n(df, 2, 1914).count() == 2 and rows(rel.sample_n(df, 2, 1914)) == rows(rel.sample_n(df, 2, 1914))
    ids = spark.createDataFrame([("10",), ("9",), ("x",), (None,), ("b",)], "i string")
    assert [r["i"] for r in ids.orderBy(*rel.order_numeric(F.col("i"))).collect()] == ["9", "10", "b", "x", None]
    assert [tuple(r) for r in rel.cast_columns(ids, ["i"], lambda x: x.try_cast("int")).collect()][0] == (10,)
    out = rel.shares_within(spark.createDataFrame([("g", 1), ("g", 2)], "g string, n int"), ["g"])
    assert dict(out.dtypes)["share"] == "double" and rows(out)[0][2] == 1 / 3
    missing = rel.shares_within(spark.createDataFrame([(None, 1), (None, 3), ("g", 2)], "g string, n int"), ["g"])
    assert rows(missing) == sorted([(None, 1, 0.25), (None, 3, 0.75), ("g", 2, 1.0)], key=repr)
    numbered = rel.row_numbers(spark.range(1000).select((F.col("id") % 7).alias("a"), "id"), ["a"]).collect()
    want = sorted((i % 7, i) for i in range(1000))
    assert sorted((r["row"], r["a"], r["id"]) for r in numbered) == [(k, a, i) for k, (a, i) in enumerate(want, 1)]


@pytest.mark.parametrize("hub_degree", [0, 50, 10_000])
def test_hubs_are_split_without_a_change(spark, hub_degree):
    """A star of 2,500 and one of 400 that a chain joins, a chain of 60, and a lone pair."""
    pairs = [(5000, i) for i in range(1, 2501)] + [(6000, 3000 + i) for i in range(400)] + [(5000, 7000), (7000, 6000)] + [(9000 + i, 9001 + i) for i in range(60)] + [(20000, 20001)]
    df = spark.createDataFrame(pairs, "a int, b int")
    found = {r["node"]: r["root"] for r in graph.connected_components(df, hub_degree=hub_degree).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    assert found == {x: root(x) for x in up}
