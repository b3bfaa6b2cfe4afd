"""Queries over all lines, on small tables written by the tests."""

import __spark_entry__ as entry


def lineitem(spark, folder, rows, names):
    spark.createDataFrame(rows, names).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def components(pairs):
    """Brute-force union-find: id to the least id of its component."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def links():
    """Supplier and part: a chain, a hub of 300 parts, a hot pair, a lone pair."""
    chain = [(s, p) for s in range(1, 60) for p in (s, s + 1)]
    hub = [(500, p) for p in range(1000, 1300)]
    return chain + hub + [(700, 2000)] * 400 + [(701, 2000), (900, 3000)]


def test_ids_of_all_lines_against_union_find(spark, tmp_path):
    # flags, discounts and quantities that the filtered queries would drop
    rows = [(s, p, "N", 0.01, 1.0) for s, p in links()]
    folder = lineitem(spark, tmp_path, rows, ["l_suppkey", "l_partkey", "l_returnflag", "l_discount", "l_quantity"])
    root = components([(s, p + 100000) for s, p in links()])
    members = {}
    for x in sorted(root):
        members.setdefault(root[x], []).append(x)
    assert sorted(map(len, members.values())) == [2, 3, 119, 301]

    found = entry.queries()["q13_id_map"](spark, folder).collect()
    assert sorted(map(tuple, found)) == sorted((str(x), str(r), str(r), len(members[r])) for x, r in root.items())

    found = entry.queries()["q13b_cluster_summary"](spark, folder).collect()
    assert sorted(map(tuple, found)) == sorted((str(r), str(r), len(m), "|".join(map(str, m))) for r, m in members.items())


def test_sides_of_the_panel_count_every_line(spark, tmp_path):
    # small quantities, parts of every remainder; supplier 3 has returns only, supplier 4 a line without flag
    rows = [(1, 1, p, "R" if p % 3 else "A", 1.0) for p in range(140)] + [(1, 3, 5, "R", 2.0), (1, 4, 6, None, 3.0), (1, 5, 8, "N", 60.0)]
    folder = lineitem(spark, tmp_path, rows, "l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string, l_quantity double")
    spark.createDataFrame([(1, 9, "1995-05-05")], ["o_orderkey", "o_custkey", "o_orderdate"]).write.parquet(f"{folder}/orders.parquet")
    found = entry.queries()["q08_full_outer_panel"](spark, folder).select("l_suppkey", "n", "n_census", "participant", "missing_census").collect()
    assert sorted(map(tuple, found)) == [(1, 93, 47, 1, 0), (3, 1, None, 1, 1), (4, None, 1, 0, 0), (5, None, 1, 0, 0)]
    found = entry.queries()["q08b_three_way_merge"](spark, folder).select("l_suppkey", "n_r", "n_a", "n_n").collect()
    assert sorted(map(tuple, found)) == [(1, 93, 47, None), (3, 1, None, None), (5, None, None, 1)]


def test_orders_of_every_priority_are_checked(spark, tmp_path):
    rows = [(k, k % 6, "1-URGENT" if k % 2 else "5-LOW", "1995-05-05", "O") for k in range(24)] + [(99, 7, None, "1995-05-05", "O")]
    spark.createDataFrame(rows, ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus"]).write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["check"]: r["value"] for r in entry.queries()["q18_replication_checks"](spark, str(tmp_path)).collect()}
    assert found["rows_before"] == found["paired"] == 7


def test_every_line_is_an_outcome(spark, tmp_path):
    # order 1 with three small lines of two suppliers, order 2 without lines
    folder = lineitem(spark, tmp_path, [(1, 1, "R", 1.0), (1, 1, "R", 2.0), (1, 2, "R", 50.0)], ["l_orderkey", "l_suppkey", "l_returnflag", "l_quantity"])
    spark.createDataFrame([(1, "O", "1995-05-05"), (2, "O", "1995-05-06")], ["o_orderkey", "o_orderstatus", "o_orderdate"]).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, 10), (2, 20)], ["s_suppkey", "s_nationkey"]).write.parquet(f"{folder}/supplier.parquet")
    found = entry.queries()["q26_outcome_panel"](spark, folder).collect()
    assert set(map(tuple, found)) == {(1995, "R", 3, 1, 2), (1995, None, 1, 1, 0)}
