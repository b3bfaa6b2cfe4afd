"""Connected components over edge lists, and consolidation of unstable identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelweave.session import discard, materialise

#: Degree from which a node is a hub: its edges get its minimum by broadcast, not by a join in one task.
HUB_DEGREE = 1_000


def _minima(edges: DataFrame) -> DataFrame:
    """Per node ``u`` the least of itself and its neighbours, and its degree."""
    return edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("degree"))


def _with_minimum(edges: DataFrame, n_edges: int, hub_degree: int) -> tuple[DataFrame, list[DataFrame]]:
    """``u, v, m``: every edge with the minimum of ``u``; and the tables written for it.

    ``n_edges`` bounds the number of ``edges``. Hubs, counted and at most 2,000, go by broadcast.
    """
    if n_edges <= hub_degree:  # no node can be a hub
        return edges.join(_minima(edges).select("u", "m"), "u"), []
    minima = materialise(_minima(edges), "minima")
    limit = max(hub_degree, n_edges // 1000)
    hubs = minima.where(F.col("degree") > limit).select("u", "m")
    if not hubs.limit(1).count():
        return edges.join(minima.select("u", "m"), "u"), [minima]
    hubs = F.broadcast(hubs)
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(minima.where(F.col("degree") <= limit).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest), [minima]


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """``node, root`` for every node of an undirected edge list; ``root`` is the least node of its component.

    Alternates large-star and small-star (Kiveris et al. 2014): the rounds grow
    with the logarithm of the longest chain, the edges never multiply. Each round
    is written to the shared folder, so a lost executor repeats one round at most;
    the round before is then deleted. Null ends and self pairs are dropped; an empty
    list gives an empty result. Nodes of more than ``hub_degree`` edges (and more than
    a thousandth of all) are nobody's join key.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u != v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n, seen = e.count(), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, written = _with_minimum(both, 2 * n, hub_degree)
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        if written:  # it is read twice
            large = materialise(large, "large")
            written.append(large)
        small, more = _with_minimum(large, n, hub_degree)
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = materialise(new.where("u != v").distinct(), "edges")
        for old in (e, *written, *more):
            discard(old)
        e = new
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        n, seen = state[0], state
    else:
        raise RuntimeError(f"no convergence after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def consolidate_ids(pairs: DataFrame, left: str, right: str, id: str = "id", numeric: bool = False) -> tuple[DataFrame, DataFrame]:
    """``id_map`` and ``cluster_summary`` of unstable ids linked in pairs.

    Ids are normalised, pairs with a null or with themselves dropped, the rest
    taken as undirected. A cluster's canonical id is its least member: by number
    if all members are numbers, else by text. Ids in no valid pair do not appear.
    """
    from panelweave.functions.columns import as_number, normal_id

    edges = pairs.select(normal_id(F.col(left), numeric).alias("a"), normal_id(F.col(right), numeric).alias("b"))
    # the map has a row per id; only the summary's text of member ids is one row per cluster, by its definition
    members = connected_components(edges).select(F.col("node").alias("m"), "root").withColumn("n", as_number(F.col("m")))
    by_number = F.min(F.struct(F.col("n"), F.col("m")))
    clusters = members.groupBy("root").agg(
        F.when(F.count("n") == F.count("*"), by_number["m"]).otherwise(F.min("m")).alias("canonical_id"),
        F.count("*").cast("int").alias("cluster_size"),
    )
    clusters = materialise(clusters, "clusters")
    named = members.join(clusters, "root")
    id_map = named.select(F.col("m").alias(id), "canonical_id", F.col("canonical_id").alias("cluster_id"), "cluster_size")
    order = F.struct(F.col("n").isNull().alias("late"), F.col("n").alias("n"), F.col("m").alias("m"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["m"]), "|")
    summary = named.groupBy("canonical_id", "cluster_size").agg(listed.alias("member_ids"))
    return id_map, summary.select(F.col("canonical_id").alias("cluster_id"), "canonical_id", "cluster_size", "member_ids")
