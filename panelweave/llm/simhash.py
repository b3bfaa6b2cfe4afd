"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has a bit where over half of its word-shingle hashes
have it. Two fingerprints link at three or fewer differing bits. Cut in two
segments, such a pair differs by one bit at most in one of them; so every
fingerprint is indexed under each segment with one bit left out (64 variants),
and an equality join on the variants finds every pair. The pairs are then
verified bit by bit.

Only distinct fingerprints are indexed: exact copies cost nothing. Within a
variant, links are kept as a spanning forest, never as all pairs. A segment value
that very many fingerprints share gets a second level (one of the two halves of
the *other* segment with one bit left out), which holds 2**18 fingerprints at
most; no task ever meets an unbounded group.

One fingerprint finds few of the pairs that differ in some words. So the operator
can take several independent ones (``lanes``): the first is the contract's, the
others come from the same shingle hashes mixed anew. A pair then links when at
least one lane differs by three or fewer bits; each lane is searched exactly as
above, and the links of all lanes make one set of components. The cost grows with
the lanes and with nothing else.

Defined results: null and empty texts have fingerprint zero and link like any
other; a text of any length is hashed whole; repeated rows get one result row each;
a null ``doc_id`` never names a component unless all its members are null; ties do
not arise, as a component is named by its least key; columns of any name pass
through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.llm.common import arrow_map, arrow_rows, numbered, strings
from panelweave.operators.graph import connected_components
from panelweave.session import materialise, table

SHINGLE, SEED, DISTANCE = 3, 42, 3

#: Lanes of :func:`deduplicate` in the pipeline.
LANES = 4

#: Fingerprints with the same segment from which the second level is used, if that is over a 2,000th of all.
HOT = 20_000

#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 16


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of a lane, by the SplitMix64 finaliser; lane 0 has them as they are."""
    if not lane:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def lane_fingerprints(text: str, shingle: int = SHINGLE, lanes: int = 1) -> list[int]:
    """Unsigned 64-bit SimHash of one text in each lane."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * lanes
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    count = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: count - 1] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    ones = np.zeros((lanes, 64), np.int64)
    for at in range(0, count, BLOCK):
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])]
        hashes = np.array(hashes, "<u8")
        for lane in range(lanes):
            bits = np.unpackbits(mixed(hashes, lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[lane] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    return lane_fingerprints(text, shingle)[0]


def lane_names(lanes: int) -> list[str]:
    return ["fp", *(f"fp{i}" for i in range(1, lanes))]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, lanes: int = 1) -> DataFrame:
    """``key`` (of that name), ``th``, ``fp`` (and ``fp1``… of further lanes) per row: the hash of the text and its fingerprints as signed 64-bit integers. A narrow map."""
    names = lane_names(lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([lane_fingerprints(x, shingle, lanes) for x in strings(batch.column(2))], np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, i].copy()) for i in range(lanes))], ["key", "th", *names])

    t = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("th"), t.alias("t"))
    return arrow_map(rows, run, f"key {docs.schema[key].dataType.simpleString()}, th bigint, " + ", ".join(f"{n} bigint" for n in names))


def variants(fps: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(key, fp)`` of all one-wildcard segments of each fingerprint (unsigned). ``hot``: sorted values of either segment."""
    keys, owners = [], []
    low = np.uint64(0xFFFFFFFF)
    halves = (fps >> np.uint64(32), fps & low)
    for segment in (0, 1):
        own, other = halves[segment], halves[1 - segment]
        many = np.isin(own, hot[segment]) if len(hot[segment]) else None
        for bit in range(32):
            mask = np.uint64(1 << bit)
            tag = np.uint64(segment << 5 | bit)
            key = (own & ~mask) << np.uint64(6) | tag
            if many is None:
                keys.append(key)
                owners.append(fps)
                continue
            both = many | np.isin(own ^ mask, hot[segment])  # the same answer for every member of the variant
            keys.append(key[~both])
            owners.append(fps[~both])
            for half in (0, 1):
                part = other[both] >> np.uint64(16 * half) & np.uint64(0xFFFF)
                for gone in range(16):
                    sub = (part & ~np.uint64(1 << gone)) << np.uint64(5) | np.uint64(half << 4 | gone)
                    keys.append(key[both] | sub << np.uint64(38) | np.uint64(1 << 62))
                    owners.append(fps[both])
    return np.concatenate(keys), np.concatenate(owners)


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is linked in this set: a search from each fingerprint over those not yet reached."""
    left, right = [], []
    rest = fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found)
    none = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def run_links(key: int, fps: np.ndarray, distance: int = DISTANCE, direct: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Links within one variant. A large one is cut by each byte of the other segment: one of the four bytes is equal."""
    if len(fps) <= direct:
        return forest(fps, distance)
    segment = key >> 5 & 1
    left, right = [], []
    for byte in range(4):
        value = fps >> np.uint64((32 if segment else 0) + 8 * byte) & np.uint64(0xFF)
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for part in np.split(fps[order], cuts):
            a, b = forest(part, distance)
            left.append(a)
            right.append(b)
    return np.concatenate(left), np.concatenate(right)


def links(keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE, small: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole runs of equal keys (sorted by key)."""
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
    sizes = np.diff(bounds)
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    for step in range(1, small):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & (size_of[step:] <= small))
        if not len(at):
            break
        a, b = fps[at], fps[at + step]
        near = np.bitwise_count(a ^ b) <= distance
        left.append(a[near])
        right.append(b[near])
    for run in np.flatnonzero(sizes > small):
        a, b = run_links(int(keys[bounds[run]]), fps[bounds[run] : bounds[run + 1]], distance)
        left.append(a)
        right.append(b)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link per member: each to the least member."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _index(hot: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                fps = batch.column(0).slice(part, 2048).to_numpy(zero_copy_only=False).view(np.uint64)
                keys, owners = variants(fps, hot)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64))], ["key", "fp"])

    return run


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.uint64), np.empty(0, np.uint64)
        held_a, held_b = [], []

        def out() -> pa.RecordBatch:
            a, b = stars(np.concatenate(held_a), np.concatenate(held_b))
            held_a.clear()
            held_b.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def take(keys: np.ndarray, fps: np.ndarray) -> bool:
            a, b = links(keys, fps, distance)
            held_a.append(a)
            held_b.append(b)
            return sum(map(len, held_a)) > 200_000

        waiting: list[tuple[np.ndarray, np.ndarray]] = []  # of the last key, which may go on in the next batch
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            waiting.append((keys, fps))
            if keys[0] == keys[-1]:
                continue
            keys, fps = (np.concatenate(x) for x in zip(*waiting))
            end = int(np.searchsorted(keys.view(np.int64), keys[-1].view(np.int64)))
            waiting = [(keys[end:], fps[end:])]
            if take(keys[:end], fps[:end]):
                yield out()
        if waiting:
            take(*(np.concatenate(x) for x in zip(*waiting)))
        if held_a:
            yield out()

    return run


def linked(fps: DataFrame, distance: int = DISTANCE, hot_from: int = HOT) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints ``fp`` within the distance, a written table."""
    spark = fps.sparkSession
    halves = fps.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), v.alias("v")) for s, v in enumerate((F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))))])).alias("h"))
    limit = max(hot_from, fps.count() // 2000)  # so there are 4,000 values at most
    crowded = halves.groupBy("h.s", "h.v").count().where(F.col("count") > limit).select("s", "v").collect()
    hot = tuple(np.array(sorted(r["v"] for r in crowded if r["s"] == s), np.uint64) for s in (0, 1))
    with arrow_rows(spark, 50_000):
        keyed = fps.select("fp").mapInArrow(_index(hot), "key bigint, fp bigint")
        found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(distance), "a bigint, b bigint")
        return materialise(found, "links")


def components(fps: DataFrame, distance: int = DISTANCE, hot_from: int = HOT) -> DataFrame:
    """``fp, root`` for every distinct ``fp`` that links to another; ``root`` is one fingerprint of its component."""
    return connected_components(linked(fps, distance, hot_from)).select(F.col("node").alias("fp"), "root")


def lane_components(nodes: DataFrame, lanes: int, distance: int = DISTANCE, hot_from: int = HOT) -> DataFrame:
    """``id, root`` for every node that links to another in some lane. ``nodes``: a written table of ``id`` and the lanes' fingerprints.

    A lane's links join distinct fingerprints; the node of least id stands for each
    fingerprint, and all other nodes of that fingerprint are linked to it.
    """
    edges = []
    for name in lane_names(lanes):
        firsts = materialise(nodes.groupBy(F.col(name).alias("fp")).agg(F.min("id").alias("first")), "firsts")
        found = linked(firsts.select("fp"), distance, hot_from)
        far = found.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
        same = nodes.select("id", F.col(name).alias("fp")).join(firsts, "fp").where("id != first")
        edges += [far.select(F.col("x").alias("a"), F.col("y").alias("b")), same.select(F.col("id").alias("a"), F.col("first").alias("b"))]
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    return connected_components(every).select(F.col("node").alias("id"), "root")


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE, hot_from: int = HOT, lanes: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows ``key, th`` and the lanes' fingerprints; and per distinct fingerprints their ``root`` and ``component_id`` (the least key reachable)."""
    names = lane_names(lanes)
    owned = materialise(fingerprints(docs, text, key, shingle, lanes), "fingerprints")
    nodes = owned.groupBy(*names).agg(F.min("key").alias("least"))
    if lanes == 1:
        nodes = materialise(nodes.withColumn("id", F.col("fp")), "nodes")
        roots = components(nodes.select("fp"), distance, hot_from).withColumnRenamed("fp", "id")
    else:
        nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
        roots = lane_components(nodes, lanes, distance, hot_from)
    rooted = nodes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return owned, materialise(rooted.join(named, "root").select(*names, "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``key, fingerprint`` (of the first lane, 16 hexadecimal digits) ``, component_id``, one row per row of ``docs``."""
    owned, named = grouped(docs, text, key, **options)
    return owned.join(named, lane_names(options.get("lanes", 1))).select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the least key (null last; of equal keys one text, of equal rows one)."""
    owned, named = grouped(docs, text, key, **options)
    order = F.struct(F.col("key").isNull().alias("last"), F.col("key").alias("k"), F.col("th"))
    names = lane_names(options.get("lanes", 1))
    chosen = owned.join(named.select(*names, "root"), names).groupBy("root").agg(F.min(order).alias("c")).select(F.col("c.k").alias("_k"), F.col("c.th").alias("_th"))
    at, own = (f"c{docs.columns.index(c)}" for c in (text, key))
    rows = numbered(docs).withColumn("_hash", F.xxhash64(F.coalesce(F.col(at), F.lit(""))))
    kept = rows.join(chosen, F.col(own).eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_th")), "left_semi")
    # whole texts are dealt out again only if some row does come twice
    if owned.groupBy("key", "th").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([own, "_hash"])
    return kept.drop("_hash").toDF(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
