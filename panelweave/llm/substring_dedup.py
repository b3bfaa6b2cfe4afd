"""Exact substring dedup: words covered by a window that starts earlier elsewhere are removed.

A window is 20 consecutive words of one document. Consecutive windows that share
their minimiser (the least of their four-word grams) travel as one packed string, a
super-k-mer, to the bucket of that minimiser. Equal windows have equal minimisers,
so all occurrences of a window meet in one bucket; there the windows are sorted by
a hash, and windows with equal hashes are compared word by word.

No bucket grows with the corpus. Grams are ordered by rarity first, then by hash:
a frequent phrase is the minimiser only of windows that hold nothing rarer. How
frequent is read off a table of gram classes (``CELLS``) counted in a sample that
grows with the corpus; it steers where windows meet, never whether they do, as
every task has the same table. The number of buckets follows the counted bytes.

Before the shuffle each task removes the windows that it holds twice itself: only
the earliest goes on. A hot passage thus reaches its bucket once per task and
chunk, however many documents hold it; and a bucket that fills up is thinned out
the same way before more of it is read. The strings of a chunk for one bucket are
compressed together.

Order: by ``doc_id`` (numbers by value, other ids as they sort), then start. Defined
results: null and wordless texts have no words; a null ``doc_id`` comes after all
others; rows with the same ``doc_id`` are the same document, told apart by their
text, and equal starts in them count as equally early (both stay). A text of any
length is windowed whole. Extra columns of any name are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelweave.llm.common import arrow_map, arrow_rows, strings
from panelweave.session import materialise, partitions, table

WINDOW, GRAM = 20, 4

#: Bytes of text that a task deduplicates at once, and buckets for each shuffle partition.
CHUNK_BYTES, BUCKETS = 8 << 20, 8

#: Bytes of text for a bucket and for a shuffle partition at most, where the session's partitions would hold more.
BUCKET_BYTES, PARTITION_BYTES = 2 << 20, 64 << 20

#: Bytes of words that a bucket holds before it is thinned out.
THIN_BYTES = 32 << 20

#: Bytes of the sample in which grams are counted, the least share of the corpus it is, and the classes of grams.
SAMPLE_BYTES, SAMPLE_SHARE = 4 << 20, 4096
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 20

#: Windows of one super-k-mer at most: a longer run of one minimiser is cut.
RUN = 64

LAST = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Word sequences that lie one after the other in one buffer, each word followed by one space."""

    def __init__(self, buffer: bytes, counts: np.ndarray):
        from xxhash import xxh64_intdigest

        data = np.frombuffer(buffer, np.uint8)
        self.buffer, self.counts = buffer, counts
        self.offsets = np.concatenate(([0], np.flatnonzero(data == 32) + 1)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(self.offsets) - 1, [None, pa.py_buffer(self.offsets), pa.py_buffer(buffer)])
        coded = words.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False)
        known = np.fromiter((xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.hashes = known[self.ids] if len(self.ids) else np.empty(0, np.uint64)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts

    def grams(self, size: int) -> np.ndarray:
        """A hash of the words from each place on, without regard to the sequences' ends."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += self.hashes[k : k + n]
        return _mix(out)

    def windows(self, window: int) -> np.ndarray:
        """Places at which a whole window of one sequence starts."""
        per = np.maximum(self.counts - window + 1, 0)
        return np.repeat(self.starts - (np.cumsum(per) - per), per) + np.arange(per.sum())

    def same(self, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
        """Whether the windows at these places are equal, word by word."""
        out = np.ones(len(a), bool)
        for k in range(window):
            out &= self.ids[a + k] == self.ids[b + k]
        return out


def earliest(words: Words, at: np.ndarray, order: tuple[np.ndarray, np.ndarray], window: int) -> np.ndarray:
    """For each window: whether an equal one is strictly earlier. ``order``: document and start of each window."""
    doc, start = order
    # the sort: hash first, then document and start
    hashes = words.grams(window)[at]
    by = np.lexsort((start, doc, hashes))
    hashes = hashes[by]
    first = np.concatenate(([0], np.flatnonzero(hashes[1:] != hashes[:-1]) + 1)) if len(by) else np.empty(0, np.int64)
    sizes = np.diff(np.concatenate((first, [len(by)])))
    later = np.zeros(len(at), bool)
    if not len(by):
        return later
    head = np.repeat(first, sizes)
    other = np.flatnonzero(head != np.arange(len(by)))
    x, y = by[other], by[head[other]]
    equal = words.same(at[x], at[y], window)
    later[x[equal]] = (doc[x[equal]] != doc[y[equal]]) | (start[x[equal]] != start[y[equal]])
    if not equal.all():  # different windows with one hash: all but unheard of, so one by one
        for h in np.unique(hashes[other[~equal]]):
            seen: dict[bytes, tuple[int, int]] = {}
            for i in by[hashes == h]:
                key = words.ids[at[i] : at[i] + window].tobytes()
                least = seen.setdefault(key, (doc[i], start[i]))
                later[i] = least != (doc[i], start[i])
    return later


def _pack(*columns: np.ndarray, text: bytes = b"") -> bytes:
    from zstandard import ZstdCompressor

    head = np.array([len(c) for c in columns], "<i8").tobytes()
    return ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(c, "<i8").tobytes() for c in columns) + text)


def _unpack(blob: bytes, columns: int) -> tuple[list[np.ndarray], bytes]:
    from zstandard import ZstdDecompressor

    raw = ZstdDecompressor().decompress(blob)
    at, out = 8 * columns, []
    for n in np.frombuffer(raw, "<i8", columns):
        out.append(np.frombuffer(raw, "<i8", int(n), at))
        at += 8 * int(n)
    return out, raw[at:]


def _spans(keys: np.ndarray, hashes: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """Starts of windows, as document, text hash, first word and word after the last; neighbours are joined."""
    order = np.lexsort((starts, hashes, keys))
    keys, hashes, starts = keys[order], hashes[order], starts[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1]) | (starts[1:] > starts[:-1] + length)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(keys)])) - 1 if len(first) else first
    return [keys[first], hashes[first], starts[first], starts[last] + length]


def _runs(at: np.ndarray, breaks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows at these places as runs: index of the first window, number of words. ``breaks``: where a run must end before this window."""
    new = np.ones(len(at), bool)
    new[1:] = breaks[1:] | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    return begin, np.diff(np.concatenate((begin, [len(at)]))) + window - 1


def by_rarity(grams: np.ndarray, levels: np.ndarray | None) -> np.ndarray:
    """Grams in the order in which minimisers are chosen: rare classes first, then by hash."""
    if levels is None:
        return grams
    cell = grams >> np.uint64(64 - (len(levels) - 1).bit_length())
    return levels[cell].astype(np.uint64) << np.uint64(56) | grams >> np.uint64(8)


def rarity_levels(counts: np.ndarray) -> np.ndarray:
    """Level of each class: 0 up to twice the mean, then one more for each doubling."""
    mean = max(4.0, counts.sum() / max(1, len(counts)))
    return np.floor(np.log2(np.maximum(counts / mean, 1.0))).astype(np.uint8)


def _texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[list, list, list, list]]:
    """Chunks of texts that have a window: keys, hashes of texts, joined words, numbers of words."""
    held, size = ([], [], [], []), 0
    for batch in batches:
        for k, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2))):
            words = text.encode("utf-8", "surrogatepass").split()
            if len(words) < window:
                continue
            joined = b" ".join(words) + b" "
            for column, value in zip(held, (k, h, joined, len(words))):
                column.append(value)
            size += len(joined)
            if size >= CHUNK_BYTES:
                yield held
                held, size = ([], [], [], []), 0
    if size:
        yield held


def _counted(cells: int, window: int, gram: int):
    """Texts to ``cell, n``: how many windows that stay begin with a gram of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for keys, hashes, texts, sizes in _texts(batches, window):
            words = Words(b"".join(texts), np.array(sizes, np.int64))
            at = words.windows(window)
            doc = np.repeat(np.arange(len(keys)), words.counts - window + 1)
            later = earliest(words, at, (doc, at), window)
            counts += np.bincount((words.grams(gram)[at[~later]] >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(counts[seen])], ["cell", "n"])

    return run


def rarity(keyed: DataFrame, size: int, window: int, gram: int) -> np.ndarray | None:
    """Levels of the gram classes, from a sample of the documents ``k, th, t`` of ``size`` bytes; at most ``MOST_CELLS`` numbers come to the driver."""
    every = max(1, min(size // SAMPLE_BYTES, SAMPLE_SHARE))
    cells = 1 << max(0, size // every // 64).bit_length()
    cells = min(MOST_CELLS, max(LEAST_CELLS, cells))
    drawn = keyed.where(F.pmod(F.xxhash64("k", "th", F.lit(1)), F.lit(every)) == 0)
    found = arrow_map(drawn, _counted(cells, window, gram), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(cells, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return rarity_levels(counts) if counts.any() else None


def _split(total: int, window: int, gram: int, run_most: int, levels: np.ndarray | None = None):
    """Texts to packed strings: ``bucket, kind, blob``. Kind 0 is super-k-mers, 1 is spans removed here already."""

    def chunk(keys: list[int], hashes: list[int], texts: list[bytes], counts: list[int]) -> Iterator[tuple[int, int, bytes]]:
        words = Words(b"".join(texts), np.array(counts, np.int64))
        at = words.windows(window)
        if not len(at):
            return
        doc = np.repeat(np.arange(len(keys)), np.maximum(words.counts - window + 1, 0))
        start = at - words.starts[doc]
        key, text_hash = np.array(keys, np.int64)[doc], np.array(hashes, np.int64)[doc]
        later = earliest(words, at, (key, start), window)
        if later.any():
            yield int(text_hash[0]) % total, 1, _pack(*_spans(key[later], text_hash[later], start[later], window))
        # the minimiser of each window: least gram, by doubling
        least, width = by_rarity(words.grams(gram), levels), 1
        most = window - gram + 1
        while width < most:
            step = min(width, most - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        at, doc, start, key, text_hash = (x[~later] for x in (at, doc, start, key, text_hash))
        least = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
        # cut long runs
        begin = np.flatnonzero(new)
        within = np.arange(len(at)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(at)]))))
        begin = np.flatnonzero(new | (within % run_most == 0))
        size = np.diff(np.concatenate((begin, [len(at)]))) + window - 1
        bucket = (_mix(least[begin]) % np.uint64(total)).astype(np.int64)
        order = np.lexsort((least[begin], bucket))
        first = words.offsets[at[begin]][order].tolist()
        stop = words.offsets[at[begin] + size][order].tolist()
        begin, size, bucket = begin[order], size[order], bucket[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).tolist()
        buffer = words.buffer
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                text = b"".join([buffer[i:j] for i, j in zip(first[a:b], stop[a:b])])
                own = begin[a:b]
                yield int(bucket[a]), 0, _pack(key[own], text_hash[own], start[own], size[a:b], text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held) -> Iterator[pa.RecordBatch]:
            rows = []
            for row in chunk(*held):
                rows.append(row)
                if sum(len(r[2]) for r in rows) > 4 << 20:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        def batch_of(rows) -> pa.RecordBatch:
            a, b, c = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["bucket", "kind", "blob"])

        for held in _texts(batches, window):
            yield from out(held)

    return run


def _count(window: int):
    """Buckets to spans ``k, th, first, stop``; a bucket's rows follow one another."""

    def spans(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "th", "first", "stop"])

    def bucket(parts: list, last: bool) -> tuple[list[pa.RecordBatch], list]:
        """Spans of windows that are not the earliest in these parts; unless it is the last time, the other windows as one part."""
        key, text_hash, first, size = (np.concatenate([p[0][i] for p in parts]) for i in range(4))
        words = Words(b"".join(p[1] for p in parts), size)
        at = words.windows(window)
        owner = np.repeat(np.arange(len(size)), size - window + 1)
        start = first[owner] + at - words.starts[owner]
        later = earliest(words, at, (key[owner], start), window)
        own = owner[later]
        out = [spans(_spans(key[own], text_hash[own], start[later], window))] if len(own) else []
        if last:
            return out, []
        at, owner, start = at[~later], owner[~later], start[~later]
        breaks = np.concatenate(([True], owner[1:] != owner[:-1]))
        begin, sizes = _runs(at, breaks, window)
        text = b"".join([words.buffer[i:j] for i, j in zip(words.offsets[at[begin]].tolist(), words.offsets[at[begin] + sizes].tolist())])
        return out, [([key[owner[begin]], text_hash[owner[begin]], start[begin], sizes], text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, most = None, [], 0, THIN_BYTES
        for batch in batches:
            for number, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if kind == 1:
                    yield spans(_unpack(blob, 4)[0])
                    continue
                if number != now:
                    if held:
                        yield from bucket(held, True)[0]
                    now, held, size, most = number, [], 0, THIN_BYTES
                held.append(_unpack(blob, 4))
                size += len(held[-1][1])
                if size > most:
                    found, held = bucket(held, False)
                    yield from found
                    size = len(held[0][1])
                    most = max(THIN_BYTES, 2 * size)  # what is left is not gone through again for each further part
        if held:
            yield from bucket(held, True)[0]

    return run


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``key, k, th, t``: ``k`` is an integer in the order of the keys, the largest for null."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(t).alias("th"), t.alias("t"))
    last = F.lit(int(LAST))
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        return rows.select("key", F.coalesce(F.col("key").cast("long"), last).alias("k"), "th", "t")
    # other ids by their rank: parts of a sort by range come in order
    ranks = rows.select("key").where("key is not null").distinct().orderBy("key")
    ranks = materialise(ranks.select(F.col("key").alias("ranked"), F.monotonically_increasing_id().alias("rank")), "ranks")
    return rows.join(ranks, F.col("key") == F.col("ranked"), "left").select("key", F.coalesce("rank", last).alias("k"), "th", "t")


def _repeated(keyed: DataFrame, window: int, gram: int, run_most: int) -> DataFrame:
    spark = keyed.sparkSession
    rows = keyed.select("k", "th", "t")
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    wide = max(partitions(spark), size // PARTITION_BYTES)
    total = max(partitions(spark) * BUCKETS, size // BUCKET_BYTES)
    packed = arrow_map(rows, _split(total, window, gram, run_most, rarity(rows, size, window, gram)), "bucket bigint, kind int, blob binary")
    # by number, not by hash: every partition gets its equal share of the buckets
    dealt = packed.repartitionById(wide, (F.col("bucket") % wide).cast("int")).sortWithinPartitions("bucket")
    with arrow_rows(spark, 128):
        return materialise(dealt.mapInArrow(_count(window), "k bigint, th bigint, first bigint, stop bigint"), "spans")


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, run_most: int = RUN) -> DataFrame:
    """``k, th, first, stop``: words of the document ``k`` (null: the largest integer; no integers: their rank) with text hash ``th`` to remove."""
    return _repeated(_keyed(docs, text, key), window, gram, run_most)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: key, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one space)."""
    keyed = _keyed(docs, text, key)
    found = _repeated(keyed, window, gram, RUN).groupBy("k", "th")
    found = found.agg(F.collect_list(F.struct("first", "stop")).alias("spans")).select(F.col("k").alias("sk"), F.col("th").alias("sh"), "spans")
    rows = keyed.join(found, (F.col("k") == F.col("sk")) & (F.col("th") == F.col("sh")), "left")
    rows = rows.select("key", "t", F.col("spans.first").alias("first"), F.col("spans.stop").alias("stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for t, first, stop in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = t.encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                if first:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, first, 1)
                    np.add.at(gone, stop, -1)
                    stays = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
                    words = [words[i] for i in stays]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), kept], ["key", "n_words", "n_removed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(rows, run, f"key {kind}, n_words bigint, n_removed bigint, kept string").toDF(key, "n_words", "n_removed", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM f WHERE n > 1
), x AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), k AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE gone.p IS NULL) AS kept, CAST(count(gone.p) AS BIGINT) AS n_removed
  FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
