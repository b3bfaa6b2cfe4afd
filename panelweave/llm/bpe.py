"""Byte-level BPE encoding and decoding.

The vocabulary is a rank file; bytes are mapped to Latin-1 characters so that a
string automaton (Aho-Corasick) can find the longest token at any place of a piece.
Encoding walks the piece from the left, takes the longest token that is
*compatible* with the token before it, and backtracks to shorter ones where none
is. Two adjacent tokens are compatible if merging their joint bytes gives just
these two; a sequence of pairwise compatible tokens is the one that the merges
give, so no merge is ever simulated on a whole piece. Compatibility is memoised
by pair, and a dead position is never tried twice: linear in the piece.

Nulls count as the empty text (no token); texts are never cut, and a piece of
any length costs linear time. Repeated rows and columns of any other name pass
through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.llm.common import arrow_map, numbered, strings, with_results
from panelweave.session import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Longest chunk that is kept in the cache, and entries before it starts anew (some 70 MB).
CACHE_CHARS, CACHE_ENTRIES = 40, 400_000

#: Pairs of tokens whose compatibility is kept (some 50 MB).
MEMO_ENTRIES = 500_000


class Generations:
    """A bounded cache of two generations: what is still asked for when the young one is full moves on with it."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries // 2, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    """Encoder and decoder of one rank file. Build it once per process with :func:`codec`."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern).findall
        self.rank = {token.decode("latin-1"): number for token, number in ranks.items()}
        self.token = {number: text for text, number in self.rank.items()}
        self.bytes = {number: token for token, number in ranks.items()}
        self.size = [0] * (max(ranks.values(), default=0) + 1)
        for token, number in ranks.items():
            self.size[number] = len(token)
        self.widest = max(self.size)
        self.automaton = ahocorasick.Automaton()
        for text, number in self.rank.items():
            self.automaton.add_word(text, number)
        self.automaton.make_automaton()
        self._split: dict[int, tuple[int, int]] = {}
        self._shorter: dict[int, int] = {}
        self._fits: dict[int, bool] = {}
        self._chunks, self._pieces = Generations(CACHE_ENTRIES), Generations(CACHE_ENTRIES // 8)

    # -- what the merges do to the bytes of a single token or pair

    def split(self, number: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; a token that no merge makes is its own two parts."""
        found = self._split.get(number)
        if found is None:
            parts = list(self.token[number])
            rank = self.rank
            while len(parts) > 2:
                best, at = number, -1
                for i in range(len(parts) - 1):
                    r = rank.get(parts[i] + parts[i + 1], number)
                    if r < best:
                        best, at = r, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else (number, number)
            self._split[number] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two again.

        Undo the later of the two merges at the border, again and again. If the
        tokens that face each other at some time would have merged before the
        merges that are still to be undone, the border does not survive.
        """
        key = left << 20 | right
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._border_survives(left, right)
        return known

    def _border_survives(self, left: int, right: int) -> bool:
        token, rank = self.token, self.rank
        # the first merge that has been undone on either side; a merge across the border must come before it
        before = len(rank) + 1
        while True:
            across = rank.get(token[left] + token[right])
            if across is not None and across < before:
                return False
            left_parts, right_parts = self.split(left), self.split(right)
            can_left, can_right = left_parts[1] != left, right_parts[0] != right
            if not can_left and not can_right:
                return True
            if can_left and (left > right or not can_right):
                # merges of equal rank run from left to right: the left token was made before one across the border
                before, left = left, left_parts[1]
            else:
                before, right = right + 1, right_parts[0]

    def shorter(self, number: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        found = self._shorter.get(number)
        if found is None:
            text, found = self.token[number], -1
            for end in range(len(text) - 1, 0, -1):
                if (found := self.rank.get(text[:end], -1)) >= 0:
                    break
            self._shorter[number] = found
        return found

    # -- pieces, texts

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as its bytes in Latin-1."""
        rank = self.rank.get
        whole = rank(piece)
        if whole is not None:
            return [whole]
        size, fits, prefix, widest = self.size, self._fits, self.automaton.longest_prefix, self.widest
        if len(fits) > MEMO_ENTRIES:
            fits.clear()
        dead: set[int] = set()
        out: list[int] = []
        at, stop, last = 0, len(piece), -1
        while True:
            part = piece[at : at + widest]
            length = prefix(part)
            while (candidate := rank(part[:length])) is None:  # the automaton's path may go on past the longest token
                length -= 1
            end = at + length
            while True:
                if end not in dead:
                    fit = True if last < 0 else fits.get(last << 20 | candidate)
                    if fit is None:
                        fit = self.fits(last, candidate)
                    if fit:
                        break
                candidate = self.shorter(candidate)
                while candidate < 0:  # nothing fits here: give the last token up
                    dead.add(at)
                    gone = out.pop()
                    at -= size[gone]
                    candidate, last = self.shorter(gone), out[-1] if out else -1
                end = at + size[candidate]
            out.append(candidate)
            if end == stop:
                return out
            at, last = end, candidate

    def _encode_chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        pieces = self.pieces(chunk)
        if len(pieces) == 1:  # most chunks: kept as a chunk, so not as a piece too
            return array("I", self.encode_piece(chunk.encode("utf-8").decode("latin-1"))).tobytes()
        for piece in pieces:
            found = self._pieces.get(piece)
            if found is None:
                found = self.encode_piece(piece.encode("utf-8").decode("latin-1"))
                if len(piece) <= CACHE_CHARS:
                    self._pieces.put(piece, found)
            ids += found
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.

        No piece reaches past a single space between two characters that are no
        white space, so the text is cut before each and the cuts are cached.
        """
        if not text:
            return b""
        words = cuts(text)
        chunks = self._chunks
        out = list(map(chunks.young.get, words))
        out[0] = self._encode_chunk(words[0])  # the only cut without a space before it
        at = -1
        try:
            while True:
                at = out.index(None, at + 1)
                word = words[at]
                found = chunks.get(word)
                if found is None:
                    found = self._encode_chunk(f" {word}")
                    if len(word) <= CACHE_CHARS:
                        chunks.put(word, found)
                out[at] = found
        except ValueError:
            return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I")))


#: A text with any of these has cuts that must be glued again: white space beside a space, or at an end.
_GLUE = re.compile(r"\s |  | \s|^\s|\s$").search


def cuts(text: str) -> list[str]:
    """The text, cut at every single space between two characters that are no white space (the space is left out)."""
    words = text.split(" ")
    if _GLUE(text):
        glued = [words[0]]
        for w in words[1:]:
            last = glued[-1]
            if not w or not last or w[0].isspace() or last[-1].isspace():
                glued[-1] = f"{last} {w}"
            else:
                glued.append(w)
        words = glued
    return words


@lru_cache(maxsize=4)
def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of a rank file, built once per process; by default the installed multilingual vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Codec(ranks, pattern or public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Add ``token_ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (binary) to every row of ``docs``.

    A narrow map: no shuffle, memory bounded by one Arrow batch and the caches.
    Null text: empty ids and empty bytes. Columns of these two names are replaced.
    """
    at, rows = docs.columns.index(text), numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(x) for x in strings(batch.column(at))]
            arrays = [*batch.columns, pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "token_ids", "decoded"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    found = arrow_map(rows, run, f"{fields}, token_ids binary, decoded binary")
    return with_results(found, docs.columns, {c: F.col(c) for c in ("token_ids", "decoded")})


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, ids: bool = False) -> DataFrame:
    """Per row ``key, n_tokens, ids_sha256, decoded_sha256``, and with ``ids`` also ``token_ids`` (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            counts, of_ids, of_bytes, all_ids = [], [], [], []
            for x in strings(batch.column(1)):
                found = own.encode(x)
                counts.append(len(found) // 4)
                of_ids.append(hashlib.sha256(found).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(found)).hexdigest())
                if ids:
                    all_ids.append(found)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                arrays, names = [*arrays, pa.array(all_ids, pa.binary())], [*names, "token_ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * ids
    found = arrow_map(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t")), run, schema)
    return found.toDF(key, *found.columns[1:])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
