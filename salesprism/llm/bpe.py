"""Byte-level BPE: encoding by ranked merges, decoding by concatenation.

Texts are split by the tokenizer's pattern. Each distinct word is folded
once per task and kept: its byte array starts as single bytes, and the
neighbours whose union has the lowest rank (the leftmost, if equal) are merged
until no union has a rank. New words of a block of texts are folded together,
one merge of each at a time; words over ``SHORT`` bytes one by one. The rank
map is a literal of the vocabulary's size, independent of the corpus. The
words kept are bounded (``MOST_WORDS``); past that they are folded again, with
the same result. Texts are handled in blocks of ``BLOCK`` bytes; a longer text
is a block of its own. Words are folded in tables of at most ``CELLS`` places,
so that a worker's memory follows neither its block nor its Arrow batch.

Ids travel as little-endian unsigned 32-bit integers in one binary value, so
that digests and lengths are plain Spark functions. Null and empty texts have
no ids; null ids decode to no bytes. Rows are independent: no shuffle.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MOST_WORDS = 800_000
SHORT = 32  # bytes of a word that is folded together with others
WIDTHS = (8, 16, SHORT)  # words up to these sizes share a table
BLOCK = 1 << 20  # bytes of texts handled at once
CELLS = 1 << 17  # places of words folded in one table
NEVER = np.iinfo(np.int32).max  # rank of a union without one
NO_UNION = np.iinfo(np.int64).max  # stands behind all pairs of ranks


@dataclass
class Vocabulary:
    """Ranks of tokens, the pattern that splits texts, and the words folded so far (never shipped)."""

    ranks: dict[bytes, int]
    pattern: str
    most_words: int = MOST_WORDS
    known: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # white space as Unicode defines it, as the rank files' own library does
        self.split = regex.compile(self.pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.pieces = pa.array(tokens, pa.large_binary())
        self.byte_ids = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        keys, found = array("q", [NO_UNION]), array("i", [NEVER])  # no objects: each worker builds this
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None:
                    keys.append(left << 32 | right)
                    found.append(rank)
        order = np.argsort(keys)
        self.unions, self.union_ranks = np.array(keys)[order], np.array(found)[order]
        self.byte_unions = self._ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def __reduce__(self):
        return Vocabulary, (self.ranks, self.pattern, self.most_words)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        known, parts = self.known, [self.split(t) for t in texts]
        words = set(chain.from_iterable(parts))
        fresh = words.difference(known)
        if fresh and len(known) + len(fresh) > self.most_words:
            known.clear()
            fresh = words
        raw = {w: w.encode("utf-8", "surrogatepass") for w in fresh}
        long = [w for w, r in raw.items() if len(r) > SHORT]
        for w in long:
            known[w] = np.array(fold(raw.pop(w), self.ranks), "<u4").tobytes()
        known.update(zip(raw, self.fold_all(list(raw.values())), strict=True))
        out = [b"".join(map(known.__getitem__, part)) for part in parts]
        for w in long:
            del known[w]
        return out

    def fold_all(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of words of at most ``SHORT`` bytes, as bytes."""
        out: list[bytes] = [b""] * len(words)
        at_width: dict[int, list[int]] = {w: [] for w in WIDTHS}
        for i, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                at_width[next(w for w in WIDTHS if len(word) <= w)].append(i)
        for width, places in at_width.items():
            for begin in range(0, len(places), CELLS // width):
                part = places[begin:begin + CELLS // width]
                table, sizes = self._merged([words[i] for i in part], width)
                flat = table.astype("<u4").tobytes()
                for row, (i, n) in enumerate(zip(part, sizes.tolist(), strict=True)):
                    out[i] = flat[4 * width * row:4 * (width * row + n)]
        return out

    def _merged(self, words: Sequence[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one row each, and how many of a row count."""
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_ids[raw], -1)
        if (ids[np.arange(width) < sizes[:, None]] < 0).any():
            raise KeyError("a byte of the text has no rank")
        ranks = np.where(
            np.arange(1, width) < sizes[:, None], self.byte_unions[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]], NEVER)
        done, live = ids.copy(), np.arange(len(words))
        places = np.arange(width)
        while len(live):
            at = ranks.argmin(axis=1)  # the leftmost of the lowest
            low = ranks[np.arange(len(live)), at]
            go = low < NEVER
            done[live[~go]] = ids[~go]
            live, ids, ranks, at, low = live[go], ids[go], ranks[go], at[go], low[go]
            rows = np.arange(len(live))
            ids[rows, at] = low
            follow = np.minimum(places + (places > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, follow, 1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(follow[:, :-1], width - 2), 1)
            ranks[:, -1] = NEVER
            sizes[live] -= 1
            right = np.minimum(at, width - 2)
            ranks[rows, right] = self._ranks(ids[rows, right], ids[rows, right + 1])
            left = np.maximum(at - 1, 0)
            ranks[rows, left] = self._ranks(ids[rows, left], ids[rows, left + 1])
        return done, sizes

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of unions of neighbours; ``NEVER`` where there is none or a row has ended."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) << 32 | right)
        at = np.searchsorted(self.unions, key)
        return np.where(self.unions[at] == key, self.union_ranks[at], NEVER)

    def decode(self, ids: bytes) -> bytes:
        """Bytes that ids stand for: the pieces taken lie one behind the other."""
        pieces = self.pieces.take(pa.array(np.frombuffer(ids, "<u4")))
        _, edges, data = pieces.buffers()
        if data is None:
            return b""
        edges = np.frombuffer(edges, np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
        return memoryview(data)[edges[0]:edges[-1]].tobytes()


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > SHORT:
        return fold_long(word, ranks)
    pieces = [word[i:i + 1] for i in range(len(word))]
    never = len(ranks) + 256
    pairs = [ranks.get(a + b, never) for a, b in zip(pieces, pieces[1:], strict=False)]
    while pairs and (low := min(pairs)) < never:
        i = pairs.index(low)
        pieces[i:i + 2] = [pieces[i] + pieces[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(pieces[i - 1] + pieces[i], never)
        if i < len(pairs):
            pairs[i] = ranks.get(pieces[i] + pieces[i + 1], never)
    return [ranks[p] for p in pieces]


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges from a heap of (rank, place), for words of any length."""
    size = len(word)
    end = list(range(1, size + 1))  # end of the piece that starts here
    before = list(range(-1, size - 1))
    alive = bytearray(b"\1") * size
    heap: list[tuple[int, int, int, int]] = []

    def offer(left: int) -> None:
        right = end[left]
        if right < size and (rank := ranks.get(word[left:end[right]])) is not None:
            heapq.heappush(heap, (rank, left, right, end[right]))

    for i in range(size - 1):
        offer(i)
    while heap:
        _, left, right, stop = heapq.heappop(heap)
        if not alive[left] or end[left] != right or not alive[right] or end[right] != stop:
            continue
        end[left] = stop
        alive[right] = 0
        if stop < size:
            before[stop] = left
        offer(left)
        if left:
            offer(before[left])
    return [ranks[word[i:end[i]]] for i in range(size) if alive[i]]


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank map of a vocabulary file: a token in base64 and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def blocks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, null as empty, in blocks of about ``BLOCK`` bytes."""
    if len(texts):
        load = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK
        edge = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), len(texts)]
        for begin, end in zip(edge, edge[1:], strict=False):
            yield [t or "" for t in texts.slice(begin, end - begin).to_pylist()]


def checked(words: Vocabulary, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Structs (ids, same) of the texts; each block goes back to Spark as soon as it is done."""
    for texts in batches:
        for block in blocks(texts):
            ids = words.encode_all(block)
            same = [words.decode(i) == t.encode("utf-8", "surrogatepass") for i, t in zip(ids, block, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], ["ids", "same"])


class Tokenizer:
    """Encoding and decoding of columns; the vocabulary is broadcast once."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str, most_words: int = MOST_WORDS):
        self.shared = spark.sparkContext.broadcast(Vocabulary(ranks, pattern, most_words))

    def encode(self, text: Column) -> Column:
        """Ids of a text as little-endian unsigned 32-bit integers; no ids for null."""
        shared = self.shared

        def run(texts: pa.Array) -> pa.Array:
            words = shared.value
            return pa.array([ids for block in blocks(texts) for ids in words.encode_all(block)], pa.binary())

        return F.arrow_udf(run, "binary")(text)

    def encode_and_check(self, text: Column) -> Column:
        """(ids, same): the ids of a text and whether they decode to it, in one pass and so one Python worker a task."""
        shared = self.shared

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return checked(shared.value, batches)

        return F.arrow_udf(run, "ids binary, same boolean")(text)

    def decode(self, ids: Column) -> Column:
        """Bytes that the ids stand for."""
        shared = self.shared

        def run(batch: pa.Array) -> pa.Array:
            words = shared.value
            return pa.array([words.decode(i.as_py() or b"") for i in batch], pa.binary())

        return F.arrow_udf(run, "binary")(ids)


def count(ids: Column) -> Column:
    """Number of ids."""
    return (F.octet_length(ids) / 4).cast("long")


def as_list(ids: bytes) -> Sequence[int]:
    return np.frombuffer(ids, "<u4").tolist()
