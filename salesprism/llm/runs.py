"""Periodic runs of words, by maximal pairs from the bottom-up tree of LCP intervals.

A run is a stretch of words with smallest period q, at least ``LEAST`` words
and ``TIMES`` periods long, that no neighbouring word extends. Its words from
the start and those one period on are equal up to its end, and differ left
and right of it: a maximal pair of distance q. The other way round, a maximal
pair at distance d with a common length of (``TIMES`` - 1) * d or more is a
stretch of period d that cannot be extended. So the maximal pairs within that
distance are the runs (and multiples of their periods, of which the smallest
is kept), and nothing needs to be extended.

1. Texts are taken in blocks. Texts in which no row of words repeats near
   enough are done with.
2. Suffixes of the others are ranked by prefix doubling, each text apart, and
   the ranks of all levels give the common length of neighbours.
3. Intervals are joined bottom-up, the smaller into the larger. Positions in
   reach of each other within a third of the common length lie one smallest
   period apart, so all of them but the first are of one left-word class: the
   class lists of an interval are one sorted list, of which a position asks
   for its first partner of another class on either side.

Whole texts are worked on where they stand: no shuffle. Memory follows the
longest text. Words are parted by ASCII white space; a null text has none.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism.llm.words import blocks

LEAST, TIMES = 6, 4
BLOCK = 1 << 20  # bytes of texts worked on at once
RUN_TYPE = "array<struct<start: long, length: long, period: long>>"
Run = tuple[int, int, int]  # start, length, period


def shortest_match(least: int = LEAST, times: int = TIMES) -> int:
    """Least common length of the two sides of a run of any period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def find_runs(texts: Sequence[Sequence[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """Runs of each text, given as words, by start and then period."""
    out: list[list[Run]] = [[] for _ in texts]
    code, owner, begin = _numbered(texts)
    some = _repeating(code, owner, begin, shortest_match(least, times), times)
    if not len(some):
        return out
    stay = np.isin(owner, some)
    code, owner = code[stay], owner[stay]
    sizes = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(sizes) - sizes
    left = np.concatenate([[-1], code[:-1]])
    left[begin[some]] = -1 - np.arange(len(some))
    order, common = _suffixes(code, owner)
    seen: dict[tuple[int, int], int] = {}
    for a, b in _segments(order, common, shortest_match(least, times), times):
        for start, period, length in _pairs(order[a:b].tolist(), common[a:b - 1].tolist(), left, times):
            if length >= least and seen.get((start, length), length) > period:
                seen[start, length] = period
    for (start, length), period in sorted(seen.items(), key=lambda run: (run[0][0], run[1])):
        text = int(owner[start])
        out[text].append((int(start - begin[text]), length, period))
    return out


def _numbered(texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each word, the text it is in, and where each text begins."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in texts], np.int64)
    code = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64, int(sizes.sum()))
    return code, np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes


def _repeating(code: np.ndarray, owner: np.ndarray, begin: np.ndarray, width: int, times: int) -> np.ndarray:
    """Texts in which some row of ``width`` words stands twice within a distance a run can have.

    Rows are compared by hash here: one text too many does no harm.
    """
    many = len(code) - width + 1
    if many < 2:
        return np.empty(0, np.int64)
    row = owner[:many].astype(np.uint64) + np.uint64(1)
    for i in range(width):
        row = (row * np.uint64(0x9E3779B97F4A7C15)) ^ (code[i:i + many].astype(np.uint64) + np.uint64(i + 1))
    whole = np.flatnonzero(owner[:many] == owner[width - 1:])
    order = whole[np.argsort(row[whole], kind="stable")]
    sizes = np.bincount(owner, minlength=len(begin))
    near = (row[order[1:]] == row[order[:-1]]) & (times * (order[1:] - order[:-1]) <= sizes[owner[order[1:]]])
    return np.unique(owner[order[1:][near]])


def _suffixes(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, texts apart, and the words each shares with the next one."""
    n = len(code)
    rank = _dense(owner * (int(code.max()) + 1) + code)
    levels, width = [rank], 1
    while rank.max() + 1 < n:
        after = np.zeros(n, np.int64)
        same = np.flatnonzero(owner[width:] == owner[:-width]) if width < n else np.empty(0, np.int64)
        after[same] = rank[same + width].astype(np.int64) + 1
        rank = _dense(rank.astype(np.int64) * (n + 1) + after)
        levels.append(rank)
        width *= 2
    order = np.argsort(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 2, -1, -1):  # the last level has no equal ranks
        ranks, width = levels[level], 1 << level
        inside = np.flatnonzero((a < n) & (b < n))
        # equal ranks also stand for equal shorter rests, which cannot be: no two rests of a text are equally long
        same = inside[ranks[a[inside]] == ranks[b[inside]]]
        common[same] += width
        a[same] += width
        b[same] += width
    return order, common


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


def _segments(order: np.ndarray, common: np.ndarray, shortest: int, times: int) -> Iterator[tuple[int, int]]:
    """Ranges of suffixes that share ``shortest`` words and hold two places near enough for a run."""
    inner = common >= shortest
    change = np.diff(np.concatenate([[0], inner.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    if not len(starts):
        return
    most = np.maximum.reduceat(common, np.stack([starts, ends], 1).reshape(-1)[:-1])[::2] if len(starts) else starts
    group = np.repeat(np.arange(len(starts)), ends - starts + 1)
    place = np.concatenate([order[a:b + 1] for a, b in zip(starts, ends, strict=True)])
    by_place = np.lexsort((place, group))
    gap = np.diff(place[by_place])
    same = group[by_place][1:] == group[by_place][:-1]
    nearest = np.full(len(starts), np.iinfo(np.int64).max)
    np.minimum.at(nearest, group[by_place][1:][same], gap[same])
    for i in np.flatnonzero((times - 1) * nearest <= most):
        yield int(starts[i]), int(ends[i]) + 1


def _pairs(order: list[int], common: list[int], left: np.ndarray, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, distance, length) of the maximal pairs of one segment that are near enough."""
    stack: list[tuple[int, list[int]]] = []  # open intervals: common length, places in order
    places = [order[0]]
    for at, length in enumerate([*common, 0]):
        while stack and stack[-1][0] > length:
            width, own = stack.pop()
            yield from _join(own, places, width, left, times)
            places = _merged(own, places)
        if stack and stack[-1][0] == length:
            yield from _join(stack[-1][1], places, length, left, times)
            stack[-1] = length, _merged(stack[-1][1], places)
        elif at < len(common):
            stack.append((length, places))
        if at < len(common):
            places = [order[at + 1]]


def _join(one: list[int], other: list[int], width: int, left: np.ndarray, times: int) -> Iterator[tuple[int, int, int]]:
    """Maximal pairs between two children of an interval of common length ``width``."""
    few, many = (one, other) if len(one) <= len(other) else (other, one)
    reach = width // (times - 1)
    for place in few:
        i = bisect_left(many, place - reach)
        if i < len(many) and many[i] < place and left[many[i]] != left[place]:
            yield many[i], place - many[i], place - many[i] + width
        i = bisect_right(many, place)
        if i < len(many) and many[i] - place <= reach and left[many[i]] != left[place]:
            yield place, many[i] - place, many[i] - place + width


def _merged(one: list[int], other: list[int]) -> list[int]:
    few, many = (one, other) if len(one) <= len(other) else (other, one)
    if 16 * len(few) > len(many):
        return sorted(many + few)
    for place in few:
        insort(many, place)
    return many


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> Sequence[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of which one text in ten goes round in a loop from some place on (its id decides)."""
    hashed = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = hashed // 10, len(words)
    if hashed % 10 or not n:
        return words
    begin = g % n
    period = 1 + (n - begin) // (3 + g % 8)
    loop = words[begin:begin + period]
    return (words[:begin] + loop * ((n - begin) // period + 1))[:n]


def detect(docs: DataFrame, edit=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period), text (its words, loops collapsed, joined by one space).

    ``edit(words, doc_id)``, if given, changes the words first. Rows that
    repeat an id stay rows of their own, a null id stays null; other columns
    are not carried.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in blocks(batch.column("text"), BLOCK):
                part = batch.slice(begin, end - begin)
                ids = part.column("doc_id").to_pylist()
                words = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in part.column("text")]
                if edit is not None:
                    words = [edit(w, i) for w, i in zip(words, ids, strict=True)]
                runs = find_runs(words)
                texts = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)]
                flat = [r for found in runs for r in found]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
                columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "length", "period"])),
                    pa.array(texts, pa.binary()).view(pa.string())], ["doc_id", "n_words", "runs", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUN_TYPE}, text string")


def report(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    # the longest; then the least start, then the least period
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda seen, r: F.when(
        seen.isNull() | (r["length"] > seen["length"]), r).otherwise(seen))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    named = found.withColumn("_best", best)
    return named.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
