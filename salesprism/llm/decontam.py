"""Benchmark passages in training texts, by a distributed positional inverted index.

1. ``build_index`` stores the postings of every training word: documents are
   taken in blocks of bounded size, and each word of a block is one row with
   the ascending places where it stands. A frequent word has a row in every
   block, so no list is longer than a block.
2. A query is a window of consecutive item words. Only the lists of words of
   the queries are read, and those of one block meet in one place.
3. In a block, a window whose words are not all there is done with. For the
   rest, the list of the window's rarest word gives the starts, and the list
   of each next rarer word, moved by its offset, keeps those it holds too.
   With a slack, words may stand that many places off: a proximity match.

Queries are dealt into slices of ``SLICE`` windows; each slice is one pass
over the lists of its own words, so what a task holds of the benchmark does
not grow with it. Words are 64-bit hashes.

Null texts have no words, as empty ones. Rows that repeat an id are documents
of their own; a null id stays null. Items without a text or without words ask
for nothing; those without an id mark words but are not listed. Other columns
are not read. Without items no word is hit; without documents there is no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.llm.words import Hasher, alphanumeric, blocks, raw_bytes
from salesprism.session import stage

WIDTH = 10
SLACK = 3
BLOCK = 1 << 22  # bytes of text in a block of the index, but for a longer text
GAP = 64  # places between documents, so that no match reaches from one to the next
SLICE = 200_000  # windows searched in one pass
STARTS = 1 << 20  # starts followed at once
PLACE_BITS = 32


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: rows of words (block, term, places) and of documents (block, doc, start, n)."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, block = Hasher(alphanumeric()), TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin, end in blocks(batch.column("text"), BLOCK):
                yield from _block(batch.slice(begin, end - begin), hasher, block)
                block += 1

    return stage(rows.mapInArrow(run, f"block long, term long, doc {kind}, start int, n int, places array<int>"), "postings")


def _block(part: pa.RecordBatch, hasher: Hasher, block: int) -> Iterator[pa.RecordBatch]:
    raw, begins = raw_bytes(part.column("text"))
    first, code = hasher.words(raw, begins)
    owner = np.searchsorted(begins, first, "right") - 1
    n = np.bincount(owner, minlength=part.num_rows)
    start = np.cumsum(n) - n + GAP * np.arange(part.num_rows)
    names = ["block", "term", "doc", "start", "n", "places"]
    none = pa.nulls(part.num_rows)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(part.num_rows, block)), none.cast(pa.int64()), part.column("doc"), pa.array(start, pa.int32()),
        pa.array(n, pa.int32()), none.cast(pa.list_(pa.int32()))], names)
    place = np.arange(len(code)) + GAP * owner
    order = np.argsort(code, kind="stable")
    code = code[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(code)), pa.int32()), pa.array(place[order], pa.int32()))
    empty = pa.nulls(len(head))
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(len(head), block)), pa.array(code[head]), empty.cast(part.column("doc").type),
        empty.cast(pa.int32()), pa.array(np.diff(np.append(head, len(code))), pa.int32()), lists], names)


def windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, terms): each run of ``width`` words of an item, or all words of a shorter one."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(alphanumeric())
        for batch in batches:
            for row in range(batch.num_rows):
                raw, begins = raw_bytes(batch.column("text").slice(row, 1))
                code = hasher.words(raw, begins)[1].astype(np.int64)
                if len(code):
                    terms = np.lib.stride_tricks.sliding_window_view(code, min(width, len(code)))
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(terms.reshape(-1)), terms.shape[1])
                    owner = batch.column("item").slice(row, 1).take(pa.array(np.zeros(len(terms), np.int64)))
                    yield pa.RecordBatch.from_arrays([owner, flat.cast(pa.list_(pa.int64()))], ["item", "terms"])

    return rows.mapInArrow(run, "item string, terms array<long>").distinct()


class Lists:
    """The posting lists of one block, to be intersected."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, places: np.ndarray):
        self.terms, self.sizes, self.places = terms, sizes, places
        self.begin = np.cumsum(sizes) - sizes
        # every posting as one ascending number: place in the list of its term
        self.keys = (np.repeat(np.arange(len(terms)), sizes) << PLACE_BITS) + places

    def search(self, asked: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``asked``, start) of the matches of windows, given as (windows, words) of terms."""
        if not len(self.terms) or not len(asked):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        whole = np.flatnonzero((self.terms[at] == asked).all(axis=1))
        at = at[whole]
        order = np.argsort(self.sizes[at], axis=1, kind="stable")  # rarest word first
        load = np.cumsum(self.sizes[at[np.arange(len(at)), order[:, 0]]]) if len(at) else np.empty(0, np.int64)
        found, begin = [], 0
        while begin < len(at):
            passed = load[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(load, passed + STARTS, "right")))
            row, start = self._follow(at[begin:end], order[begin:end], slack)
            found.append((whole[begin + row], start))
            begin = end
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found])

    def _follow(self, at: np.ndarray, order: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        rare = order[:, 0]
        first = at[np.arange(len(at)), rare]
        size = self.sizes[first]
        row = np.repeat(np.arange(len(at)), size)
        within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        start = self.places[self.begin[first][row] + within] - rare[row]
        for j in range(1, at.shape[1]):
            offset = order[row, j]
            base = at[row, offset] << PLACE_BITS
            low = base + np.maximum(start + offset - slack, 0)
            there = self.keys[np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)]
            keep = (there >= low) & (there <= base + start + offset + slack)
            row, start = row[keep], start[keep]
        return row, start


def _items_by_doc(doc: np.ndarray, item: np.ndarray, names: list[str | None], many: int) -> pa.Array:
    """The distinct named items of each document."""
    pairs = np.unique(np.stack([doc, item]), axis=1)
    named = np.array([names[i] is not None for i in pairs[1]], bool)
    doc, item = pairs[0][named], pairs[1][named]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=many))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([names[i] for i in item], pa.string()))


def _search_block(table: pa.Table, queries: list[tuple[np.ndarray, np.ndarray]], names: list[str | None], slack: int) -> pa.Table:
    is_doc = np.asarray(table.column("term").is_null())
    docs = table.filter(pa.array(is_doc)).sort_by("start")
    rest = table.filter(pa.array(~is_doc)).sort_by("term").combine_chunks()
    begin, n = (docs.column(c).to_numpy().astype(np.int64) for c in ("start", "n"))
    many = docs.num_rows
    sizes = rest.column("n").to_numpy().astype(np.int64)
    places = np.concatenate([c.flatten().to_numpy() for c in rest.column("places").chunks] or [np.empty(0)]).astype(np.int64)
    lists = Lists(rest.column("term").to_numpy(), sizes, places)
    length = int(begin[-1] + n[-1]) + 1 if many else 1
    edge = np.zeros(length + 1, np.int64)
    hits: dict[int, list] = {0: [], slack: []}
    for asked, item in queries:
        for off in hits:
            row, start = lists.search(asked, off)
            if off == 0:
                np.add.at(edge, start, 1)
                np.add.at(edge, start + asked.shape[1], -1)
            # the start of a match with slack may lie before its document; the rarest word does not
            hits[off].append((np.clip(np.searchsorted(begin, start + off, "right") - 1, 0, None), item[row]))
    cover = np.cumsum(edge)[:-1] > 0
    change = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
    left, right = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    owner = np.searchsorted(begin, left, "right") - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=many))])
    spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(left - begin[owner]), pa.array(right - begin[owner])], ["first", "until"]))
    found = {
        off: _items_by_doc(np.concatenate([d for d, _ in x] or [np.empty(0, np.int64)]),
                           np.concatenate([i for _, i in x] or [np.empty(0, np.int64)]), names, many)
        for off, x in hits.items()}
    return pa.table({
        "block": docs.column("block"), "start": docs.column("start"), "doc": docs.column("doc"),
        "n_words": pa.array(n), "spans": spans, "items": found[0], "near": found[slack]})


def find(index: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = SLACK) -> DataFrame:
    """Per document: doc, n_words, spans (words in a phrase match, as [first, until)), items and near (item ids).

    ``items`` are those with a phrase match, ``near`` those with a match
    where each word may stand up to ``slack`` words off its place.
    """
    if width - 1 + 2 * slack >= GAP:
        raise ValueError(f"width and slack must stay below the gap of {GAP} places between documents")
    spark = index.sparkSession
    asked = stage(windows(items, width), "windows")
    slices = max(1, -(-asked.count() // SLICE))
    kind = index.schema["doc"].dataType.simpleString()
    schema = (f"block long, start int, doc {kind}, n_words long, spans array<struct<first: long, until: long>>, "
              "items array<string>, near array<string>")
    found = []
    for number in range(slices):
        own = asked.where(F.pmod(F.xxhash64("item", "terms"), F.lit(slices)) == number)
        held = spark.sparkContext.broadcast(_packed(own.toArrow()))
        # at most SLICE * width terms: small enough to be sent to every task, so that no list is moved to be chosen
        terms = F.broadcast(own.select(F.explode("terms").alias("term")).distinct())
        lists = index.join(terms, "term", "left_semi")
        met = index.where(F.col("term").isNull()).unionByName(lists)
        found.append(met.groupBy("block").applyInArrow(_searcher(held, slack), schema))
    if slices == 1:
        return found[0]
    return reduce(DataFrame.unionByName, found).groupBy("block", "start").agg(
        F.any_value("doc").alias("doc"), F.any_value("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _searcher(held: Broadcast, slack: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        return _search_block(table, *held.value, slack)

    return run


def _packed(own: pa.Table) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str | None]]:
    """Windows of equal length as one array of terms with the number of each one's item, and the items' names."""
    ids = own.column("item").combine_chunks().dictionary_encode()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    names = [*ids.dictionary.to_pylist(), None]
    item = np.asarray(ids.indices.fill_null(len(names) - 1)).astype(np.int64)
    terms = own.column("terms").combine_chunks()
    size = np.diff(np.asarray(terms.offsets)) if len(terms) else np.empty(0, np.int64)
    queries = []
    for width in np.unique(size):
        rows = np.flatnonzero(size == width)
        queries.append((np.asarray(terms.take(pa.array(rows)).flatten()).reshape(-1, width), item[rows]))
    return queries, names


def _length(spans: Column) -> Column:
    """Number of words in any of the spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("until"))
    return F.aggregate(F.sort_array(spans), start, lambda seen, s: F.struct(
        (seen["n"] + F.greatest(F.lit(0), s["until"] - F.greatest(s["first"], seen["until"]))).alias("n"),
        F.greatest(seen["until"], s["until"]).alias("until")))["n"]


def report(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    n_hit = _length(F.col("spans"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))
