"""Shards of near-equal bytes: a minimax contiguous partition of ordered atomic groups.

Rows with equal text form a group that is never split. Groups are ordered
by a 64-bit hash of their text. The smallest feasible capacity of a shard is
found by binary search, each trial checked greedily, and the shards are cut
there.

The driver never sees all groups. It holds cells of the hash range (a fixed
number), and only cells in which some trial could cut are divided further,
until every such cell is a single group; the result is then the same as over
all groups. If one group alone sets the capacity, greedy filling would leave
later shards empty, so each cut is moved towards an equal share of what is
left, as far as the capacity allows.

Null text counts as empty text (0 bytes, the same group as ''). Null ids are
kept. Repeated rows are rows of the same group. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.session import stage

ROW_BYTES = 16  # added to each text's bytes
CELL_BITS = 16  # cells of the first round: 2^16
MOST_PIECES = 1 << 18  # pieces of one further round
SALTS = 1024  # parts of a shard in which slots are numbered


class Pieces:
    """Neighbouring cells of the hash range, in order; an atomic one holds a single group."""

    def __init__(self, low: np.ndarray, high: np.ndarray, size: np.ndarray):
        order = np.argsort(low, kind="stable")
        self.low, self.high, self.size = low[order], high[order], size[order]
        self.edge = np.concatenate([[0], np.cumsum(self.size)])

    @property
    def atomic(self) -> np.ndarray:
        return self.low == self.high


def greedy_cuts(edge: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """End of each shard when each takes all it can, or None if the shards do not suffice."""
    ends, at, last = [], 0, len(edge) - 1
    while at < last:
        at_next = int(np.searchsorted(edge, edge[at] + capacity, "right")) - 1
        if at_next == at or len(ends) == shards:
            return None
        ends.append(at_next)
        at = at_next
    return ends


def smallest_capacity(edge: np.ndarray, shards: int) -> int:
    """Binary search over capacities."""
    sizes = np.diff(edge)
    total = int(edge[-1])
    low, high = max(int(sizes.max()), -(-total // shards)), total
    while low < high:
        trial = (low + high) // 2
        if greedy_cuts(edge, trial, shards) is None:
            low = trial + 1
        else:
            high = trial
    return low


def could_cut(pieces: Pieces, capacity: int, least: int, shards: int) -> np.ndarray:
    """Pieces of several groups inside which a trial between ``least`` and ``capacity`` may cut."""
    edge, total = pieces.edge, int(pieces.edge[-1])
    open_ = np.zeros(len(pieces.size), bool)
    low = 0
    for j in range(1, shards):
        inside = int(np.searchsorted(edge, min(low + least, total), "right")) - 1
        low = max(low, int(edge[min(inside, len(edge) - 1)]))
        first = int(np.searchsorted(edge, low, "right")) - 1
        last = int(np.searchsorted(edge, min(j * capacity, total), "left"))
        open_[first:last + 1] = True
        if low >= total:
            break
    return open_ & ~pieces.atomic


def balanced_cuts(edge: np.ndarray, capacity: int, shards: int) -> list[int]:
    """End of each shard: nearest to an equal share of the rest, within what the capacity leaves possible."""
    last = len(edge) - 1
    latest = [last]  # latest[k]: the first piece from which k shards suffice
    for _ in range(shards):
        latest.append(int(np.searchsorted(edge, edge[latest[-1]] - capacity, "left")))
    ends, at = [], 0
    for j in range(shards):
        most = int(np.searchsorted(edge, edge[at] + capacity, "right")) - 1
        least = max(at, latest[shards - j - 1])
        share = edge[at] + (edge[last] - edge[at]) / (shards - j)
        near = int(np.searchsorted(edge, share, "left"))
        if near > 0 and share - edge[near - 1] < edge[min(near, last)] - share:
            near -= 1
        at = int(min(max(near, least), most, last))
        ends.append(at)
    return ends


def _cells(rows: DataFrame, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = (
        rows.groupBy(F.shiftright("_key", shift).alias("cell"))
        .agg(F.min("_key").alias("low"), F.max("_key").alias("high"), F.sum("_size").alias("size"))
        .select("low", "high", "size").toPandas()
    )
    return tuple(found[c].to_numpy(np.int64) for c in ("low", "high", "size"))


def find_cuts(rows: DataFrame, shards: int) -> list[int]:
    """First hash of shards 1, 2, ...; ``rows`` has ``_key`` and ``_size``."""
    largest = rows.groupBy("_key").agg(F.sum("_size").alias("s")).agg(F.max("s")).first()[0]
    if largest is None:
        return []
    shift = 64 - CELL_BITS
    pieces = Pieces(*_cells(rows, shift))
    total = int(pieces.edge[-1])
    least = max(int(largest), -(-total // shards))
    while True:
        capacity = smallest_capacity(pieces.edge, shards)
        split = could_cut(pieces, capacity, least, shards)
        if not split.any() or capacity == least:
            break
        finer = max(1, min(shift, int(np.log2(max(2, MOST_PIECES / split.sum())))))
        wanted = rows.sparkSession.createDataFrame([(int(k) >> shift,) for k in pieces.low[split]], "_cell bigint")
        # at most MOST_PIECES rows
        inside = rows.withColumn("_cell", F.shiftright("_key", shift)).join(F.broadcast(wanted), "_cell", "left_semi")
        shift -= finer
        low, high, size = _cells(inside, shift)
        pieces = Pieces(
            np.concatenate([pieces.low[~split], low]), np.concatenate([pieces.high[~split], high]),
            np.concatenate([pieces.size[~split], size]))
    ends = balanced_cuts(pieces.edge, capacity, shards)
    top = np.iinfo(np.int64).max
    return [int(pieces.low[e]) if e < len(pieces.low) else int(top) for e in ends[:-1]]


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's size, text checksum, shard and slot (0, 1, ... in each shard). Other columns are not carried."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"), F.xxhash64(text).alias("_key")), "shard-rows")
    number: Column = F.lit(0)
    for cut in find_cuts(rows, shards):
        number = number + F.when(F.col("_key") >= F.lit(cut), 1).otherwise(0)
    placed = rows.withColumns({
        "_shard": number, "_salt": F.pmod(F.xxhash64("_id", "_key"), F.lit(SALTS))})
    # one row per shard and salt
    counts = placed.groupBy("_shard", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_shard", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_shard", "_salt").orderBy("_id", "_key", "_size")
    numbered = placed.withColumn("_at", F.row_number().over(inside))
    return numbered.join(F.broadcast(offsets), ["_shard", "_salt"]).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), (F.col("_before") + F.col("_at") - 1).alias("slot"))
