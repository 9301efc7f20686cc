"""Trie of conversation prefixes by a splitter skeleton.

1. Every conversation becomes a path: one 16-byte code per turn (role and
   text), so paths compare as bytes and texts stay where they are.
2. A bounded sample of (path, conversation) gives the splitters of a range
   partition. The trie of their paths is the skeleton; it is broadcast, its
   size bounded by ``SKELETON_BYTES`` (longer splitters are cut, which moves
   borders but changes no result). Copies of one path are split by id.
3. A node that is no prefix of a splitter lies whole in one shard. Sorted
   shards are read once with a stack of open nodes, and such nodes are
   finished there. For skeleton nodes each shard gives a partial aggregate.
4. Partials are summed; what skeleton nodes themselves add to the subtrees
   above them is a difference of running sums over the skeleton in preorder.

A shard is streamed: a task holds the open nodes of one path and the direct
children of open nodes. A conversation's turns meet in one task as codes and
sizes (about 50 bytes a turn), never as texts. The ids that end at a skeleton
node are passed on in pieces and hashed in order.

Null roles and texts are empty. Turns without conv_id belong to none and take
no part. Turns of equal number go in a fixed order of their own; repeated
rows are turns of their own. Other columns are not read. Without
conversations there is no node.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesprism.session import stage

CODE = 16  # bytes of a turn's code
HEAD, FAMILY = 9, 5
SKELETON_BYTES = 1 << 22
SAMPLES = 16  # sampled conversations per shard
TURNS_PER_SHARD = 2_000_000
PIECE = 10_000  # ids in a piece
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id and turns in order, as structs with the hex code and the bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * CODE)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), code.alias("code"), F.octet_length(text).cast("long").alias("size")).alias("turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % 5; h = crc32(c) % 9."""
    own = convs.withColumns({
        "_base": F.col("conv_id") - F.col("conv_id") % FAMILY,
        "_head": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")})
    bases = convs.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, HEAD - 1).alias("_first"))
    none = F.slice("turns", 1, 0)
    rest = F.slice("turns", F.col("_head") + 1, F.greatest(F.size("turns") - F.col("_head"), F.lit(0)))
    head = F.slice(F.coalesce("_first", none), F.lit(1), F.col("_head"))
    return own.join(bases, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


@dataclass(frozen=True)
class Skeleton:
    """Splitters in order, and the number, in preorder, of the node at each depth of their paths."""

    splitters: list[tuple[bytes, int]]
    nodes: list[list[int]]
    parents: list[int | None]
    depths: list[int]

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))

    def along(self, shard: int, path: bytes) -> list[int]:
        """Numbers of the skeleton nodes on a path of a shard, from the root."""
        best = [0]
        for i in (shard - 1, shard):
            if 0 <= i < len(self.splitters):
                known = self.nodes[i][:shared(self.splitters[i][0], path) + 1]
                if len(known) > len(best):
                    best = known
        return best

    def rows(self) -> list[tuple[int, int | None, int, int, int]]:
        """(node, parent, depth, first node behind its subtree, number of skeleton children)."""
        many = len(self.parents)
        until, children = list(range(1, many + 1)), [0] * many
        for node in range(many - 1, 0, -1):
            parent = self.parents[node]
            until[parent] = max(until[parent], until[node])
            children[parent] += 1
        return list(zip(range(many), self.parents, self.depths, until, children, strict=True))


def shared(one: bytes, other: bytes) -> int:
    """Number of first turns that two paths share."""
    most = min(len(one), len(other))
    if one[:most] == other[:most]:
        return most // CODE
    depth = 0
    while one[depth:depth + CODE] == other[depth:depth + CODE]:
        depth += CODE
    return depth // CODE


def skeleton(splitters: list[tuple[bytes, int]]) -> Skeleton:
    nodes, parents, depths, before, last = [], [None], [0], b"", [0]
    for path, _ in splitters:
        own = last[:shared(before, path) + 1]
        while len(own) <= len(path) // CODE:
            parents.append(own[-1])
            depths.append(len(own))
            own.append(len(parents) - 1)
        nodes.append(own)
        before, last = path, own
    return Skeleton(splitters, nodes, parents, depths)


def choose_splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Evenly spaced (path, conv_id) of a bounded sample: the conversations with the least hashes."""
    cut = max(1, SKELETON_BYTES // (CODE * shards))
    sample = paths.select(
        F.substring("path", 1, CODE * cut).alias("path"), "conv_id", (F.length("path") > CODE * cut).alias("cut"),
    ).orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLES * shards).collect()
    low = -(1 << 63)
    keys = sorted((bytes(r.path), low if r.cut else r.conv_id) for r in sample)
    return sorted({keys[i * len(keys) // shards] for i in range(1, shards)}) if keys else []


class Open:
    """An open node of a shard: what is known of it so far."""

    __slots__ = ("began", "children", "conv", "ends", "leaves", "pending", "piece", "saved", "size")

    def __init__(self, began: int, size: int):
        self.began, self.size = began, size
        self.children = self.leaves = self.saved = self.piece = 0
        self.conv, self.ends, self.pending = None, None, []

    def meet(self, conv: int) -> None:
        if self.conv is None or conv < self.conv:
            self.conv = conv


class Shard:
    """One shard read in order of path and id; gives rows of finished nodes, partial aggregates and pieces."""

    def __init__(self, number: int, trie: Skeleton, give: Callable[..., None]):
        self.number, self.trie, self.give = number, trie, give
        self.seen, self.path, self.known = 0, b"", [0]
        self.stack = [Open(0, 0)]

    def add(self, path: bytes, conv: int, sizes: list[int]) -> None:
        self._close(shared(self.path, path) if self.seen else 0)
        for depth in range(len(self.stack), len(path) // CODE + 1):
            self.stack.append(Open(self.seen, sizes[depth - 1]))
        if path != self.path or not self.seen:
            self.path, self.known = path, self.trie.along(self.number, path)
        self.seen += 1
        self._end(conv)

    def _end(self, conv: int) -> None:
        node, depth = self.stack[-1], len(self.stack) - 1
        node.meet(conv)
        name = str(conv)
        if depth >= len(self.known):
            if node.ends is None:
                node.ends = hashlib.sha256(name.encode())
            else:
                node.ends.update(f",{name}".encode())
            return
        node.ends = node.ends or []
        node.ends.append(name)
        if len(node.ends) == PIECE:
            self._piece(node, depth)

    def _piece(self, node: Open, depth: int) -> None:
        self.give("piece", node=self.known[depth], shard=self.number, piece=node.piece, ends=",".join(node.ends))
        node.piece, node.ends = node.piece + 1, []

    def _close(self, depth: int) -> None:
        """Finish the open nodes below ``depth``."""
        while len(self.stack) - 1 > depth:
            self._finish(self.stack.pop(), self.stack[-1], len(self.stack))

    def _finish(self, node: Open, above: Open, depth: int) -> None:
        members = self.seen - node.began
        if depth < len(self.known):
            self._partial(node, depth, members)
        else:
            for row in node.pending:
                self.give("node", parent_conv_id=node.conv, **row)
            node.leaves = node.leaves or 1
            node.saved += (members - 1) * node.size
            row = dict(conv_id=node.conv, depth=depth, n_convs=members, n_children=node.children, n_leaves=node.leaves,
                       saved_tokens=node.saved, ends=node.ends.hexdigest() if node.ends else NO_ENDS)
            above.children += 1
            if depth - 1 < len(self.known):
                self.give("node", node=self.known[depth - 1], **row)
            else:
                above.pending.append(row)
        above.meet(node.conv)
        above.leaves += node.leaves
        above.saved += node.saved

    def _partial(self, node: Open, depth: int, members: int) -> None:
        if node.ends:
            self._piece(node, depth)
        self.give("partial", node=self.known[depth], conv_id=node.conv, n_convs=members, n_children=node.children,
                  n_leaves=node.leaves, saved_tokens=node.saved, size=node.size)

    def done(self) -> None:
        if self.seen:
            self._close(0)
            self._partial(self.stack[0], 0, self.seen)


FIELDS = pa.schema([
    ("kind", pa.string()), ("node", pa.int64()), ("shard", pa.int64()), ("piece", pa.int64()), ("conv_id", pa.int64()),
    ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()), ("ends", pa.string())])
SCHEMA = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in FIELDS)
ROWS = 4096


def _local(trie: Skeleton) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []

        def give(kind: str, **row) -> None:
            rows.append({"kind": kind, **row})

        shard = None
        for batch in batches:
            for number, path, conv, sizes in zip(*(batch.column(c) for c in ("shard", "path", "conv_id", "sizes")), strict=True):
                if shard is None or shard.number != number.as_py():
                    if shard is not None:
                        shard.done()
                    shard = Shard(number.as_py(), trie, give)
                shard.add(path.as_py(), conv.as_py(), sizes.as_py())
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, FIELDS)
                    rows.clear()
        if shard is not None:
            shard.done()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, FIELDS)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) of pieces in order."""
    node, digest = None, None
    names = ["node", "ends_sha256"]
    for batch in batches:
        for number, text in zip(batch.column("node"), batch.column("ends"), strict=True):
            if number.as_py() != node:
                if digest is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names)
                node, digest = number.as_py(), hashlib.sha256(text.as_py().encode())
            else:
                digest.update(b"," + text.as_py().encode())
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names)


def build(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns); the columns are those of ``NODE``."""
    spark = convs.sparkSession
    code = F.unhex(F.array_join(F.transform("turns", lambda t: t["code"]), ""))
    paths = stage(convs.select("conv_id", code.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "trie-paths")
    turns = paths.agg(F.sum(F.size("sizes"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS_PER_SHARD))
    trie = skeleton(choose_splitters(paths, shards))

    def dealt(path: pa.Array, conv: pa.Array) -> pa.Array:
        return pa.array([trie.shard(p, c) for p, c in zip(path.to_pylist(), conv.to_pylist(), strict=True)], pa.int32())

    sorted_shards = paths.withColumn("shard", F.arrow_udf(dealt, "int")("path", "conv_id")).repartitionById(
        shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = stage(sorted_shards.mapInArrow(_local(trie), SCHEMA), "trie-nodes")

    shape = spark.createDataFrame(trie.rows(), "node long, parent long, depth long, until long, below long")
    partial = found.where(F.col("kind") == "partial").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max("size").alias("size"))
    known = shape.join(partial, "node")
    childless = F.col("n_children") + F.col("below") == 0
    upto = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the bounded skeleton only
    summed = known.withColumns({
        "_leaf": F.sum(childless.cast("long")).over(upto), "_saved": F.sum((F.col("n_convs") - 1) * F.col("size")).over(upto),
        "_own_leaf": childless.cast("long"), "_own_saved": (F.col("n_convs") - 1) * F.col("size")})
    last = summed.select((F.col("node") + 1).alias("until"), F.col("_leaf").alias("_leaf_end"), F.col("_saved").alias("_saved_end"))
    ends = found.where(F.col("kind") == "piece").select("node", "shard", "piece", "ends").repartition("node").sortWithinPartitions(
        "node", "shard", "piece").mapInArrow(_digests, "node long, ends_sha256 string")
    whole = stage(summed.join(last, "until").join(ends, "node", "left").select(
        "node", "parent", "conv_id", "depth", "n_convs", (F.col("n_children") + F.col("below")).alias("n_children"),
        (F.col("n_leaves") + F.col("_leaf_end") - F.col("_leaf") + F.col("_own_leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("_saved_end") - F.col("_saved") + F.col("_own_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")), "trie-skeleton")
    above = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = found.where(F.col("kind") == "node").withColumnRenamed("ends", "ends_sha256")
    inside = nodes.where(F.col("node").isNull()).select(*NODE)
    below = nodes.where(F.col("node").isNotNull()).drop("parent_conv_id").withColumnRenamed("node", "parent").join(
        F.broadcast(above), "parent").select(*NODE)
    return inside.unionByName(below).unionByName(whole.join(F.broadcast(above), "parent", "left").select(*NODE))
