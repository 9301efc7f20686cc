"""Approximate nearest neighbours by inner product: NN-descent by joins, greedy search on its graph.

Equal vectors are one node; a node keeps its smallest ids, as many as any
answer can need, so ties among copies are settled exactly and a group of
copies costs one node. The graph starts from leaves of random planes, each
compared in itself. A round then joins every node with its neighbours and a bounded draw
of those it is a neighbour of; inside such a neighbourhood all meet all but
those that were there before, and an offer is made only where it beats the
worst neighbour a node has. Rounds go on until the summed scores gain less
than ``LEAST_GAIN``, however many that takes.

Queries start from their own node and expand the best nodes not yet expanded,
until none is left in the pool. How wide a pool must be depends on the table,
so it is measured: a bounded sample of the queries is compared with all nodes,
and the pools are doubled until ``RECALL`` of the sample's true neighbours is
found, or until a pool holds all that can be reached. Twice the pool is kept,
so that a doubled one goes on where the narrower ended.

Neighbourhoods travel as one row a member, with the vector in half precision
in one binary value, and are met as sorted rows stream by: a task holds one
neighbourhood and one Arrow batch. Scores returned are of the stored vectors.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do those of another length than the most frequent one, nor null
ids. Of rows that repeat an id, the smallest vector counts. Only row counts,
sums and the vectors of two samples (at most ``SAMPLE`` each) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.session import stage

NEIGHBOURS = 40
LEAF = 1000  # nodes of a starting leaf, about
TREES = 4  # starting leaves of a node
ROWS = 256  # of a neighbourhood's scores held at once
ASKS = 1000  # queries that ask at one node, handled together
LEAST_GAIN = 0.002
POOL = 100  # nodes a query keeps at first
RECALL = 0.95  # of the sample's true neighbours
SAMPLE = 200  # queries compared with all nodes; nodes that planes are laid through
SALTS = 32
OFFERS = 200_000  # made before they are handed on, about


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part; vec stays single where it is stored so, else it is double."""
    single = rows.schema[vec_col].dataType.simpleString() == "array<float>"
    vec = F.col(vec_col).cast("array<float>" if single else "array<double>")
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vec") == (sizes["n"] if sizes else 0))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: id (the smallest), vec, ids (the ``keep`` smallest)."""
    salted = rows.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("_salt")).agg(
        F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"))
    merged = salted.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    return merged.select(F.element_at("ids", 1).alias("id"), "vec", "ids")


def _handed_on(offers: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Offers as batches of about ``OFFERS``: those of a whole batch of neighbourhoods may be very many."""
    some, held = [], 0
    for part in offers:
        some.append(part)
        held += len(part[0])
        if held >= OFFERS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*some, strict=True)], names)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*some, strict=True)], names)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(np.float64)


def brief(nodes: DataFrame) -> DataFrame:
    """(id, vec) with each vector as its largest absolute component and half-precision shares of it, in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch.column("vec"))
            size = np.abs(x).max(axis=1, keepdims=True)
            raw = np.hstack([size.astype("<f8").view(np.uint8), (x / size).astype("<f2").view(np.uint8)])
            edges = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(edges), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed], ["id", "vec"])

    return nodes.select("id", "vec").mapInArrow(run, "id long, vec binary")


def _read_brief(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shares, and the size they are of."""
    _, edges, data = vectors.buffers()
    edges = np.frombuffer(edges, np.int32)[vectors.offset:vectors.offset + len(vectors) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]].reshape(len(vectors), -1)
    return raw[:, 8:].copy().view("<f2").astype(np.float32), raw[:, :8].copy().view("<f8")[:, 0]


def _together(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, shares, sizes) of the rows of each key; rows come sorted by it, and no more than a batch and a key are held."""
    held: list[pa.RecordBatch] = []

    def parts(rows: pa.RecordBatch, edges: list[int]) -> Iterator[tuple]:
        columns = {n: rows.column(n).to_numpy(zero_copy_only=False) for n in rows.schema.names if n != "vec"}
        x, size = _read_brief(rows.column("vec"))
        for begin, end in zip(edges, edges[1:], strict=False):
            yield {n: c[begin:end] for n, c in columns.items()}, x[begin:end], size[begin:end]

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch
        change = np.zeros(rows.num_rows - 1, bool)
        for n in keys:
            key = rows.column(n).to_numpy(zero_copy_only=False)
            change |= key[1:] != key[:-1]
        edges = (np.flatnonzero(change) + 1).tolist()
        if edges:
            yield from parts(rows, [0, *edges])
        held = [rows.slice(edges[-1] if edges else 0)]
    if held:
        yield from parts(held[0], [0, held[0].num_rows])


def meet(members: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Offers (a, b, s, new) inside each neighbourhood: for every member its best others above its bound.

    ``members`` holds (keys, a, bound, new, vec), one row a member of the
    neighbourhood that ``keys`` name. Two members that are not new have met before.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows, x, size in _together(batches, keys):
            ids, bound, new = rows["a"], rows["bound"], rows["new"]
            for at in range(0, len(ids) if len(ids) > 1 else 0, ROWS):
                own = slice(at, at + ROWS)
                s = (x[own] @ x.T).astype(np.float64) * size[own, None] * size
                s[ids[own, None] == ids] = -np.inf
                s[np.ix_(~new[own], ~new)] = -np.inf
                better = s > bound[own, None]
                if better.sum(axis=1).max() > most:
                    best = np.argpartition(-s, most - 1, axis=1)[:, :most]
                    row, to = np.nonzero(np.take_along_axis(better, best, 1))
                    to = best[row, to]
                else:
                    row, to = np.nonzero(better)
                yield ids[own][row], ids[to], s[row, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _handed_on(met(batches), ["a", "b", "s"])

    rows = members.select(*keys, "a", "bound", "new", "vec").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "a long, b long, s double").withColumn("new", F.lit(True))


def leaves(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(tree, leaf, part, a, vec): where each node starts, once per tree.

    A leaf is the side of some random planes that a node lies on; a plane runs
    through the median of a sample. Leaves that are far too large, as of
    vectors that hardly differ, are dealt by hash.
    """
    planes = max(0, int(np.log2(max(1, nodes.count()) / LEAF)))
    sample = np.array([r["vec"] for r in nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()], np.float64)
    width = sample.shape[1] if len(sample) else 0
    ways = np.random.default_rng(width).normal(size=(width, TREES * planes))
    middle = np.median(sample @ ways, axis=0) if len(sample) else np.empty(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, size = _read_brief(batch.column("vec"))
            side = (x.astype(np.float64) * size[:, None]) @ ways > middle
            for tree in range(TREES):
                leaf = side[:, tree * planes:(tree + 1) * planes] @ (1 << np.arange(planes, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(x), tree, np.int32)), pa.array(leaf.astype(np.int64)), batch.column("id"), batch.column("vec"),
                ], ["tree", "leaf", "a", "vec"])

    placed = vectors.mapInArrow(run, "tree int, leaf long, a long, vec binary")
    counts = placed.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * LEAF)).alias("parts"))
    return placed.join(counts, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("a", "tree"), F.col("parts")))


def best_of(offers: DataFrame, most: int) -> DataFrame:
    """The graph: id, near (array of cost = -s, node b and whether it is new, best first), bound (score to beat).

    A pair's score may differ in its last bits from one neighbourhood to the
    next, so pairs are made one before the best are taken.
    """
    pairs = offers.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    near = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("cost"), "b", "new"))), 1, most)
    graph = pairs.groupBy(F.col("a").alias("id")).agg(near.alias("near"))
    bound = F.when(F.size("near") == most, -F.element_at("near", -1)["cost"]).otherwise(F.lit(float("-inf")))
    return graph.withColumn("bound", bound)


def as_offers(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("id").alias("a"), F.explode("near").alias("n")).select(
        "a", "n.b", (-F.col("n.cost")).alias("s"), F.lit(False).alias("new"))


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("id").alias("hub"), F.explode("near").alias("n")).select("hub", "n.b", "n.cost", "n.new")


def _backward(edges: DataFrame, order: Column, most: int) -> DataFrame:
    """(hub, a, new): of those a hub is a neighbour of the first ``most``, first per salt so that no list is gathered whole."""
    back = edges.select(F.col("b").alias("hub"), F.struct(order.alias("order"), F.col("hub").alias("a"), "new").alias("e"))
    salt = F.pmod(F.xxhash64("e.a", "hub"), F.lit(SALTS)).alias("salt")
    back = back.groupBy("hub", salt).agg(F.slice(F.array_sort(F.collect_list("e")), 1, most).alias("some"))
    back = back.groupBy("hub").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, most).alias("some"))
    return back.select("hub", F.explode("some").alias("e")).select("hub", "e.a", "e.new")


def _total(graph: DataFrame) -> float | None:
    return graph.agg(F.sum(F.aggregate("near", F.lit(0.0), lambda t, n: t - n["cost"]))).first()[0]


def neighbour_graph(nodes: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """NN-descent over nodes (id, vec)."""
    vectors = stage(brief(nodes), "ann-brief")
    start = leaves(nodes, vectors).withColumns({"bound": F.lit(float("-inf")), "new": F.lit(True)})
    graph = stage(best_of(meet(start, ["tree", "leaf", "part"], most), most), "ann-graph")
    total, turn = _total(graph), 0
    while total is not None:
        edges = _edges(graph)
        # a bounded draw, new ones first
        draw = F.struct((~F.col("new")).alias("old"), F.xxhash64("hub", "b", F.lit(turn)).alias("draw"))
        pairs = edges.select("hub", F.col("b").alias("a"), "new").union(_backward(edges, draw, most)).union(
            graph.select(F.col("id").alias("hub"), F.col("id").alias("a"), F.lit(False).alias("new")))
        pairs = pairs.repartition("hub").groupBy("hub", "a").agg(F.max("new").alias("new"))
        own = F.collect_list(F.struct("a", "new")).alias("own")
        pairs = pairs.groupBy("hub").agg(own).where(F.exists("own", lambda m: m["new"])).select(
            "hub", F.explode("own").alias("m")).select("hub", "m.a", "m.new")
        told = vectors.select(F.col("id").alias("a"), "vec").join(graph.select(F.col("id").alias("a"), "bound"), "a")
        graph = stage(best_of(as_offers(graph).union(meet(pairs.join(told, "a"), ["hub"], most)), most), "ann-graph")
        now = _total(graph)
        if now - total <= LEAST_GAIN * abs(now):
            break
        total, turn = now, turn + 1
    return graph


def least_scores(queries: DataFrame, nodes: DataFrame, k: int) -> dict[int, list[float]]:
    """The ``k`` best scores with all other nodes, best first, of at most ``SAMPLE`` of the query nodes (q, vec)."""
    sample = queries.orderBy(F.xxhash64("q"), "q").limit(SAMPLE).collect()
    if not sample:
        return {}
    asked = np.array([r["q"] for r in sample])
    wanted = np.array([r["vec"] for r in sample], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            s = wanted @ _matrix(batch.column("vec")).T
            s[asked[:, None] == batch.column("id").to_numpy()[None, :]] = -np.inf
            best = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            row, at = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(best[row, at])], ["q", "s"])

    found = nodes.select("id", "vec").mapInArrow(run, "q long, s double")
    best = F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, k)
    return {r["q"]: r["best"] for r in found.groupBy("q").agg(best.alias("best")).collect()}


def found_share(state: DataFrame, best: dict[int, list[float]], k: int) -> float:
    """Share of the sample's true neighbours that the pools hold."""
    if not best:
        return 1.0
    low = state.sparkSession.createDataFrame(
        [(q, s[-1] - 1e-9 * max(1.0, abs(s[-1])), len(s)) for q, s in best.items()], "q long, low double, many int")
    hits = state.where(F.col("q") != F.col("b")).join(F.broadcast(low), "q").where(F.col("s") >= F.col("low")).groupBy("q").agg(
        F.least(F.count(F.lit(1)), F.first("many")).alias("hits")).agg(F.sum("hits")).first()[0]
    return (hits or 0) / sum(map(len, best.values()))


def expanded(fresh: DataFrame, asked: DataFrame, links: DataFrame, vectors: DataFrame) -> DataFrame:
    """Offers (q, b, s): of the nodes that b is linked with those above the bound of the query q, for each (q, b, bound).

    The queries that ask at one node are dealt in parts of about ``ASKS``, each with the links repeated.
    """
    parts = fresh.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / ASKS).alias("parts"))
    asks = fresh.join(parts, "b").select("b", F.pmod(F.xxhash64("q"), F.col("parts")).alias("part"), "q", "bound").join(
        asked, "q").select("b", "part", F.lit(True).alias("asks"), F.col("q").alias("id"), "bound", "vec")
    hoods = parts.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(
        links.withColumnRenamed("hub", "b"), "b").join(vectors.withColumnRenamed("id", "a"), "a").select(
        "b", "part", F.lit(False).alias("asks"), F.col("a").alias("id"), F.lit(float("-inf")).alias("bound"), "vec")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows, x, size in _together(batches, ["b", "part"]):
            ids, asks, bound = rows["id"], rows["asks"], rows["bound"]
            s = (x[asks] @ x[~asks].T).astype(np.float64) * size[asks, None] * size[~asks]
            row, at = np.nonzero(s > bound[asks, None])
            yield ids[asks][row], ids[~asks][at], s[row, at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _handed_on(told(batches), ["q", "b", "s"])

    return asks.unionByName(hoods).repartition("b", "part").sortWithinPartitions("b", "part").mapInArrow(
        run, "q long, b long, s double")


def scored(pools: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pools (q, b, s) with scores of the vectors as they are stored, in double precision."""
    vec = nodes.select("id", "vec")
    pairs = pools.select("q", "b").join(vec.select(F.col("id").alias("q"), F.col("vec").alias("_x")), "q").join(
        vec.select(F.col("id").alias("b"), F.col("vec").alias("_y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = (_matrix(batch.column("_x")) * _matrix(batch.column("_y"))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("b"), pa.array(s)], ["q", "b", "s"])

    return pairs.select("q", "b", "_x", "_y").mapInArrow(run, "q long, b long, s double")


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, pool: int = POOL, k: int = 20) -> DataFrame:
    """Pools (q, b, s): for each query node the best nodes found."""
    vectors = stage(brief(nodes), "ann-brief")
    asked = stage(queries.select(F.col("id").alias("q")).distinct().join(
        vectors.withColumnRenamed("id", "q"), "q"), "ann-asked")
    edges = _edges(graph)
    # nodes that are nobody's neighbour are met from their own neighbours
    links = stage(edges.select("hub", F.col("b").alias("a")).union(
        _backward(edges, F.col("cost"), NEIGHBOURS // 2).select("hub", "a")).distinct(), "ann-links")
    best = least_scores(asked.select("q").join(nodes.select(F.col("id").alias("q"), "vec"), "q"), nodes, k)
    every, kept = nodes.count(), 2 * pool
    in_pool = Window.partitionBy("q")
    order = in_pool.orderBy(F.desc("s"), "b")  # at most what is kept and one round's offers

    def settled(offers: DataFrame) -> DataFrame:
        once = offers.repartition("q").groupBy("q", "b").agg(F.max("s").alias("s"), F.max("done").alias("done"))
        once = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)
        full = F.count(F.lit(1)).over(in_pool) == kept
        return stage(once.withColumn("bound", F.when(full, F.min("s").over(in_pool)).otherwise(
            F.lit(float("-inf")))), "ann-pool")

    # the query's own node is expanded first
    state = settled(scored(asked.select("q", F.col("q").alias("b")), nodes).withColumn("done", F.lit(False)))
    while True:
        fresh = F.col("rank") <= pool
        while not (asks := state.where(fresh & ~F.col("done"))).isEmpty():
            offers = expanded(asks.select("q", "b", "bound"), asked, links, vectors).withColumn("done", F.lit(False))
            state = settled(state.select("q", "b", "s", (F.col("done") | fresh).alias("done")).union(offers))
        found = stage(scored(state, nodes), "ann-found")
        if found_share(found, best, k) >= RECALL or pool >= every or state.where(~fresh).isEmpty():
            return found
        pool *= 2  # goes on with the nodes that were kept behind the narrower pool
        if pool > kept:  # what was dropped is offered again
            kept = 2 * pool
            state = settled(state.select("q", "b", "s", F.lit(False).alias("done")))


def search(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows of each query row: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column ``id``.
    """
    used = usable(rows, id_col, vec_col)
    nodes = stage(nodes_of(used, k + 1), "ann-nodes")
    graph = neighbour_graph(nodes.select("id", "vec"))
    queries = stage(used.where(is_query).join(
        nodes.select("vec", F.col("id").alias("node")), "vec").select(F.col("id").alias("query_id"), "node"), "ann-queries")
    pools = greedy_search(queries.select(F.col("node").alias("id")), nodes, graph, k=k)
    found = (
        queries.join(pools, F.col("node") == F.col("q"))
        .join(nodes.select(F.col("id").alias("b"), "ids"), "b")
        .select("query_id", F.explode("ids").alias("vec_id"), F.col("s").alias("score"))
        .where(F.col("query_id") != F.col("vec_id")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most a pool times (k + 1) rows
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
