"""Mixing and sharding against brute force."""

import itertools
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salesprism.llm import mixing, queries, sharding

from .. import conftest

CLASH = "doc_id long, text string, source string, size int, shard string, target string, _key int"


def write(spark, folder, rows):
    spark.createDataFrame([(*r, 5, "s", None, 1) for r in rows], CLASH).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


ODD = [(1, None, "a"), (2, "", "a"), (None, "x y z", None), (3, "one two", "b"), (3, "one two", "b"),
       (4, "w " * 30_000, "c"), (5, "w " * 100, "é"), *((10 + i, f"t{i} " * 9, "hot") for i in range(300))]


def brute_targets(sizes):
    """Shares by water-filling, one source capped at a time."""
    weights, total, capped = {s: 1 + i % 3 for i, s in enumerate(sizes)}, sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * w / (sum(weights[x] for x in sizes if x not in capped) or 1) for s, w in weights.items() if s not in capped}
        over = [s for s, x in share.items() if x > 3 * sizes[s] + 1e-9]
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped.update(over)


def test_mix_meets_targets(spark, tmp_path):
    for folder in (conftest.SMALL, write(spark, tmp_path, ODD)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        size = [len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs]
        names = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
        of = {s: sum(n for d, n in zip(docs, size, strict=True) if d["source"] == s) for s in names}
        got = queries.op2_mixing(spark, folder).collect()
        assert sorted(map(str, got)) == sorted(map(str, queries.op2_mixing(spark, folder).collect()))
        assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d["doc_id"]), n) for d, n in zip(docs, size, strict=True))
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        targets, source_of = brute_targets(of), {d["doc_id"]: d["source"] for d in docs}
        taken = dict.fromkeys(names, 0)
        for r in got:
            s = source_of[r["doc_id"]]
            assert r["source_size"] == of[s] and abs(r["target"] - targets[s]) < 1e-5
            taken[s] += r["taken"]
        for s in names:
            # within half of the smallest copy that was left
            left = [r["size"] for r in got if source_of[r["doc_id"]] == s and r["taken"] < 3 * r["size"]]
            most = max(n for d, n in zip(docs, size, strict=True) if d["source"] == s)
            assert abs(targets[s] - taken[s]) <= min(left, default=most) / 2 + 1e-5


def filled(docs):
    """Words taken and wanted by source."""
    got = mixing.mix(docs, F.array("s"), F.col("n"), tie=F.col("n"))
    rows = got.groupBy("members").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"),
        F.max("copies").alias("most"), F.count(F.lit(1)).alias("rows")).collect()
    assert sum(r["rows"] for r in rows) == docs.count() and all(r["most"] <= 3 for r in rows)
    return {r["members"][0]: (r["taken"], r["target"]) for r in rows}


def test_one_huge_document_does_not_stop_the_fill(spark):
    rows = [(1, "a", 20_000), *((10 + i, "a", 10) for i in range(300)), *((1000 + i, "b", 100) for i in range(100)),
            *((2000 + i, "c", 5) for i in range(4200))]
    got = filled(spark.createDataFrame(rows, "doc_id long, s string, n long"))
    # a copy of the huge document never fits, and small ones are used up to three times
    for taken, target in got.values():
        assert abs(target - taken) <= 50.001
    assert got["a"][1] < 20_000 and got["a"][0] > 3000


def test_rows_of_one_id_are_taken_one_by_one(spark):
    rows = [*((None, "a", 10) for _ in range(2000)), *((7, "b", 9) for _ in range(2000)), *((i, None, 11) for i in range(300))]
    got = filled(spark.createDataFrame(rows, "doc_id long, s string, n long"))
    for taken, target in got.values():
        assert abs(target - taken) <= 5.501


def test_overlapping_sources_share_one_pattern(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, m array<string>, n long")
    got = mixing.mix(docs, docs["m"], docs["n"]).collect()
    # a has 2000 tokens and b 1000: b's quota is two thirds of 2000, so its tokens are used once and a third again
    assert sum(r["size"] * r["copies"] for r in got) == 2000
    assert abs(sum(r["size"] * r["copies"] for r in got if len(r["members"]) == 2) - 4000 / 3) <= 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 2), min_size=1), st.integers(0, 6)), min_size=1, max_size=5),
       st.lists(st.integers(0, 9), min_size=3, max_size=3))
def test_flow_is_cheapest(patterns, quota):
    """Against the best of all integer amounts: as much as can be routed, at least repetition cost."""
    patterns = [(tuple(sorted(s)), n) for s, n in patterns]
    taken = mixing.min_cost_flow(patterns, quota)

    def most(limits):  # max flow by the cut over sets of sources
        subsets = itertools.chain.from_iterable(itertools.combinations(range(3), k) for k in range(4))
        return min(sum(quota[s] for s in cut) + sum(n for (m, _), n in zip(patterns, limits, strict=True) if not set(m) <= set(cut))
                   for cut in subsets)

    # each repetition level is as full as it can be when the levels before it are full
    for level in (1, 2, 3):
        assert abs(sum(min(t, level * n) for t, (_, n) in zip(taken, patterns, strict=True))
                   - most([level * n for _, n in patterns])) < 1e-6


def test_shards(spark, tmp_path):
    for folder in (conftest.SMALL, write(spark, tmp_path, ODD)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        got = queries.op6_sharding(spark, folder).collect()
        want = sorted((str(d[0]), len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in docs)
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
        shards = {}
        for r in got:
            shards.setdefault(r["shard"], []).append(r)
        assert set(shards) <= set(range(40))
        for rows in shards.values():
            assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        groups = {}
        for r in got:
            groups.setdefault(r["text_crc32"], set()).add(r["shard"])
        assert all(len(s) == 1 for s in groups.values())
        total, largest = sum(r["size"] for r in got), {}
        for r in got:
            largest[r["text_crc32"]] = largest.get(r["text_crc32"], 0) + r["size"]
        fullest = max(sum(r["size"] for r in rows) for rows in shards.values())
        assert fullest <= max(max(largest.values()), total / 40 + max(largest.values()))


def test_empty(spark, tmp_path):
    folder = write(spark, tmp_path, [])
    assert queries.op2_mixing(spark, folder).isEmpty() and queries.op6_sharding(spark, folder).isEmpty()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 5))
def test_smallest_capacity_against_all_partitions(sizes, shards):
    edge = np.concatenate([[0], np.cumsum(sizes)])
    best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *cuts, len(sizes))))
               for k in range(shards) for cuts in itertools.combinations(range(1, len(sizes)), min(k, len(sizes) - 1)))
    capacity = sharding.smallest_capacity(edge, shards)
    assert capacity == best
    ends = [0, *sharding.balanced_cuts(edge, capacity, shards)]
    assert ends[-1] == len(sizes) and all(edge[b] - edge[a] <= capacity for a, b in itertools.pairwise(ends))


def test_cells_are_refined_to_the_exact_capacity(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(n)) for k, n in zip(rng.integers(-2**63, 2**63 - 1, 3000), rng.integers(1, 500, 3000), strict=True)]
    rows += [(rows[0][0] + i, 400) for i in range(1, 40)]  # neighbours that share a cell
    rows.sort()
    cuts = sharding.find_cuts(spark.createDataFrame(rows, "_key long, _size long"), 7)
    edge = np.concatenate([[0], np.cumsum([n for _, n in rows])])
    loads = [sum(n for k, n in rows if a <= k < b) for a, b in itertools.pairwise((-2**63, *cuts, 2**63))]
    assert max(loads) <= sharding.smallest_capacity(edge, 7)
