import hashlib
import random
import zlib

import pytest

from salesprism.llm import prefix_trie
from salesprism.llm.queries import op11_prefix_trie

from .. import conftest

TURNS = "conv_id long, turn long, role string, text string"


def originals(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    return {c: tuple(t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1] or 0))) for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, ())[:h] + turns[h:]
    return out


def brute(paths):
    members, ends = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = own + sum(saved[b] for b in below)
    return sorted((
        min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, m in members.items())


def nodes(df):
    return sorted(tuple(r) for r in df.select(*prefix_trie.NODE).collect())


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{conftest.SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in op11_prefix_trie(spark, conftest.SMALL).select(*prefix_trie.NODE).collect()]
    assert key(got) == key(brute(rebuilt(originals(rows))))


def crowd(seed, many=400):
    """Shared openings, a third of all conversations equal, one far longer than the rest."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-50, 3000), many):
        turns = ["same"] * 6 if rng.random() < 0.35 else [rng.choice("ab") for _ in range(rng.randrange(0, 9))]
        turns = turns * 60 if rng.random() < 0.01 else turns
        rows += [(c, i, rng.choice(["u", None]) if turns[0] != "same" else "u", t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_any_number_of_shards(spark, seed, monkeypatch):
    rows = crowd(seed)
    turns = spark.createDataFrame(rows, TURNS)
    want = key(brute(originals(rows)))
    for shards, bytes_, piece in ((1, 1 << 22, 10_000), (7, 1 << 22, 5), (23, 23 * 16 * 3, 2)):
        monkeypatch.setattr(prefix_trie, "SKELETON_BYTES", bytes_)
        monkeypatch.setattr(prefix_trie, "PIECE", piece)
        spark.conf.set("spark.sql.shuffle.partitions", shards)
        try:
            got = key([tuple(r) for r in prefix_trie.build(prefix_trie.sequences(turns)).collect()])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == want


def test_edge_rows(spark):
    rows = [
        (10, None, None, None), (10, 2, "u", "b"), (10, 1, "u", "é"), (11, 1, "u", "x"), (11, 1, "u", "x"), (12, 0, "", ""),
        (None, 0, "u", "lost"), (17, 0, "u", "y" * 100_000), (17, 5, None, "z"), (-7, 0, "u", "n"), (19, 0, "ab", "c"), (20, 0, "a", "bc"),
    ]
    turns = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS depth", "2 AS turns", "3 AS path")
    got = [tuple(r) for r in prefix_trie.build(prefix_trie.rebuilt(prefix_trie.sequences(turns))).collect()]
    assert key(got) == key(brute(rebuilt(originals(rows))))
    got = [tuple(r) for r in prefix_trie.build(prefix_trie.sequences(turns)).collect()]
    assert key(got) == key(brute(originals(rows)))


def test_empty_table(spark):
    turns = spark.createDataFrame([], TURNS)
    assert prefix_trie.build(prefix_trie.rebuilt(prefix_trie.sequences(turns))).count() == 0


def test_equal_paths_are_split_by_id(spark):
    """Half of the conversations are copies, and no shard takes most of them."""
    rows = [(c, i, "u", f"t{i}" if c % 2 else f"{c}") for c in range(800) for i in range(3)]
    convs = prefix_trie.sequences(spark.createDataFrame(rows, TURNS))
    paths = convs.selectExpr("conv_id", "unhex(array_join(transform(turns, t -> t.code), '')) AS path").collect()
    frame = spark.createDataFrame(paths)
    trie = prefix_trie.skeleton(prefix_trie.choose_splitters(frame, 8))
    load = {}
    for r in paths:
        shard = trie.shard(bytes(r.path), r.conv_id)
        load[shard] = load.get(shard, 0) + 1
    assert len(load) == 8 and max(load.values()) < 3 * 800 / 8
