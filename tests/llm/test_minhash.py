import random

import numpy as np
import pytest

from salesprism.llm import minhash, queries

from .. import conftest


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, threshold):
    """(id, size, smallest reachable id) by all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= threshold * max(len(sets[i]), len(sets[j])):
                common = len(sets[i] & sets[j])
                if 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                    a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                    parent[b] = a
    return sorted((r[0], len(s), rows[root(i)][0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def result(df):
    got = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


@pytest.mark.parametrize("width,threshold", [(3, 85)])
def test_same_groups_as_all_pairs(spark, width, threshold):
    docs = spark.read.parquet(f"{conftest.SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert result(queries.op9_superminhash(spark, conftest.SMALL)) == brute(rows, width, threshold)


def test_chains_short_texts_nulls_and_empty_table(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(10 + k, " ".join(base[k * 4:k * 4 + 60])) for k in range(15)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "One two"), (104, "one TWO"), (105, "one"), (106, "two one")]
    rows += [(200 + k, " ".join([*base[:50], f"x{k}"])) for k in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _key int")
    assert result(minhash.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)
    assert minhash.near_duplicates(docs.limit(0), 3, 85).count() == 0
    kept = [r["doc_id"] for r in minhash.one_of_each(docs.union(docs), 3, 85).collect()]
    assert {10, 100, 103, 105, 200} <= set(kept) and 104 not in kept and kept.count(103) == 1 and kept.count(100) == 2


def crowd(n, changed=(2, 4), seed=4):
    """An original and copies with a few words changed: many link to it but not to each other, some to neither."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    rows = [(500, " ".join(base))]
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(100), changed[0] if k % 3 else changed[1]):
            words[at] = f"x{k}-{at}"
        rows.append((1000 + k, " ".join(words)))
    return rows


def test_a_crowd_of_near_copies(spark):
    rows = crowd(150) + [(i + 5000, t) for i, t in crowd(60, (3, 6), 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 3, 85)
    assert 20 < sum(1 for r in want if r[0] == r[2]) < 200  # one large component and many rows apart
    assert result(minhash.near_duplicates(docs, 3, 85)) == want


def test_pairs_grow_with_the_rows_and_not_with_their_square(spark, monkeypatch):
    made, check = [], minhash.verified

    def counted(pairs, sets, threshold):
        made.append(pairs.count())
        return check(pairs, sets, threshold)

    monkeypatch.setattr(minhash, "verified", counted)
    for n in (300, 1500):
        minhash.near_duplicates(spark.createDataFrame(crowd(n), "doc_id long, text string"), 3, 85).count()
    assert made[2] + made[3] < 8 * (made[0] + made[1]) and made[3] < 1500


def test_prefix_join_loses_no_pair(spark):
    rng = random.Random(6)
    sets = []
    for k in range(60):
        own = set(rng.sample(range(40), 22)) if k % 4 or not sets else set(sets[-1][1]) - {min(sets[-1][1])} | {100 + k}
        sets.append((k, sorted(own)))
    keyed = [(bytes([k]), own) for k, own in sets]
    frame = spark.createDataFrame(keyed, "_key binary, _set array<long>")
    residual = spark.createDataFrame([(k, len(own), bytes([k[0] // 2])) for k, own in keyed], "_key binary, _n long, _root binary")
    for threshold in (60, 80):
        got = {(bytes(r.a), bytes(r.b)) for r in minhash.verified(minhash.alike_across(residual, frame, threshold), frame, threshold).collect()}
        want = {(a, b) for a, x in keyed for b, y in keyed if a[0] // 2 < b[0] // 2
                and 100 * len(set(x) & set(y)) >= threshold * len(set(x) | set(y))}
        assert got == want and want


def test_one_row_of_each_group_whatever_its_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, 0), (5, a + " q", 1), (5, b, 2), (None, a + " r", 3), (None, a + " s", 4), (9, b, 5), (9, b, 6), (7, None, 7), (7, None, 8), (None, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int").withColumnRenamed("_id", "_hash")
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["_hash"] for r in kept.collect()) == [0, 2, 7, 8, 9]
    twice = minhash.one_of_each(docs.where("_hash in (5, 6)")).collect()
    assert [r["text"] for r in twice] == [b]
    assert minhash.one_of_each(docs.limit(0)).count() == 0


def test_signatures_estimate_the_similarity():
    draw = np.random.default_rng(1)
    common, rest = draw.integers(1, 1 << 62, 700).astype(np.uint64), draw.integers(1, 1 << 62, 300).astype(np.uint64)
    sign = minhash.signatures([np.unique(np.concatenate([common, rest[:150]])), np.unique(np.concatenate([common, rest[150:]]))])
    assert abs((sign[0] == sign[1]).mean() - 0.7) < 0.12
    assert (minhash.signatures([common[:2], common[:2]])[0] < np.iinfo(np.uint64).max).all()
