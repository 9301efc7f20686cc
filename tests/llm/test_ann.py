import numpy as np
import pyarrow as pa

from salesprism.llm import ann, queries

from .. import conftest


def brute(rows):
    """The 20 nearest of each query, by all pairs."""
    good = {i: np.array(v, float) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    for i in ids[ids % 20 == 0]:
        s = x @ good[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
        yield i, [(ids[j], s[j]) for j in order]


def recall(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {}
    for r in queries.op5_nn_descent(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(got[r["query_id"]]) == r["rank"] and r["vec_id"] != r["query_id"]
    hits = total = 0
    for q, want in brute(rows):
        assert len(got[q]) == len(want)
        low = want[-1][1] - 1e-9
        hits += sum(s >= low for _, s in got[q])
        total += len(want)
    return hits / total


def test_recall_against_all_pairs(spark):
    assert recall(spark, conftest.SMALL.replace("0.001", "0.01")) >= 0.9


def test_unusable_rows_and_copies(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(50)]
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan"), 1.0, 0.0, 0.0]), (None, [1.0] * 4)]
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, a int").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    assert recall(spark, str(tmp_path)) == 1.0
    got = queries.op5_nn_descent(spark, str(tmp_path)).where("query_id = 120 and rank <= 3").orderBy("rank").collect()
    best = [r["vec_id"] for r in got if abs(r["score"] - 1.0) < 1e-6]
    assert best == sorted(best)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op5_nn_descent(spark, str(tmp_path)).count() == 0


def test_search_goes_on_until_pools_are_settled(spark):
    """On a chain whose far end is best, the way is as long as the table."""
    nodes = spark.createDataFrame([(i, [float(i + 1)]) for i in range(30)], "id long, vec array<double>")
    graph = spark.createDataFrame(
        [(i, [(-float(i + 1) * (i + 2), i + 1, False)]) for i in range(29)], "id long, near array<struct<cost:double,b:long,new:boolean>>")
    found = ann.greedy_search(nodes.where("id = 0"), nodes, graph, pool=10).collect()
    assert {29, 28, 27, 26, 25} <= {r["b"] for r in found}


def test_offers_of_many_neighbourhoods_come_in_pieces(monkeypatch):
    monkeypatch.setattr(ann, "OFFERS", 10)
    part = (np.arange(4), np.arange(4), np.ones(4))
    pieces = list(ann._handed_on(iter([part] * 10), ["a", "b", "s"]))
    assert [p.num_rows for p in pieces] == [12, 12, 12, 4] and pieces[0].schema.names == ["a", "b", "s"]
    assert not list(ann._handed_on(iter([]), ["a", "b", "s"]))


def test_neighbourhoods_stream_in_small_rows(spark):
    """No row holds a neighbourhood: what Python gets at once does not grow with its members."""
    members = spark.range(500).selectExpr("id % 5 hub", "id a", "double('-inf') bound", "true new", "array(float(id + 1), 1f) vec")
    packed = ann.brief(members.selectExpr("a id", "vec")).withColumnRenamed("id", "a")
    offers = ann.meet(members.drop("vec").join(packed, "a"), ["hub"], 3)
    assert "collect_list" not in offers._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in offers.collect():
        assert r["a"] % 5 == r["b"] % 5 != r["a"] + 1 and abs(r["s"] - (r["a"] + 1) * (r["b"] + 1) - 1) <= 2e-3 * r["s"]
        got.setdefault(r["a"], set()).add(r["b"])
    assert got[7] == {497, 492, 487} and len(got) == 500


def test_a_key_over_several_batches_is_met_once():
    raw = pa.array([np.float64(1).tobytes() + np.float16([i]).tobytes() for i in range(10)], pa.binary())
    rows = pa.RecordBatch.from_arrays([pa.array([0, 0, 0, 1, 1, 1, 1, 1, 2, 2]), pa.array(range(10)), raw], ["hub", "a", "vec"])
    parts = list(ann._together(iter([rows.slice(0, 2), rows.slice(2, 3), rows.slice(5, 0), rows.slice(5, 2), rows.slice(7, 3)]), ["hub"]))
    assert [p[0]["a"].tolist() for p in parts] == [[0, 1, 2], [3, 4, 5, 6, 7], [8, 9]]
    assert [p[1][:, 0].tolist() for p in parts] == [[0, 1, 2], [3, 4, 5, 6, 7], [8, 9]]


def test_queries_that_ask_at_one_node_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "ASKS", 3)
    vectors = ann.brief(spark.createDataFrame([(i, [float(i + 1)]) for i in range(20)], "id long, vec array<double>"))
    links = spark.createDataFrame([(0, 18), (0, 19)], "hub long, a long")
    fresh = spark.createDataFrame([(q, 0, 19.5 * (q + 1)) for q in range(10)], "q long, b long, bound double")
    got = ann.expanded(fresh, vectors.withColumnRenamed("id", "q"), links, vectors).collect()
    assert {(r["q"], r["b"]) for r in got} == {(q, 19) for q in range(10)} and len(got) == 10


def test_a_doubled_pool_goes_on_where_the_narrower_ended(spark, monkeypatch):
    draw = np.random.default_rng(5)
    nodes = spark.createDataFrame([(i, draw.normal(size=8).tolist()) for i in range(60)], "id long, vec array<double>")
    graph = spark.createDataFrame(
        [(i, [(0.0, (i * 7 + j) % 60, False) for j in range(1, 5)]) for i in range(60)], "id long, near array<struct<cost:double,b:long,new:boolean>>")
    asked, shares = [], iter([0.0, 1.0])
    plain = ann.expanded
    monkeypatch.setattr(ann, "found_share", lambda *a: next(shares))
    monkeypatch.setattr(ann, "expanded", lambda fresh, *a: (asked.extend((r["q"], r["b"]) for r in fresh.collect()), plain(fresh, *a))[1])
    ann.greedy_search(nodes.where("id < 5"), nodes, graph, pool=10)
    assert len(asked) == len(set(asked)) > 50
