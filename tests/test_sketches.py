"""Mergeable summaries and keyed samples."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from salesprism.operators import basket, sampling, sketches


def test_cells_answer_any_panel(t):
    cells = sketches.distinct_cells(t)
    plan = sketches.distinct_by(cells, ["city"])._jdf.queryExecution().executedPlan().toString()
    assert "distinct-cells" in plan and "customer_id" not in plan
    where = F.col("category").isin("PROMO", "LARGE")
    got = {r.city: r.customers for r in sketches.distinct_by(cells, ["city"], where).collect()}
    want = {r.city: r.n for r in t.where(where).groupBy("city").agg(F.count_distinct("customer_id").alias("n")).collect()}
    assert got == want
    one, other = F.col("category") == "PROMO", F.col("category") == "LARGE"
    sides = [{r[0] for r in t.where(c).select("customer_id").distinct().collect()} for c in (one, other)]
    both = sketches.distinct_in_both(cells, one, other).first()
    assert both.asDict() == {"in_both": len(sides[0] & sides[1]), "in_one": len(sides[0]), "in_other": len(sides[1]),
                             "in_any": len(sides[0] | sides[1])}


def test_small_sketches_keep_their_error(spark):
    many = spark.range(200_000).select("id", (F.col("id") % 7).alias("part"), F.lit(None).cast("long").alias("none"))
    cells = sketches.distinct_cells(many, ["part"], "id", 12)
    got = sketches.distinct_by(cells, []).first().customers
    assert abs(got / 200_000 - 1) <= 2 * sketches.theta_error(12)
    assert sketches.distinct_by(sketches.distinct_cells(many, ["part"], "none"), []).first().customers == 0
    quantiles = sketches.quantile_cells(many, "id", ["part"], k=400)
    for r in sketches.quantiles_by(quantiles, [], (0.0, 0.1, 0.5, 0.99, 1.0)).collect():
        assert r.rows == 200_000 and abs(r.value / 200_000 - r.p) <= 2 * sketches.kll_rank_error(400)


def test_quantile_cells_skip_what_is_no_number(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (1, float("nan")), (2, None)], "g int, v double")
    found = sketches.quantiles_by(sketches.quantile_cells(df, "v", ["g"]), [], (0.5,)).collect()
    assert [(r.rows, r.value) for r in found] == [(1, 5.0)]
    assert sketches.quantiles_by(sketches.quantile_cells(df.limit(0), "v", ["g"]), ["g"], (0.5,)).count() == 0


def test_frequent_values_with_a_small_state(spark):
    wide = spark.range(1_000_000).select(F.when(F.col("id") % 3 == 0, F.pmod("id", F.lit(4))).otherwise(F.col("id") + 10).alias("v"))
    state = wide.agg(F.expr("approx_top_k_accumulate(v, 256)").alias("s")).select(F.length("s.sketch").alias("n")).first().n
    assert state < 20_000
    got = [tuple(r) for r in sketches.top_values(wide, "v", 4, tracked=256).collect()]
    want = Counter(i % 4 if i % 3 == 0 else i + 10 for i in range(1_000_000))
    assert got == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:4]


@pytest.mark.parametrize(("n", "tracked"), [(3, 8), (3, 4096), (50, 8)])
def test_even_values_are_counted_in_full(spark, n, tracked):
    rng = random.Random(n)
    values = [rng.choice([None, *"abcdefghijklmnopqrstuvwxyz"]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    counts = sorted(((v, values.count(v)) for v in set(values) - {None}), key=lambda x: (-x[1], x[0]))[:n]
    assert [tuple(r) for r in sketches.top_values(df, "v", n, tracked).collect()] == counts
    assert sketches.top_values(df.limit(0), "v").count() == 0


def test_sample_does_not_depend_on_layout(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 30}", None if i % 5 == 0 else i % 11) for i in range(3000)] + [(7, "hot", 7)] * 2
    df = spark.createDataFrame(rows, "id long, s string, x long")
    picks = [sorted(map(tuple, sampling.bottom_k(d, "s", ["id", "x"], 20).collect())) for d in (
        df, df.repartition(7), df.repartition(3, "x").sortWithinPartitions(F.desc("id")))]
    assert picks[0] == picks[1] == picks[2]
    sizes = [sum(1 for r in picks[0] if r[1] == s) for s in {r[1] for r in rows}]
    assert sizes and all(n == 20 for n in sizes)
    other = sampling.bottom_k(df, "s", ["id", "x"], 20, seed=1)
    assert sorted(r.id for r in other.collect()) != [r[0] for r in picks[0]]
    plan = sampling.bottom_k(df.repartition(7), "s", ["id"], 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # cut in each partition before rows move


def every_split(sets, least):
    """All rules by trying every split."""
    support = {tuple(s): v for s, v in sets}
    out = set()
    for items, v in support.items():
        for size in range(1, len(items)):
            for left in combinations(items, size):
                right = tuple(x for x in items if x not in left)
                if left in support and right in support and v / support[left] >= least:
                    out.add((left, right, round(v / support[left], 9)))
    return out


@pytest.mark.parametrize("least", [0.1, 0.5, 0.9])
def test_rules_by_level_are_all_rules(spark, least):
    rng = random.Random(3)
    baskets = [tuple(sorted(rng.sample("abcdef", rng.randrange(1, 7)))) for _ in range(200)]
    sets = []
    for size in range(1, 7):
        for items in combinations("abcdef", size):
            n = sum(set(items) <= set(b) for b in baskets)
            if n >= 4:
                sets.append((list(items), n / len(baskets)))
    df = spark.createDataFrame(sets, "items array<string>, support double")
    got = {(tuple(r.antecedent), tuple(r.consequent), round(r.confidence, 9)) for r in basket.rules(df, least).collect()}
    assert got == every_split(sets, least)


def test_a_large_set_with_weak_rules_ends_after_one_level(spark):
    items = [f"i{n:02d}" for n in range(20)]
    sets = [(items, 0.01), *(([x for x in items if x != y], 0.9) for y in items), *(([x], 0.95) for x in items)]
    df = spark.createDataFrame(sets, "items array<string>, support double")
    assert basket.rules(df, 0.3).count() == 0
    assert math.comb(20, 10) > 100_000  # splits that are never made
