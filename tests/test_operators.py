"""Properties of the operators on the small tables, sinks, guards and baskets."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from salesprism.operators import aggregates as agg
from salesprism.operators import basket, customers, filters, insights, pricing, sales
from salesprism.sources import readers, schema, sinks
from tests.conftest import SMALL


def total(df, column="revenue"):
    return df.agg(F.sum(column)).first()[0]


@pytest.mark.parametrize("keys", [["category"], ["city"], ["payment_method"], ["order_year"], ["order_year", "order_month"],
                                  ["customer_id"], ["product_id"], ["is_prime_member"]])
def test_groups_add_up_to_the_total(t, keys):
    assert total(agg.group_metrics(t, keys)) == pytest.approx(total(t, "final_amount_inr"))


def test_shares_add_up(t):
    assert total(sales.payment_share(t), "share_pct") == pytest.approx(100.0)
    assert total(agg.state_share(t), "share_pct") == pytest.approx(100.0)


def test_null_keys_and_all_null_sums(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 4.0)], "k string, final_amount_inr double")
    assert [tuple(r) for r in agg.group_metrics(df, ["k"]).collect()] == [("a", 0.0)]
    counts = agg.value_counts(df, "k", keep_null=True).collect()
    assert {(r.k, r["count"]) for r in counts} == {("a", 2), (None, 1)}


def test_scores_stay_in_range(t):
    scores = customers.churn_scores(t)
    low, high = scores.agg(F.min("churn_risk_score"), F.max("churn_risk_score")).first()
    assert 0 <= low <= high <= 100
    rfm = customers.rfm_by_rank(t)
    sizes = [r["count"] for r in rfm.groupBy("r_score").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert total(customers.segment_counts(customers.rfm_by_value(t)), "customers") == rfm.count()
    assert total(customers.risk_heatmap(scores), "customers") == scores.count()


@pytest.mark.parametrize("months,days", [(2, 60), (6, 182), (18, 547)])
def test_churn_threshold(months, days):
    assert customers.churn_days(months) == days


@pytest.mark.parametrize("r,f,name", [(5, 4, "Champion"), (4, 2, "New Customer"), (2, 5, "At Risk"), (1, 1, "Lost"),
                                      (3, 3, "Loyal"), (4, 3, "Loyal")])
def test_segments(spark, r, f, name):
    assert spark.range(1).select(customers.segment(F.lit(r), F.lit(f))).first()[0] == name


def test_discount_slabs_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.5,), (100.0,), (101.0,)], "discount_percent double").withColumn(
        "final_amount_inr", F.lit(1.0))
    got = {r.slab: r.revenue for r in sales.discount_slabs(df).collect()}
    assert got == {"(0, 10]": 1.0, "(10, 20]": 1.0, "(20, 30]": 0.0, "(30, 40]": 0.0, "(40, 50]": 0.0, "(50, 100]": 1.0}


def test_filters_empty_choice_keeps_all(t):
    assert filters.apply_filters(t, years=[], categories=None).count() == t.count()
    one = filters.apply_filters(t, years=[1999], payments=["2-HIGH"])
    assert one.select("order_year", "payment_method").distinct().collect() == [(1999, "2-HIGH")]


def test_year_filter_prunes_partitions(t):
    plan = filters.apply_filters(t, years=[1999])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year" in plan


def test_elasticity_labels(spark):
    rows = [("p", i, float(p), float(1000.0 / p**2)) for i, p in enumerate([1, 2, 4, 8, 16])]
    bands = spark.createDataFrame(rows, "product_name string, price_bin int, avg_price double, total_qty double")
    row = pricing.elasticity(bands).first()
    assert row.elasticity == pytest.approx(-2.0) and row.label.startswith("Elastic")
    assert pricing.elasticity(bands.limit(4)).count() == 0


def baskets(spark):
    rows = [(i, x) for i in range(60) for x in (["a", "b", "c"] if i % 3 else ["a", "b"])]
    rows += [(100 + i, "d") for i in range(30)] + [(0, "a")] * 200 + [(200, "z"), (201, None)]
    return spark.createDataFrame(rows, "transaction_id long, product_id string")


def brute_sets(df, support):
    carts = {}
    for r in df.where("product_id IS NOT NULL").collect():
        carts.setdefault(r.transaction_id, set()).add(r.product_id)
    counts = {}
    for items in carts.values():
        for k in range(1, len(items) + 1):
            for c in combinations(sorted(items), k):
                counts[c] = counts.get(c, 0) + 1
    return {c: n for c, n in counts.items() if n >= support * len(carts)}, len(carts)


def test_item_sets_and_rules_match_brute_force(spark):
    df = baskets(spark)
    want, n = brute_sets(df, 0.05)
    sets = basket.item_sets(df, min_support=0.05)
    assert {tuple(r["items"]): r.freq for r in sets.collect()} == want
    pairs = {(r.item_a, r.item_b): r.baskets for r in basket.item_pairs(df, min_support=0.05).collect()}
    assert pairs == {c: k for c, k in want.items() if len(c) == 2}
    got = {(tuple(r.antecedent), tuple(r.consequent)): (r.confidence, r.lift) for r in basket.rules(sets, 0.3).collect()}
    expected = {}
    for whole, freq in want.items():
        for k in range(1, len(whole)):
            for left in combinations(whole, k):
                right = tuple(x for x in whole if x not in left)
                confidence = freq / want[left]
                if confidence >= 0.3:
                    expected[(left, right)] = (confidence, confidence / (want[right] / n))
    assert set(got) == set(expected)
    for key, pair in expected.items():
        assert got[key] == pytest.approx(pair)


def test_no_frequent_items(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "transaction_id long, product_id string")
    assert basket.item_sets(df, min_support=0.5).count() == 0


def test_csv_round_trip_keeps_text(spark, tmp_path):
    raw = spark.createDataFrame([("1", "  a, \"b\" "), ("2", "₹5\nline")], "transaction_id string, city string")
    path = sinks.write_csv(raw, str(tmp_path / "csv"))
    back = spark.read.option("multiLine", True).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, raw.collect()))


def test_csv_bad_record_is_kept(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n1,2,3\n")
    df = readers.read_csv(spark, str(tmp_path / "x.csv"), readers.csv_schema(spark, str(tmp_path / "x.csv"))).cache()
    assert df.count() == 2 and df.where(F.col(readers.BAD_RECORD).isNotNull()).count() == 1


def test_transactions_sink_replaces_and_partitions(spark, t, tmp_path):
    path = str(tmp_path / "tx")
    sinks.write_transactions(t, path)
    sinks.write_transactions(t.where("order_year = 1999"), path)
    assert [r.order_year for r in spark.read.parquet(path).select("order_year").distinct().collect()] == [1999]


def test_report_skips_empty_tables(spark, tmp_path):
    full, empty = spark.range(3), spark.range(0)
    assert sinks.write_report({"a": full, "b": empty, "c": full.where("1 = 0")}, str(tmp_path)) == {"a": full.count()}
    assert [p.name for p in tmp_path.iterdir()] == ["a"]


def test_lines_sink(spark, t, tmp_path):
    path = sinks.write_lines(insights.overview(t), str(tmp_path / "txt"), "Summary")
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == "Summary" and lines[1].startswith("Total revenue: ₹") and len(lines) == 6


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, 2)], "` Order Date ` int, QTY int")
    tidy = schema.normalize_columns(df)
    assert tidy.columns == ["order_date", "qty"]
    assert schema.resolve_schema(tidy, required=["quantity"]).columns == ["order_date", "quantity"]
    with pytest.raises(ValueError, match="brand"):
        schema.require_columns(tidy, ["brand"])
    with pytest.raises(ValueError):
        schema.revenue_column(tidy)
    filled = schema.default_columns(tidy, schema.SUMMARY_DEFAULTS)
    assert dict(filled.dtypes)["delivery_days"] == "double" and filled.first().category == "Unknown"


def test_shared_folder_is_the_named_one(spark):
    from salesprism.session import shared_folder

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    assert SMALL
