"""Stored layouts, incremental refresh and the reject channel."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from salesprism.operators import cleaning, customers
from salesprism.plans.catalog import base
from salesprism.session import new_path
from salesprism.sources import layout, readers, refresh
from tests.conftest import SMALL


def row_groups(path):
    """For each row group of a table: column -> (least, greatest)."""
    for name in sorted(glob.glob(f"{path}/*/*.parquet")):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            chunks = [group.column(i) for i in range(group.num_columns)]
            yield {c.path_in_schema: (c.statistics.min, c.statistics.max) for c in chunks if c.statistics and c.statistics.has_min_max}


def share_kept(path, **wanted):
    groups = list(row_groups(path))
    kept = [g for g in groups if all(g[c][0] <= v <= g[c][1] for c, v in wanted.items())]
    return len(kept) / len(groups), len(groups)


def scanned(df):
    """Rows the scan of a plan hands on after row groups were ruled out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def t(spark):
    """More rows than the other tests use: pruning shows on many row groups."""
    return base(spark, SMALL.replace("0.001", "0.01"))


@pytest.fixture(scope="module")
def clustered(t):
    return layout.write_clustered(t.where("product_id % 2 = 0"), new_path(t.sparkSession, "clustered"), files=8, row_group_bytes=4096)


def test_few_row_groups_answer_a_lookup(t, clustered):
    many = t.where("product_id % 2 = 0")
    place = many.groupBy("category", "city").count().orderBy("category", "city").first()
    share, groups = share_kept(clustered, category=place.category, city=place.city)
    assert groups >= 100 and share < 0.25


def test_single_keys_read_few_rows(spark, t, clustered):
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        stored = spark.read.schema(t.schema).parquet(clustered)
        odd = t.where("product_id % 2 = 1").agg(F.percentile_approx("product_id", 0.5)).first()[0]
        assert scanned(stored.where(F.col("product_id") == odd)) == 0
        assert scanned(stored.where(F.col("product_id") == odd + 1)) > 0
        buyer = stored.agg(F.percentile_approx("customer_id", 0.5)).first()[0]
        assert 0 < scanned(stored.where(F.col("customer_id") == buyer)) < 0.25 * stored.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_clustering_keeps_rows_with_nulls_ties_and_hot_values(spark):
    rows = [(1990, None if i % 5 == 0 else "hot" if i % 3 else f"c{i}", None if i % 7 == 0 else "x", i % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "order_year int, category string, city string, customer_id long")
    path = layout.write_clustered(df, new_path(spark, "clustered"), 4, bloom=("customer_id",))
    assert sorted(map(tuple, spark.read.parquet(path).select(df.columns).collect()), key=repr) == sorted(rows, key=repr)
    assert len(glob.glob(f"{path}/order_year=1990/*.parquet")) >= 3  # the hot value is not one file
    empty = layout.write_clustered(df.limit(0), new_path(spark, "clustered"), 4)
    assert spark.read.schema(df.schema).parquet(empty).count() == 0


def test_curve_interleaves_bits(spark):
    found = spark.range(64).select("id", layout.curve([F.col("id").bitwiseAND(F.lit(7)), F.shiftright("id", 3)], bits=3).alias("at"))
    want = {i: sum(((i >> b & 1) << 2 * b) | ((i >> 3 + b & 1) << 2 * b + 1) for b in range(3)) for i in range(64)}
    assert {r.id: r["at"] for r in found.collect()} == want


def test_borders_deal_values_evenly(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("v"), F.lit(None).cast("string").alias("n"))
    borders = layout.range_borders(df, ["v", "n"], bits=2)
    assert borders["n"] == [] and [round(b / 3, -1) for b in borders["v"]] == [250, 500, 750]


def test_buckets_need_no_shuffle_by_customer(spark, t):
    table = layout.save_bucketed(t, "bucket_test", new_path(spark, "bucketed"), 4)
    for query in (customers.customer_summary, customers.last_category):
        plan = query(table)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(customer_id" not in plan
        plain = query(t)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(customer_id" in plain
        assert sorted(query(table).collect(), key=repr)[0][0] is not None


def files_of(table):
    return {os.path.basename(os.path.dirname(f)): set() for f in glob.glob(f"{table}/*/*.parquet")} | {
        year: {os.path.basename(f) for f in glob.glob(f"{table}/{year}/*.parquet")} for year in os.listdir(table) if "=" in year}


def test_refresh_rewrites_touched_years_only(spark, tmp_path):
    inputs, table = str(tmp_path / "in puts"), str(tmp_path / "table")
    schema = "id long, order_year int"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{inputs}/{name}")

    def read(spark, paths):
        return spark.read.schema(schema).parquet(*paths)

    def stored():
        return sorted(((r.id, r.order_year) for r in spark.read.parquet(table).select("id", "order_year").collect()), key=repr)

    put("a", [(1, 2001), (2, 2002)])
    put("b", [(3, 2002), (4, 2003), (5, None)])
    assert refresh.refresh(spark, read, inputs, table) == [-1, 2001, 2002, 2003]
    first = files_of(table)
    assert refresh.refresh(spark, read, inputs, table) == [] and files_of(table) == first
    put("a", [(1, 2001), (2, 2002), (6, 2004)])
    assert refresh.refresh(spark, read, inputs, table) == [2001, 2002, 2004]
    second = files_of(table)
    assert second["order_year=2003"] == first["order_year=2003"] and second["order_year=2001"] != first["order_year=2001"]
    assert stored() == [(1, 2001), (2, 2002), (3, 2002), (4, 2003), (5, None), (6, 2004)]
    for name in glob.glob(f"{inputs}/b/*"):
        os.remove(name)
    assert refresh.refresh(spark, read, inputs, table) == [-1, 2002, 2003]
    assert stored() == [(1, 2001), (2, 2002), (6, 2004)]
    assert files_of(table)["order_year=2004"] == second["order_year=2004"] and "order_year=2003" not in files_of(table)


def test_rejects_split_one_read(spark, tmp_path):
    text = (
        "transaction_id,order_date,final_amount_inr,customer_rating\n1,2020-01-02,₹5,4\n2,someday,x,great\n3,,n/a,\n"
        "4,2020-01-02,7,9/10,extra,more\n5,02/01/2020,,0\n6,2020-13-45,7,5 stars\n")
    (tmp_path / "a.csv").write_text(text)
    raw = readers.read_csv(spark, str(tmp_path), readers.csv_schema(spark, str(tmp_path)))
    kept, gone = cleaning.split_rejects(raw)
    reasons = {r.transaction_id: (tuple(r.reasons), False) for r in kept.collect()} | {r.transaction_id: (tuple(r.reasons), True) for r in gone.collect()}
    assert reasons == {
        "1": ((), False), "2": (("unparsed_date", "unparsed_price", "unparsed_rating"), True),
        "3": (("unparsed_date", "unparsed_price"), True), "4": (("broken_record",), True), "5": (("unparsed_rating",), False),
        "6": (("unparsed_date",), True)}
    counts = {r.reason: (r.rows, r.rejected, r.kept) for r in cleaning.reject_counts(kept, gone).collect()}
    assert counts["all"] == (6, 4, 2) and counts["unparsed_price"] == (2, 2, 0) and counts["broken_record"] == (1, 1, 0)
    strict = cleaning.split_rejects(raw, cleaning.REASONS)
    assert [d.count() for d in strict] == [1, 5]
    assert [d.count() for d in cleaning.split_rejects(raw, ())] == [6, 0]
    assert kept.columns == gone.columns == [*raw.columns, "reasons"]


def test_files_and_buckets_grow_with_the_table(spark):
    small, large = spark.range(1000), spark.range(2_000_001)
    assert (layout.parts(small, 4), layout.parts(small, 8)) == (4, 8)
    assert layout.parts(small, 4, rows=100) == 10 and layout.parts(large, 4) == 5


def test_stored_transactions_keep_plain_columns_only(spark, t):
    """What follows from other columns is not written, and the product's long texts are not shuffled to the orders."""
    written = spark.read.parquet(os.path.dirname(os.path.dirname(t.inputFiles()[0]))).columns
    assert {"l_extendedprice", "l_discount", "l_quantity", "order_year"} <= set(written)
    assert not {"final_amount_inr", "original_price_inr", "discounted_price_inr", "festival_name"} & set(written)
