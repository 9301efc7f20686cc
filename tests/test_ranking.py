"""Ranks, quantiles and bins against numpy and plain windows, with hot keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from salesprism.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to key 0, and a third share one value."""
    return spark.range(6000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 101).alias("k"),
        F.when(F.col("id") % 3 == 1, 5.0).otherwise((F.col("id") * 7919 % 1009).cast("double")).alias("v"), "id")


def test_global_row_number_is_a_permutation(skewed):
    out = ranking.global_row_number(skewed, ["v", "id"])
    want = skewed.withColumn("rn", F.row_number().over(Window.orderBy("v", "id"))).select("id", "rn")
    assert out.select("id", "rn").exceptAll(want).count() == 0
    assert out.agg(F.min("n"), F.max("n")).first() == (6000, 6000)


def test_rank_within_hot_key(skewed):
    out = ranking.rank_within(skewed, ["k"], ["v", "id"])
    w = Window.partitionBy("k").orderBy("v", "id")
    want = skewed.withColumn("order_rank", F.row_number().over(w))
    assert out.select("k", "id", "order_rank").exceptAll(want.select("k", "id", "order_rank")).count() == 0
    assert out.count() == 6000


def test_rank_within_a_key_over_many_partitions(spark):
    df = spark.range(0, 5000, numPartitions=5).select(F.when(F.col("id") < 4900, 1).otherwise(2).alias("k"), "id")
    out = ranking.rank_within(df, ["k"], ["id"])
    bad = out.where(F.col("order_rank") != F.when(F.col("k") == 1, F.col("id") + 1).otherwise(F.col("id") - 4899))
    assert bad.count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 11, 23, 300])
def test_rank_quintile_sizes_match_pandas(spark, n):
    df = spark.range(n).select((F.col("id") + 1).alias("rn"), F.lit(n).cast("long").alias("n"))
    got = [r[0] for r in df.orderBy("rn").select(ranking.rank_quintile(F.col("rn"), F.col("n"))).collect()]
    if n >= 5:
        want = pd.qcut(pd.Series(range(1, n + 1)).rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
        assert got == want
    assert got == sorted(got) and got[0] == 1


@pytest.mark.parametrize("small", [10, 50_000])
def test_exact_quantiles_match_numpy(skewed, small):
    probs = [0.0, 0.2, 0.25, 0.5, 0.75, 0.8, 1.0]
    row = ranking.exact_quantiles(skewed, "v", probs, accuracy=1000, small=small).first()
    values = [r.v for r in skewed.select("v").collect()]
    assert row.n == 6000
    assert row.q == pytest.approx(np.quantile(values, probs))


def test_exact_quantiles_few_rows_and_nulls(spark):
    for values in ([3.0], [1.0, 2.0], [1.0, None, 5.0, 9.0, 2.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        kept = [v for v in values if v is not None]
        got = ranking.exact_quantiles(df, "v", [0.25, 0.5, 0.9]).first()
        assert got.q == pytest.approx(np.quantile(kept, [0.25, 0.5, 0.9]))


def test_value_quintile_matches_pandas(spark):
    values = [float(i * i % 97) + i / 1000 for i in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.q for r in ranking.value_quintile(df, "v", "q").orderBy("i").collect()]
    assert got == pd.qcut(pd.Series(values), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()


def test_equal_width_bin_matches_pandas(spark):
    values = [float(i * 37 % 211) for i in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.bin for r in ranking.equal_width_bin(df, "v", 20).orderBy("i").collect()]
    assert got == (pd.cut(pd.Series(values), 20, labels=False) + 1).tolist()


def test_constant_column(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert {r.bin for r in ranking.equal_width_bin(df, "v").collect()} == {1}
    scaled = df.select(ranking.minmax(F.col("v"), F.lit(4.0), F.lit(4.0)).alias("s"))
    assert {r.s for r in scaled.collect()} == {0.5}
