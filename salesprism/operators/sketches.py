"""Mergeable summaries: distinct counts and quantiles from stored cells, frequent values with bounded state, keyed samples.

Cells are small tables made once; questions are answered by merging cells,
without reading rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.functions import cleaners as clean
from salesprism.session import stage

LG_ENTRIES = 14
KLL_K = 20_000
TRACKED = 4096


# Distinct counts

def theta_error(lg_entries: int = LG_ENTRIES) -> float:
    """Relative error that a theta sketch keeps to in 95 of 100 cases; it is exact up to 2**lg_entries values."""
    return 2 / (1 << lg_entries) ** 0.5


def distinct_cells(
    df: DataFrame, keys: Sequence[str] = ("month", "category", "city"), value: str = "customer_id", lg_entries: int = LG_ENTRIES,
) -> DataFrame:
    """One row per month, category and city: a theta sketch of the customers, stored; a null value is not counted."""
    rows = df.withColumn("month", clean.month_start("order_date")) if "month" in keys else df
    cells = rows.groupBy(*keys).agg(F.theta_sketch_agg(value, F.lit(lg_entries)).alias("sketch"))
    return stage(cells, "distinct-cells")


def distinct_by(cells: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Distinct values for each ``keys`` over the cells that pass ``where``."""
    chosen = cells if where is None else cells.where(where)
    merged = chosen.groupBy(*keys).agg(F.theta_union_agg("sketch").alias("_s"))
    return merged.select(*keys, F.theta_sketch_estimate("_s").alias("customers"))


def distinct_in_both(cells: DataFrame, one: Column, other: Column) -> DataFrame:
    """One row: how many values two segments share, and how many each and both together have."""
    sides = [cells.where(c).agg(F.theta_union_agg("sketch").alias(n)) for c, n in ((one, "_a"), (other, "_b"))]
    both = sides[0].withColumn("_b", sides[1].scalar())
    return both.select(
        F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias("in_both"),
        F.theta_sketch_estimate("_a").alias("in_one"), F.theta_sketch_estimate("_b").alias("in_other"),
        F.theta_sketch_estimate(F.theta_union("_a", "_b")).alias("in_any"))


# Quantiles

def kll_rank_error(k: int = KLL_K) -> float:
    """Rank error, as a share of all rows, that a KLL sketch keeps to in 99 of 100 cases; exact while rows are fewer than k."""
    return 2.296 / k ** 0.9723


def quantile_cells(df: DataFrame, value: str, keys: Sequence[str] = ("order_year", "month"), k: int = KLL_K) -> DataFrame:
    """One row per month: a KLL sketch of ``value``, stored; nulls and NaN are left out."""
    rows = df.withColumn("month", clean.month_start("order_date")) if "month" in keys else df
    number = F.col(value).cast("double")
    kept = rows.where(number.isNotNull() & ~F.isnan(number))
    return stage(kept.groupBy(*keys).agg(F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch")), "quantile-cells")


def quantiles_by(cells: DataFrame, keys: Sequence[str], shares: Sequence[float], where: Column | None = None) -> DataFrame:
    """The least value at or below which a share of the rows lies, for each ``keys`` and share."""
    chosen = cells if where is None else cells.where(where)
    merged = chosen.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    wanted = F.array(*[F.lit(float(p)) for p in shares])
    pairs = F.explode(F.arrays_zip(wanted.alias("p"), F.kll_sketch_get_quantile_double("_s", wanted).alias("value"))).alias("_q")
    return merged.select(*keys, F.kll_sketch_get_n_double("_s").alias("rows"), pairs).select(*keys, "rows", "_q.p", "_q.value")


# Frequent values

def top_values(df: DataFrame, column: str, n: int = 5, tracked: int = TRACKED) -> DataFrame:
    """The ``n`` most frequent values of a column and their rows, exactly, without a state for every value.

    A frequent-items sketch of ``tracked`` counters per partition, merged,
    names the values that may be among them; a second pass counts those. A
    value outside has at most a known number of rows. Should the n-th of the
    counted be no more frequent than that, the values are too even for the
    sketch and all are counted. Ties go by value; nulls are left out.
    """
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
    state = stage(values.agg(F.expr(f"approx_top_k_accumulate(value, {tracked})").alias("state"), F.count(F.lit(1)).alias("rows")), "top-values")
    rows = state.select("rows").first()["rows"]
    if rows:
        named = state.select(F.explode(F.expr(f"approx_top_k_estimate(state, {tracked})")).alias("_i")).select("_i.item")
        # at most ``tracked`` values
        counted = values.join(F.broadcast(named), values["value"] == named["item"], "left_semi")
        top = stage(_most(counted, n), "top-values")
        last = top.agg(F.count(F.lit(1)).alias("found"), F.min("rows").alias("least")).first()
        if last.found == n and last.least > unseen_rows(rows, tracked):
            return top
    return _most(values, n)


def unseen_rows(rows: int, tracked: int = TRACKED) -> float:
    """Most rows of a value that the sketch does not name."""
    size = 1
    while 0.75 * size < tracked:
        size *= 2
    return 2 * 3.5 * rows / size


def _most(values: DataFrame, n: int) -> DataFrame:
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "value").limit(n)


def top_values_of(df: DataFrame, columns: Sequence[str], n: int = 5, tracked: int = TRACKED) -> DataFrame:
    """``top_values`` of several columns: (column, value as text, rows)."""
    out = None
    for c in columns:
        one = top_values(df, c, n, tracked).select(F.lit(c).alias("dim"), F.col("value").cast("string").alias("value"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
