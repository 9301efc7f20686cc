"""Group metrics, top-k lists, shares and calendar tables.

Every table is a partial-then-final hash aggregate, so a hot group is reduced
before it is shuffled. Null keys are dropped, an all-null sum is 0, and each
limited list has its key as a tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.functions.cleaners import month_start, percent
from salesprism.session import stage

AMOUNT = "final_amount_inr"


def total(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def group_metrics(df: DataFrame, by: Sequence[str], **metrics: Column) -> DataFrame:
    """Aggregate named metrics per key; revenue by default."""
    wanted = metrics or {"revenue": total(AMOUNT)}
    return drop_null_keys(df, by).groupBy(*by).agg(*[c.alias(n) for n, c in wanted.items()])


def top_k(
    df: DataFrame, by: Sequence[str], k: int | None, metric: Column | None = None,
    name: str = "revenue", ascending: bool = False, **more: Column,
) -> DataFrame:
    """The ``k`` best groups by one metric (all groups, sorted, when ``k`` is None)."""
    grouped = group_metrics(df, by, **{name: total(AMOUNT) if metric is None else metric, **more})
    lead = F.asc_nulls_last(name) if ascending else F.desc_nulls_last(name)
    ordered = grouped.orderBy(lead, *by)
    return ordered if k is None else ordered.limit(k)


def value_counts(df: DataFrame, by: str, k: int | None = None, keep_null: bool = False,
                 sort_by_key: bool = False, name: str = "count") -> DataFrame:
    rows = df if keep_null else drop_null_keys(df, [by])
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    ordered = counted.orderBy(by) if sort_by_key else counted.orderBy(F.desc(name), by)
    return ordered if k is None else ordered.limit(k)


def kpis(df: DataFrame, amount: str = AMOUNT) -> DataFrame:
    """Revenue, rows, revenue per row, and the mean of the non-null amounts."""
    return df.agg(
        total(amount).alias("total_revenue"),
        F.count(F.lit(1)).alias("total_orders"),
        F.coalesce(F.try_divide(F.sum(amount), F.count(F.lit(1))), F.lit(0.0)).alias("avg_order_value"),
        F.avg(amount).alias("mean_amount"),
    )


def share_of_total(table: DataFrame, value: str = "revenue", name: str = "share_pct") -> DataFrame:
    """Each row's percentage of the column total of an already reduced table."""
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table.withColumn(name, percent(F.col(value), F.sum(value).over(whole)))


def category_performance(df: DataFrame) -> DataFrame:
    return top_k(df, ["category"], None, count=F.count(AMOUNT), avg=F.avg(AMOUNT))


def revenue_and_orders(df: DataFrame, by: str) -> DataFrame:
    """Revenue and non-null order ids per group, best first."""
    return top_k(df, [by], None, orders=F.count("transaction_id"))


def sales_by_year(df: DataFrame) -> DataFrame:
    return group_metrics(df, ["order_year"], revenue=total(AMOUNT),
                         orders=F.count("transaction_id")).orderBy("order_year")


def monthly_revenue(df: DataFrame) -> DataFrame:
    labelled = df.where(F.col("order_date").isNotNull()).withColumn(
        "month_label", F.date_format("order_date", "yyyy-MM"))
    return group_metrics(labelled, ["month_label"]).orderBy("month_label")


def daily_revenue(df: DataFrame) -> DataFrame:
    return group_metrics(df.withColumn("order_day", F.to_date("order_date")), ["order_day"]).orderBy("order_day")


def sales_monthly(df: DataFrame) -> DataFrame:
    return group_metrics(df, ["order_year", "order_month"]).orderBy("order_year", "order_month")


def month_year_matrix(df: DataFrame) -> DataFrame:
    """Months down, the years of the data across, 0 where nothing was sold.

    The years are those of the data, so no year is left out. They and the cells
    are read from the sums per month, which are made once and stored.
    """
    sums = drop_null_keys(df, ["order_month", "order_year"]).groupBy("order_month", "order_year").agg(F.sum(AMOUNT).alias("_sum"))
    sums = stage(sums, "month-sums")
    wide = sums.groupBy("order_month").pivot("order_year").agg(F.sum("_sum")).na.fill(0.0)
    return wide.withColumnsRenamed({c: f"y{c}" for c in wide.columns if c != "order_month"}).orderBy("order_month")


def month_seasonality(df: DataFrame) -> DataFrame:
    """Revenue per calendar month, all twelve present."""
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("order_month"))
    sums = group_metrics(df, ["order_month"])
    return (
        months.join(sums, "order_month", "left")
        .select("order_month", F.coalesce("revenue", F.lit(0.0)).alias("revenue"))
        .orderBy("order_month")
    )


def category_monthly(df: DataFrame) -> DataFrame:
    period = F.concat_ws("-", F.col("order_year").cast("string"),
                         F.lpad(F.col("order_month").cast("string"), 2, "0"))
    return group_metrics(df.withColumn("period", period), ["period", "category"]).orderBy("period", "category")


def prime_summary(df: DataFrame, flag: str = "is_prime_member") -> DataFrame:
    """Revenue, orders, revenue per order and order share by membership."""
    table = group_metrics(df, [flag], revenue=total(AMOUNT), orders=F.count("transaction_id"))
    labelled = table.withColumns({
        "label": F.when(F.col(flag), "Prime").otherwise("Non-Prime"),
        "avg_order_value": F.try_divide("revenue", "orders"),
    })
    return share_of_total(labelled, "orders", "order_pct")


def customer_kpis(df: DataFrame) -> DataFrame:
    """Buyers, repeat buyers, members, non-members and mean spend, from one row per buyer."""
    buyers = drop_null_keys(df, ["customer_id"]).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max("is_prime_member").alias("prime"), total(AMOUNT).alias("spend"))
    prime = F.coalesce(F.sum(F.when(F.col("prime"), 1).otherwise(0)), F.lit(0))
    return buyers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.coalesce(F.sum(F.when(F.col("rows") > 1, 1).otherwise(0)), F.lit(0)).alias("repeat_customers"),
        prime.alias("prime_customers"),
        (F.count(F.lit(1)) - prime).alias("non_prime_customers"),
        F.avg("spend").alias("avg_spend"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"n_{c}") for c in columns])


def state_share(df: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` states and their share of those ``k`` states' sum."""
    return share_of_total(top_k(df, ["customer_state"], k))


def new_and_returning(df: DataFrame) -> DataFrame:
    """Distinct buyers per month, split into first-month and returning.

    Rows are reduced to (buyer, month) before the window, so a buyer's window
    holds at most one row per month however many orders there are.
    """
    seen = (
        df.where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
        .select("customer_id", month_start("order_date").alias("month")).distinct()
        .withColumn("first_month", F.min("month").over(Window.partitionBy("customer_id")))
    )
    is_new = F.col("month") == F.col("first_month")
    return seen.groupBy("month").agg(
        F.count(F.when(is_new, 1)).alias("new_customers"),
        F.count(F.when(~is_new, 1)).alias("returning_customers"),
    ).orderBy("month")


def peak(table: DataFrame, by: str, value: str = "revenue") -> DataFrame:
    """The row with the largest value; the smallest key wins a tie."""
    return table.orderBy(F.desc_nulls_last(value), by).limit(1)
