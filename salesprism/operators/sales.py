"""Delivery, returns, profit, discount and festival tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.functions import cleaners as clean
from salesprism.functions import fixed_values as fixed
from salesprism.operators.aggregates import AMOUNT, drop_null_keys, group_metrics, share_of_total, top_k, total
from salesprism.operators.ranking import exact_quantiles
from salesprism.sources.schema import find_column


def _dated(df: DataFrame) -> DataFrame:
    return df.where(F.col("order_date").isNotNull()) if "order_date" in df.columns else df


# Delivery

def delivery_by_state(df: DataFrame) -> DataFrame:
    return top_k(df, ["customer_state"], None, F.avg("delivery_days"), "avg_delivery_days", ascending=True)


def courier_performance(df: DataFrame, k: int = 10) -> DataFrame:
    """The couriers with the lowest mean delivery time."""
    courier = find_column(df, ("courier", "delivery_partner", "shipping_provider", "logistics_name"))
    if courier is None:
        raise ValueError("no courier column")
    return top_k(df, [courier], k, F.avg("delivery_days"), "avg_delivery_days", ascending=True)


def delivery_box(df: DataFrame) -> DataFrame:
    """Five-number summary of delivery days by membership.

    Delivery days take few distinct values, so the exact percentile's
    value-to-count map stays small.
    """
    label = clean.flag_label("is_prime_member", "Prime", "Non-Prime")
    five = F.percentile(F.col("delivery_days").cast("double"), [0.0, 0.25, 0.5, 0.75, 1.0])
    table = df.withColumn("member", label).groupBy("member").agg(five.alias("p"))
    names = ("lowest", "q1", "median", "q3", "highest")
    return table.select("member", *[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def festival_delivery_delta(df: DataFrame, notable: float = 0.3) -> DataFrame:
    """Mean delivery days in and out of festivals, and whether the gap is worth reporting."""
    fest = F.avg(F.when(F.col("is_festival_sale"), F.col("delivery_days")))
    norm = F.avg(F.when(~F.col("is_festival_sale"), F.col("delivery_days")))
    return df.agg(
        F.avg("delivery_days").alias("avg_delivery"), fest.alias("festival"), norm.alias("normal"),
    ).withColumn("delta", F.col("festival") - F.col("normal")).withColumn(
        "notable", F.abs("delta") >= notable)


# Returns

def with_returns(df: DataFrame, report: str = "returns") -> DataFrame:
    """Add the return flag and the loss: the full amount of a returned line. Lines without a date are dropped."""
    df = _dated(df)
    column = find_column(df, ("return_status", "is_returned", "refund_status"))
    flag = clean.is_returned(column, report) if column else F.lit(False)
    amount = F.coalesce(F.col(AMOUNT), F.lit(0.0))
    return df.withColumns({"returned": flag, "return_loss": F.when(flag, amount).otherwise(F.lit(0.0))})


def return_kpis(flagged: DataFrame) -> DataFrame:
    """Returned orders, rates and loss; the category that loses most comes from its own table."""
    loss, returned = total("return_loss"), F.count(F.when(F.col("returned"), 1))
    worst = top_k(flagged, ["category"], 1, total("return_loss"), "loss").select("category").scalar()
    return flagged.agg(
        loss.alias("total_return_loss"), returned.alias("returned_orders"),
        F.count(F.lit(1)).alias("total_orders"),
        clean.percent(returned, F.count(F.lit(1))).alias("return_rate_pct"),
        clean.percent(loss, F.sum(AMOUNT)).alias("loss_pct_of_revenue"),
    ).withColumn("most_affected_category", worst)


def return_loss_by(flagged: DataFrame, by: str, k: int | None = 10) -> DataFrame:
    return top_k(flagged, [by], k, total("return_loss"), "return_loss")


def return_monthly(flagged: DataFrame) -> DataFrame:
    monthly = flagged.where(F.col("order_date").isNotNull()).withColumn("month", clean.month_start("order_date"))
    return group_metrics(monthly, ["month"], return_loss=total("return_loss"),
                         return_count=F.count(F.when(F.col("returned"), 1))).orderBy("month")


def return_summary(df: DataFrame) -> DataFrame:
    flagged = df.withColumn("is_returned", clean.is_returned("return_status", "export"))
    return group_metrics(flagged, ["is_returned"], orders=F.count(AMOUNT), revenue=total(AMOUNT))


def worst_return_category(df: DataFrame) -> DataFrame:
    """The highest return rate among categories with enough rows: 100, or 1 % of all."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    table = group_metrics(df, ["category"], orders=F.count(F.lit(1)),
                          return_rate=F.avg(clean.is_returned("return_status", "insights").cast("double")))
    enough = F.col("orders") >= F.greatest(F.lit(100.0), rows * 0.01)
    return table.where(enough).orderBy(F.desc("return_rate"), "category").limit(1)


def to_long(table: DataFrame, key: str, *values: str) -> DataFrame:
    """Metric columns turned into (key, metric, value) rows."""
    as_double = table.select(key, *[F.col(v).cast("double").alias(v) for v in values])
    return as_double.unpivot([key], list(values), "metric", "value")


# Profit

def with_profit(df: DataFrame) -> DataFrame:
    """Add cost, discount loss, return loss, profit and margin per line.

    A line without both prices has a null discount loss and so a null profit.
    Lines without a date are dropped.
    """
    df = _dated(df)
    discount: Column = F.lit(0.0)
    if "discounted_price_inr" in df.columns and "original_price_inr" in df.columns:
        discount = (F.col("original_price_inr") - F.col("discounted_price_inr")) * F.col("quantity")
    returned = F.lit(0.0)
    if "return_status" in df.columns:
        returned = F.when(clean.is_returned("return_status", "profit"), F.col(AMOUNT)).otherwise(F.lit(0.0))
    df = df.withColumns({
        "estimated_cost": F.col(AMOUNT) * fixed.COST_SHARE, "discount_loss": discount, "return_loss": returned,
    })
    df = df.withColumn("profit", F.col(AMOUNT) - F.col("estimated_cost") - F.col("discount_loss") - F.col("return_loss"))
    return df.withColumn("profit_margin", F.try_divide("profit", AMOUNT) * 100)


def profit_kpis(profit: DataFrame) -> DataFrame:
    return profit.agg(
        total(AMOUNT).alias("total_revenue"), total("estimated_cost").alias("total_cost"),
        total("profit").alias("total_profit"),
        clean.percent(total("profit"), F.sum(AMOUNT)).alias("margin_pct"),
        total("return_loss").alias("total_return_loss"),
    )


def profit_by_category(profit: DataFrame, k: int = 10) -> DataFrame:
    return top_k(profit, ["category"], k, total("profit"), "profit")


def profit_monthly(profit: DataFrame) -> DataFrame:
    monthly = profit.where(F.col("order_date").isNotNull()).withColumn(
        "month_label", F.date_format("order_date", "yyyy-MM"))
    return group_metrics(monthly, ["month_label"], revenue=total(AMOUNT), profit=total("profit")).orderBy("month_label")


def discount_profit_points(profit: DataFrame) -> DataFrame:
    return profit.where(F.col("discount_percent").isNotNull()).select("discount_percent", "profit", AMOUNT)


# Discounts and festivals

def discount_slabs(df: DataFrame) -> DataFrame:
    """Revenue per right-closed discount slab, empty slabs as 0; a 0 % discount is in none."""
    edges = list(zip(fixed.DISCOUNT_EDGES, fixed.DISCOUNT_EDGES[1:]))
    chain = F.lit(None).cast("int")
    for i, (low, high) in reversed(list(enumerate(edges))):
        d = F.col("discount_percent")
        chain = F.when((d > low) & (d <= high), F.lit(i)).otherwise(chain)
    sums = group_metrics(df.withColumn("_slab", chain), ["_slab"])
    names = [f"({low}, {high}]" for low, high in edges]
    slabs = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("_slab", "slab"))
    return slabs.join(sums, "_slab", "left").orderBy("_slab").select(
        "slab", F.coalesce("revenue", F.lit(0.0)).alias("revenue"))


def festival_kpis(df: DataFrame) -> DataFrame:
    fest = F.col("is_festival_sale")
    revenue, orders = total(F.when(fest, F.col(AMOUNT))), F.count(F.when(fest, 1))
    return df.agg(
        revenue.alias("festival_revenue"), orders.alias("festival_orders"),
        F.bround(F.coalesce(F.try_divide(revenue, orders), F.lit(0.0)), 2).alias("avg_festival_order"),
        clean.percent(revenue, F.sum(AMOUNT)).alias("share_pct"),
    )


def festival_revenue(df: DataFrame, k: int = 10) -> DataFrame:
    return top_k(df.where("is_festival_sale"), ["festival_name"], k)


def event_revenue(df: DataFrame, column: str, revenue: Column) -> DataFrame:
    """Revenue per event whose name holds a festival word."""
    events = df.where(clean.is_festival_event(column)).withColumn("_revenue", revenue)
    return group_metrics(events, [column], revenue=total("_revenue"))


def festival_monthly(df: DataFrame) -> DataFrame:
    labelled = df.withColumns({
        "label": clean.flag_label("is_festival_sale", "Festival", "Non-Festival"),
        "period": F.concat_ws("-", F.col("order_year").cast("string"), F.col("order_month").cast("string")),
    })
    return group_metrics(labelled, ["order_year", "order_month", "period", "label"])


def festival_spike(df: DataFrame) -> DataFrame:
    labelled = df.withColumn("label", clean.flag_label("is_festival_sale", "Festival", "Non-Festival"))
    return group_metrics(labelled, ["label"], avg_amount=F.bround(F.avg(AMOUNT), 2))


def payment_share(df: DataFrame) -> DataFrame:
    return share_of_total(top_k(df, ["payment_method"], None, orders=F.count("transaction_id")))


def price_outliers(df: DataFrame, k: int = 1000, factor: float = 5.0) -> DataFrame:
    """The ``k`` largest amounts beyond the third quartile by ``factor`` interquartile ranges."""
    q = exact_quantiles(df, AMOUNT, [0.25, 0.75]).select("q").scalar()
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    far = df.withColumn("_q", q).where(F.col(AMOUNT) > q3 + factor * (q3 - q1)).drop("_q")
    return far.orderBy(F.desc(AMOUNT), "transaction_id", "product_id").limit(k)
