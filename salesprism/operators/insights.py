"""Insight sentences, written from one pass over the transactions.

The rules need totals by month, category, city, payment method and festival.
One grouping-sets aggregate produces all of them from a single scan; its
result, one row per group, is stored and every rule reads that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.functions import cleaners as clean
from salesprism.operators import customers
from salesprism.operators.aggregates import AMOUNT, total
from salesprism.operators.forecasting import trailing_growth
from salesprism.session import stage

DIMENSIONS = ("month", "category", "city", "payment_method", "festival")


def summary_cube(df: DataFrame, city: str = "city") -> DataFrame:
    """Totals per month, category, city, payment method, festival and overall, as ``(dim, key, ...)``."""
    fest, days = F.coalesce("is_festival_sale", F.lit(False)), F.col("delivery_days").cast("double")
    returned = clean.is_returned("return_status", "insights")
    rows = df.select(
        F.date_format("order_date", "yyyy-MM").alias("month"), "category", F.col(city).alias("city"),
        "payment_method", F.when(fest, F.col("festival_name")).alias("festival"),
        F.col("transaction_id"), F.col(AMOUNT).alias("amount"), fest.alias("fest"), days.alias("days"),
        returned.alias("returned"),
    )
    sets = [[F.col(d)] for d in DIMENSIONS] + [[]]
    cube = rows.groupingSets(sets, *[F.col(d) for d in DIMENSIONS]).agg(
        F.grouping_id().alias("gid"),
        total("amount").alias("revenue"), F.count(F.lit(1)).alias("rows"),
        F.count("transaction_id").alias("orders"), F.avg("days").alias("avg_days"),
        F.avg(F.when(F.col("fest"), F.col("days"))).alias("fest_days"),
        F.avg(F.when(~F.col("fest"), F.col("days"))).alias("norm_days"),
        F.count(F.when(F.col("returned"), 1)).alias("returns"),
        total(F.when(F.col("fest"), F.col("amount"))).alias("fest_revenue"),
    )
    last = len(DIMENSIONS) - 1
    full = (1 << len(DIMENSIONS)) - 1
    dim = F.lit("all")
    for i, name in enumerate(DIMENSIONS):
        dim = F.when(F.col("gid") == full - (1 << (last - i)), name).otherwise(dim)
    cube = cube.withColumn("dim", dim).withColumn("key", F.coalesce(*DIMENSIONS)).drop(*DIMENSIONS, "gid")
    return cube.where((F.col("dim") == "all") | F.col("key").isNotNull())


def _number(c: Column, digits: int = 0) -> Column:
    return F.format_number(c, digits)


def _rupees(c: Column) -> Column:
    return F.concat(F.lit("₹"), _number(c))


def _rule(number: int, table: DataFrame, value: Column, text: Column, when: Column | None = None) -> DataFrame:
    kept = table if when is None else table.where(when)
    return kept.select(F.lit(number).alias("rule"), text.alias("text"), value.cast("double").alias("value"))


def _best(cube: DataFrame, dim: str, n: int) -> DataFrame:
    """The ``n`` best keys of a dimension as one row: name list and first key's numbers."""
    top = cube.where(F.col("dim") == dim).orderBy(F.desc("revenue"), "key").limit(n)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("revenue")).alias("r"), "key", "revenue")))
    listed = F.array_join(F.transform(ranked, lambda s: F.concat(s["key"], F.lit(" ("), _rupees(s["revenue"]), F.lit(")"))), ", ")
    return top.agg(listed.alias("listed"), F.count(F.lit(1)).alias("n"), ranked[0].alias("first")).select(
        "listed", "n", F.col("first.key").alias("key"), F.col("first.revenue").alias("revenue"))


def executive_summary(df: DataFrame, city: str = "city") -> DataFrame:
    """The numbered insight sentences as rows ``(rule, text, value)``."""
    cube = stage(summary_cube(df, city), "summary")
    all_ = cube.where("dim = 'all'")
    months = cube.where("dim = 'month'").select(
        F.to_date("key", "yyyy-MM").alias("month"), F.col("revenue").alias("value"), "orders")
    grand = all_.select("revenue").scalar()
    join = F.concat

    growth = trailing_growth(months)
    g = F.col("growth_pct")
    direction = F.when(g >= 0, "grew").otherwise("declined")
    parts = [
        _rule(1, growth, g, join(F.lit("Year-over-year revenue "), direction, F.lit(" by "), _number(F.abs(g), 1),
                                 F.lit("% based on the latest window."))),
    ]
    for number, dim, label in ((2, "category", "categories"), (3, "city", "cities")):
        best = _best(cube, dim, 3)
        parts.append(_rule(number, best, F.col("revenue"),
                           join(F.lit(f"Top {label} by revenue: "), "listed", F.lit(".")), F.col("n") > 0))
        parts.append(_rule(number, best, F.lit(None),
                           F.lit(f"{dim.capitalize()} breakdown unavailable."), F.col("n") == 0))

    paid = _best(cube, "payment_method", 1).withColumn("share", clean.percent(F.col("revenue"), grand))
    parts.append(_rule(4, paid, F.col("share"), join(F.lit("Most revenue came via "), "key", F.lit(" (~"),
                       _number(F.col("share"), 1), F.lit("% share).")), F.col("n") > 0))
    parts.append(_rule(5, all_, F.col("avg_days"), join(F.lit("Average delivery time is "),
                       _number(F.col("avg_days"), 1), F.lit(" days.")), F.col("avg_days").isNotNull()))
    delta = all_.withColumn("delta", F.col("fest_days") - F.col("norm_days"))
    parts.append(_rule(6, delta, F.col("delta"), join(F.lit("Festival orders are "), _number(F.abs("delta"), 1),
                       F.lit(" days "), F.when(F.col("delta") > 0, "slower").otherwise("faster"), F.lit(" than normal.")),
                       F.abs("delta") >= 0.3))
    rate = all_.withColumn("rate", clean.percent(F.col("returns"), F.col("rows")))
    parts.append(_rule(7, rate, F.col("rate"), join(F.lit("Overall return rate is "), _number(F.col("rate"), 2), F.lit("%."))))
    floor = F.greatest(F.lit(100.0), all_.select("rows").scalar() * 0.01)
    worst = (
        cube.where("dim = 'category'").where(F.col("rows") >= floor)
        .withColumn("rate", F.col("returns") * 100.0 / F.col("rows")).orderBy(F.desc("rate"), "key").limit(1)
    )
    parts.append(_rule(8, worst, F.col("rate"), join(F.lit("Highest return rate is in "), "key", F.lit(" at "),
                       _number(F.col("rate"), 2), F.lit("%."))))
    peak = months.orderBy(F.desc("value"), "month").limit(1)
    parts.append(_rule(9, peak, F.col("value"), join(F.lit("Peak monthly revenue was "), _rupees(F.col("value")),
                       F.lit(" in "), F.date_format("month", "MMM yyyy"), F.lit("."))))
    share = all_.withColumn("share", clean.percent(F.col("fest_revenue"), F.col("revenue")))
    parts.append(_rule(10, share, F.col("share"), join(F.lit("Festival orders contribute "),
                       _number(F.col("share"), 1), F.lit("% of total revenue."))))
    fest = _best(cube, "festival", 1)
    parts.append(_rule(11, fest, F.col("revenue"), join(F.lit("Top festival by revenue: "), "key", F.lit(" ("),
                       _rupees(F.col("revenue")), F.lit(").")), F.col("n") > 0))
    aov = months.withColumn("aov", F.try_divide("value", "orders")).where("aov IS NOT NULL")
    aov = aov.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("month")))).where("_r <= 6")
    aov = aov.agg(F.count(F.lit(1)).alias("n"), (F.max_by("aov", "month") - F.min_by("aov", "month")).alias("change"))
    parts.append(_rule(12, aov, F.col("change"), join(F.lit("Avg order value has "),
                       F.when(F.col("change") > 0, "increased").otherwise("decreased"), F.lit(" by "),
                       _rupees(F.abs("change")), F.lit(" in the last 6 months.")),
                       (F.col("n") >= 6) & (F.abs("change") > 1)))
    return _union(parts)


def overview(df: DataFrame, city: str = "city") -> DataFrame:
    """Totals, and the best city and category, as five lines."""
    cube = stage(summary_cube(df, city), "overview")
    all_ = cube.where("dim = 'all'")
    aov = F.coalesce(F.try_divide("revenue", "rows"), F.lit(0.0))
    return _union([
        _rule(1, all_, F.col("revenue"), F.concat(F.lit("Total revenue: "), _rupees(F.col("revenue")))),
        _rule(2, all_, F.col("rows"), F.concat(F.lit("Total orders: "), _number(F.col("rows")))),
        _rule(3, all_, aov, F.concat(F.lit("Avg order value: "), _rupees(aov))),
        _rule(4, _best(cube, "city", 1), F.col("revenue"),
              F.concat(F.lit("Top city: "), F.coalesce("key", F.lit("Unknown")))),
        _rule(5, _best(cube, "category", 1), F.col("revenue"),
              F.concat(F.lit("Top category: "), F.coalesce("key", F.lit("Other")))),
    ])


def return_insights(flagged: DataFrame) -> DataFrame:
    """Peak loss month, worst category and the overall rates, from one grouping-sets pass."""
    rows = flagged.select(clean.month_start("order_date").cast("string").alias("month"), "category",
                          "return_loss", "returned", F.col(AMOUNT).alias("amount"))
    cube = stage(rows.groupingSets([[F.col("month")], [F.col("category")], []], "month", "category").agg(
        F.grouping_id().alias("gid"), total("return_loss").alias("loss"), total("amount").alias("revenue"),
        F.count(F.when(F.col("returned"), 1)).alias("returns"), F.count(F.lit(1)).alias("rows")), "returns")
    peak = cube.where("gid = 1 AND month IS NOT NULL").orderBy(F.desc("loss"), "month").limit(1)
    worst = cube.where("gid = 2 AND category IS NOT NULL").orderBy(F.desc("loss"), "category").limit(1)
    rates = cube.where("gid = 3").withColumns({
        "rate": clean.percent(F.col("returns"), F.col("rows")), "lost": clean.percent(F.col("loss"), F.col("revenue"))})
    return _union([
        _rule(1, peak, F.col("loss"), F.concat(F.lit("Highest monthly return loss was "), _rupees(F.col("loss")),
              F.lit(" in "), F.date_format(F.to_date("month"), "MMM yyyy"), F.lit(".")), F.col("loss") > 0),
        _rule(2, worst, F.col("loss"), F.concat("category", F.lit(" contributes the most to return loss ("),
              _rupees(F.col("loss")), F.lit(")."))),
        _rule(3, rates, F.col("rate"), F.concat(F.lit("Overall return rate is "), _number(F.col("rate"), 2),
              F.lit("%, causing "), _number(F.col("lost"), 2), F.lit("% revenue loss."))),
    ])


def churn_insights(df: DataFrame, months: int = 6) -> DataFrame:
    """Snapshot and threshold, churn rate, riskiest bucket and riskiest last category."""
    scores = stage(customers.churn_scores(df, months), "churn")
    heat = customers.risk_heatmap(scores).where("customers > 0")
    riskiest = heat.orderBy(F.desc("avg_risk"), "r_bucket", "f_bucket").limit(1)
    by_last = customers.churn_by_last_category(df, scores).limit(1)
    days = customers.churn_days(months)
    dated = df.agg(F.max("order_date").alias("m"))
    k = customers.churn_kpis(scores)
    return _union([
        _rule(1, dated, F.lit(days), F.concat(F.lit("Snapshot date: "), F.date_format("m", "dd MMM yyyy"),
              F.lit(f"; churn threshold: {months} months (~{days} days)."))),
        _rule(2, k, F.col("churn_rate"), F.concat(F.lit("Churn rate is "), _number(F.col("churn_rate"), 2), F.lit("% ("),
              _number(F.col("churned_customers")), F.lit(" of "), _number(F.col("total_customers")), F.lit(")."))),
        _rule(3, riskiest, F.col("avg_risk"), F.concat(F.lit("Highest-risk segment: R="), "r_bucket", F.lit(" × F="),
              "f_bucket", F.lit(" with avg risk "), _number(F.col("avg_risk"), 1), F.lit(" across "),
              _number(F.col("customers")), F.lit(" customers."))),
        _rule(4, by_last, F.col("churn_share"), F.concat(F.lit("Highest churn share observed among last-purchased "),
              "last_category", F.lit(" customers."))),
    ])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
