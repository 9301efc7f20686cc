"""Customer value, segments and churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.functions import cleaners as clean
from salesprism.functions import fixed_values as fixed
from salesprism.operators.aggregates import AMOUNT, drop_null_keys, top_k, total
from salesprism.operators.ranking import (
    equal_width_bin, exact_quantiles, extent, last_per, minmax, rank_score, value_quintile,
)
from salesprism.session import stage


def snapshot(df: DataFrame) -> Column:
    """The latest order time in the data, as a scalar."""
    return df.agg(F.max("order_date").alias("m")).scalar()


def customer_profile(df: DataFrame, frequency: Column | None = None) -> DataFrame:
    """Last order, order count, revenue and days since the last order per customer."""
    return (
        drop_null_keys(df, ["customer_id"]).groupBy("customer_id").agg(
            F.max("order_date").alias("last_order_date"),
            (F.count("transaction_id") if frequency is None else frequency).alias("frequency"),
            total(AMOUNT).alias("monetary"),
        )
    )


def customer_summary(df: DataFrame) -> DataFrame:
    recency = clean.days_between(snapshot(df), F.col("last_order_date"))
    return customer_profile(df).withColumn("recency_days", recency).withColumnsRenamed(
        {"frequency": "orders", "monetary": "lifetime_value"})


def describe(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """count, mean, min, quartiles, max and sample deviation, one row per column."""
    df, parts = stage(df.select(*columns), "describe"), []
    for c in columns:
        q = exact_quantiles(df, c, [0.25, 0.5, 0.75]).select("q").scalar()
        parts.append(
            df.agg(
                F.count(c).alias("count"), F.avg(c).alias("mean"), F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"), F.stddev_samp(c).alias("std"))
            .withColumn("q", q)
            .withColumns({"metric": F.lit(c), **{f"q{p}": F.col("q")[i] for i, p in enumerate((25, 50, 75))}})
            .select("metric", "count", "mean", "min", "q25", "q50", "q75", "max", "std")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def segment(r: Column, f: Column) -> Column:
    return (
        F.when((r >= 4) & (f >= 4), "Champion")
        .when((r >= 4) & (f <= 2), "New Customer")
        .when((r <= 2) & (f >= 4), "At Risk")
        .when((r <= 2) & (f <= 2), "Lost")
        .otherwise("Loyal")
    )


def rfm_by_value(df: DataFrame) -> DataFrame:
    """RFM digits: recency and spend by value quintile, frequency by rank quintile, plus the segment."""
    day_after = snapshot(df) + F.expr("INTERVAL 1 DAY")
    base = customer_profile(df).withColumn("recency", clean.days_between(day_after, F.col("last_order_date")))
    base = base.select("customer_id", "recency", "frequency", "monetary")
    scored = rank_score(base, "frequency", "customer_id", "f_score")
    scored = value_quintile(scored, "recency", "r_score", reverse=True)
    scored = value_quintile(scored, "monetary", "m_score")
    return scored.withColumns({
        "rfm_score": F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")]),
        "segment": segment(F.col("r_score"), F.col("f_score")),
    })


def segment_counts(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("segment").agg(F.count(F.lit(1)).alias("customers")).orderBy(F.desc("customers"), "segment")


def rfm_by_rank(df: DataFrame) -> DataFrame:
    """RFM scores 1 to 5 by rank quintile, and their sum (3 to 15)."""
    base = customer_profile(df, F.count_distinct("transaction_id"))
    recency = clean.days_between(snapshot(df), F.col("last_order_date"))
    base = base.withColumn("recency", F.coalesce(recency, F.lit(0))).select(
        "customer_id", "recency", "frequency", "monetary")
    scored = rank_score(base, "recency", "customer_id", "r_score", reverse=True)
    scored = rank_score(scored, "frequency", "customer_id", "f_score")
    scored = rank_score(scored, "monetary", "customer_id", "m_score")
    return scored.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))


def rfm_kpis(rfm: DataFrame) -> DataFrame:
    return rfm.agg(F.count(F.lit(1)).alias("total_customers"), F.avg("monetary").alias("avg_monetary"),
                   F.max("rfm_score").alias("best_score"))


def churn_days(months: int) -> int:
    return int(months * fixed.DAYS_PER_MONTH)


def churn_scores(df: DataFrame, months: int = 6, today: Column | None = None) -> DataFrame:
    """Churn flag and a 0 to 100 risk from scaled recency, frequency and spend."""
    dated = df.where(F.col("order_date").isNotNull())
    base = customer_profile(dated, F.count_distinct("transaction_id"))
    as_of = snapshot(dated) if today is None else today
    base = base.withColumnRenamed("last_order_date", "last_purchase").withColumn(
        "recency_days", clean.days_between(as_of, F.col("last_purchase")))
    base = base.withColumn("_e", extent(base, "recency_days", "frequency", "monetary"))

    def scaled(c: str) -> Column:
        return minmax(F.col(c).cast("double"), F.col("_e")[f"{c}_min"].cast("double"), F.col("_e")[f"{c}_max"].cast("double"))

    w = fixed.RISK_WEIGHTS
    risk = (w["recency"] * scaled("recency_days") + w["frequency"] * (1 - scaled("frequency"))
            + w["monetary"] * (1 - scaled("monetary")))
    churned = F.col("recency_days") >= churn_days(months)
    return base.withColumns({
        "is_churned": churned.cast("int"),
        "churn_risk_score": F.bround(risk * 100, 1),
        "status": clean.flag_label(churned, "Churned", "Active"),
    }).drop("_e")


CHURN_COLUMNS = ("customer_id", "status", "recency_days", "frequency", "monetary",
                 "churn_risk_score", "last_purchase")


def churn_kpis(scores: DataFrame) -> DataFrame:
    churned = F.coalesce(F.sum("is_churned"), F.lit(0))
    rows = F.count(F.lit(1))
    return scores.agg(
        rows.alias("total_customers"), (rows - churned).alias("active_customers"),
        churned.alias("churned_customers"), clean.percent(churned, rows).alias("churn_rate"))


def churn_status(scores: DataFrame) -> DataFrame:
    return scores.groupBy("status").agg(F.count(F.lit(1)).alias("customers")).orderBy(F.desc("customers"))


def top_churn_risk(scores: DataFrame, k: int = 50) -> DataFrame:
    return scores.orderBy(F.desc("is_churned"), F.desc("churn_risk_score"), F.desc("recency_days"),
                          "customer_id").select(*CHURN_COLUMNS).limit(k)


def churned_customers(scores: DataFrame) -> DataFrame:
    """The export list: every churned customer, riskiest first."""
    return scores.where("is_churned = 1").select(*CHURN_COLUMNS).orderBy(
        F.desc("churn_risk_score"), F.desc("recency_days"), "customer_id")


# Names of the five recency and frequency buckets.
RECENCY_BUCKETS = ("Best", "Good", "Mid", "Low", "Worst")
FREQUENCY_BUCKETS = ("Worst", "Low", "Mid", "Good", "Best")


def risk_heatmap(scores: DataFrame) -> DataFrame:
    """Mean risk and customers on the full 5 x 5 grid of recency and frequency buckets."""
    slim = scores.select("customer_id", "recency_days", "frequency", "churn_risk_score")
    ranked = rank_score(slim, "recency_days", "customer_id", "r_bin")
    ranked = rank_score(ranked, "frequency", "customer_id", "f_bin")
    cells = ranked.groupBy("r_bin", "f_bin").agg(
        F.avg("churn_risk_score").alias("avg_risk"), F.count("customer_id").alias("customers"))
    grid = (
        scores.sparkSession.range(1)
        .select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("r_bin"))
        .select("r_bin", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("f_bin"))
    )
    names_r = F.array(*[F.lit(n) for n in RECENCY_BUCKETS])
    names_f = F.array(*[F.lit(n) for n in FREQUENCY_BUCKETS])
    return (
        grid.join(cells, ["r_bin", "f_bin"], "left")
        .select(F.element_at(names_r, F.col("r_bin")).alias("r_bucket"),
                F.element_at(names_f, F.col("f_bin")).alias("f_bucket"),
                "avg_risk", F.coalesce("customers", F.lit(0)).alias("customers"))
    )


def recency_histogram(scores: DataFrame, bins: int = 40) -> DataFrame:
    """Customers per equal-width recency bin with the bin's bounds."""
    scores = stage(scores.select("recency_days"), "recency")
    low, high = F.col("_e.recency_days_min").cast("double"), F.col("_e.recency_days_max").cast("double")
    width = (high - low) / bins
    e = extent(scores, "recency_days")
    return (
        equal_width_bin(scores, "recency_days", bins, "bin", e)
        .groupBy("bin").agg(F.count(F.lit(1)).alias("customers")).withColumn("_e", e)
        .select("bin", "customers", (low + (F.col("bin") - 1) * width).alias("low"), (low + F.col("bin") * width).alias("high"))
        .orderBy("bin")
    )


def last_category(df: DataFrame) -> DataFrame:
    """The category of each customer's last order line."""
    dated = drop_null_keys(df.where(F.col("order_date").isNotNull()), ["customer_id"])
    return last_per(dated, ["customer_id"],
                    ["order_date", "transaction_id", "product_id", "category"], "category", "last_category")


def churn_by_last_category(df: DataFrame, scores: DataFrame) -> DataFrame:
    joined = scores.join(last_category(df), "customer_id", "left")
    return top_k(joined, ["last_category"], None, F.avg("is_churned"), "churn_share",
                 customers=F.count(F.lit(1)))
