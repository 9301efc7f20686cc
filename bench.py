"""Headline queries on ``$BENCH_SF_DIR``; prints one JSON line.

The transactions table is built once ("ingest"), as a report session does;
each query is then timed warm: the median of three runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from salesprism.plans.catalog import all_queries
from salesprism.session import build_session
from salesprism.sources.tables import stored_transactions

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "kpis", "category_performance", "city_revenue", "payment_share", "sales_by_year", "monthly_revenue",
    "top_products", "top_customers", "top_brands", "prime_summary", "customer_kpis", "month_year_pivot",
    "filter_panel", "delivery_box", "return_kpis", "return_loss_month", "profit_monthly", "discount_slab",
    "festival_monthly", "customer_summary", "iqr_outliers", "order_rank", "new_vs_returning", "dup_flag",
    "clean_payment", "clean_category", "clean_pipeline", "rfm_v1", "rfm_v2", "churn_scores", "risk_heatmap",
    "price_elasticity", "product_best_band", "demand_ma3", "yoy_growth", "trend_season_forecast",
    "brand_forecast", "seasonal_ar_forecast", "basket_pairs", "freq_itemsets", "assoc_rules", "insights",
)


def run(query, spark) -> float:
    """Seconds to compute every row of a query; the rows go nowhere."""
    start = time.perf_counter()
    query(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(CORES, shuffle_partitions=int(CORES), app="bench")
    queries, seconds = all_queries(), {}
    spark.range(1).count()
    start = time.perf_counter()
    stored_transactions(spark, FOLDER)
    seconds["ingest"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        run(queries[name], spark)
        seconds[name] = round(statistics.median(run(queries[name], spark) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")), "cpus": int(CORES),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
