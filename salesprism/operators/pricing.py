"""Price bands, elasticity and revenue curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism.operators import sampling
from salesprism.operators.aggregates import AMOUNT, drop_null_keys, total
from salesprism.operators.filters import sellable
from salesprism.operators.ranking import equal_width_bin
from salesprism.sources.schema import as_number, price_column

MIN_PRICES = 5


def priced(df: DataFrame) -> DataFrame:
    """Add numeric ``price``, ``quantity`` and ``revenue`` and keep sellable rows."""
    quantity = F.coalesce(as_number(df, "quantity"), F.lit(0.0))
    revenue = as_number(df, AMOUNT) if AMOUNT in df.columns else F.coalesce(price_column(df), F.lit(0.0)) * quantity
    numeric = df.select(
        *[c for c in df.columns if c not in ("price", "quantity", "revenue")],
        price_column(df).alias("price"), quantity.alias("quantity"), F.coalesce(revenue, F.lit(0.0)).alias("revenue"))
    return sellable(numeric)


def eligible_products(rows: DataFrame, product: str = "product_name") -> DataFrame:
    """Products with at least five distinct prices and some quantity sold."""
    return (
        drop_null_keys(rows, [product]).groupBy(product)
        .agg(F.count_distinct("price").alias("prices"), F.sum("quantity").alias("sold"))
        .where((F.col("prices") >= MIN_PRICES) & (F.col("sold") > 0))
    )


def price_kpis(rows: DataFrame, product: str = "product_name") -> DataFrame:
    eligible = eligible_products(rows, product).agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.agg(
        F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
    ).withColumn("eligible_products", eligible)


def with_bands(rows: DataFrame, bins: int = 20) -> DataFrame:
    return equal_width_bin(rows, "price", bins, "price_bin")


def product_bands(banded: DataFrame, product: str = "product_name") -> DataFrame:
    """Mean price, quantity and revenue per product and price band."""
    return drop_null_keys(banded, [product, "price_bin"]).groupBy(product, "price_bin").agg(
        F.avg("price").alias("avg_price"), F.sum("quantity").alias("total_qty"), total("revenue").alias("revenue"))


def _varied(bands: DataFrame, product: str) -> DataFrame:
    """Per-product facts over its bands; a product has at most one row per band."""
    usable = (F.col("avg_price") > 0) & (F.col("total_qty") > 0)
    return bands.groupBy(product).agg(
        F.count_distinct("avg_price").alias("prices"),
        F.sum("total_qty").alias("sold"),
        F.count_distinct(F.when(usable, F.col("avg_price"))).alias("usable_prices"),
        F.regr_slope(F.when(usable, F.ln("total_qty")), F.when(usable, F.ln("avg_price"))).alias("slope"),
    ).where((F.col("prices") >= MIN_PRICES) & (F.col("sold") > 0))


def elasticity(bands: DataFrame, product: str = "product_name") -> DataFrame:
    """Log-log slope of quantity on price over a product's bands, with its label."""
    e = F.bround("slope", 3)
    label = (
        F.when(F.col("elasticity") <= -1.0, "Elastic (|E| ≥ 1)")
        .when(F.col("elasticity") < 0, "Inelastic (0 > E > -1)")
        .otherwise("Positive/Zero (Atypical)")
    )
    return (
        _varied(bands, product).where((F.col("usable_prices") >= MIN_PRICES) & F.col("slope").isNotNull())
        .select(product, e.alias("elasticity")).withColumn("label", label)
    )


def elasticity_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("label").agg(F.count(F.lit(1)).alias("products")).orderBy("label")


def elasticity_ends(table: DataFrame, k: int = 10, product: str = "product_name") -> DataFrame:
    """The ``k`` most and ``k`` least elastic products."""
    most = table.orderBy("elasticity", product).limit(k).withColumn("side", F.lit("most elastic"))
    least = table.orderBy(F.desc("elasticity"), product).limit(k).withColumn("side", F.lit("least elastic"))
    return most.unionByName(least)


def revenue_curve(banded: DataFrame) -> DataFrame:
    return drop_null_keys(banded, ["price_bin"]).groupBy("price_bin").agg(
        F.avg("price").alias("avg_price"), total("revenue").alias("revenue")).orderBy("avg_price")


def best_band(curve: DataFrame) -> DataFrame:
    return curve.orderBy(F.desc("revenue"), "avg_price").limit(1)


def best_band_per_product(bands: DataFrame, product: str = "product_name") -> DataFrame:
    """The band with the most revenue, for every product with enough price variation."""
    best = F.max_by(F.struct("price_bin", "avg_price", "revenue"), F.struct("revenue", -F.col("avg_price")))
    varied = _varied(bands, product).select(product)
    return (
        bands.join(varied, product, "left_semi").groupBy(product).agg(best.alias("b"))
        .select(product, "b.price_bin", "b.avg_price", "b.revenue")
    )


POINT_KEY = ("transaction_id", "product_id", "customer_id", "delivery_days")


def price_points(rows: DataFrame, size: int = 50_000, seed: int = 42) -> DataFrame:
    """Price and quantity of at most ``size`` rows for a scatter plot, each product with about equally many.

    The rows with the least keyed hashes of each product are taken, so the
    same rows come from any layout.
    """
    products = rows.agg(F.count_distinct("product_name").alias("n")).first()["n"]
    share = max(1, size // max(1, products))
    picked = sampling.bottom_k(rows, "product_name", POINT_KEY, share, seed, ties=("price", "quantity"))
    return picked.orderBy("_hash", "price", "quantity").limit(size).select("product_name", "price", "quantity", "revenue")
