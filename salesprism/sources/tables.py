"""The transactions table built from a star schema of order tables.

``transactions`` is the lazy join. ``stored_transactions`` writes that join
once per session into the shared folder and hands out the stored table, so a
session that asks many questions pays for the joins once and every later
query is a scan of the few columns it needs. What follows from a row's other
columns (amounts, festivals, flags) is not stored but worked out by the scan,
so the joins, the sort and the files carry the plain columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.session import new_path, shuffles_dropped
from salesprism.sources.sinks import write_transactions

STAR_TABLES = ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")

_STORED: dict[tuple, DataFrame] = {}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _festival(month):
    return (
        F.when(month == 10, "Diwali").when(month == 3, "Holi")
        .when(month == 12, "Christmas").when(month == 1, "New Year")
    )


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    """The order lines with the plain columns that all others are made of.

    Lines meet couriers and orders while they are narrow; products, with the
    longest texts, come last, so no shuffle carries their names once a line.
    Places are a handful of rows and are looked up at the end.
    """
    line, order, cust, nation, region, part, supp = (load(spark, folder, t) for t in STAR_TABLES)
    line = line.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus")
    placed = order.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(
        cust.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    ).drop("c_custkey")
    product = part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return (
        line.join(supp.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
        .join(product, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
        .join(place, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey", "n_nationkey")
        .withColumn("order_year", F.year("o_orderdate"))
        .withColumnRenamed("p_type", "category")
    )


def following(
    subtotal: str = "subtotal_inr", quantity: str = "quantity", state: str = "customer_state",
    customer: str = "customer_id", date: str = "order_date",
) -> dict[str, Column]:
    """Columns of the transactions that follow from other columns of theirs, so that none need be moved or stored."""
    month = F.month(date)
    return {
        "original_price_inr": F.col(subtotal) / F.col(quantity),
        "customer_city": F.concat(state, F.lit("-C"), (F.col(customer) % 5).cast("string")),
        "order_month": month,
        "festival_name": _festival(month),
        "is_festival_sale": month.isin(1, 3, 10, 12),
    }


def _described(joined: DataFrame) -> DataFrame:
    """The transactions' columns from the joined lines, row by row."""
    follows = {name: c.alias(name) for name, c in following(
        "l_extendedprice", "l_quantity", "n_name", "o_custkey", "o_orderdate").items()}
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return joined.select(
        F.col("l_orderkey").alias("transaction_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        "category",
        F.col("p_size").alias("stock"),
        F.col("l_quantity").alias("quantity"),
        follows["original_price_inr"],
        (unit * (1 - F.col("l_discount"))).alias("discounted_price_inr"),
        (F.col("l_discount") * 100).alias("discount_percent"),
        F.col("l_extendedprice").alias("subtotal_inr"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("final_amount_inr"),
        F.col("s_name").alias("delivery_partner"),
        ((F.col("l_linenumber") + F.col("l_suppkey")) % 11).alias("delivery_days"),
        F.when(F.col("l_returnflag") == "R", "Returned").otherwise("Delivered").alias("return_status"),
        F.col("l_linestatus").alias("return_reason"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("c_mktsegment").alias("customer_tier"),
        F.floor(F.col("c_acctbal") / 2500).cast("int").alias("customer_age_group"),
        (F.col("c_acctbal") >= 5000).alias("is_prime_member"),
        F.col("n_name").alias("customer_state"),
        follows["customer_city"],
        F.col("r_name").alias("zone"),
        "order_year",
        follows["order_month"],
        follows["festival_name"],
        follows["is_festival_sale"],
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line, with its order, buyer, place, product and courier."""
    return _described(_joined(spark, folder))


def _version(spark: SparkSession, folder: str) -> tuple:
    """Size and change time of each input table, so a rewritten input is noticed."""
    sc = spark.sparkContext
    seen = []
    for name in STAR_TABLES:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        summary = fs.getContentSummary(path)
        seen.append((summary.getLength(), summary.getFileCount(), fs.getFileStatus(path).getModificationTime()))
    return tuple(seen)


def stored_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """``transactions`` written once for this session and these input files."""
    key = (spark.sparkContext.applicationId, folder, _version(spark, folder))
    if key not in _STORED:
        joined = _joined(spark, folder)
        with shuffles_dropped(spark):
            path = write_transactions(joined, new_path(spark, "transactions"))
        _STORED[key] = _described(spark.read.schema(joined.schema).parquet(path))
    return _STORED[key]
