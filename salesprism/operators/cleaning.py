"""Whole-table cleaning, duplicate flags and the quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.functions import cleaners as clean
from salesprism.session import new_path, stage
from salesprism.sources.readers import BAD_RECORD
from salesprism.sources.schema import city_column, find_column

PRICE_COLUMNS = ("original_price_inr", "discounted_price_inr", "final_amount_inr", "subtotal_inr")
DUPLICATE_KEYS = ("customer_id", "product_id", "order_date", "final_amount_inr")


def parse_dates(df: DataFrame, column: str = "order_date", keep_bad: bool = True) -> DataFrame:
    """``column`` as a timestamp; rows without a date go unless ``keep_bad``.

    Rows without a date are dropped by exploding the list of dates found,
    which has none or one: a filter on the parsed column would be pushed below
    the projection and parse every date a second time.
    """
    date = clean.parse_date(column)
    found = date if keep_bad else F.explode(F.array_compact(F.array(date)))
    return df.withColumn("_date", found).withColumn(column, F.col("_date")).drop("_date")


def drop_bad_dates(df: DataFrame, column: str = "order_date") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def flag_duplicates(
    df: DataFrame, keys: Sequence[str] = DUPLICATE_KEYS, count: str = "transaction_id"
) -> DataFrame:
    """Mark rows whose key occurs more than once; a null in the key never counts.

    Copies are counted with a map-side combined aggregate, and only the
    repeated keys travel back. A window over the key would put all copies of
    a hot key in one task; the join lets adaptive execution split them.
    """
    repeated = (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count(count).alias("_copies"))
        .where("_copies > 1")
    )
    return (
        df.join(repeated, list(keys), "left")
        .withColumn("is_possible_duplicate", F.col("_copies").isNotNull())
        .drop("_copies")
    )


def clean_rows(raw: DataFrame) -> DataFrame:
    """All row-wise cleaning of a raw text table, without any shuffle."""
    df = parse_dates(raw.withColumn("city", city_column(raw)), keep_bad=False)
    df = df.withColumns({c: clean.clean_price(c) for c in PRICE_COLUMNS if c in df.columns})
    fallbacks = ("final_amount_inr", "discounted_price_inr", "subtotal_inr", "original_price_inr")
    amount = clean.final_amount(*[c for c in fallbacks if c in df.columns])
    prime = find_column(df, ("is_prime_member", "is_prime", "is_prime_eligible"))
    sources = [c for c in ("category", "subcategory", "product_name") if c in df.columns]
    cleaned = {
        "final_amount_inr": amount,
        "is_prime": clean.clean_bool(prime) if prime else F.lit(False),
        "payment_method": clean.clean_payment("payment_method") if "payment_method" in df.columns
        else F.lit("Other"),
        "category": clean.clean_category(*sources) if sources else F.lit("Other"),
        "city": clean.clean_city("city"),
        **{k: v for k, v in clean.date_parts("order_date").items() if k != "month_name"},
    }
    if "customer_rating" in df.columns:
        cleaned["customer_rating"] = clean.clean_rating("customer_rating")
    if "delivery_days" in df.columns:
        cleaned["delivery_days"] = clean.clean_delivery_days("delivery_days")
    return df.withColumns(cleaned).withColumn("order_value_segment", clean.value_segment("final_amount_inr"))


REASONS = ("broken_record", "unparsed_date", "unparsed_price", "unparsed_rating")
DROPPED_FOR = REASONS[:2]


def reject_reasons(raw: DataFrame, amount: str = "final_amount_inr") -> DataFrame:
    """``raw`` with ``reasons``: what is wrong with a row, in the order of ``REASONS``; empty if nothing is.

    A broken record is one whose reader kept its text; nothing else is said
    of it. A date that is missing or fits no layout is unparsed. A price or
    rating is, if there is a text but no number in it.
    """
    dated = parse_dates(raw.withColumn("_raw_date", F.col("order_date")), "_raw_date")

    def unread(column: str, value: Column) -> Column:
        there = clean.strip(column) != ""
        return F.coalesce(there & value.isNull(), F.lit(False)) if column in raw.columns else F.lit(False)

    broken = F.col(BAD_RECORD).isNotNull() if BAD_RECORD in raw.columns else F.lit(False)
    found = (
        ~broken & F.col("_raw_date").isNull(), ~broken & unread(amount, clean.clean_price(amount)),
        ~broken & unread("customer_rating", clean.clean_rating("customer_rating")))
    named = F.array(F.when(broken, REASONS[0]), *[F.when(f, r) for f, r in zip(found, REASONS[1:], strict=True)])
    return dated.withColumn("reasons", F.array_compact(named)).drop("_raw_date")


def split_rejects(raw: DataFrame, drop_for: Sequence[str] = DROPPED_FOR) -> tuple[DataFrame, DataFrame]:
    """(rows to clean, rejected rows), both with ``reasons``, from one pass over ``raw``.

    A row is rejected if any of its reasons is in ``drop_for``. Both parts
    are written in that pass, each into a folder of its own, as they came.
    """
    drop = F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in drop_for])) if drop_for else F.lit(False)
    marked = reject_reasons(raw).withColumn("rejected", F.coalesce(drop, F.lit(False)))
    path = new_path(raw.sparkSession, "rejects")
    marked.write.partitionBy("rejected").option("compression", "zstd").parquet(path)
    both = raw.sparkSession.read.schema(marked.schema).parquet(path)
    return both.where(~F.col("rejected")).drop("rejected"), both.where("rejected").drop("rejected")


def reject_counts(kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows with each reason, among kept and among rejected rows, and all rows."""
    both = kept.select("reasons", F.lit(0).alias("gone")).unionByName(rejected.select("reasons", F.lit(1).alias("gone")))
    named = both.select("gone", F.explode(F.concat("reasons", F.array(F.lit("all")))).alias("reason"))
    return named.groupBy("reason").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("gone").alias("rejected"), F.sum(1 - F.col("gone")).alias("kept"))


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Row cleaning plus the duplicate flag (its only shuffle).

    The flag reads the rows twice; they are cleaned once and stored, as
    cleaning costs far more than writing and reading them.
    """
    df = stage(clean_rows(raw), "clean-rows")
    if all(c in df.columns for c in (*DUPLICATE_KEYS, "transaction_id")):
        return flag_duplicates(df)
    return df.withColumn("is_possible_duplicate", F.lit(False))


def quality_report(
    before: DataFrame, after: DataFrame, columns: Sequence[str] = ("category", "city", "payment_method"), n: int = 5
) -> DataFrame:
    """Rows before, after and dropped, and the ``n`` most frequent cleaned values of each column.

    One grouping-sets pass over the cleaned rows counts all columns and the
    rows; nulls are counted too. The per-column top ``n`` is taken on each
    partition before the shuffle.
    """
    counted = after.groupingSets([[F.col(c)] for c in columns] + [[]], *columns).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("rows"))
    last = len(columns) - 1
    dim = F.lit("all")
    for i, c in enumerate(columns):
        dim = F.when(F.col("gid") == (1 << len(columns)) - 1 - (1 << (last - i)), c).otherwise(dim)
    value = F.coalesce(*[F.col(c).cast("string") for c in columns])
    best = Window.partitionBy("dim").orderBy(F.desc("rows"), F.asc_nulls_last("value"))
    top = (
        counted.select(dim.alias("dim"), value.alias("value"), "rows")
        .withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)
    )
    top = stage(top, "quality")

    label = F.concat(F.coalesce("value", F.lit("nan")), F.lit("("), F.col("rows"), F.lit(")"))
    placed = F.array_sort(F.collect_list(F.struct("place", label.alias("label"))))
    values = top.where("dim <> 'all'").groupBy("dim").agg(
        F.array_join(F.transform(placed, lambda p: p["label"]), "; ").alias("value")
    ).select(F.concat(F.lit("top_"), "dim", F.lit("_after")).alias("metric"), "value")

    rows = before.agg(F.count(F.lit(1)).alias("rows_before")).withColumn(
        "rows_after", top.where("dim = 'all'").select("rows").scalar())
    rows = rows.withColumn("rows_dropped_due_to_invalid_dates", F.col("rows_before") - F.col("rows_after"))
    counts = rows.select(*[F.col(c).cast("string") for c in rows.columns]).unpivot(
        [], list(rows.columns), "metric", "value")
    return counts.unionByName(values)
