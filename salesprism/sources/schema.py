"""Column names and types: probing, renaming, guarding and defaulting.

Everything here looks only at ``df.columns``; no function starts a job.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesprism.functions.cleaners import to_number

# The input column names accepted for each canonical name, first match wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "transaction_id": ("transaction_id",),
    "customer_id": ("customer_id",),
    "product_id": ("product_id", "asin", "product_code", "sku"),
    "product_name": ("product_name", "product", "title", "item_name", "item", "product_title"),
    "brand": ("brand", "brand_name", "manufacturer"),
    "order_date": ("order_date", "date", "order_timestamp"),
    "quantity": ("quantity", "qty", "units", "order_quantity"),
    "city": ("city", "customer_city"),
    "customer_state": ("customer_state", "state", "ship_state"),
    "is_prime_member": ("is_prime_member", "is_prime", "is_prime_eligible"),
    "return_status": ("return_status", "is_returned", "refund_status"),
    "return_reason": ("return_reason", "refund_reason", "return_category"),
    "delivery_partner": ("courier", "delivery_partner", "shipping_provider", "logistics_name"),
    "final_amount_inr": ("final_amount_inr", "order_amount", "subtotal_inr", "revenue", "amount"),
}

# Which column counts as revenue, by report, first match wins.
REVENUE_CANDIDATES: dict[str, tuple[str, ...]] = {
    "trends": ("selling_price", "discounted_price_inr", "final_amount_inr", "subtotal_inr"),
    "products": ("revenue", "final_amount_inr", "order_amount", "subtotal_inr"),
    "regions": ("revenue", "final_amount_inr", "subtotal_inr"),
    "returns": ("final_amount_inr", "order_amount", "subtotal_inr"),
    "export": ("final_amount_inr", "order_amount", "subtotal_inr", "revenue"),
}

# The raw file's columns, all read as text.
RAW_COLUMNS: tuple[str, ...] = (
    "transaction_id", "customer_id", "product_id", "product_name", "category", "subcategory",
    "brand", "order_date", "original_price_inr", "discounted_price_inr", "subtotal_inr",
    "final_amount_inr", "quantity", "city", "customer_state", "customer_tier",
    "customer_age_group", "payment_method", "is_prime_member", "delivery_days", "delivery_type",
    "customer_rating", "return_status", "return_reason", "is_festival_sale", "festival_name",
    "event_name", "discount_percent", "courier",
)
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])


def normalize_columns(df: DataFrame, underscore: bool = True) -> DataFrame:
    """Lower-case and trim every column name; spaces become ``_`` by default."""

    def tidy(name: str) -> str:
        name = name.strip().lower()
        return re.sub(r" ", "_", name) if underscore else name

    return df.toDF(*[tidy(name) for name in df.columns])


def find_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """The first candidate that is a column of ``df``."""
    return next((name for name in candidates if name in df.columns), None)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def resolve_schema(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    required: Sequence[str] = (),
) -> DataFrame:
    """Give each aliased column its canonical name; other columns pass through."""
    taken: dict[str, str] = {}
    for canonical, candidates in aliases.items():
        found = find_column(df, (canonical, *candidates))
        if found is not None and found not in taken and (found == canonical or canonical not in df.columns):
            taken[found] = canonical
    renamed = df.withColumnsRenamed({old: new for old, new in taken.items() if old != new})
    return require_columns(renamed, required)


def default_columns(df: DataFrame, defaults: Mapping[str, tuple[object, str]]) -> DataFrame:
    """Add each missing column as a typed literal ``{name: (value, type)}``."""
    absent = {
        name: F.lit(value).cast(dtype)
        for name, (value, dtype) in defaults.items()
        if name not in df.columns
    }
    return df.withColumns(absent) if absent else df


# What a missing column of the summary report defaults to.
SUMMARY_DEFAULTS: dict[str, tuple[object, str]] = {
    "order_date": (None, "timestamp"),
    "final_amount_inr": (None, "double"),
    "category": ("Unknown", "string"),
    "city": ("Unknown", "string"),
    "payment_method": ("Unknown", "string"),
    "is_festival_sale": (False, "boolean"),
    "delivery_days": (None, "double"),
    "return_status": ("Unknown", "string"),
    "order_year": (None, "int"),
    "order_month": (None, "int"),
}


def city_column(df: DataFrame) -> Column:
    """``city`` or ``customer_city`` in any letter case, else ``Unknown``."""
    found = next((c for c in df.columns if c.lower() in ("city", "customer_city")), None)
    return F.col(found) if found else F.lit("Unknown")


def revenue_column(df: DataFrame) -> Column:
    """``revenue``, else price times quantity, else the order amount columns."""
    if "revenue" in df.columns:
        return F.col("revenue")
    if "selling_price" in df.columns and "quantity" in df.columns:
        return F.col("selling_price") * F.col("quantity")
    found = find_column(df, ("final_amount_inr", "order_amount"))
    if found is None:
        raise ValueError("no revenue column: need revenue, selling_price and quantity, "
                         "final_amount_inr or order_amount")
    return F.col(found)


def report_revenue(df: DataFrame, report: str) -> Column:
    """The revenue column a named report uses."""
    found = find_column(df, REVENUE_CANDIDATES[report])
    if found is not None:
        return F.col(found)
    if report == "products":
        price = find_column(df, ("selling_price", "discounted_price_inr", "original_price_inr"))
        if price and "quantity" in df.columns:
            return F.col(price) * F.col("quantity")
    if report in ("products", "regions"):
        return F.lit(0.0)
    raise ValueError(f"no revenue column for {report}: expected one of {REVENUE_CANDIDATES[report]}")


def as_number(df: DataFrame, name: str) -> Column:
    """A column as a double; text that is not a number becomes null."""
    return to_number(name) if dict(df.dtypes)[name] == "string" else F.col(name).cast("double")


def price_column(df: DataFrame) -> Column:
    """A numeric unit price: listed if there is one, else amount over quantity (null at 0)."""
    require_columns(df, ["quantity"])
    listed = find_column(df, ("selling_price", "discounted_price_inr"))
    if listed:
        return as_number(df, listed)
    require_columns(df, ["final_amount_inr"])
    return F.try_divide(as_number(df, "final_amount_inr"), F.nullif(as_number(df, "quantity"), F.lit(0.0)))
