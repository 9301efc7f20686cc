"""Row filters of the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism.functions import cleaners as clean


def apply_filters(
    df: DataFrame,
    years: Sequence[int] | None = None,
    categories: Sequence[str] | None = None,
    states: Sequence[str] | None = None,
    cities: Sequence[str] | None = None,
    payments: Sequence[str] | None = None,
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """AND of the chosen values; an empty choice filters nothing.

    Plain ``IN`` predicates, so they reach the Parquet scan and the year
    choice prunes partitions.
    """
    names = {"years": "order_year", "categories": "category", "states": "customer_state",
             "cities": "city", "payments": "payment_method", **(columns or {})}
    chosen = {"years": years, "categories": categories, "states": states,
              "cities": cities, "payments": payments}
    for choice, values in chosen.items():
        if values:
            df = df.where(F.col(names[choice]).isin(list(values)))
    return df


def choices(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values of one column."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def default_panel(df: DataFrame, last_years: int = 3, first_categories: int = 5) -> DataFrame:
    """The panel's opening choice: latest years and first categories by name.

    The choices are at most a handful of rows by their limits, so they are
    broadcast.
    """
    years = choices(df, "order_year").orderBy(F.desc("order_year")).limit(last_years)
    categories = choices(df, "category").limit(first_categories)
    return (
        df.join(F.broadcast(years), "order_year", "left_semi")
        .join(F.broadcast(categories), "category", "left_semi")
    )


def festival_events(df: DataFrame, column: str = "event_name") -> DataFrame:
    return df.where(clean.is_festival_event(column))


def sellable(df: DataFrame, price: str = "price", quantity: str = "quantity") -> DataFrame:
    return df.where((F.col(price) > 0) & (F.col(quantity) >= 0))


def low_stock(df: DataFrame, product: str = "product_name", stock: str = "stock",
              below: int = 50, rows: int = 20) -> DataFrame:
    """Distinct (product, stock) pairs under the threshold, first ``rows`` by key."""
    return (
        df.where(F.col(stock) < below).select(product, stock).distinct()
        .orderBy(product, stock).limit(rows)
    )
