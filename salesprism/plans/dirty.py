"""A dirty raw table derived from the transactions, for the cleaning queries.

The test tables are clean, so the raw text is spelled from their keys and
values. The expressions are plain SQL that Spark and other engines read the
same way; every transaction becomes one dirty row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def cases(key: str, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {whens} END"


def whole(column: str) -> str:
    return f"CAST(CAST(floor({column}) AS BIGINT) AS STRING)"


_DAY = "lpad(CAST(day(order_date) AS STRING), 2, '0')"
_MONTH = "lpad(CAST(month(order_date) AS STRING), 2, '0')"
_YEAR = "CAST(year(order_date) AS STRING)"
_AMOUNT = whole("final_amount_inr")

DIRTY: dict[str, str] = {
    "transaction_id": "CAST(transaction_id AS STRING)",
    "customer_id": "concat('CUST_', CAST(customer_id AS STRING))",
    "product_id": "concat('PROD_', CAST(product_id AS STRING))",
    "product_name": cases("transaction_id", "'Sony Earphone'", "'Boat Soundbar'", "product_name"),
    "category": cases(
        "product_id", "'Electronics - Audio'", "'Headphones'", "'Electronics'", "'Smart Watch'",
        "'TV & Entertainment'", "'Books'", "NULL", "' smart-PHONES '", "'Ultrabook/Laptops'", "'iPad   Tablets'"),
    "subcategory": cases("customer_id", "'Laptops'", "NULL", "'Accessories'", "''"),
    "order_date": cases(
        "transaction_id", f"concat({_DAY}, '/', {_MONTH}, '/', {_YEAR})", f"concat({_YEAR}, '-', {_MONTH}, '-', {_DAY})",
        f"concat({_MONTH}, '/', {_DAY}, '/', {_YEAR})", f"concat({_DAY}, '-', {_MONTH}, '-', {_YEAR})",
        "'not a date'", f"concat({_YEAR}, '-', {_MONTH}, '-', {_DAY}, ' 10:30:00')", "NULL",
        f"concat({_DAY}, '-', {_MONTH}, '-', right({_YEAR}, 2))"),
    "original_price_inr": cases("product_id", "NULL", whole("original_price_inr")),
    "discounted_price_inr": cases("product_id", "NULL", "'N/A'", "'  '", whole("discounted_price_inr")),
    "subtotal_inr": cases("customer_id", "NULL", whole("subtotal_inr"), "'none'"),
    "final_amount_inr": cases(
        "transaction_id", f"concat('₹', {_AMOUNT})", "'Price on Request'", "NULL", f"concat('$', {_AMOUNT}, '.50')",
        "'12nash'", "'Rs 500'", f"concat('₹', left({_AMOUNT}, 1), ',', substr({_AMOUNT}, 2))", f"concat('-', {_AMOUNT})",
        f"concat(left({_AMOUNT}, 1), 'e3')"),
    "quantity": whole("quantity"),
    "city": cases(
        "customer_id", "' bangalore '", "'delhi  ncr'", "'CALCUTTA'", "'chenai'", "'Bombay'", "'  '", "NULL",
        "'new-delhi'", "lower(customer_state)"),
    "customer_state": "customer_state",
    "payment_method": cases(
        "transaction_id", "'Google  Pay'", "'PAYTM'", "'icici cc'", "'debit card'", "'C.O.D'", "'Net Banking'",
        "'e-wallet'", "'Simpl'", "'Cash on Delivery'", "NULL", "'Credit/Debit'", "'phonepe'", "'pay later'"),
    "is_prime_member": cases(
        "customer_id", "'Yes'", "' y'", "'TRUE'", "'1'", "'no'", "'0'", "'maybe'", "'1.0'", "NULL", "'t'", "'7'"),
    "delivery_days": cases(
        "transaction_id", "'Same Day'", "'2-3 days'", "'3.7'", "'45'", "'30'", "'40-50'", "'-2'", "'express'",
        "'5 days'", "NULL", "'4 - 8'"),
    "customer_rating": cases(
        "transaction_id", "'4.5/5.0'", "'8/10'", "'3/50'", "'0'", "'0/10'", "'6'", "'4 out of 5'", "'5 Stars'", "'7/20'",
        "'great'", "'-1'", "NULL", "'1 star'"),
    "return_status": cases(
        "transaction_id", "'Returned'", "' refund '", "'REPLACED'", "'Return_Initiated'", "'Delivered'", "NULL",
        "'returned'", "'refunded'"),
    "event_name": cases(
        "transaction_id", "concat('Great ', festival_name, ' Sale')", "lower(festival_name)", "'Summer Sale'",
        "'new year bash'", "NULL"),
}


def dirty_transactions(t: DataFrame) -> DataFrame:
    return t.selectExpr(*[f"{sql} AS {name}" for name, sql in DIRTY.items()])
