"""Dirty values with the results they must be cleaned to."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from salesprism.functions import cleaners as clean
from salesprism.functions import fixed_values as fixed
from salesprism.operators import cleaning
from salesprism.sources.schema import city_column


def apply(spark, rule, values, dtype="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {dtype}")
    return [r[0] for r in df.select(rule(F.col("v")).alias("o"), "i").orderBy("i").collect()]


CASES = {
    "price": (clean.clean_price, {
        "₹1,23,456.50": 123456.5, "$99": 99.0, "Price on Request": None, "N/A": None, "12nash": None, "Rs 500": None,
        "-50": -50.0, "1e3": 1000.0, "": None, "  ": None, None: None, "null": None, "None": None, "12d": None,
        "inf": None, " 7 ": 7.0, ".5": 0.5, "5.": 5.0}),
    "rating": (clean.clean_rating, {
        "4.5/5.0": 4.5, "8/10": 4.0, "3/50": 5.0, "0": None, "0/10": 0.0, "6": 5.0, "4 out of 5": 4.0, "5 stars": 5.0,
        "7/20": 1.75, "great": None, "-1": None, None: None, "3/0": None, "1 STAR": 1.0}),
    "delivery": (clean.clean_delivery_days, {
        "Same Day": 0.0, "2-3 days": 2.5, "3.7": 3.0, "45": None, "30": 30.0, "40-50": 45.0, "-2": None,
        "express": None, "5 days": 5.0, None: None, "today": 0.0, "4 - 8": 6.0}),
    "payment": (clean.clean_payment, {
        "Google Pay": "UPI", "PAYTM": "UPI", "Amazon Pay": "UPI", "pay later": "UPI", "icici cc": "Credit Card",
        "Credit/Debit": "Credit Card", "debit card": "Debit Card", "C.O.D": "COD", "Net  Banking": "Net Banking",
        "e-wallet": "Wallet", "Simpl": "BNPL", "bnpl": "BNPL", "Cash on Delivery": "Other", None: "Other"}),
    "payment strict": (lambda c: clean.clean_payment(c, strict=True), {
        "PAYTM": "Wallet", "Amazon Pay": "Wallet", "pay later": "BNPL", "Google Pay": "UPI", "gpay": "UPI",
        "Cash on Delivery": "COD"}),
    "city": (clean.clean_city, {
        " bangalore ": "Bengaluru", "delhi  ncr": "Delhi", "CALCUTTA": "Kolkata", "chenai": "Chennai",
        "Bombay": "Bombay", "": "Unknown", "  ": "Unknown", None: "Unknown", "new-delhi": "New-Delhi",
        "o'fallon": "O'Fallon", "navi MUMBAI": "Navi Mumbai"}),
    "bool": (clean.clean_bool, {
        "Yes": True, "y": True, "TRUE": True, "1": True, "no": False, "0": False, "maybe": False, "1.0": False,
        None: False}),
    "flag": (clean.clean_flag, {"t": 1, "Yes": 1, "f": 0, "1.0": 1, "7": 7, "maybe": 0, None: 0}),
    "date": (lambda c: F.to_date(clean.parse_date(c)), {
        "31/12/2020": dt.date(2020, 12, 31), "2020-12-31": dt.date(2020, 12, 31), "12/31/2020": dt.date(2020, 12, 31),
        "03/04/2020": dt.date(2020, 4, 3), "1-2-2021": dt.date(2021, 2, 1), "05-06-21": dt.date(2021, 6, 5),
        "05-06-95": dt.date(1995, 6, 5), "2020-12-31 10:30:00": dt.date(2020, 12, 31), "5 Jan 2019": dt.date(2019, 1, 5),
        "31/12/2020 10:30": dt.date(2020, 12, 31), "20201231": dt.date(2020, 12, 31), "junk": None, "": None,
        None: None, "32/13/2020": None, "30/02/2020": None}),
    "returned": (clean.is_returned, {"Returned": True, " refund ": True, "Replaced": True, "true": False, None: False}),
    "returned export": (lambda c: clean.is_returned(c, "export"), {"refunded": True, "replaced": False, " refund": False}),
    "returned insights": (lambda c: clean.is_returned(c, "insights"), {"Returned": True, "returned": False}),
    "festival": (clean.is_festival_event, {"Great DIWALI sale": True, "summer": False, None: False}),
    "title": (clean.title_case, {"tv & a-b/c'd": "Tv & A-B/C'D"}),
}


@pytest.mark.parametrize("name", CASES)
def test_text_rules(spark, name):
    rule, cases = CASES[name]
    got = apply(spark, rule, list(cases))
    assert dict(zip(cases, got)) == cases


def test_category_sources(spark):
    cases = [
        (("Electronics - Audio", None, None), "Audio"), (("Headphones", None, None), "Smartphones"),
        (("Electronics", None, "Sony Earphone"), "Smartphones"), (("Electronics", "Laptops", None), "Laptops"),
        (("Electronics", None, "Boat Soundbar"), "Audio"), (("Smart Watch", None, None), "Smart Watches"),
        (("TV & Entertainment", None, None), "TV & Entertainment"), (("Books", None, None), "Other"),
        ((None, None, None), "Other"),
    ]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, a string, b string, c string")
    got = df.select("i", clean.clean_category("a", "b", "c").alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [c[1] for c in cases]


def test_value_segments(spark):
    values = [5000.0, 5000.01, 20000.0, 50000.0, 100000.0, 100000.01, None]
    want = ["Low", "Mid", "Mid", "High", "Premium", "Luxury", "Unknown"]
    assert apply(spark, clean.value_segment, values, "double") == want


def test_final_amount_falls_back(spark):
    df = spark.createDataFrame([(None, 10.0, 1.0), (None, None, 7.0), (None, None, None), (3.0, 10.0, 7.0)],
                               "f double, d double, s double")
    assert [r[0] for r in df.select(clean.final_amount("f", "d", "s")).collect()] == [10.0, 7.0, 0.0, 3.0]


def test_days_between_rounds_down(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2020-01-03 00:00:00' a, TIMESTAMP_NTZ'2020-01-01 12:00:00' b")
    row = df.select(clean.days_between(F.col("a"), F.col("b")), clean.days_between(F.col("b"), F.col("a"))).first()
    assert tuple(row) == (1, -2)


def test_city_column_name_in_any_case(spark):
    df = spark.createDataFrame([("x",)], "Customer_City string")
    assert df.select(city_column(df).alias("c")).first().c == "x"
    assert df.drop("Customer_City").select(city_column(df.drop("Customer_City")).alias("c")).first().c == "Unknown"


def test_duplicates_ignore_null_keys(spark):
    rows = [("1", "a", 1.0), ("2", "a", 1.0), ("3", "b", 1.0), ("4", None, 2.0), ("5", None, 2.0)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, final_amount_inr double")
    out = cleaning.flag_duplicates(df, keys=("customer_id", "final_amount_inr"))
    got = {r.transaction_id: r.is_possible_duplicate for r in out.collect()}
    assert got == {"1": True, "2": True, "3": False, "4": False, "5": False}


def test_clean_transactions_defaults_for_absent_columns(spark):
    raw = spark.createDataFrame([("1", "2020-01-05", "₹5"), ("2", "junk", "₹6")],
                                "transaction_id string, order_date string, subtotal_inr string")
    row = cleaning.clean_transactions(raw).collect()
    assert len(row) == 1
    assert (row[0].final_amount_inr, row[0].payment_method, row[0].category, row[0].city, row[0].is_prime,
            row[0].is_possible_duplicate) == (5.0, "Other", "Other", "Unknown", False, False)


def test_quality_report_counts_nulls(spark):
    after = spark.createDataFrame([("a", None), ("a", "x"), ("b", None)], "category string, city string")
    before = spark.range(5)
    got = {r.metric: r.value for r in cleaning.quality_report(before, after, ("category", "city")).collect()}
    assert got == {"rows_before": "5", "rows_after": "3", "rows_dropped_due_to_invalid_dates": "2",
                   "top_category_after": "a(2); b(1)", "top_city_after": "nan(2); x(1)"}


def test_cleaning_is_not_fused_into_one_method(spark):
    """A fused method of all rules is too large for the JVM's compiler and then runs many times slower."""
    raw = spark.createDataFrame([("1", "c", "p", "02/01/2020", "₹5", "delhi", "4/5", "3")], (
        "transaction_id string, customer_id string, product_id string, order_date string, final_amount_inr string, "
        "city string, customer_rating string, delivery_days string"))
    plan = cleaning.clean_rows(raw)._jdf.queryExecution().executedPlan().toString()
    fused = [line for line in plan.splitlines() if "regexp_" in line and re.match(r"[ :+-]*\*\(", line)]
    assert "regexp_" in plan and not fused


def test_cleaning_casts_and_parses_what_can_fit_only(spark):
    """Casting a text that is no number, or trying a layout that cannot fit, costs an exception a row."""
    row = spark.createDataFrame([("12/25/2020", "12-25-2020", "25-12-2020", "13-13-2020")], "a string, b string, c string, d string")
    got = row.select(*[F.to_date(clean.parse_date(c)).cast("string") for c in "abcd"]).first()
    assert tuple(got) == ("2020-12-25", "2020-12-25", "2020-12-25", None)
    rules = row.select(clean.to_number("a"), clean.clean_rating("b"), clean.clean_delivery_days("c"))
    assert "cast(regexp_extract" not in rules._jdf.queryExecution().analyzed().toString()
    assert any(re.match(shape, "12-25-2020") and "d-M-yyyy" not in layouts for shape, layouts in fixed.DATE_SHAPES[:1])
