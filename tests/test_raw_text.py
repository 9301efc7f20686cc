"""Spellings that must not be lost: numbers, white space, dates, CSV headers, years."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesprism.functions import cleaners as clean
from salesprism.operators import aggregates
from salesprism.sources import readers


def one(spark, value, rule, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(rule("x").alias("y")).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("1e100", 1e100), ("1e-100", 1e-100), ("1." + "3" * 51, 4 / 3), ("9" * 250, 1e250), ("1e999", None), ("nan", None),
    ("inf", None), ("\t12\n", 12.0), ("1 2", None), (".5", 0.5), ("", None)])
def test_numbers(spark, text, want):
    assert one(spark, text, clean.to_number) == (want if want is None else pytest.approx(want))


def test_outer_space_of_any_kind(spark):
    assert one(spark, "yes\t", clean.clean_bool) and one(spark, "Returned\n", clean.is_returned)
    assert one(spark, "today\t", clean.clean_delivery_days) == 0
    assert one(spark, "₹\u00a0500", clean.clean_price) == 500
    assert one(spark, "pune\u00a0", clean.clean_city) == one(spark, "pune", clean.clean_city)


def test_numeric_flags(spark):
    assert [one(spark, v, clean.clean_bool, "double") for v in (1.0, 1.7, 0.0, 2.0, None)] == [True, True, False, False, False]
    assert one(spark, 1, clean.clean_bool, "int") and one(spark, True, clean.clean_bool, "boolean")
    assert not one(spark, "1.0", clean.clean_bool)


JAN5 = dt.datetime(2020, 1, 5)


@pytest.mark.parametrize(("text", "want"), [
    ("5 January 2020", JAN5), ("January 5, 2020", JAN5), ("Jan 5 2020", JAN5), ("05/01/2020 10:30 PM", JAN5.replace(hour=22, minute=30)),
    ("5/1/2020 10:30:15.123", JAN5.replace(hour=10, minute=30, second=15, microsecond=123000)),
    ("05/01/2020T10:30", JAN5.replace(hour=10, minute=30)), ("2020.01.05", JAN5), ("05.01.20", JAN5), ("5-Jan-20", JAN5),
    ("20200105 10:30", JAN5.replace(hour=10, minute=30)), ("1 Sept 2020", dt.datetime(2020, 9, 1)), ("2020-01-05\t", JAN5),
    ("2020-01-05 12:05 am", JAN5.replace(minute=5)), ("2020-01-05T10:30:00", JAN5.replace(hour=10, minute=30)),
    ("05/13/2020", dt.datetime(2020, 5, 13)), ("31/02/2020", None), ("5 Smarch 2020", None), ("05/01/2020 25:00", None),
    ("05/01/2020 13:00 PM", None), ("not a date", None), ("", None), (None, None)])
def test_dates(spark, text, want):
    assert one(spark, text, clean.parse_date) == want


def test_csv_by_name_with_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('order_date,Extra,customer_id\n2020-01-05,"x\ny",c1\n2020-01-06,z,c2\n')
    rows = readers.read_csv(spark, str(tmp_path / "x.csv"), multi_line=True)
    assert rows.columns[0] == "transaction_id"
    got = [tuple(r) for r in rows.orderBy("order_date").select("transaction_id", "customer_id", "order_date", "Extra").collect()]
    assert got == [(None, "c1", "2020-01-05", "x\ny"), (None, "c2", "2020-01-06", "z")]


def test_every_year_has_its_column(spark, t):
    more = t.limit(1).withColumn("order_year", F.lit(2015))
    assert "y2015" in aggregates.month_year_matrix(t.union(more.select(*t.columns))).columns
