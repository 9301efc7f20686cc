from salesprism.functions import cleaners as clean
from salesprism.operators import sales


def test_lines_without_a_date_count_in_neither_report(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (DATE '2020-01-01', 'Returned', 100.0D, 1), (NULL, 'Returned', 50.0D, 1), "
        "(DATE '2020-01-02', 'Kept', 70.0D, 1) AS t(order_date, return_status, final_amount_inr, quantity)")
    flagged = sales.with_returns(rows).selectExpr("count(*)", "sum(return_loss)").first()
    assert tuple(flagged) == (2, 100.0)
    assert sales.with_profit(rows).count() == 2


def test_not_a_number_has_no_value_segment(spark):
    got = spark.sql("SELECT double('NaN') AS a").select(clean.value_segment("a")).first()[0]
    assert got == "Unknown"
