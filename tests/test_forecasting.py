"""Forecasts against numpy on small series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesprism.operators import forecasting


def months(n, start=(2015, 1)):
    y, m = start
    return [dt.date(y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1, 1) for i in range(n)]


def series(spark, values, start=(2015, 1), key=None):
    rows = [(key, d, float(v)) for d, v in zip(months(len(values), start), values)]
    df = spark.createDataFrame(rows, "k string, month date, value double")
    return df if key else df.drop("k")


def wave(n):
    rng = np.random.default_rng(7)
    return 100 + 3 * np.arange(n) + 20 * np.sin(np.arange(n) * np.pi / 6) + rng.normal(0, 2, n)


def test_trend_season_matches_numpy(spark):
    y = wave(40)
    got = [r.forecast for r in forecasting.trend_season_forecast(series(spark, y)).orderBy("month").collect()]
    t = np.arange(40)
    slope, icept = np.polyfit(t, y, 1)
    moy = t % 12
    seas = {m: (y - (icept + slope * t))[moy == m].mean() for m in range(12)}
    want = [icept + slope * (40 + h) + seas[(40 + h) % 12] for h in range(12)]
    assert got == pytest.approx(want)


def test_short_series_is_flat(spark):
    out = forecasting.trend_season_forecast(series(spark, [1, 2, 3, 4, 5, 9])).orderBy("month").collect()
    assert [r.forecast for r in out] == pytest.approx([6.0] * 12)
    assert out[0].month == dt.date(2015, 7, 1)


def seasonal_ar(y, steps=12):
    y = list(map(float, y))
    if len(y) < 13:
        return [y[-1]] * steps
    w = [None] * 13 + [y[t] - y[t - 1] - y[t - 12] + y[t - 13] for t in range(13, len(y))]
    rows = [(w[t - 1], w[t - 12], w[t]) for t in range(25, len(y))]
    a = b = 0.0
    if len(rows) >= 2:
        x = np.array([r[:2] for r in rows])
        a, b = np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)[0]
    w = [0.0 if v is None else v for v in w]
    for _ in range(steps):
        nxt = a * w[-1] + b * w[-12]
        y.append(nxt + y[-1] + y[-12] - y[-13])
        w.append(nxt)
    return y[-steps:]


@pytest.mark.parametrize("n", [6, 13, 20, 60])
def test_seasonal_ar_matches_brute_force(spark, n):
    y = wave(n)
    got = [r.forecast for r in forecasting.seasonal_ar_forecast(series(spark, y)).orderBy("month").collect()]
    assert got == pytest.approx(seasonal_ar(y), rel=1e-6)


def test_many_series_at_once(spark):
    a, b = wave(50), wave(30) * 2
    both = series(spark, a, key="a").unionByName(series(spark, b, (2018, 4), key="b"))
    out = forecasting.seasonal_ar_forecast(both, ["k"])
    got = {k: [r.forecast for r in out.where(F.col("k") == k).orderBy("month").collect()] for k in "ab"}
    assert got["a"] == pytest.approx(seasonal_ar(a), rel=1e-6)
    assert got["b"] == pytest.approx(seasonal_ar(b), rel=1e-6)


def test_fill_months_adds_zeroes(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 5.0), (dt.date(2020, 4, 1), 7.0)], "month date, value double")
    assert [r.value for r in forecasting.fill_months(df).orderBy("month").collect()] == [5.0, 0.0, 0.0, 7.0]


@pytest.mark.parametrize("values,want", [([1.0], 0.0), ([4.0, 5.0], 25.0), ([1.0] * 12 + [2.0] * 12, 100.0)])
def test_growth(spark, values, want):
    assert forecasting.trailing_growth(series(spark, values)).first().growth_pct == pytest.approx(want)


def test_moving_average_needs_three_months(spark):
    both = series(spark, [1, 2, 6, 9], key="a").unionByName(series(spark, [5, 6], key="b"))
    out = forecasting.moving_average(both, ["k"]).collect()
    assert [(r.k, r.forecast_units) for r in out] == [("a", 5)]


def arma(y, steps=12):
    """Hannan-Rissanen with numpy: (coefficients, forecast)."""
    y = list(map(float, y))
    w = {t: y[t] - y[t - 1] - y[t - 12] + y[t - 13] for t in range(13, len(y))}

    def fit(target, terms):
        rows = [(r, target[t]) for t in sorted(target) if None not in (r := [x.get(t - n) for x, n in terms])]
        if len(rows) < len(terms):
            return [0.0] * len(terms)
        return list(np.linalg.lstsq(np.array([r for r, _ in rows]), np.array([v for _, v in rows]), rcond=None)[0])

    long = (1, 2, 3, 12, 13, 14)
    c = fit(w, [(w, n) for n in long])
    e = {t: w[t] - sum(a * w[t - n] for a, n in zip(c, long)) for t in w if all(t - n in w for n in long)}
    coef = fit(w, [(w, 1), (w, 12), (e, 1), (e, 12)])
    for t in range(len(y), len(y) + steps):
        w[t] = sum(a * x.get(t - n, 0.0) for a, (x, n) in zip(coef, [(w, 1), (w, 12), (e, 1), (e, 12)]))
        y.append(w[t] + y[-1] + y[-12] - y[-13])
    return coef, y[-steps:]


@pytest.mark.parametrize("n", [20, 60, 150])
def test_seasonal_arma_matches_numpy(spark, n):
    y = wave(n)
    got = forecasting.seasonal_arma_forecast(series(spark, y)).orderBy("month").collect()
    assert [r.forecast for r in got] == pytest.approx(arma(y)[1], rel=1e-6)


def test_seasonal_arma_of_a_very_short_series_repeats_its_last_value(spark):
    assert [r.forecast for r in forecasting.seasonal_arma_forecast(series(spark, [3.0, 5.0, 4.0])).collect()] == [4.0] * 12
    assert forecasting.seasonal_arma_forecast(series(spark, [])).count() == 0


def test_seasonal_arma_of_many_series(spark):
    a, b = wave(90), wave(80) * 2 + 7
    both = series(spark, a, key="a").unionByName(series(spark, b, (2018, 4), key="b"))
    out = forecasting.seasonal_arma_forecast(both, ["k"])
    for k, y in (("a", a), ("b", b)):
        assert [r.forecast for r in out.where(F.col("k") == k).orderBy("month").collect()] == pytest.approx(arma(y)[1], rel=1e-6)


def test_seasonal_arma_recovers_known_coefficients(spark):
    rng, n, true = np.random.default_rng(11), 6000, (0.4, 0.3, 0.35, -0.25)
    e, w = rng.normal(0, 1, n), np.zeros(n)
    for t in range(12, n):
        w[t] = true[0] * w[t - 1] + true[1] * w[t - 12] + e[t] + true[2] * e[t - 1] + true[3] * e[t - 12]
    y = np.zeros(n)
    for t in range(13, n):
        y[t] = w[t] + y[t - 1] + y[t - 12] - y[t - 13]
    df = series(spark, y[13:], (1500, 1))
    fitted = forecasting.seasonal_arma_fit(df).select("arma").first().arma
    assert fitted == pytest.approx(true, abs=0.1)


def test_elimination(spark):
    systems = [([[2.0, 1.0, 5.0], [1.0, 3.0, 10.0]], [1.0, 3.0]), ([[1.0, 1.0, 2.0], [1.0, 1.0, 2.0]], [None, None]), ([[0.0, 0.0, 0.0]] * 2, [None] * 2)]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(systems)], "i int, m array<array<double>>")
    got = {r.i: r.x for r in df.select("i", forecasting.solve(F.col("m"), 2).alias("x")).collect()}
    for i, (_, want) in enumerate(systems):
        assert got[i] == (pytest.approx(want) if None not in want else want)
