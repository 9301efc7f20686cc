"""Monthly series, growth, moving averages and forecasts for many series at once.

A series is a DataFrame of ``(keys..., month DATE, value DOUBLE)``. It is
already reduced to one row per key and month, so the windows below, which
are partitioned by series, hold at most the number of calendar months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.functions.cleaners import month_start, percent
from salesprism.operators.aggregates import AMOUNT, group_metrics, total

SERIES = "series"
MIN_SEASONAL_MONTHS = 15
SEASON = 12


def monthly_series(df: DataFrame, keys: Sequence[str] = (), value: Column | None = None) -> DataFrame:
    dated = df.where(F.col("order_date").isNotNull()).withColumn("month", month_start("order_date"))
    return group_metrics(dated, [*keys, "month"], value=total(AMOUNT) if value is None else value)


def _named(series: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A series without keys becomes the one series ``all``."""
    if keys:
        return series, list(keys)
    return series.withColumn(SERIES, F.lit("all")), [SERIES]


def fill_months(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add the missing months between each series' first and last, with value 0."""
    named, by = _named(series, keys)
    spine = named.groupBy(*by).agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        *by, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    filled = spine.join(named, [*by, "month"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return filled if keys else filled.drop(SERIES)


def moving_average(series: DataFrame, keys: Sequence[str], months: int = 3) -> DataFrame:
    """Next month's demand: the mean of the last months present, cut to whole units."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("month"))
    recent = series.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= months)
    return (
        recent.groupBy(*keys).agg(F.avg("value").alias("avg_value"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= months)
        .select(*keys, F.col("avg_value").cast("bigint").alias("forecast_units"))
    )


def trailing_growth(series: DataFrame) -> DataFrame:
    """Last 12 months against the 12 before; with under 24 months, last month against the one before."""
    back = F.row_number().over(Window.orderBy(F.desc("month")))
    s = series.withColumn("_r", back)

    def part(low: int, high: int) -> Column:
        return F.sum(F.when(F.col("_r").between(low, high), F.col("value")))

    table = s.agg(F.count(F.lit(1)).alias("months"), part(1, 12).alias("last12"), part(13, 24).alias("prev12"),
                  part(1, 1).alias("last1"), part(2, 2).alias("prev1"))
    growth = (
        F.when(F.col("months") >= 24, percent(F.col("last12") - F.col("prev12"), F.col("prev12")))
        .when(F.col("months") >= 2, percent(F.col("last1") - F.col("prev1"), F.col("prev1")))
        .otherwise(F.lit(0.0))
    )
    return table.select("months", growth.alias("growth_pct"))


def order_value_trend(df: DataFrame, months: int = 6) -> DataFrame:
    """Change of the average order value over the last months, last minus first."""
    s = group_metrics(df.withColumn("month", month_start("order_date")), ["month"],
                      revenue=total(AMOUNT), orders=F.count("transaction_id"))
    s = s.withColumn("aov", F.try_divide("revenue", "orders")).where("aov IS NOT NULL")
    recent = s.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("month")))).where(F.col("_r") <= months)
    return recent.agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        (F.max_by("aov", "month") - F.min_by("aov", "month")).alias("aov_change"))


def trend_season_forecast(series: DataFrame, keys: Sequence[str] = (), horizon: int = 12) -> DataFrame:
    """Straight-line trend plus the mean residual of each calendar month.

    A series with under 15 months gets the flat mean of its last 3 instead.
    """
    named, by = _named(series, keys)
    whole = Window.partitionBy(*by)
    s = named.withColumns({
        "t": (F.row_number().over(whole.orderBy("month")) - 1).cast("double"),
        "n": F.count(F.lit(1)).over(whole),
    })
    fit = s.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("month").alias("last_month"),
        F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("intercept"),
        F.avg(F.when(F.col("t") >= F.col("n") - 3, F.col("value"))).alias("flat"))
    residual = F.col("value") - (F.col("intercept") + F.col("slope") * F.col("t"))
    season = (
        s.drop("n").join(fit, by).groupBy(*by, F.month("month").alias("moy")).agg(F.avg(residual).alias("seasonal"))
    )
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "month", F.add_months("last_month", F.col("step"))).withColumn("moy", F.month("month"))
    trend = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    value = F.when(F.col("n") < MIN_SEASONAL_MONTHS, F.col("flat")).otherwise(
        trend + F.coalesce("seasonal", F.lit(0.0)))
    out = ahead.join(season, [*by, "moy"], "left").select(*by, "month", value.alias("forecast"))
    return out if keys else out.drop(SERIES)


def with_history(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actual and forecast months in one table, told apart by ``kind``."""
    actual = series.withColumn("kind", F.lit("actual"))
    return actual.unionByName(forecast.withColumnRenamed("forecast", "value").withColumn("kind", F.lit("forecast")))


def seasonal_ar_forecast(series: DataFrame, keys: Sequence[str] = (), horizon: int = 12) -> DataFrame:
    """Seasonal autoregression on the doubly differenced, gap-filled series.

    ``w = (1 - B)(1 - B^12) y`` is regressed on its lags 1 and 12 by least
    squares (the two normal equations are grouped sums), rolled forward, and
    integrated back. Where the equations have no unique solution, or a series
    is too short for them, the coefficients are 0: last year's step repeats.
    A series under 13 months repeats its last value.
    """
    named, by = _named(fill_months(series, keys), keys)
    order = Window.partitionBy(*by).orderBy("month")
    y = F.col("value").cast("double")
    w = named.withColumn("y", y).withColumn(
        "w", F.col("y") - F.lag("y", 1).over(order) - F.lag("y", SEASON).over(order) + F.lag("y", SEASON + 1).over(order))
    lags = w.withColumns({"x1": F.lag("w", 1).over(order), "x2": F.lag("w", SEASON).over(order)})
    ready = F.col("x1").isNotNull() & F.col("x2").isNotNull()

    def moment(a: str, b: str) -> Column:
        return F.coalesce(F.sum(F.when(ready, F.col(a) * F.col(b))), F.lit(0.0)).alias(f"{a}{b}")

    point = F.struct("month", "y", F.coalesce("w", F.lit(0.0)).alias("w"))
    fit = lags.groupBy(*by).agg(
        moment("x1", "x1"), moment("x1", "x2"), moment("x2", "x2"), moment("x1", "w"), moment("x2", "w"),
        F.array_sort(F.collect_list(point)).alias("points"))
    det = F.col("x1x1") * F.col("x2x2") - F.col("x1x2") * F.col("x1x2")
    solvable = F.abs(det) > 1e-9 * F.col("x1x1") * F.col("x2x2")

    def solved(top: Column) -> Column:
        return F.when(solvable, top / F.nullif(det, F.lit(0.0))).otherwise(F.lit(0.0))

    fit = fit.withColumns({
        "a": solved(F.col("x1w") * F.col("x2x2") - F.col("x2w") * F.col("x1x2")),
        "b": solved(F.col("x2w") * F.col("x1x1") - F.col("x1w") * F.col("x1x2")),
        "ys": F.transform("points", lambda p: p["y"]), "ws": F.transform("points", lambda p: p["w"]),
        "last_month": F.element_at("points", -1)["month"],
    })

    def back(values: Column, steps: int) -> Column:
        return F.coalesce(F.try_element_at(values, F.lit(-steps)), F.lit(0.0))

    def step(state: Column, _: Column) -> Column:
        ys, ws = state["ys"], state["ws"]
        next_w = F.col("a") * back(ws, 1) + F.col("b") * back(ws, SEASON)
        seasonal = next_w + back(ys, 1) + back(ys, SEASON) - back(ys, SEASON + 1)
        next_y = F.when(F.size("points") > SEASON, seasonal).otherwise(back(ys, 1))
        return F.struct(F.concat(ys, F.array(next_y)).alias("ys"), F.concat(ws, F.array(next_w)).alias("ws"))

    rolled = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.struct("ys", "ws"), step)
    future = fit.select(*by, "last_month", F.slice(rolled["ys"], F.size("ys") + 1, F.lit(horizon)).alias("f"))
    out = future.select(*by, "last_month", F.posexplode("f").alias("i", "forecast")).select(
        *by, F.add_months("last_month", F.col("i") + 1).alias("month"), "forecast")
    return out if keys else out.drop(SERIES)


LONG_LAGS = (1, 2, 3, SEASON, SEASON + 1, SEASON + 2)
ARMA_LAGS = (1, SEASON)


def solve(system: Column, size: int) -> Column:
    """Solution of ``size`` linear equations, given as rows of coefficients and right side; null where there is no single one.

    Gauss-Jordan elimination down the diagonal, which suits the positive
    definite normal equations of a regression.
    """
    scale = F.transform(system, lambda row, i: F.abs(F.get(row, i)))

    def eliminate(rows: Column, k: Column) -> Column:
        own = F.get(rows, k)
        pivot = F.when(F.abs(F.get(own, k)) > 1e-9 * F.get(scale, k), F.get(own, k))
        scaled = F.transform(own, lambda x: x / pivot)
        return F.transform(rows, lambda row, i: F.when(i == k, scaled).otherwise(
            F.zip_with(row, scaled, lambda x, y: x - y * F.get(row, k))))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), system, eliminate)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def least_squares(rows: DataFrame, by: Sequence[str], target: str, regressors: Sequence[str], name: str) -> DataFrame:
    """Coefficients of ``target`` on ``regressors`` for each group, from grouped sums; zeros where they are not determined.

    Rows with a null in any of them take no part. There is no constant.
    """
    ready = F.lit(True)
    for c in (target, *regressors):
        ready = ready & F.col(c).isNotNull()

    def moment(a: str, b: str) -> Column:
        return F.coalesce(F.sum(F.when(ready, F.col(a) * F.col(b))), F.lit(0.0))

    system = F.array(*[F.array(*[moment(a, b) for b in (*regressors, target)]) for a in regressors])
    found = rows.groupBy(*by).agg(system.alias("_system"))
    return found.select(*by, F.transform(solve(F.col("_system"), len(regressors)), lambda x: F.coalesce(x, F.lit(0.0))).alias(name))


def seasonal_arma_fit(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each month's ``y``, its double difference ``w``, the shock ``e`` and the coefficients ``arma`` of its series.

    Hannan-Rissanen in two regressions: a long autoregression of ``w`` on
    ``LONG_LAGS`` leaves residuals that stand in for the shocks; then ``w`` is
    regressed on ``w`` and ``e`` at ``ARMA_LAGS``, which gives the two
    autoregressive and the two moving-average terms. Products of the plain
    and the seasonal terms are left out. Months without all lags have no shock.
    """
    named, by = _named(fill_months(series, keys), keys)
    order = Window.partitionBy(*by).orderBy("month")

    def lagged(df: DataFrame, value: str, lags: Sequence[int]) -> DataFrame:
        return df.withColumns({f"_{value}{n}": F.lag(value, n).over(order) for n in lags})

    y = named.withColumn("y", F.col("value").cast("double"))
    w = y.withColumn("w", F.col("y") - F.lag("y", 1).over(order) - F.lag("y", SEASON).over(order) + F.lag("y", SEASON + 1).over(order))
    long = lagged(w, "w", LONG_LAGS)
    terms = [f"_w{n}" for n in LONG_LAGS]
    shocks = long.join(least_squares(long, by, "w", terms, "_long"), by)
    expected = sum((F.col("_long")[i] * F.col(c) for i, c in enumerate(terms)), F.lit(0.0))
    shocks = shocks.withColumn("e", F.col("w") - expected).select(*by, "month", "y", "w", "e")
    short = lagged(lagged(shocks, "w", ARMA_LAGS), "e", ARMA_LAGS)
    names = [f"_{v}{n}" for v in "we" for n in ARMA_LAGS]
    return shocks.join(least_squares(short, by, "w", names, "arma"), by)


def seasonal_arma_forecast(series: DataFrame, keys: Sequence[str] = (), horizon: int = 12) -> DataFrame:
    """Seasonal ARMA forecast of the doubly differenced series, integrated back; future shocks are 0.

    A series too short for the regressions repeats last year's steps, one of
    under 13 months its last value.
    """
    fitted = seasonal_arma_fit(series, keys)
    by = list(keys) or [SERIES]
    point = F.struct("month", "y", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("e", F.lit(0.0)).alias("e"))
    whole = fitted.groupBy(*by).agg(F.any_value("arma").alias("arma"), F.array_sort(F.collect_list(point)).alias("points"))
    start = whole.select(
        *by, "arma", "points", F.element_at("points", -1)["month"].alias("last_month"),
        *[F.col("points")[v].alias(f"{v}s") for v in "ywe"])

    def back(values: Column, steps: int) -> Column:
        return F.coalesce(F.try_element_at(values, F.lit(-steps)), F.lit(0.0))

    def step(state: Column, _: Column) -> Column:
        ys, ws, es = state["ys"], state["ws"], state["es"]
        terms = [back(ws, n) for n in ARMA_LAGS] + [back(es, n) for n in ARMA_LAGS]
        next_w = sum((F.col("arma")[i] * x for i, x in enumerate(terms)), F.lit(0.0))
        seasonal = next_w + back(ys, 1) + back(ys, SEASON) - back(ys, SEASON + 1)
        next_y = F.when(F.size("points") > SEASON, seasonal).otherwise(back(ys, 1))
        return F.struct(*[F.concat(old, F.array(new)).alias(name) for old, new, name in (
            (ys, next_y, "ys"), (ws, next_w, "ws"), (es, F.lit(0.0), "es"))])

    rolled = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.struct("ys", "ws", "es"), step)
    future = start.select(*by, "last_month", F.slice(rolled["ys"], F.size("ys") + 1, F.lit(horizon)).alias("f"))
    out = future.select(*by, "last_month", F.posexplode("f").alias("i", "forecast")).select(
        *by, F.add_months("last_month", F.col("i") + 1).alias("month"), "forecast")
    return out if keys else out.drop(SERIES)
