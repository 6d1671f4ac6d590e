"""Closed-form forecasts and backtests: sums, windows and joins only.

All series of a panel are handled in one job. Input panels are gap-free
(``city, target, ds, y``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickline.bindings import CUTOFF
from brickline.functions.dates import months_since
from brickline.functions.numbers import clip_non_negative
from brickline.operators.panel import by_date, forward_fill, lagged, series_with_min_history

SERIES = ["city", "target"]
# Fixed value: normal quantile of a 95 % interval.
Z95 = 1.96
HORIZON = 60
MIN_TRAIN = 36
MIN_VALID = 6
BACKTEST_COLUMNS = [
    "model_name", "target", "city", "horizon_months", "predict_date", "yhat", "yhat_lower", "yhat_upper", "y_true",
]


def backtest_rows(df: DataFrame, models: dict[str, tuple[Column, Column]], cutoff: str = CUTOFF) -> DataFrame:
    """Rows after the cutoff in the forecast-fact layout, one per model.

    ``models`` gives the point forecast and the half interval per model name; all
    models of a month come out of the same input row.
    """
    valid = df.filter((F.col("ds") > F.lit(cutoff).cast("date")) & F.col("y").isNotNull())
    facts = F.array(
        *[
            F.struct(
                F.lit(name).alias("model_name"),
                clip_non_negative(yhat).alias("yhat"),
                clip_non_negative(yhat - spread).alias("yhat_lower"),
                clip_non_negative(yhat + spread).alias("yhat_upper"),
            )
            for name, (yhat, spread) in models.items()
        ]
    )
    opened = valid.select(
        "target",
        "city",
        months_since(F.col("ds"), cutoff).alias("horizon_months"),
        F.col("ds").alias("predict_date"),
        F.col("y").alias("y_true"),
        F.inline(facts),
    )
    return opened.select(*BACKTEST_COLUMNS).filter("yhat is not null")


def _predictors(series: DataFrame, cutoff: str, lags: Sequence[int], ar1: bool) -> DataFrame:
    """Lagged predictors and the first-order fit with their training spreads.

    Coefficients and spreads are window aggregates over the series, so fitting
    and predicting share one shuffle.
    """
    w = Window.partitionBy(*SERIES)
    train = F.col("ds") <= F.lit(cutoff).cast("date")
    out = series_with_min_history(series, SERIES, "y", cutoff, MIN_TRAIN, MIN_VALID, "ds")
    out = out.withColumns({f"p{k}": lagged("y", k, SERIES, "ds") for k in {*lags, 1}})
    names = [f"p{k}" for k in lags]
    if ar1:
        pair = train & F.col("y").isNotNull() & F.col("p1").isNotNull()
        y, x = F.when(pair, F.col("y")), F.when(pair, F.col("p1"))
        slope = F.try_divide(F.covar_pop(y, x).over(w), F.var_pop(x).over(w))
        out = out.withColumns({"__mx": F.avg(x).over(w), "__my": F.avg(y).over(w), "__b": slope})
        out = out.withColumn("par1", F.col("__my") + F.col("__b") * (F.col("p1") - F.col("__mx")))
        names.append("par1")
    spreads = {}
    for n in names:
        error = F.when(train, F.col("y") - F.col(n))
        spreads[f"{n}_sd"] = F.sqrt(F.avg(error * error).over(w)) * Z95
    return out.withColumns(spreads)


def _model(name: str) -> tuple[Column, Column]:
    return F.col(name), F.col(f"{name}_sd")


def backtest_naive(series: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    return backtest_rows(_predictors(series, cutoff, [1], False), {"naive_backtest": _model("p1")}, cutoff)


def backtest_seasonal_naive(series: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    return backtest_rows(_predictors(series, cutoff, [12], False), {"seasonal_naive_backtest": _model("p12")}, cutoff)


def backtest_ar1(series: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """One-step-ahead first-order autoregression fitted on the rows up to the cutoff."""
    return backtest_rows(_predictors(series, cutoff, [], True), {"ar1_backtest": _model("par1")}, cutoff)


def all_backtests(series: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """The three backtests of every series from one pass over the panel."""
    models = {
        "naive_backtest": _model("p1"),
        "seasonal_naive_backtest": _model("p12"),
        "ar1_backtest": _model("par1"),
    }
    return backtest_rows(_predictors(series, cutoff, [1, 12], True), models, cutoff)


def forecast_drift(series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Last value plus h times the mean step; the interval widens with sqrt(h)."""
    w = by_date(SERIES, "ds")
    known = series.filter("y is not null")
    step = F.col("y") - F.lag("y").over(w)
    fit = (
        known.withColumn("__d", step)
        .groupBy(*SERIES)
        .agg(
            F.max("ds").alias("last_ds"),
            F.max_by("y", "ds").alias("last_y"),
            F.min_by("y", "ds").alias("first_y"),
            F.count("y").alias("n"),
            F.stddev_samp("__d").alias("sd"),
        )
        .withColumn("drift", F.try_divide(F.col("last_y") - F.col("first_y"), F.col("n") - 1))
    )
    future = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    yhat = F.col("last_y") + F.col("h") * F.col("drift")
    spread = Z95 * F.col("sd") * F.sqrt("h")
    return future.select(
        F.lit("drift").alias("model_name"),
        "target",
        "city",
        F.col("h").alias("horizon_months"),
        F.add_months("last_ds", F.col("h")).alias("predict_date"),
        clip_non_negative(yhat).alias("yhat"),
        clip_non_negative(yhat - spread).alias("yhat_lower"),
        clip_non_negative(yhat + spread).alias("yhat_upper"),
    )


def filled(series: DataFrame) -> DataFrame:
    """Gap months carry the last value forward, for models that need every month."""
    return series.withColumn("y", forward_fill("y", SERIES, "ds"))
