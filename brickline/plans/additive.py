"""Additive trend, season and regressor model for every series of a panel.

The trend is a line whose slope may change at any of a row of candidate months; an absolute-value penalty keeps the
changes that the data ask for and sets the others to zero. Ahead of the data the slope goes on changing as often and as
strongly as it did, so the band widens with the horizon.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.bindings import CUTOFF
from brickline.functions.dates import months_since
from brickline.functions.numbers import clip_non_negative
from brickline.operators.panel import series_with_min_history, whole, zscore
from brickline.operators.regression import dot, gram, solve_sparse
from brickline.plans.baselines import BACKTEST_COLUMNS, HORIZON, SERIES

# Model shape, penalties, history limits, the interval quantiles and the normal value at the upper one.
KNOTS = 12
KNOT_SPAN = 0.8
FOURIER = 3
KNOT_WIDTH = 0.05
OTHER_PENALTY = 1e-4
MIN_POINTS = 24
MIN_VALID = 6
LOWER_Q, UPPER_Q = 0.1, 0.9
UPPER_Z = 1.2816


def _scaled_regressors(df: DataFrame, regressors: list[str], train: Column | None) -> DataFrame:
    """Regressors as z-scores per series; missing values sit at the mean."""
    return df.withColumns({f"r_{c}": F.coalesce(zscore(c, SERIES, train), F.lit(0.0)) for c in regressors})


def _design(df: DataFrame, regressors: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns of the linear model from ``tau`` (0..1 over the training span) and the month."""
    columns = {"x_one": F.lit(1.0), "x_trend": F.col("tau")}
    for k in range(KNOTS):
        at = KNOT_SPAN * (k + 1) / (KNOTS + 1)
        columns[f"x_knot{k}"] = F.greatest(F.lit(0.0), F.col("tau") - at)
    for k in range(1, FOURIER + 1):
        angle = F.month("ds") * (2 * math.pi * k / 12)
        columns[f"x_sin{k}"], columns[f"x_cos{k}"] = F.sin(angle), F.cos(angle)
    for c in regressors:
        columns[f"x_{c}"] = F.col(f"r_{c}")
    return df.withColumns(columns), list(columns)


def _clock(df: DataFrame, train: Column | None) -> DataFrame:
    """Months since the first one over the months of the training span, and the value scale."""
    inside = F.lit(True) if train is None else train
    w = whole(SERIES)
    first = F.min("ds").over(w)
    last = F.max(F.when(inside, F.col("ds"))).over(w)
    scale = F.max(F.when(inside, F.abs("y"))).over(w)
    return df.withColumns({"first_ds": first, "last_ds": last, "scale": scale}).withColumn("tau", _tau())


def _tau() -> Column:
    return F.try_divide(
        F.months_between("ds", "first_ds"), F.greatest(F.lit(1.0), F.months_between("last_ds", "first_ds"))
    )


def _fit(rows: DataFrame, names: list[str], train: Column | None) -> DataFrame:
    """``coefs`` on the scaled target, the mean change ``turn`` of the slope at a knot, and the residual quantiles per series."""
    scaled = rows.withColumn("y_scaled", F.try_divide(F.col("y"), F.col("scale")))
    fit_rows = scaled if train is None else scaled.filter(train)
    knots = [n.startswith("x_knot") for n in names]
    penalty = [0.0 if knot else OTHER_PENALTY for knot in knots]
    sums = gram(fit_rows, SERIES, names, "y_scaled")
    coefs = solve_sparse(["n", "xtx", "xty", "yy"], penalty, knots, KNOT_WIDTH)
    turn = sum((F.abs(F.element_at("coefs", i + 1)) for i, knot in enumerate(knots) if knot), F.lit(0.0)) / KNOTS
    model = sums.select(*SERIES, coefs.alias("coefs")).withColumn("turn", turn)
    error = F.col("y_scaled") - dot(F.col("coefs"), [F.col(c) for c in names])
    # A series is bounded by the calendar, so the plain percentile buffer is small.
    spread = fit_rows.join(model, SERIES).groupBy(*SERIES).agg(
        F.percentile(error, LOWER_Q).alias("lo"), F.percentile(error, UPPER_Q).alias("hi")
    )
    return model.join(spread, SERIES)


def _predict(names: list[str]) -> dict[str, Column]:
    """Forecast and band: residual quantiles, and ahead of the data the spread of a trend that keeps turning.

    Turns come at the rate of the knots, their size is Laplace with the mean of the fitted ones. Those between the last
    knot and the end of the data leave the slope in doubt, which moves a later month by the time ahead; those ahead move
    it by the time since, so the variance of their sum grows with the third power of the time.
    """
    yhat = dot(F.col("coefs"), [F.col(c) for c in names])
    ahead = F.greatest(F.lit(0.0), F.col("tau") - 1)
    unseen = 1 - KNOT_SPAN * KNOTS / (KNOTS + 1)
    wander = UPPER_Z * F.col("turn") * F.sqrt(2 * (KNOTS + 1) / KNOT_SPAN * (unseen * ahead * ahead + F.pow(ahead, 3.0) / 3))

    low, high = F.least(F.lit(0.0), F.col("lo")), F.greatest(F.lit(0.0), F.col("hi"))
    return {
        "yhat": clip_non_negative(yhat * F.col("scale")),
        "yhat_lower": clip_non_negative((yhat - F.hypot(low, wander)) * F.col("scale")),
        "yhat_upper": clip_non_negative((yhat + F.hypot(high, wander)) * F.col("scale")),
    }


def forecast_additive(panel: DataFrame, regressors: list[str], horizon: int = HORIZON) -> DataFrame:
    """Fit each series and extend it; the last known regressor values are held."""
    enough = panel.withColumn("__n", F.count("y").over(whole(SERIES))).filter(F.col("__n") >= MIN_POINTS).drop("__n")
    rows = _clock(_scaled_regressors(enough, regressors, None), None)
    history, names = _design(rows, regressors)
    model = _fit(history, names, None)
    held = ["first_ds", "last_ds", "scale", *[f"r_{c}" for c in regressors]]
    last = rows.groupBy(*SERIES).agg(F.max_by(F.struct(*held), "ds").alias("l")).select(*SERIES, "l.*")
    future = last.withColumn("horizon_months", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "ds", F.add_months("last_ds", F.col("horizon_months"))
    )
    steps, _ = _design(future.withColumn("tau", _tau()), regressors)
    return steps.join(model, SERIES).select(
        F.lit("additive").alias("model_name"),
        "target",
        "city",
        "horizon_months",
        F.col("ds").alias("predict_date"),
        *[c.alias(n) for n, c in _predict(names).items()],
    )


def backtest_additive(panel: DataFrame, regressors: list[str], cutoff: str = CUTOFF) -> DataFrame:
    """Fit on rows up to the cutoff, predict later rows with their actual regressors."""
    train = F.col("ds") <= F.lit(cutoff).cast("date")
    kept = series_with_min_history(panel, SERIES, "y", cutoff, MIN_POINTS, MIN_VALID, "ds").drop("split")
    rows = _clock(_scaled_regressors(kept, regressors, train), train)
    history, names = _design(rows, regressors)
    model = _fit(history, names, train)
    valid = history.filter(~train & F.col("y").isNotNull()).join(model, SERIES)
    return valid.select(
        F.lit("additive_backtest").alias("model_name"),
        "target",
        "city",
        months_since(F.col("ds"), cutoff).alias("horizon_months"),
        F.col("ds").alias("predict_date"),
        *[c.alias(n) for n, c in _predict(names).items()],
        F.col("y").alias("y_true"),
    ).select(*BACKTEST_COLUMNS)
