"""Seasonal decomposition, unit-root test and period similarity, from windows and sums."""

from __future__ import annotations

from collections.abc import Sequence
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickline.operators.panel import by_date, lagged, whole
from brickline.operators.regression import gram, square
from brickline.plans.baselines import SERIES, filled

# Fixed value: 5 % critical value of the unit-root test with a constant, about 100 points.
CRITICAL_5 = -2.89
# Critical values of the test with a constant, as a polynomial in one over the number of rows (MacKinnon 2010),
# and the polynomials of its p-value below and above the turn (MacKinnon 1994).
CRITICAL = {
    "critical_1": (-3.43035, -6.5393, -16.786, -79.433),
    "critical_5": (-2.86154, -2.8903, -4.234, -40.040),
    "critical_10": (-2.56677, -1.5384, -2.809, 0.0),
}
P_TURN, P_LOWEST, P_HIGHEST = -1.61, -18.83, 2.74
P_BELOW = (2.1659, 1.4412, 0.038269)
P_ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)
MAX_LAG = 12


def decompose(panel: DataFrame) -> DataFrame:
    """Classical additive decomposition, period 12: centred 2x12 mean, monthly means, remainder."""
    w = by_date(SERIES, "ds")
    full = F.count("y").over(w.rowsBetween(-6, 6)) == 13
    left, right = F.sum("y").over(w.rowsBetween(-6, 5)), F.sum("y").over(w.rowsBetween(-5, 6))
    trended = filled(panel).withColumn("trend", F.when(full, (left + right) / 24))
    month = Window.partitionBy(*SERIES, F.month("ds"))
    raw = trended.withColumn("__d", F.col("y") - F.col("trend")).withColumn("__m", F.avg("__d").over(month))
    first = F.row_number().over(Window.partitionBy(*SERIES, F.month("ds")).orderBy("ds")) == 1
    level = raw.withColumn("__one", F.when(first, F.col("__m")))
    seasonal = F.col("__m") - F.avg("__one").over(Window.partitionBy(*SERIES))
    return level.withColumn("seasonal", seasonal).select(
        *SERIES, "ds", "y", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("resid")
    )


def unit_root(panel: DataFrame) -> DataFrame:
    """Dickey-Fuller regression of the change on the previous value: t statistic per series."""
    rows = filled(panel).withColumn("x", lagged("y", 1, SERIES, "ds")).withColumn("d", F.col("y") - F.col("x"))
    d, x = F.col("d"), F.col("x")
    sums = rows.groupBy(*SERIES).agg(
        F.regr_count(d, x).alias("n_obs"),
        F.regr_slope(d, x).alias("b"),
        F.regr_sxx(d, x).alias("sxx"),
        F.regr_syy(d, x).alias("syy"),
        F.regr_sxy(d, x).alias("sxy"),
    )
    sigma2 = F.try_divide(F.col("syy") - F.col("b") * F.col("sxy"), F.col("n_obs") - 2)
    t = F.try_divide(F.col("b"), F.sqrt(F.try_divide(sigma2, F.col("sxx"))))
    return sums.select(*SERIES, "n_obs", t.alias("t_stat"), F.coalesce(t < CRITICAL_5, F.lit(False)).alias("is_stationary"))


def unit_root_p(t: float) -> float:
    """Probability of a test value as low as ``t`` for a series with a unit root, by the response surface."""
    if t > P_HIGHEST:
        return 1.0
    if t < P_LOWEST:
        return 0.0
    powers = P_BELOW if t <= P_TURN else P_ABOVE
    return 0.5 * (1 + erf(sum(c * t**k for k, c in enumerate(powers)) / sqrt(2)))


def _nested_test(fixed: int | None):
    """Test value of one series from its sums: lag orders are leading blocks of the same normal equations."""

    @F.pandas_udf("struct<lags: int, t_stat: double, p_value: double>")
    def test(n: pd.Series, xtx: pd.Series, xty: pd.Series, yy: pd.Series) -> pd.DataFrame:
        out = []
        for count, upper, rhs, total in zip(n, xtx, xty, yy):
            rhs = np.asarray(rhs, float)
            full, best = square(np.asarray(upper, float), len(rhs)), None
            for lags in range(len(rhs) - 1) if fixed is None else [fixed]:
                size = lags + 2
                block = full[:size, :size]
                if count <= size + 1 or np.linalg.matrix_rank(block, hermitian=True) < size:
                    break
                inverse = np.linalg.inv(block)
                b = inverse @ rhs[:size]
                sse = total - b @ rhs[:size]
                if sse <= 1e-12 * total:
                    break
                aic = count * np.log(sse / count) + 2 * size
                if best is None or aic < best[0]:
                    best = aic, lags, float(b[1] / np.sqrt(sse / (count - size) * inverse[1, 1]))
            out.append((None, None, None) if best is None else (best[1], best[2], unit_root_p(best[2])))
        frame = pd.DataFrame(out, columns=["lags", "t_stat", "p_value"])
        return frame.astype({"lags": "Int32", "t_stat": "float64", "p_value": "float64"})

    return test


def critical_value(n: Column, powers: Sequence[float]) -> Column:
    x = F.try_divide(F.lit(1.0), n)
    return powers[0] + x * (powers[1] + x * (powers[2] + x * powers[3]))


def augmented_unit_root(panel: DataFrame, max_lag: int = MAX_LAG, fixed: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant: ``n_obs, lags, t_stat, p_value, critical_1, _5, _10, is_stationary``.

    The number of lagged changes, up to ``max_lag``, is the one of least AIC on the rows that have all of them (the
    fewest, if equal), or ``fixed``. Values are centred and scaled first, which leaves the test as it is. Where no
    regression has a residual (constant, straight or very short series) the values are null and nothing is stationary;
    series without a row that has all lags are left out, so an empty panel gives an empty table.
    """
    lags = max_lag if fixed is None else fixed
    every = whole(SERIES)
    spread = F.stddev_pop("y").over(every)
    scaled = filled(panel).withColumn("y", F.coalesce(F.try_divide(F.col("y") - F.avg("y").over(every), spread), F.col("y") * 0))
    rows = scaled.withColumn("x", lagged("y", 1, SERIES, "ds")).withColumn("d", F.col("y") - F.col("x"))
    rows = rows.withColumns({f"d{k}": lagged("d", k, SERIES, "ds") for k in range(1, lags + 1)}).withColumn("one", F.lit(1.0))
    sums = gram(rows, SERIES, ["one", "x", *[f"d{k}" for k in range(1, lags + 1)]], "d")
    tested = sums.withColumn("m", _nested_test(fixed)("n", "xtx", "xty", "yy"))
    return tested.select(
        *SERIES,
        F.col("n").alias("n_obs"),
        "m.lags",
        "m.t_stat",
        "m.p_value",
        *[critical_value(F.col("n"), powers).alias(name) for name, powers in CRITICAL.items()],
        F.coalesce(F.col("m.p_value") <= 0.05, F.lit(False)).alias("is_stationary"),
    )


def period_similarity(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cosine between each past month's vector of a city and its newest month's vector."""
    vector = F.array(*[F.coalesce(c, F.lit(0.0)) for c in columns])
    rows = scored.select("city", "date", vector.alias("v"))
    newest = Window.partitionBy("city")
    paired = rows.withColumn("now", F.max_by("v", "date").over(newest)).withColumn("last", F.max("date").over(newest))

    def inner(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    norm = F.sqrt(inner("v", "v")) * F.sqrt(inner("now", "now"))
    return paired.filter("date < last").select("city", "date", F.try_divide(inner("v", "now"), norm).alias("similarity"))
