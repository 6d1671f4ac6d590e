"""Robust seasonal-trend decomposition by locally weighted lines, for every series of a panel after one shuffle.

A series is one row, bounded by the calendar. Points are a month apart, so a smoother is the same set of tricube
kernels for all series of a length: the five weighted sums of a local line are products with fixed matrices, and only
the robustness weights differ (Cleveland and others 1990).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.plans.baselines import SERIES, filled

PERIOD = 12
# Spans in months (years for the season), and the loops of the robust fit.
SEASON_SPAN, TREND_SPAN, LOW_SPAN = 7, 23, 13
INNER, OUTER = 2, 15


@lru_cache(maxsize=256)
def _kernels(n: int, span: int, before: int, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tricube weights of ``n`` points for targets from ``-before`` to ``n - 1 + after``, times distance to powers 0, 1, 2."""
    target = np.arange(-before, n + after)[:, None]
    away = np.arange(n)[None, :] - target
    near = np.sort(np.abs(away), axis=1)
    # A span longer than the series widens by half of what it lacks.
    width = near[:, min(span, n) - 1] + max(0, span - n) / 2
    width = np.maximum(width, 1e-9)[:, None]
    ratio = np.abs(away) / width
    weight = np.where(ratio >= 0.999, 0.0, np.where(ratio <= 0.001, 1.0, (1 - np.minimum(ratio, 1) ** 3) ** 3))
    return weight.T, (weight * away).T, (weight * away * away).T


def local_line(y: np.ndarray, robust: np.ndarray, span: int, before: int = 0, after: int = 0) -> np.ndarray:
    """Value at each target of the line fitted near it, by row of ``y``; a mean where the points near it give no line.

    Where every point near a target has lost its weight, all of them count alike.
    """
    k0, k1, k2 = _kernels(y.shape[1], span, before, after)
    s0, s1, s2 = robust @ k0, robust @ k1, robust @ k2
    t0, t1 = (robust * y) @ k0, (robust * y) @ k1
    det = s0 * s2 - s1 * s1
    line = det > 1e-9 * np.maximum(s0 * s2, 1e-300)
    held = s0 > 0
    mean = np.where(held, t0 / np.where(held, s0, 1), (y @ k0) / np.maximum(k0.sum(0), 1e-300))
    return np.where(line, (s2 * t0 - s1 * t1) / np.where(line, det, 1), mean)


def _moving(x: np.ndarray, k: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([np.zeros((len(x), 1)), x], axis=1), axis=1)
    return (total[:, k:] - total[:, :-k]) / k


def _weights(rest: np.ndarray) -> np.ndarray:
    """Bisquare weights by the size of the remainder against six times its median."""
    size = np.abs(rest)
    limit = 6 * np.median(size, axis=1, keepdims=True)
    ratio = size / np.where(limit > 0, limit, 1)
    weight = np.where(ratio >= 0.999, 0.0, np.where(ratio <= 0.001, 1.0, (1 - np.minimum(ratio, 1) ** 2) ** 2))
    return np.where(limit > 0, weight, 1.0)


def seasonal_trend(y: np.ndarray, outer: int = OUTER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``trend, seasonal, weight`` of series of one length (rows of ``y``, two years or more)."""
    rows, n = y.shape
    trend, seasonal, robust = np.zeros_like(y), np.zeros_like(y), np.ones_like(y)
    for turn in range(outer + 1):
        for _ in range(INNER):
            detrended = y - trend
            cycle = np.zeros((rows, n + 2 * PERIOD))
            for m in range(PERIOD):
                cycle[:, m::PERIOD] = local_line(detrended[:, m::PERIOD], robust[:, m::PERIOD], SEASON_SPAN, 1, 1)
            low = _moving(_moving(_moving(cycle, PERIOD), PERIOD), 3)
            seasonal = cycle[:, PERIOD:-PERIOD] - local_line(low, np.ones_like(low), LOW_SPAN)
            trend = local_line(y - seasonal, robust, TREND_SPAN)
        if turn < outer:
            robust = _weights(y - trend - seasonal)
    return trend, seasonal, robust


def _decompose_udf():
    @F.pandas_udf("array<struct<trend: double, seasonal: double, weight: double>>")
    def decompose(values: pd.Series) -> pd.Series:
        out = [None] * len(values)
        lengths = values.map(len)
        for n in lengths.unique():
            at = np.flatnonzero(lengths == n)
            if n < 2 * PERIOD:
                for k in at:
                    out[k] = [(None, None, None)] * n
                continue
            for part in np.array_split(at, -(-len(at) // 256)):
                parts = seasonal_trend(np.array([values.iloc[k] for k in part], float))
                for k, *columns in zip(part, *(p.tolist() for p in parts)):
                    out[k] = list(zip(*columns))
        return pd.Series(out)

    return decompose


def robust_decomposition(panel: DataFrame) -> DataFrame:
    """``city, target, ds, y, trend, seasonal, resid, weight``: a value far from the others loses its weight, not the season its form.

    Gaps carry the last value forward; months before the first value are left out. Series of under two years get null
    parts, an empty panel an empty table.
    """
    tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = filled(panel.repartition(tasks, *SERIES)).filter(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")))
    months = F.array_sort(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y"))))
    rows = known.groupBy(*SERIES).agg(months.alias("s")).withColumn("p", _decompose_udf()(F.col("s.y")))
    opened = rows.select(*SERIES, F.inline(F.arrays_zip("s", "p")))
    return opened.select(
        *SERIES, "s.ds", "s.y", "p.trend", "p.seasonal", (F.col("s.y") - F.col("p.trend") - F.col("p.seasonal")).alias("resid"), "p.weight"
    )
