"""Anomaly detectors over all series of a panel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["city", "target"]
# Detector limits.
Z_LIMIT = 2.0
MAD_LIMIT = 3.5
MAD_SCALE = 0.6745
# Isolation forest settings.
CONTAMINATION = 0.1
TREES = 100
SAMPLE = 256
SEED = 42


def _signals(df: DataFrame, keys: Sequence[str], score: Column, flag: Column, model: str) -> DataFrame:
    return df.select(
        *keys,
        F.col("ds").alias("detect_date"),
        F.col("y").alias("value"),
        score.alias("anomaly_score"),
        F.coalesce(flag, F.lit(False)).alias("is_anomaly"),
        F.lit(model).alias("model_name"),
    )


def detect_zscore(series: DataFrame, keys: Sequence[str] = SERIES, limit: float = Z_LIMIT) -> DataFrame:
    """Population z-score magnitude per series."""
    w = Window.partitionBy(*keys)
    z = F.abs(F.try_divide(F.col("y") - F.avg("y").over(w), F.stddev_pop("y").over(w)))
    scored = series.filter("y is not null").withColumn("__z", z)
    return _signals(scored, keys, F.col("__z"), F.col("__z") > limit, "zscore")


def detect_mad(series: DataFrame, keys: Sequence[str] = SERIES, limit: float = MAD_LIMIT) -> DataFrame:
    """Modified z-score from the median absolute deviation. Series are bounded by the calendar."""
    w = Window.partitionBy(*keys)
    scored = (
        series.filter("y is not null")
        .withColumn("__dev", F.abs(F.col("y") - F.median("y").over(w)))
        .withColumn("__score", F.try_divide(MAD_SCALE * F.col("__dev"), F.median("__dev").over(w)))
    )
    return _signals(scored, keys, F.col("__score"), F.col("__score") > limit, "mad")


def detect_on_forecast(facts: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """The z-score detector on the forecast path of each horizon."""
    paths = facts.select(
        "city",
        "target",
        "horizon_months",
        F.col("predict_date").alias("ds"),
        F.col("yhat").alias("y"),
        F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"),
    ).filter("horizon_months <= horizon")
    return detect_zscore(paths, [*SERIES, "horizon"], 1.5)


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    return np.where(n > 1, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, 0.0)


def _tree_depth(sample: np.ndarray, y: np.ndarray, rng: np.random.Generator, limit: int) -> np.ndarray:
    """Depth at which one random univariate tree isolates each value of ``y``.

    All values go down one level at a time. A node is a run of the sorted sample,
    known by its first position, which also addresses the node's random cut.
    """
    s = np.sort(sample)
    lo = np.zeros(len(y), dtype=int)
    hi = np.full(len(y), len(s))
    depth = np.zeros(len(y))
    for _ in range(limit):
        low, high = s[lo], s[hi - 1]
        open_ = high > low
        if not open_.any():
            break
        cut = low + rng.uniform(size=len(s))[lo] * (high - low)
        at = np.clip(np.searchsorted(s, cut), lo + 1, np.maximum(hi - 1, lo + 1))
        left = y < cut
        hi = np.where(open_ & left, at, hi)
        lo = np.where(open_ & ~left, at, lo)
        depth += open_
    return depth + _average_path(hi - lo)


def forest_scores(y: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Isolation score in (0, 1]; larger is more isolated."""
    rng = np.random.default_rng(seed)
    size = min(SAMPLE, len(y))
    limit = int(np.ceil(np.log2(max(size, 2))))
    depth = np.zeros(len(y))
    for _ in range(TREES):
        depth += _tree_depth(rng.choice(y, size, replace=False), y, rng, limit)
    norm = float(_average_path(size))
    return np.power(2.0, -depth / TREES / norm) if norm else np.full(len(y), 0.5)


def detect_forest(series: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Isolation forest per series: a row holds a series, bounded by the calendar, and a task takes rows in batches.

    Flagged is what scores above the ``1 - contamination`` quantile of its series' scores, in short series too; where
    all score alike nothing is.
    """

    @F.pandas_udf("array<struct<score: double, flagged: boolean>>")
    def score(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            scores = forest_scores(np.asarray(v, dtype=float))
            flagged = scores > np.quantile(scores, 1 - contamination) + 1e-12
            out.append(list(zip(scores.tolist(), flagged.tolist())))
        return pd.Series(out, dtype=object)

    # Few bytes but much work per series: a fixed spread keeps adaptive merging from making one task of it.
    spread = series.sparkSession.sparkContext.defaultParallelism
    known = series.filter("y is not null").select("city", "target", "ds", F.col("y").cast("double")).repartition(spread, *SERIES)
    rows = known.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("s"))
    opened = rows.select(*SERIES, F.inline(F.arrays_zip("s", score(F.col("s.y")).alias("f"))))
    scored = opened.select(*SERIES, "s.ds", "s.y", "f.score", "f.flagged")
    return _signals(scored, SERIES, F.col("score"), F.col("flagged"), "isolation_forest")
