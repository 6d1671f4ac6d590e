"""Periods that resemble each other: distances between all windows of months of a city, over several measures.

A city is one row, bounded by the calendar. For each distance in time the squared differences of the months are formed
once, and their sliding sums are the distances of every pair of windows that far apart; pairs are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTHS = (12, 24)
# Digits of a squared distance that count when windows are compared; equal ones go to the earlier window.
DIGITS = 6


def _sliding(values: np.ndarray, months: Sequence[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(length, lag, squared)``: squared distances of windows that do not overlap.

    Entry ``j`` is that of the windows ending at ``j + length - 1`` and ``lag`` later.
    """
    for lag in range(min(months), len(values)):
        apart = ((values[lag:] - values[:-lag]) ** 2).sum(1)
        for length in months:
            if length <= lag and length <= len(apart):
                windows = np.lib.stride_tricks.sliding_window_view(apart, length)
                yield length, lag, np.round(windows.sum(1), DIGITS)


def nearest_windows(values: np.ndarray, months: Sequence[int]) -> list[tuple[int, int, int, float]]:
    """``(length, end, end of the nearest window, squared distance)`` of every window that has another beside it."""
    n, out = len(values), []
    best = {length: np.full((2, n), np.inf) for length in months}
    where = {length: np.zeros((2, n), int) for length in months}
    for length, lag, squared in _sliding(values, months):
        early = np.arange(len(squared)) + length - 1
        late = early + lag
        # Among earlier windows a later lag, among later windows an earlier lag, is the earlier window.
        better = squared <= best[length][0, late]
        best[length][0, late[better]], where[length][0, late[better]] = squared[better], early[better]
        better = squared < best[length][1, early]
        best[length][1, early[better]], where[length][1, early[better]] = squared[better], late[better]
    for length in months:
        side = (best[length][1] < best[length][0]).astype(int)
        for end in np.flatnonzero(np.isfinite(best[length].min(0))):
            out.append((length, int(end), int(where[length][side[end], end]), float(best[length][side[end], end])))
    return out


def newest_against_past(values: np.ndarray, months: Sequence[int]) -> list[tuple[int, int, int, float]]:
    """The newest window of each length against every earlier one that it does not overlap."""
    last = len(values) - 1
    return [(length, last, last - lag, float(squared[-1])) for length, lag, squared in _sliding(values, months)]


def _distances(scored: DataFrame, columns: Sequence[str], months: Sequence[int], compare) -> DataFrame:
    """``city, months, date, match_date, distance``; one shuffle by city."""

    @F.pandas_udf("array<struct<months: int, at: int, match: int, squared: double>>")
    def distances(*measures: pd.Series) -> pd.Series:
        return pd.Series([compare(np.stack([np.asarray(m, float) for m in row], axis=1), months) for row in zip(*measures)], dtype=object)

    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = {f"m{i}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(columns)}
    rows = scored.repartition(tasks, "city").select("city", "date", *[c.alias(n) for n, c in named.items()])
    series = rows.groupBy("city").agg(F.array_sort(F.collect_list(F.struct("date", *named))).alias("s"))
    found = series.select("city", F.col("s.date").alias("dates"), F.explode(distances(*[F.col(f"s.{n}") for n in named])).alias("f"))

    def date(place: str) -> Column:
        return F.get("dates", F.col(place))

    return found.select(
        "city", "f.months", date("f.at").alias("date"), date("f.match").alias("match_date"), F.sqrt("f.squared").alias("distance")
    )


def period_profile(scored: DataFrame, columns: Sequence[str], months: Sequence[int] = MONTHS) -> DataFrame:
    """Each window, named by its last month, with the window most like it: ``city, months, date, match_date, distance``.

    Windows do not overlap their match; equally near ones go to the earlier. One row per city and month without gaps is
    expected; nulls and NaN count as zero, the mean of a z-score. A city of under two windows has no row, an empty
    table gives an empty result.
    """
    return _distances(scored, columns, months, nearest_windows)


def period_matches(scored: DataFrame, columns: Sequence[str], months: Sequence[int] = MONTHS, top: int = 5) -> DataFrame:
    """The ``top`` past windows most like a city's newest one, nearest first, with ``rank``; rules as in `period_profile`."""
    found = _distances(scored, columns, months, newest_against_past)
    nearest = Window.partitionBy("city", "months").orderBy("distance", "match_date")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= top)
