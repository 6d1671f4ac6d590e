"""A price index from repeat sales, by weighted least squares on the graph of months.

Each pair of sales of one unit is an edge between two months. All that the fit needs of the pairs is their number, sum
and sum of squares per region and pair of months, so facts are grouped once and the rest is as large as the calendar.
Three stages: a plain fit; squared errors fitted on the time between the sales; a fit weighted by their inverse. The
normal equations are a weighted Laplacian, solved by conjugate gradients over its edges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.functions.dates import month_floor
from brickline.plans.listings import repeat_sales_pairs
from brickline.session import settle

# Relative size of the residual at which a solve ends.
SETTLED = 1e-12
# Smallest fitted error variance, as a share of the mean squared error.
LEAST_VARIANCE = 1e-3


def pair_sums(sales: DataFrame, regions: Sequence[str]) -> DataFrame:
    """``regions, first_month, second_month, n, total, squares`` of the log changes between consecutive sales.

    Both sales must have a positive price and lie in different months. A unit belongs to the regions of its later sale.
    """
    priced = sales.where("price > 0 and date_posted is not null and unit_id is not null")
    months = {"first_month": month_floor(F.col("first_date")), "second_month": month_floor(F.col("second_date"))}
    pairs = repeat_sales_pairs(priced, keep=regions).withColumns(months).where("first_month < second_month")
    return pairs.groupBy(*regions, *months).agg(
        F.count("*").alias("n"), F.sum("log_change").alias("total"), F.sum(F.col("log_change") * F.col("log_change")).alias("squares")
    )


def components(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Smallest node of each node's connected component."""
    label = np.arange(size)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def solve_laplacian(a: np.ndarray, b: np.ndarray, weight: np.ndarray, rhs: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """``x`` with ``L x = rhs`` for the edges' Laplacian and ``x = 0`` at the fixed nodes.

    Conjugate gradients scaled by the diagonal; one product is one pass over the edges.
    """
    size = len(rhs)
    degree = np.bincount(a, weight, size) + np.bincount(b, weight, size)
    scale = np.where(fixed | (degree == 0), 0.0, 1 / np.where(degree > 0, degree, 1.0))

    def times(x: np.ndarray) -> np.ndarray:
        flow = weight * (x[a] - x[b])
        return np.where(fixed, 0.0, np.bincount(a, flow, size) - np.bincount(b, flow, size))

    x, r = np.zeros(size), np.where(fixed, 0.0, rhs)
    z = scale * r
    p, rz = z.copy(), float(r @ z)
    end = SETTLED**2 * rz
    for _ in range(20 * size):
        if rz <= end or rz == 0:
            break
        q = times(p)
        step = rz / float(p @ q)
        x += step * p
        r -= step * q
        z = scale * r
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    return x


def fit_index(a: np.ndarray, b: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(log index, component)`` of each month number, from the sums of the pairs of months ``a`` to ``b``."""
    label = components(a, b, size)
    fixed = label == np.arange(size)

    def solve(weight: np.ndarray) -> np.ndarray:
        rhs = np.bincount(b, weight * total, size) - np.bincount(a, weight * total, size)
        return solve_laplacian(a, b, weight * n, rhs, fixed)

    x = solve(np.ones(len(a)))
    rise = x[b] - x[a]
    errors = np.maximum(squares - 2 * rise * total + n * rise * rise, 0.0)
    mean = errors.sum() / n.sum()
    if mean <= SETTLED:
        return x, label
    gap = (b - a).astype(float)
    centre = (n * gap).sum() / n.sum()
    spread = (n * (gap - centre) ** 2).sum()
    slope = ((gap - centre) * errors).sum() / spread if spread > 0 else 0.0
    variance = np.maximum(mean + slope * (gap - centre), LEAST_VARIANCE * mean)
    return solve(mean / variance), label


def index_from_sums(sums: DataFrame, regions: Sequence[str]) -> DataFrame:
    """``regions, date, base_date, log_index, price_index, n_pairs`` from ``pair_sums``.

    A month's index is 100 times the exponent of its log index, which is 0 at the base: the first month of those that
    pairs connect with it. Months that no pair touches have no row.
    """
    kinds = dict(sums.dtypes)
    schema = ", ".join(f"`{r}` {kinds[r]}" for r in regions) + ", date date, base_date date, log_index double, price_index double, n_pairs long"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        month = lambda c: pd.DatetimeIndex(pd.to_datetime(rows[c]))
        first, second = month("first_month"), month("second_month")
        a, b = (m.year.to_numpy() * 12 + m.month.to_numpy() - 1 for m in (first, second))
        start = int(a.min())
        a, b, size = a - start, b - start, int(b.max()) - start + 1
        n = rows["n"].to_numpy()
        x, label = fit_index(a, b, n.astype(float), rows["total"].to_numpy(), rows["squares"].to_numpy(), size)
        pairs = np.bincount(a, n, size) + np.bincount(b, n, size)
        there = np.flatnonzero(pairs)
        date = [pd.Timestamp((start + k) // 12, (start + k) % 12 + 1, 1).date() for k in range(size)]
        out = pd.DataFrame({"date": [date[k] for k in there], "base_date": [date[label[k]] for k in there], "log_index": x[there]})
        out["price_index"], out["n_pairs"] = 100 * np.exp(out["log_index"]), pairs[there].astype("int64")
        for place, r in enumerate(regions):
            out.insert(place, r, rows[r].iloc[0])
        return out

    return sums.groupBy(*regions).applyInPandas(solve, schema)


def repeat_sales_index(sales: DataFrame, regions: Sequence[str] = ("province",)) -> DataFrame:
    """Monthly index of each region; no pair of sales in a region, no rows for it."""
    return index_from_sums(settle(pair_sums(sales, regions), "repeat-sales-sums"), regions)
