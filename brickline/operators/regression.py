"""Least squares over many series (or one pooled group) from plain sums.

The normal equations are sums of products, so Spark computes them with partial
aggregation for any group size; only the k x k solve runs in Python, one row per
group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rounds of penalty and variance in turn, and sweeps of coordinate descent in each.
SPARSE_TURNS, SPARSE_SWEEPS = 4, 400


def gram(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """``keys, n, xtx (upper triangle by rows), xty, yy`` over the complete rows."""
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in xs]
    target = F.col(y).cast("double")
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*xs, y]])
    rows = df.filter(complete)
    upper = [F.sum(columns[i] * columns[j]) for i in range(len(xs)) for j in range(i, len(xs))]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*upper).alias("xtx"),
        F.array(*[F.sum(c * target) for c in columns]).alias("xty"),
        F.sum(target * target).alias("yy"),
    )


def square(upper: np.ndarray, k: int) -> np.ndarray:
    """Full symmetric matrix from its upper triangle."""
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = upper
    return full + np.triu(full, 1).T


def solve_ridge(xtx: Column, xty: Column, penalty: Sequence[float]) -> Column:
    """Coefficients of ``(X'X + diag(penalty)) b = X'y`` per row."""
    weights = np.asarray(penalty, dtype=float)

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for upper, rhs in zip(a, b):
            k = len(rhs)
            lhs = square(np.asarray(upper, dtype=float), k) + np.diag(weights)
            out.append(np.linalg.lstsq(lhs, np.asarray(rhs, dtype=float), rcond=None)[0])
        return pd.Series(out)

    return solve(xtx, xty)


def sparse_fit(
    full: np.ndarray, rhs: np.ndarray, n: np.ndarray, yy: np.ndarray, ridge: np.ndarray, chosen: np.ndarray, width: float
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual variance by row, with an absolute-value penalty on the ``chosen`` columns.

    The penalty is that of a Laplace prior of scale ``width`` beside normal errors, so its weight is the residual
    variance over ``width``; both are found in turn. The other columns, with their ridge weights, are solved out
    exactly, and coordinate descent runs over the chosen ones for all rows at once.
    """
    other = ~chosen
    lhs = full + np.diag(ridge)
    cross = lhs[:, other][:, :, chosen]
    solved = np.linalg.solve(lhs[:, other][:, :, other], np.concatenate([cross, rhs[:, other, None]], axis=2))
    by_chosen, base = solved[:, :, :-1], solved[:, :, -1]
    left = lhs[:, chosen][:, :, chosen] - cross.transpose(0, 2, 1) @ by_chosen
    right = rhs[:, chosen] - (cross * base[:, :, None]).sum(1)
    own = np.maximum(left[:, np.arange(left.shape[1]), np.arange(left.shape[1])], 1e-12)
    picked, coefs = np.zeros_like(right), np.zeros_like(rhs)

    def variance_of(b: np.ndarray) -> np.ndarray:
        sse = yy - 2 * (b * rhs).sum(1) + (b * (full @ b[:, :, None])[:, :, 0]).sum(1)
        return np.maximum(sse, 1e-12) / np.maximum(n, 1)

    variance = variance_of(np.linalg.solve(lhs + 1e-9 * np.eye(rhs.shape[1]), rhs[:, :, None])[:, :, 0])
    for _ in range(SPARSE_TURNS):
        bound = variance / width
        for _ in range(SPARSE_SWEEPS):
            before = picked.copy()
            for j in range(picked.shape[1]):
                pull = right[:, j] - (left[:, j] * picked).sum(1) + own[:, j] * picked[:, j]
                picked[:, j] = np.sign(pull) * np.maximum(np.abs(pull) - bound, 0) / own[:, j]
            if np.abs(picked - before).max(initial=0) < 1e-10:
                break
        coefs[:, chosen], coefs[:, other] = picked, base - (by_chosen @ picked[:, :, None])[:, :, 0]
        variance = variance_of(coefs)
    return coefs, variance


def solve_sparse(sums: Sequence[str], penalty: Sequence[float], chosen: Sequence[bool], width: float) -> Column:
    """Coefficients by :func:`sparse_fit` from the columns ``n, xtx, xty, yy`` of :func:`gram`."""
    ridge, marked = np.asarray(penalty, float), np.asarray(chosen, bool)

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, xtx: pd.Series, xty: pd.Series, yy: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype=object)
        full = np.array([square(np.asarray(u, float), len(ridge)) for u in xtx])
        rhs = np.array([np.asarray(v, float) for v in xty])
        coefs, _ = sparse_fit(full, rhs, n.to_numpy(float), yy.to_numpy(float), ridge, marked, width)
        return pd.Series(list(coefs))

    return solve(*sums)


def dot(coefs: Column, xs: Sequence[Column]) -> Column:
    """Sum of coefficient times column, in order."""
    return reduce(lambda a, b: a + b, [F.element_at(coefs, i + 1) * x for i, x in enumerate(xs)])


def fit_ridge(
    df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, penalty: Sequence[float] | float = 1e-6
) -> DataFrame:
    """``keys, n, coefs`` of a ridge fit per group."""
    weights = [penalty] * len(xs) if isinstance(penalty, float) else list(penalty)
    sums = gram(df, keys, xs, y)
    return sums.select(*keys, "n", solve_ridge(F.col("xtx"), F.col("xty"), weights).alias("coefs"))
