"""Whitening of embeddings by their leading principal components.

The fit list holds each distinct vector once, as whole numbers (``floor(256 c)``). Its scatter is centred before it is
multiplied: tasks subtract the mean rounded to whole numbers, so that products and sums are exact, and the driver
takes off what the rounding left, in whole numbers too. The covariance is factored by pivoted Cholesky; one-sided Jacobi
rotates the columns of the triangular factor until they are orthogonal. Their squared norms are the eigenvalues, the
columns over their norms the components.

Only matrices of the vectors' dimension reach the driver; rows stay in Spark throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.session import settle

SCALE = 256
# Rows that are multiplied at once in a task.
ROWS = 4096
# Column pairs count as orthogonal below this cosine; sweeps end there, or at the bound.
COSINE, SWEEPS = 1e-15, 60
# Sums of all tasks are added up in this many tasks before they reach the driver.
ADDERS = 4
# Largest magnitudes that whole numbers of 64 bits, and doubles, hold exactly.
WHOLE, EXACT = 2**62, 2**53
OUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """``mean`` is ``sums / n``; ``directions`` has a component in each row, ``values`` their eigenvalues."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, x`` of the rows that take part, entries as whole numbers.

    A vector that is null or holds null, NaN or infinite entries takes no part, nor one whose length is not the
    commonest of the table (the longer of equally common ones). Entries beyond 64 bits become the nearest long.
    """
    entries = vectors.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    usual = entries.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    length = usual["d"] if usual else 0
    return entries.where(F.size("v") == length).select(key, F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of ``part`` of their matrix, a flat array of ``size`` doubles; at most ADDERS arrays reach the driver."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                total += part(matrix(batch.slice(at, ROWS)))
        yield pa.record_batch({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += matrix(batch, "s").sum(axis=0)
        yield pa.record_batch({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    partial = rows.mapInArrow(in_task, "s array<double>")
    found = partial.repartition(ADDERS).mapInArrow(add, "s array<double>").collect()
    return np.sum([r["s"] for r in found], axis=0) if found else np.zeros(size)


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Row count and exact sum of each dimension; high and low halves are summed apart."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, [0] * d, [0] * d
        for batch in batches:
            x = matrix(batch)
            n += len(x)
            low = [a + int(b) for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0))]
            high = [a + int(b) for a, b in zip(high, (x >> 32).sum(axis=0))]
        rows = [(-1, n), *((i, low[i] + (high[i] << 32)) for i in range(d))]
        yield pa.record_batch({"i": pa.array([r[0] for r in rows], pa.int32()), "s": pa.array([str(r[1]) for r in rows])})

    parts = fit.mapInArrow(in_task, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["i"]: int(r["s"]) for r in parts.collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n, centred before multiplying; exact up to the last rounding while sums stay below 2^53."""
    d = len(sums)
    middle = [(2 * s + n) // (2 * n) for s in sums]

    def part(x: np.ndarray) -> np.ndarray:
        c = (x - np.array(middle, dtype=np.int64)).astype(np.float64)
        return (c.T @ c).ravel()

    scatter = summed(fit, part, d * d).reshape(d, d)
    rest = [s - n * m for s, m in zip(sums, middle)]
    if np.abs(scatter).max() < EXACT:
        return np.array([[(n * int(scatter[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    off = np.array([r / n for r in rest])
    return scatter / n - np.outer(off, off)


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(factor, order)``: ``v[order][:, order] = factor @ factor.T``, with as many columns as the rank."""
    v = v.copy()
    d = len(v)
    order, factor = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(v.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(v.diagonal()[k:]))
        if v[p, p] <= least:
            return factor[:, :k], order
        for a in (v, v.T, factor, order):
            a[[k, p]] = a[[p, k]]
        factor[k, k] = np.sqrt(v[k, k])
        factor[k + 1 :, k] = v[k + 1 :, k] / factor[k, k]
        v[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """Rotates pairs of columns until all are orthogonal; a round turns half of the columns against the other half."""
    rows = factor.T.copy()
    if len(rows) % 2:
        rows = np.vstack([rows, np.zeros(rows.shape[1])])
    half, ring = len(rows) // 2, np.arange(len(rows))
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(rows) - 1):
            i, j = ring[:half], ring[half:][::-1]
            a, b = rows[i], rows[j]
            aa, bb, ab = (a * a).sum(axis=1), (b * b).sum(axis=1), (a * b).sum(axis=1)
            size = np.sqrt(aa * bb)
            cosine = np.divide(np.abs(ab), size, out=np.zeros(half), where=size > 0)
            worst = max(worst, cosine.max())
            turn = cosine > COSINE
            z = np.divide(bb - aa, 2 * ab, out=np.zeros(half), where=turn)
            t = np.where(turn, np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            rows[i], rows[j] = c[:, None] * a - (c * t)[:, None] * b, (c * t)[:, None] * a + c[:, None] * b
            ring[1:] = np.roll(ring[1:], 1)
        if worst <= COSINE:
            break
    return rows.T[:, : factor.shape[1]] if len(rows) == factor.shape[1] else rows.T


def eigen(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading components, one a row, and their eigenvalues; the largest entry of a component is positive."""
    factor, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    found = [k for k in np.argsort(-norms, kind="stable") if norms[k] > 0][:most]
    directions = np.zeros((len(found), len(v)))
    for row, k in enumerate(found):
        directions[row, order] = turned[:, k] / norms[k]
        if directions[row, np.argmax(np.abs(directions[row]))] < 0:
            directions[row] *= -1
    return directions, norms[found] ** 2


def fit_whitening(fit: DataFrame, components: int) -> Whitening | None:
    """The whitening of a table of distinct vectors ``x``; None where it has no rows, no dimension or no variance."""
    first = fit.first()
    d = len(first["x"]) if first else 0
    if d == 0:
        return None
    n, sums = column_sums(fit, d)
    v = covariance(fit, n, sums)
    directions, values = eigen(v, components)
    return Whitening(n, sums, directions, values, float(v.trace())) if len(values) else None


def numerators(x: np.ndarray, model: Whitening) -> np.ndarray:
    """``n x - S``, exact; Python numbers where 64 bits could overflow."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if model.n * top + max(map(abs, model.sums)) < WHOLE:
        return model.n * x - np.array(model.sums, dtype=np.int64)
    return model.n * x.astype(object) - np.array(model.sums, dtype=object)


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    centred = (numerators(x, model) / model.n).astype(np.float64)
    return centred @ model.directions.T / np.sqrt(model.values)


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums of squares; None beyond 38 digits."""
    num = numerators(x, model)
    top = int(np.abs(num).max(initial=0))
    if num.dtype == object or top * top * x.shape[1] >= WHOLE:
        num = num.astype(object)
    return [k if (k := int(s)) < 10**38 else None for s in (num * num).sum(axis=1)]


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = project(x, model)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    total = summed(fit, part, k + k * k) / model.n
    return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each vector that takes part and each of the leading components.

    ``key, component, n, deviation, whitened, explained, identity_error``: components count from 1 by falling
    eigenvalue; ``deviation`` is the exact sum of ``(n x - S)^2``, null beyond 38 digits. Which rows take part:
    ``whole_vectors``. Repeated rows each get their rows and count once in the fit; a null key stays null. Vectors that
    have fewer directions than ``components`` get a row for each direction whose variance is above a double's rounding
    of the largest, so a single distinct vector and an empty table give none. Equal eigenvalues have no order of their own. Other columns are left behind,
    whatever their names.
    """
    rows = whole_vectors(vectors, key, vector)
    fit = settle(rows.select("x").distinct(), "whitening-fit")
    model = fit_whitening(fit, components)
    schema = f"`{key}` long, {OUT}"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, model)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                x = matrix(piece)
                rows = len(x)
                by_row = np.repeat(np.arange(rows), k)
                deviation = pa.array([str(s) if s is not None else None for s in deviations(x, model)])
                yield pa.record_batch({
                    key: piece.column(key).take(pa.array(by_row)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * k, model.n)),
                    "deviation": deviation.cast(pa.decimal128(38, 0)).take(pa.array(by_row)),
                    "whitened": pa.array(project(x, model).ravel()),
                    "explained": pa.array(np.tile(model.values / model.trace, rows)),
                    "identity_error": pa.array(np.full(rows * k, error)),
                })

    return rows.mapInArrow(out, schema)
