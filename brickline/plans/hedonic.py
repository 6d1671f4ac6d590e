"""Hedonic regression with absorbed fixed effects and cluster-robust errors.

Keys with many values (place, month, unit) aren't made columns: their effects are taken out of the price and of every
regressor by alternating demeaning. Facts are grouped once into cells, one per combination of the keys, with a sum of each
column; a sweep then needs only the cells and the effects found so far, so it moves tables as large as the keys and cells, not the
facts. What is left is a solve as large as the number of regressors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.operators.regression import square
from brickline.session import settle

# Sweeps end when no effect of the last key, which follow from the others', moves by more than this share of its column's spread.
SETTLED, SWEEPS = 1e-10, 200
# A regressor with a smaller share of its variance left after the effects are out can't be told from them.
LEFT = 1e-9
# Values of an attribute that become columns; keys with more belong to ``absorbed``.
LEVELS = 1000
MISSING = "missing"
OUT = "term string, coefficient double, std_error double, t_value double"


@dataclass
class Design:
    """Rows with ``y``, regressors ``x0..``, the keys ``k0..`` as text, and the cluster; the regressors' names."""

    rows: DataFrame
    terms: list[str]
    keys: list[str]

    @property
    def columns(self) -> list[str]:
        return ["y", *self.regressors]

    @property
    def regressors(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.terms))]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def design(listings: DataFrame, attributes: Sequence[str], numbers: Sequence[str], absorbed: Sequence[str], cluster: str | None) -> Design | None:
    """The regression's rows; None where no row has a positive price and all numbers."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in numbers], F.col("price") > 0)
    listings = listings.where(complete)
    found = listings.agg(F.count("*").alias("n"), *[F.array_sort(F.collect_set(_text(a))).alias(a) for a in attributes]).first()
    if found["n"] == 0:
        return None
    for a in attributes:
        if len(found[a]) > LEVELS:
            raise ValueError(f"{a} has {len(found[a])} values; put it into absorbed")
    levels = [(a, v) for a in attributes for v in found[a][1:]]
    xs = [F.col(c).cast("double") for c in numbers] + [(_text(a) == v).cast("double") for a, v in levels]
    keys = [f"k{i}" for i in range(len(absorbed))]
    columns = [F.log("price").alias("y"), *[x.alias(f"x{i}") for i, x in enumerate(xs)], *[_text(c).alias(k) for c, k in zip(absorbed, keys)]]
    if not keys:
        columns.append(F.lit("").alias("k0"))
    # Without a cluster every row is one of its own.
    columns.append(_text(cluster).alias("cluster") if cluster else F.monotonically_increasing_id().alias("cluster"))
    return Design(settle(listings.select(*columns), "hedonic-rows"), [*numbers, *[f"{a}={v}" for a, v in levels]], keys or ["k0"])


def effects(d: Design) -> dict[str, DataFrame]:
    """``key, y, x0, ..`` per key: what to take off each column so that its mean is 0 for every value of every key."""
    cells = settle(d.rows.groupBy(*d.keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in d.columns]), "hedonic-cells")
    spread = d.rows.agg(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in d.columns]).first().asDict()
    out: dict[str, DataFrame] = {}
    for sweep in range(SWEEPS):
        moved = 0.0
        for key in d.keys:
            table, rest = cells, [k for k in d.keys if k != key and k in out]
            for k in rest:
                table = table.join(out[k].select(k, *[F.col(c).alias(f"{k}_{c}") for c in d.columns]), k)
            left = [F.sum(F.col(c) - F.col("n") * sum((F.col(f"{k}_{c}") for k in rest), F.lit(0.0))) for c in d.columns]
            found = table.groupBy(key).agg(*[(s / F.sum("n")).alias(c) for c, s in zip(d.columns, left)])
            found = settle(found, f"hedonic-{key}")
            if key in out and key == d.keys[-1]:
                old = out[key].select(key, *[F.col(c).alias(f"old_{c}") for c in d.columns])
                steps = [F.coalesce(F.max(F.abs(F.col(c) - F.col(f"old_{c}"))), F.lit(0.0)).alias(c) for c in d.columns]
                step = found.join(old, key).agg(*steps).first().asDict()
                moved = max([moved, *(step[c] / spread[c] for c in d.columns if spread[c] > 0)])
            out[key] = found
        if len(d.keys) == 1 or (sweep and moved <= SETTLED):
            break
    return out


def residual_rows(d: Design, found: dict[str, DataFrame]) -> DataFrame:
    """The rows with every column's effects taken out."""
    rows = d.rows
    for k, table in found.items():
        rows = rows.join(table.select(k, *[F.col(c).alias(f"{k}_{c}") for c in d.columns]), k)
    return rows.select("cluster", *[(F.col(c) - sum(F.col(f"{k}_{c}") for k in found)).alias(c) for c in d.columns])


def hedonic_regression(
    listings: DataFrame, attributes: Sequence[str], numbers: Sequence[str] = (), absorbed: Sequence[str] = (), cluster: str | None = None
) -> DataFrame:
    """Log price on numbers and on the values of attributes: ``term, coefficient, std_error, t_value``.

    The first value of an attribute in order is the one that others are compared with, so an attribute with one value
    has no term; a null is the value ``missing``. Keys in ``absorbed`` get an effect for each of their values; without any there is
    an intercept alone. Errors allow for any dependence within a cluster, by default for unequal variances only, with
    the factor ``G / (G - 1) * (N - 1) / (N - K)``, where K counts the terms and the absorbed effects. A term that the effects or
    the terms before it explain has nulls. Rows without a positive price or with a null number take no part; no row
    left, or no term, gives an empty result.
    """
    spark, d = listings.sparkSession, design(listings, attributes, numbers, absorbed, cluster)
    if d is None or not d.terms:
        return spark.createDataFrame([], OUT)
    found = effects(d)
    rows = settle(residual_rows(d, found), "hedonic-residuals")
    xs = d.regressors
    upper = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(xs) for b in xs[i:]]
    sums = rows.agg(F.count("*").alias("n"), F.array(*upper).alias("xx"), F.array(*[F.sum(F.col(x) * F.col("y")) for x in xs]).alias("xy")).first()
    raw = d.rows.agg(F.array(*[F.var_pop(x) for x in xs]).alias("v")).first()["v"]
    xx, xy = square(np.array(sums["xx"]), len(xs)), np.array(sums["xy"])
    kept = independent(xx, np.array(raw) * sums["n"])
    if not kept:
        return spark.createDataFrame([(term, None, None, None) for term in d.terms], OUT)
    inverse = np.linalg.inv(xx[np.ix_(kept, kept)])
    beta = inverse @ xy[kept]
    error = F.col("y") - sum((F.lit(float(b)) * F.col(xs[i]) for b, i in zip(beta, kept)), F.lit(0.0))
    scores = rows.withColumn("e", error).groupBy("cluster").agg(*[F.sum(F.col(xs[i]) * F.col("e")).alias(f"s{i}") for i in kept])
    pairs = [F.coalesce(F.sum(F.col(f"s{i}") * F.col(f"s{j}")), F.lit(0.0)) for at, i in enumerate(kept) for j in kept[at:]]
    meat = scores.agg(F.count("*").alias("g"), F.array(*pairs).alias("m")).first()
    absorbed_effects = sum(t.count() for t in found.values()) - (len(found) - 1)
    n, g, k = sums["n"], meat["g"], len(kept) + absorbed_effects
    factor = g / (g - 1) * (n - 1) / (n - k) if g > 1 and n > k else float("nan")
    errors = np.sqrt(factor * (inverse @ square(np.array(meat["m"]), len(kept)) @ inverse).diagonal())
    by_term = {i: (float(b), float(e)) for i, b, e in zip(kept, beta, errors)}
    out = []
    for i, term in enumerate(d.terms):
        b, e = by_term.get(i, (None, None))
        e = e if e is not None and np.isfinite(e) else None
        out.append((term, b, e, b / e if e else None))
    return spark.createDataFrame(out, OUT)


def independent(xx: np.ndarray, raw: np.ndarray) -> list[int]:
    """Columns that those before them don't explain, by elimination in order."""
    kept: list[int] = []
    for i in range(len(xx)):
        left = xx[i, i]
        if kept:
            left -= xx[i, kept] @ np.linalg.solve(xx[np.ix_(kept, kept)], xx[kept, i])
        if raw[i] > 0 and left > LEFT * raw[i]:
            kept.append(i)
    return kept
