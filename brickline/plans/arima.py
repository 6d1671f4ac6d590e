"""Autoregressive moving-average models for every series of a panel in one job.

Two-stage least squares (Hannan and Rissanen 1982): a long autoregression gives
residuals, then the series is regressed on its own lags and the residual lags.
All sums come from Spark; each candidate order is a sub-block of the same normal
equations, so the order search costs one small solve per candidate and no
further pass over the data. Selection is by AIC on one common sample, where
differencing has unit Jacobian and likelihoods compare across d.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.bindings import CUTOFF
from brickline.functions.numbers import clip_non_negative
from brickline.operators.panel import by_date, series_with_min_history, whole
from brickline.operators.regression import dot, fit_ridge, gram, square
from brickline.plans.baselines import HORIZON, MIN_TRAIN, MIN_VALID, SERIES, Z95, backtest_rows

# Search space and the order of the long autoregression.
MAX_P, MAX_Q, MAX_D = 5, 5, 2
LONG_LAGS = 8
SEASON = 12
RIDGE = 1e-6


@dataclass(frozen=True)
class Spec:
    """Differencing choices, lag sets and the candidate subsets of those lags."""

    name: str
    diffs: tuple[tuple[int, int], ...]  # (regular, seasonal) differences
    ar: tuple[int, ...]
    ma: tuple[int, ...]
    candidates: tuple[tuple[tuple[int, ...], tuple[int, ...]], ...] = field(default=())

    @property
    def long(self) -> tuple[int, ...]:
        return tuple(sorted({*range(1, LONG_LAGS + 1), *[k for k in self.ar if k > LONG_LAGS]}))

    @property
    def warmup(self) -> int:
        lost = max(d + SEASON * s for d, s in self.diffs)
        return lost + max(self.long) + max((0, *self.ma, *self.ar))


def auto_spec() -> Spec:
    orders = [
        (tuple(range(1, p + 1)), tuple(range(1, q + 1))) for p in range(MAX_P + 1) for q in range(MAX_Q + 1)
    ]
    return Spec(
        "arima",
        tuple((d, 0) for d in range(MAX_D + 1)),
        tuple(range(1, MAX_P + 1)),
        tuple(range(1, MAX_Q + 1)),
        tuple(orders),
    )


def fixed_spec(name: str, diff: tuple[int, int], ar: Sequence[int], ma: Sequence[int]) -> Spec:
    return Spec(name, (diff,), tuple(ar), tuple(ma), ((tuple(ar), tuple(ma)),))


def diff_weights(d: int, s: int) -> np.ndarray:
    """Coefficients of (1-B)^d (1-B^12)^s."""
    w = np.ones(1)
    for _ in range(d):
        w = np.convolve(w, [1.0, -1.0])
    for _ in range(s):
        w = np.convolve(w, np.r_[1.0, np.zeros(SEASON - 1), -1.0])
    return w


def _differenced(d: int, s: int) -> Column:
    w = by_date(SERIES, "ds")
    terms = [F.col("y") * float(c) if k == 0 else F.lag("y", k).over(w) * float(c) for k, c in enumerate(diff_weights(d, s)) if c]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


KEYS = [*SERIES, "diff"]


def with_lags(panel: DataFrame, spec: Spec, train: Column | None = None) -> DataFrame:
    """Rows per series, differencing and month with lag columns, residual lags and the sample flag.

    The windows partition by a superset of the series key the rows are already
    grouped on, so the lag steps need no further shuffle.
    """
    numbered = panel.withColumn("rn", F.row_number().over(by_date(SERIES, "ds")))
    opened = numbered.withColumns({f"__z{i}": _differenced(d, s) for i, (d, s) in enumerate(spec.diffs)}).select(
        *panel.columns,
        "rn",
        F.inline(F.array(*[F.struct(F.lit(i).alias("diff"), F.col(f"__z{i}").alias("z")) for i in range(len(spec.diffs))])),
    )
    w = by_date(KEYS, "ds")
    lags = sorted({*spec.long, *spec.ar})
    lagged = opened.withColumns({f"z{k}": F.lag("z", k).over(w) for k in lags}).withColumn("one", F.lit(1.0))
    fit_rows = lagged if train is None else lagged.filter(train)
    long_x = ["one", *[f"z{k}" for k in spec.long]]
    first = fit_ridge(fit_rows, KEYS, long_x, "z", RIDGE).select(*KEYS, F.col("coefs").alias("__c"))
    resid = lagged.join(first, KEYS).withColumn("e", F.col("z") - dot(F.col("__c"), [F.col(c) for c in long_x]))
    out = resid.withColumns({f"e{k}": F.lag("e", k).over(w) for k in spec.ma}) if spec.ma else resid
    in_fit = F.col("rn") > spec.warmup
    return out.drop("__c").withColumn("in_fit", in_fit if train is None else in_fit & train)


def design(spec: Spec) -> list[str]:
    return ["one", *[f"z{k}" for k in spec.ar], *[f"e{k}" for k in spec.ma]]


def select_order(rows: DataFrame, spec: Spec) -> DataFrame:
    """Best candidate per series: ``diff, coefs (zeros outside the order), sigma2, aic, order``."""
    names = design(spec)
    at = {n: i for i, n in enumerate(names)}
    subsets = [
        np.array([0, *[at[f"z{k}"] for k in ar], *[at[f"e{k}"] for k in ma]], dtype=int) for ar, ma in spec.candidates
    ]
    labels = [(max(ar, default=0), max(ma, default=0)) for ar, ma in spec.candidates]
    result = "struct<aic: double, p: int, q: int, sigma2: double, coefs: array<double>>"

    @F.pandas_udf(result)
    def best(n: pd.Series, xtx: pd.Series, xty: pd.Series, yy: pd.Series) -> pd.DataFrame:
        out = []
        for count, upper, rhs, total in zip(n, xtx, xty, yy):
            rhs = np.asarray(rhs, dtype=float)
            full = square(np.asarray(upper, dtype=float), len(rhs))
            found = None
            for idx, (p, q) in zip(subsets, labels):
                lhs = full[np.ix_(idx, idx)] + RIDGE * np.eye(len(idx))
                b = np.linalg.lstsq(lhs, rhs[idx], rcond=None)[0]
                sse = max(total - 2 * b @ rhs[idx] + b @ full[np.ix_(idx, idx)] @ b, 1e-12)
                aic = count * np.log(sse / count) + 2 * (len(idx) + 1)
                if found is None or aic < found[0]:
                    coefs = np.zeros(len(rhs))
                    coefs[idx] = b
                    found = (aic, p, q, sse / max(count - len(idx), 1), coefs)
            out.append(found)
        return pd.DataFrame(out, columns=["aic", "p", "q", "sigma2", "coefs"])

    sums = gram(rows.filter("in_fit"), KEYS, names, "z")
    fits = sums.select(*KEYS, best("n", "xtx", "xty", "yy").alias("m"))
    row = F.struct("diff", "m.aic", "m.p", "m.q", "m.sigma2", "m.coefs")
    return fits.groupBy(*SERIES).agg(F.min_by(row, F.struct("m.aic", "diff")).alias("f")).select(*SERIES, "f.*")


def _path_udf(spec: Spec, horizon: int):
    """Recursive path and half-widths of one fitted series per row."""
    polys = [diff_weights(d, s) for d, s in spec.diffs]
    ar, ma = spec.ar, spec.ma

    @F.pandas_udf("array<struct<yhat: double, half: double>>")
    def path(
        diff: pd.Series, coefs: pd.Series, sigma2: pd.Series, ys: pd.Series, zs: pd.Series, es: pd.Series
    ) -> pd.Series:
        out = []
        for i, b, s2, y, z, e in zip(diff, coefs, sigma2, ys, zs, es):
            phi = dict(zip(ar, b[1 : 1 + len(ar)]))
            theta = dict(zip(ma, b[1 + len(ar) :]))
            y, z, e, delta = list(y), list(z), list(e), polys[i]
            values = []
            for _ in range(horizon):
                step = b[0] + sum(c * z[-k] for k, c in phi.items()) + sum(c * e[-k] for k, c in theta.items())
                z.append(step)
                e.append(0.0)
                y.append(step - sum(c * y[-k] for k, c in enumerate(delta) if k))
                values.append(y[-1])
            poly = np.zeros(max(phi, default=0) + 1)
            poly[0] = 1.0
            for k, c in phi.items():
                poly[k] = -c
            full = np.convolve(poly, delta)
            psi = np.zeros(horizon)
            psi[0] = 1.0
            for h in range(1, horizon):
                psi[h] = theta.get(h, 0.0) - sum(full[k] * psi[h - k] for k in range(1, min(h, len(full) - 1) + 1))
            half = Z95 * np.sqrt(s2 * np.cumsum(psi**2))
            out.append([(float(v), float(w)) for v, w in zip(values, half)])
        return pd.Series(out)

    return path


def forecast_arima(panel: DataFrame, spec: Spec | None = None, horizon: int = HORIZON) -> DataFrame:
    """Order search, fit and recursive forecast of every series with at least 36 points."""
    spec = spec or auto_spec()
    enough = (
        panel.withColumn("__n", F.count("y").over(whole(SERIES))).filter(F.col("__n") >= MIN_TRAIN).drop("__n")
    )
    rows = with_lags(enough, spec)
    order = select_order(rows, spec)
    keep = max(1, *spec.ar, *spec.ma, *[len(diff_weights(d, s)) for d, s in spec.diffs])
    tail = rows.withColumn("__back", F.row_number().over(by_date(KEYS, "ds").orderBy(F.desc("ds")))).filter(
        F.col("__back") <= keep
    )

    def last(c: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("ds", F.coalesce(c, F.lit(0.0)).alias("v")))), lambda s: s["v"])

    state = tail.groupBy(*KEYS).agg(F.max("ds").alias("last_ds"), last("y").alias("ys"), last("z").alias("zs"), last("e").alias("es"))
    fitted = order.join(state, KEYS)
    path = _path_udf(spec, horizon)("diff", "coefs", "sigma2", "ys", "zs", "es")
    opened = fitted.select(*SERIES, "last_ds", F.posexplode(path).alias("i", "f"))
    yhat, half = F.col("f.yhat"), F.col("f.half")
    return opened.select(
        F.lit(spec.name).alias("model_name"),
        "target",
        "city",
        (F.col("i") + 1).alias("horizon_months"),
        F.add_months("last_ds", F.col("i") + 1).alias("predict_date"),
        clip_non_negative(yhat).alias("yhat"),
        clip_non_negative(yhat - half).alias("yhat_lower"),
        clip_non_negative(yhat + half).alias("yhat_upper"),
    )


def backtest_arima(panel: DataFrame, spec: Spec | None = None, cutoff: str = CUTOFF) -> DataFrame:
    """Fit on the rows up to the cutoff; one-step predictions afterwards from actual history."""
    spec = spec or auto_spec()
    kept = series_with_min_history(panel, SERIES, "y", cutoff, MIN_TRAIN, MIN_VALID, "ds").drop("split")
    train = F.col("ds") <= F.lit(cutoff).cast("date")
    rows = with_lags(kept, spec, train)
    order = select_order(rows, spec).select(*KEYS, "coefs", "sigma2")
    step = dot(F.col("coefs"), [F.col(c) for c in design(spec)])
    # The differenced value holds y plus known history, so its error is the error of y.
    scored = rows.join(order, KEYS).withColumn("__p", F.col("y") - F.col("z") + step)
    return backtest_rows(scored, {f"{spec.name}_backtest": (F.col("__p"), Z95 * F.sqrt("sigma2"))}, cutoff)
