"""Multiplicative seasonal moving-average models by exact likelihood, for every series of a panel in one job.

A series is one row: its values are bounded by the calendar, so a task takes a batch of rows and runs the Kalman
recursion for all of them at once, one array operation a month. Parameters are mapped from partial autocorrelations
inside the unit interval (Monahan 1984), so every polynomial stays stationary or invertible; the variance is
concentrated out, and the rest is found by quasi-Newton steps taken for the whole batch. Covariances are carried as the
rank-one difference between two months (Morf, Sidhu and Kailath 1974), so a month costs the length of the state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import CUTOFF
from brickline.functions.numbers import clip_non_negative
from brickline.operators.panel import series_with_min_history
from brickline.plans.arima import SEASON, diff_weights
from brickline.plans.baselines import HORIZON, MIN_TRAIN, MIN_VALID, SERIES, Z95, backtest_rows

# Series that a task works on at once, quasi-Newton steps, and how near one a partial autocorrelation may come.
BATCH = 64
STEPS = 40
EDGE = 0.995
DOUBLINGS = 14
LINE = np.array([0.0, 1.0, 0.5, 0.25, 0.1, 0.02, 0.002])


@dataclass(frozen=True)
class Orders:
    """``(p, d, q)`` and the seasonal ``(P, D, Q)`` with a season of twelve months; no constant."""

    name: str
    regular: tuple[int, int, int]
    seasonal: tuple[int, int, int] = (0, 0, 0)

    @property
    def blocks(self) -> tuple[int, int, int, int]:
        """Numbers of coefficients: autoregressive, seasonal autoregressive, moving average, seasonal moving average."""
        return self.regular[0], self.seasonal[0], self.regular[2], self.seasonal[2]

    @property
    def delta(self) -> np.ndarray:
        return diff_weights(self.regular[1], self.seasonal[1])


SEASONAL = Orders("sarima_111_111_12", (1, 1, 1), (1, 1, 1))
PLAIN = Orders("arima_011", (0, 1, 1))


# --- parameters ----------------------------------------------------------------------------------------------------


def _stationary(free: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from free numbers, by row: Levinson's recursion on ``(-1, 1)``."""
    partial = EDGE * free / np.sqrt(1 + free * free)
    out = np.zeros_like(partial)
    for k in range(free.shape[1]):
        before = out[:, :k].copy()
        out[:, :k] = before - partial[:, k : k + 1] * before[:, ::-1]
        out[:, k] = partial[:, k]
    return out


def coefficients(free: np.ndarray, spec: Orders) -> np.ndarray:
    """The model's coefficients in the order of ``spec.blocks``; moving averages are written with a plus sign."""
    ends = np.cumsum(spec.blocks)
    ar, sar, ma, sma = np.split(free, ends[:-1], axis=1)
    return np.concatenate([_stationary(ar), _stationary(sar), -_stationary(ma), -_stationary(sma)], axis=1)


def _times(short: np.ndarray, seasonal: np.ndarray) -> np.ndarray:
    """Product of ``1 + sum a_k B^k`` and ``1 + sum b_k B^(12 k)`` by row, without its leading one."""
    n, p = short.shape
    one = np.concatenate([np.ones((n, 1)), short], axis=1)
    out = np.zeros((n, p + 1 + SEASON * seasonal.shape[1]))
    out[:, : p + 1] = one
    for k in range(seasonal.shape[1]):
        at = SEASON * (k + 1)
        out[:, at : at + p + 1] += seasonal[:, k : k + 1] * one
    return out[:, 1:]


def polynomials(coefs: np.ndarray, spec: Orders) -> tuple[np.ndarray, np.ndarray]:
    """Multiplied-out lag coefficients ``phi`` and ``theta`` of the differenced series."""
    ar, sar, ma, sma = np.split(coefs, np.cumsum(spec.blocks)[:-1], axis=1)
    return -_times(-ar, -sar), _times(ma, sma)


# --- the filter ----------------------------------------------------------------------------------------------------


def _system(phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrices and shock loadings of the models in companion form."""
    n, size = len(phi), max(phi.shape[1], theta.shape[1] + 1)
    move = np.zeros((n, size, size))
    move[:, : phi.shape[1], 0] = phi
    move[:, np.arange(size - 1), np.arange(1, size)] = 1
    load = np.zeros((n, size))
    load[:, 0] = 1
    load[:, 1 : theta.shape[1] + 1] = theta
    return move, load


def _resting(move: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Covariance of the state before any value is seen, by doubling."""
    cov, power = load[:, :, None] * load[:, None, :], move
    for _ in range(DOUBLINGS):
        cov = cov + power @ cov @ power.transpose(0, 2, 1)
        power = power @ power
    return cov


def run_filter(w: np.ndarray, lengths: np.ndarray, phi: np.ndarray, theta: np.ndarray, keep: bool = False) -> dict[str, np.ndarray]:
    """One pass over differenced series (rows of ``w``, the first ``lengths`` values of each count).

    Gives ``logs`` (sum of log variances) and ``squares`` (sum of scaled squared errors), in units of the shock
    variance; with ``keep`` also each month's expected value ``mean`` and variance ``var``, and the state ``state`` with
    its covariance ``cov`` for the month after the last.
    """
    move, load = _system(phi, theta)
    cov = _resting(move, load)
    first = move[:, :, 0]

    def advance(x: np.ndarray) -> np.ndarray:
        out = first * x[:, :1]
        out[:, :-1] += x[:, 1:]
        return out

    state, f = np.zeros_like(load), cov[:, 0, 0].copy()
    k = advance(cov[:, :, 0])
    step, scale = k.copy(), -1 / f
    logs, squares = np.zeros(len(w)), np.zeros(len(w))
    mean, var = [], []
    for t in range(w.shape[1]):
        on = t < lengths
        error = np.where(on, w[:, t] - state[:, 0], 0.0)
        if keep:
            mean.append(state[:, 0].copy())
            var.append(f.copy())
            cov = cov + np.where(on, scale, 0.0)[:, None, None] * step[:, :, None] * step[:, None, :]
        logs += np.where(on, np.log(f), 0.0)
        squares += error * error / f
        gain, lead, moved = k / f[:, None], step[:, 0], advance(step)
        after = np.maximum(f + scale * lead * lead, 1.0)
        live = on[:, None]
        state = np.where(live, advance(state) + gain * error[:, None], state)
        k = np.where(live, k + moved * (scale * lead)[:, None], k)
        step = np.where(live, moved - gain * lead[:, None], step)
        scale, f = np.where(on, scale * f / after, scale), np.where(on, after, f)
    out = {"logs": logs, "squares": squares}
    if keep:
        out |= {"mean": np.array(mean).T, "var": np.array(var).T, "state": state, "cov": cov}
    return out


def log_likelihood(w: np.ndarray, lengths: np.ndarray, coefs: np.ndarray, spec: Orders) -> tuple[np.ndarray, np.ndarray]:
    """Exact Gaussian log likelihood with the shock variance at its best value, and that variance."""
    sums = run_filter(w, lengths, *polynomials(coefs, spec))
    variance = np.maximum(sums["squares"] / lengths, 1e-12)
    return -0.5 * (lengths * (np.log(2 * np.pi * variance) + 1) + sums["logs"]), variance


def fit_batch(w: np.ndarray, lengths: np.ndarray, spec: Orders) -> np.ndarray:
    """Coefficients of greatest likelihood for each row of ``w``."""
    n, size = len(w), sum(spec.blocks)
    if not size:
        return np.zeros((n, 0))

    def loss(points: np.ndarray) -> np.ndarray:
        """``points`` is rows x tries x parameters."""
        tries = points.shape[1]
        flat = coefficients(points.reshape(-1, size), spec)
        value, _ = log_likelihood(np.repeat(w, tries, axis=0), np.repeat(lengths, tries), flat, spec)
        return -(value / np.repeat(lengths, tries)).reshape(n, tries)

    every, eye, h = np.arange(n), np.eye(size), 1e-5
    corners = np.stack(np.meshgrid(*[[-0.6, 0.6]] * size, indexing="ij"), -1).reshape(-1, size)
    starts = np.concatenate([np.zeros((1, size)), corners])
    at = starts[loss(np.repeat(starts[None], n, axis=0)).argmin(axis=1)]

    def slope(x: np.ndarray) -> np.ndarray:
        both = loss(np.concatenate([x[:, None] + h * eye, x[:, None] - h * eye], axis=1))
        return (both[:, :size] - both[:, size:]) / (2 * h)

    grad, inverse = slope(at), np.repeat(eye[None], n, axis=0)
    for _ in range(STEPS):
        way = -(inverse @ grad[:, :, None])[:, :, 0]
        uphill = (way * grad).sum(1) >= 0
        way[uphill], inverse[uphill] = -grad[uphill], eye
        way *= np.minimum(1, 2 / np.maximum(np.abs(way).max(1), 1e-12))[:, None]
        values = loss(at[:, None] + LINE[None, :, None] * way[:, None])
        best = values.argmin(axis=1)
        inverse[best == 0] = eye
        move = LINE[best][:, None] * way
        if (values[:, 0] - values[every, best]).max() < 1e-10:
            break
        new = slope(at + move)
        turn, at = new - grad, at + move
        bend = (move * turn).sum(1)
        good = bend > 1e-12
        rho = np.where(good, 1 / np.where(good, bend, 1), 0)[:, None, None]
        left = eye - rho * move[:, :, None] * turn[:, None, :]
        inverse = np.where(good[:, None, None], left @ inverse @ left.transpose(0, 2, 1) + rho * move[:, :, None] * move[:, None, :], inverse)
        grad = new
    return coefficients(at, spec)


# --- a batch of series ---------------------------------------------------------------------------------------------


def _differenced(ys: Sequence[np.ndarray], delta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differenced series as rows padded to one length, divided by their spread; their lengths; the spreads."""
    parts = [np.convolve(y, delta)[len(delta) - 1 : len(y)] for y in ys]
    lengths = np.array([len(p) for p in parts])
    scale = np.array([np.sqrt(np.mean(p * p)) if len(p) else 0.0 for p in parts])
    scale[scale == 0] = 1.0
    w = np.zeros((len(parts), max(lengths)))
    for k, p in enumerate(parts):
        w[k, : len(p)] = p / scale[k]
    return w, lengths, scale


def _future(spec: Orders, phi: np.ndarray, theta: np.ndarray, kept: dict, tails: np.ndarray, variance: np.ndarray, horizon: int):
    """Means and standard deviations of the months ahead; the state is the filter's, beside the last undifferenced values."""
    move, load = _system(phi, theta)
    n, size, back = len(phi), load.shape[1], len(spec.delta) - 1
    whole = np.zeros((n, size + back, size + back))
    whole[:, :size, :size] = move
    read = np.zeros(size + back)
    read[0], read[size:] = 1, -spec.delta[1:]
    if back:
        whole[:, size] = read
        whole[:, np.arange(size + 1, size + back), np.arange(size, size + back - 1)] = 1
    load = np.concatenate([load, np.zeros((n, back))], axis=1)
    state = np.concatenate([kept["state"], tails], axis=1)
    cov = np.zeros_like(whole)
    cov[:, :size, :size] = kept["cov"]
    shock, means, spreads = load[:, :, None] * load[:, None, :], [], []
    for _ in range(horizon):
        means.append(state @ read)
        spreads.append(np.sqrt(np.maximum(variance * ((cov @ read) @ read), 0)))
        state = (whole @ state[:, :, None])[:, :, 0]
        cov = whole @ cov @ whole.transpose(0, 2, 1) + shock
    return np.array(means).T, np.array(spreads).T


def _batches(n: int):
    return (slice(k, k + BATCH) for k in range(0, n, BATCH))


def _fit_udf(spec: Orders, horizon: int):
    back = len(spec.delta) - 1
    shape = "struct<coefs: array<double>, sigma2: double, loglik: double, aic: double, path: array<struct<yhat: double, sd: double>>>"

    @F.pandas_udf(shape)
    def fit(values: pd.Series) -> pd.DataFrame:
        out = []
        for part in _batches(len(values)):
            ys = [np.asarray(v, float) for v in values.iloc[part]]
            w, lengths, scale = _differenced(ys, spec.delta)
            coefs = fit_batch(w, lengths, spec)
            value, variance = log_likelihood(w, lengths, coefs, spec)
            value = value - lengths * np.log(scale)
            phi, theta = polynomials(coefs, spec)
            kept = run_filter(w, lengths, phi, theta, keep=True)
            tails = np.array([y[::-1][:back] for y in ys]).reshape(len(ys), back) / scale[:, None]
            means, spreads = _future(spec, phi, theta, kept, tails, variance, horizon)
            for k, s in enumerate(scale):
                path = [(float(m * s), float(d * s)) for m, d in zip(means[k], spreads[k])]
                aic = 2 * (sum(spec.blocks) + 1) - 2 * value[k]
                out.append((coefs[k].tolist(), float(variance[k] * s * s), float(value[k]), float(aic), path))
        return pd.DataFrame(out, columns=["coefs", "sigma2", "loglik", "aic", "path"])

    return fit


def _one_step_udf(spec: Orders):
    back = len(spec.delta) - 1

    @F.pandas_udf("array<struct<yhat: double, sd: double>>")
    def predict(values: pd.Series, trained: pd.Series) -> pd.Series:
        out = []
        for part in _batches(len(values)):
            ys, known = [np.asarray(v, float) for v in values.iloc[part]], trained.iloc[part].to_numpy()
            w, lengths, scale = _differenced(ys, spec.delta)
            seen = np.maximum(known - back, 1)
            coefs = fit_batch(w[:, : seen.max()], seen, spec)
            _, variance = log_likelihood(w[:, : seen.max()], seen, coefs, spec)
            kept = run_filter(w, lengths, *polynomials(coefs, spec), keep=True)
            for k, y in enumerate(ys):
                held = slice(0, lengths[k])
                # The differenced value is y plus known history, so its error is the error of y.
                mean = y[back:] + (kept["mean"][k, held] - w[k, held]) * scale[k]
                spread = np.sqrt(variance[k] * kept["var"][k, held]) * scale[k]
                out.append([(None, None)] * min(back, len(y)) + [(float(m), float(s)) for m, s in zip(mean, spread)])
        return pd.Series(out)

    return predict


# --- panels --------------------------------------------------------------------------------------------------------


def _by_series(panel: DataFrame, cutoff: str) -> DataFrame:
    """One row per series: ``s`` its months in order, ``trained`` how many lie up to the cutoff; no nulls, no NaN.

    The number of partitions is given, because a fit costs far more than the size of its row says.
    """
    tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = panel.filter(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double"))).repartition(tasks, *SERIES)
    months = F.array_sort(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y"))))
    trained = F.count_if(F.col("ds") <= F.lit(cutoff).cast("date")).alias("trained")
    return known.groupBy(*SERIES).agg(months.alias("s"), trained)


def fit_state_space(panel: DataFrame, spec: Orders, horizon: int = 0) -> DataFrame:
    """``city, target, n, last_ds, coefs, sigma2, loglik, aic, path`` of every series with at least 36 values.

    ``coefs`` follow ``spec.blocks``; ``path`` holds the expected values and their standard deviations ahead, from the
    covariance of the state. Months without a value are skipped, so fill gaps first. A series that never changes gets a
    variance of next to nothing; an empty panel gives an empty table.
    """
    rows = _by_series(panel, CUTOFF).filter(F.size("s") >= MIN_TRAIN)
    fitted = rows.withColumn("m", _fit_udf(spec, horizon)(F.col("s.y")))
    return fitted.select(*SERIES, F.size("s").alias("n"), F.array_max("s.ds").alias("last_ds"), "m.*")


def forecast_state_space(panel: DataFrame, spec: Orders, horizon: int = HORIZON) -> DataFrame:
    """The path beyond the data with a 95 % band that widens by the state's variance."""
    opened = fit_state_space(panel, spec, horizon).select(*SERIES, "last_ds", F.posexplode("path").alias("i", "f"))
    yhat, half = F.col("f.yhat"), Z95 * F.col("f.sd")
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


def backtest_state_space(panel: DataFrame, spec: Orders, cutoff: str = CUTOFF) -> DataFrame:
    """Fit on the rows up to the cutoff; one-step predictions afterwards, the filter running on over actual values."""
    kept = series_with_min_history(panel, SERIES, "y", cutoff, MIN_TRAIN, MIN_VALID, "ds")
    rows = _by_series(kept, cutoff).withColumn("p", _one_step_udf(spec)(F.col("s.y"), F.col("trained")))
    opened = rows.select(*SERIES, F.inline(F.arrays_zip("s", "p"))).select(*SERIES, "s.ds", "s.y", "p.yhat", "p.sd")
    return backtest_rows(opened, {f"{spec.name}_backtest": (F.col("yhat"), Z95 * F.col("sd"))}, cutoff)


def forecast_fixed(panel: DataFrame, specs: dict[str, Orders], horizon: int, cutoff: str = CUTOFF) -> DataFrame:
    """A fixed order per target: the path beyond the data, and the forecast of the test span with its actual values."""
    parts = []
    for target, spec in specs.items():
        series = panel.filter(F.col("target") == target)
        parts += [forecast_state_space(series, spec, horizon), backtest_state_space(series, spec, cutoff)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
