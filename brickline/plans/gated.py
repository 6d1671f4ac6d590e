"""A small gated recurrent network over windows, trained by gradients that Spark sums.

The network corrects a linear prediction and starts at no correction, so it can only improve on it in training. Each
evaluation is one job: tasks take the weights with them, add up loss and gradient over their rows, and Spark sums these
by target; no row reaches the driver. The driver keeps a weight vector per target and takes quasi-Newton steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cells, evaluations (each a job), remembered steps, weight decay per row, and the seed of the first weights.
CELLS, EVALUATIONS, MEMORY, DECAY, SEED = 6, 14, 8, 1e-4, 7
GATES = 3


def sizes(cells: int) -> list[tuple[int, ...]]:
    """Shapes of the weights in one vector: input, recurrent, offset and output; gates are update, reset, candidate."""
    return [(GATES * cells,), (GATES * cells, cells), (GATES * cells,), (cells,)]


def parts(theta: np.ndarray, cells: int) -> list[np.ndarray]:
    out, at = [], 0
    for shape in sizes(cells):
        n = int(np.prod(shape))
        out.append(theta[at : at + n].reshape(shape))
        at += n
    return out


def first_weights(cells: int = CELLS) -> np.ndarray:
    """Small random weights; the output's are 0, so the network says 0."""
    rng = np.random.default_rng(SEED)
    n = sum(int(np.prod(s)) for s in sizes(cells))
    theta = rng.normal(scale=0.5, size=n)
    theta[n - cells :] = 0.0
    return theta


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def run(theta: np.ndarray, x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Outputs for windows ``x`` (one a row), and what each step left for the way back."""
    w, u, b, out = parts(theta, cells)
    h, trace = np.zeros((len(x), cells)), []
    for t in range(x.shape[1]):
        given = x[:, t : t + 1] * w + b
        z = _sigmoid(given[:, :cells] + h @ u[:cells].T)
        r = _sigmoid(given[:, cells : 2 * cells] + h @ u[cells : 2 * cells].T)
        c = np.tanh(given[:, 2 * cells :] + (r * h) @ u[2 * cells :].T)
        trace.append((h, z, r, c))
        h = (1 - z) * h + z * c
    return h @ out, [*trace, (h,)]


def loss_and_gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, cells: int = CELLS) -> tuple[float, np.ndarray]:
    """Sum of squared errors over the rows and its gradient, by going back through the steps."""
    w, u, b, out = parts(theta, cells)
    said, trace = run(theta, x, cells)
    error = said - y
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros_like(b)
    last = trace.pop()[0]
    dout = 2 * error @ last
    dh = 2 * error[:, None] * out
    for t in range(x.shape[1] - 1, -1, -1):
        h, z, r, c = trace[t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * z * (1 - z)
        drh = dc @ u[2 * cells :]
        dr = drh * h * r * (1 - r)
        gates = np.concatenate([dz, dr, dc], axis=1)
        dw += x[:, t] @ gates
        db += gates.sum(axis=0)
        du[: 2 * cells] += gates[:, : 2 * cells].T @ h
        du[2 * cells :] += dc.T @ (r * h)
        dh = dh * (1 - z) + drh * r + dz @ u[:cells] + dr @ u[cells : 2 * cells]
    return float(error @ error), np.concatenate([dw, du.ravel(), db, dout])


def sums_by_target(samples: DataFrame, part: Callable[[str, np.ndarray, np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
    """Sum over all rows of ``part(target, x, y)``, a vector of one length, per target.

    Every task sends one vector per target it meets; Spark sums them by place.
    """

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = np.array(batch.column("target").to_pylist(), dtype=object)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for name in sorted(set(names)):
                chosen = names == name
                totals[name] = totals.get(name, 0.0) + part(name, x[chosen], y[chosen])
        yield pa.record_batch({
            "target": pa.array(list(totals), pa.string()), "v": pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64())),
        })

    parts_of = samples.select("target", "x", "y").mapInArrow(in_task, "target string, v array<double>")
    placed = parts_of.select("target", F.posexplode("v").alias("i", "v")).groupBy("target", "i").agg(F.sum("v").alias("v"))
    found: dict[str, dict[int, float]] = {}
    for r in placed.collect():
        found.setdefault(r["target"], {})[r["i"]] = r["v"]
    return {name: np.array([v[i] for i in range(len(v))]) for name, v in found.items()}


@dataclass
class Descent:
    """Limited-memory quasi-Newton steps on one target's loss, one evaluation at a time."""

    at: np.ndarray
    best: float = np.inf
    gradient: np.ndarray | None = None
    step: float = 1.0
    steps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    trial: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.trial = self.at

    def direction(self) -> np.ndarray:
        q, used = self.gradient.copy(), []
        for s, y in reversed(self.steps):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if self.steps:
            s, y = self.steps[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(q)))
        for (s, y), a in zip(self.steps, reversed(used)):
            q += s * (a - (y @ q) / (s @ y))
        return -q

    def take(self, loss: float, gradient: np.ndarray) -> None:
        """The loss and gradient at ``trial``: a better point is kept, a worse one shortens the step."""
        if np.isfinite(loss) and loss < self.best:
            if self.gradient is not None:
                s, y = self.trial - self.at, gradient - self.gradient
                if s @ y > 1e-12:
                    self.steps = [*self.steps, (s, y)][-MEMORY:]
            self.at, self.best, self.gradient, self.step = self.trial, loss, gradient, 1.0
        else:
            self.step *= 0.3
        self.trial = self.at + self.step * self.direction()


@dataclass
class Correction:
    """A target's network: inputs are divided by ``x_scale``, outputs times ``y_scale``."""

    theta: np.ndarray
    x_scale: float
    y_scale: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return run(self.theta, x / self.x_scale)[0] * self.y_scale


def fit_corrections(samples: DataFrame, width: int, linear: dict[str, np.ndarray], evaluations: int = EVALUATIONS) -> dict[str, Correction]:
    """A network per target for ``samples`` (``target, x, y``) whose first ``width`` inputs are the window, oldest first;
    it learns what ``linear`` (an offset and a weight per input) leaves."""

    def left(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return y - linear[name][0] - x @ linear[name][1:]

    def moments(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        e = left(name, x, y)
        return np.array([len(e), e @ e, (x[:, :width] ** 2).sum()])

    found = sums_by_target(samples, moments)
    scale = {k: (np.sqrt(v[2] / (v[0] * width)) or 1.0, np.sqrt(v[1] / v[0]) or 1.0, v[0]) for k, v in found.items()}
    descents = {name: Descent(first_weights()) for name in scale}
    for _ in range(evaluations if descents else 0):
        trials = {name: d.trial for name, d in descents.items()}

        def evaluate(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            loss, gradient = loss_and_gradient(trials[name], x[:, :width] / scale[name][0], left(name, x, y) / scale[name][1])
            return np.append(gradient, loss)

        for name, v in sums_by_target(samples, evaluate).items():
            n, theta = scale[name][2], trials[name]
            descents[name].take(v[-1] / n + DECAY * float(theta @ theta), v[:-1] / n + 2 * DECAY * theta)
    return {name: Correction(d.at, *scale[name][:2]) for name, d in descents.items()}
