"""The gated network: its gradient, summed gradients, and a nonlinear panel that a linear model can't follow."""

from __future__ import annotations

import numpy as np
import pytest

from brickline.plans import sequence
from brickline.plans.gated import first_weights, fit_corrections, loss_and_gradient, run, sums_by_target


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    theta, x, y = rng.normal(size=len(first_weights(4))) * 0.7, rng.normal(size=(5, 6)), rng.normal(size=5)
    _, gradient = loss_and_gradient(theta, x, y, 4)
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        slope = (loss_and_gradient(theta + step, x, y, 4)[0] - loss_and_gradient(theta - step, x, y, 4)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, rel=1e-5, abs=1e-7)
    assert not run(first_weights(), x)[0].any()


def samples_of(spark, x, y, target="price"):
    return spark.createDataFrame([(target, list(map(float, r)), float(v)) for r, v in zip(x, y)], "target string, x array<double>, y double")


def test_sums_are_the_same_however_rows_lie(spark):
    rng = np.random.default_rng(4)
    x, y, theta = rng.normal(size=(97, 5)), rng.normal(size=97), rng.normal(size=len(first_weights()))
    part = lambda _, a, b: np.append(loss_and_gradient(theta, a, b)[1], loss_and_gradient(theta, a, b)[0])
    both = samples_of(spark, x, y).unionByName(samples_of(spark, x[:9], y[:9], "rent"))
    for parts in (1, 7):
        got = sums_by_target(both.repartition(parts), part)
        assert np.allclose(got["price"], part("", x, y)) and np.allclose(got["rent"], part("", x[:9], y[:9]))
    assert sums_by_target(both.where("false"), part) == {}


def test_network_learns_what_a_line_cannot(spark):
    """The next value is the size of the newest step, whatever its sign, on which every linear weight is about 0."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 4))
    y = np.abs(x[:, 3]) * 1.5 + 0.05 * rng.normal(size=1500)
    design = np.hstack([np.ones((1500, 1)), x])
    coefs = np.linalg.lstsq(design, y, rcond=None)[0]
    line = ((y - design @ coefs) ** 2).mean()
    correction = fit_corrections(samples_of(spark, x, y).coalesce(2), 4, {"price": coefs}, 40)["price"]
    net = ((y - design @ coefs - correction(x)) ** 2).mean()
    assert net < 0.5 * line


def test_model_beats_the_line_on_a_nonlinear_panel(spark):
    """Each step is a parabola of the one before, which no line follows; judged on later months than were learned from."""
    early, late = [], []
    for k in range(8):
        step, level = 0.3 + 0.04 * k, [100.0]
        for _ in range(160):
            step = 1 - 2 * step * step
            level.append(level[-1] * (1 + 0.04 * step))
        w = sequence.WINDOW
        for t in range(w, len(level)):
            shape = [level[t - w + i] / level[t - 1] - 1 for i in range(w - 1)]
            (early if t < 120 else late).append(("price", *shape, level[t] / level[t - 1] - 1))
    names = [f"s{i}" for i in range(sequence.WINDOW - 1)]
    df = spark.createDataFrame(early, "target string, " + ", ".join(f"{n} double" for n in names) + ", step double")
    x, y = np.array([r[1:-1] for r in late]), np.array([r[-1] for r in late])
    error = {n: ((sequence.fit_models(df, names, "step", len(names), n)["price"](x) - y) ** 2).mean() for n in (0, 50)}
    assert error[50] < 0.6 * error[0]
