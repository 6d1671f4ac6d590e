"""Chosen slope changes of the additive model: optimality, a planted break, and how often its band holds."""

from __future__ import annotations

import numpy as np
import pytest
from months import month
from pyspark.sql import functions as F

from brickline.operators import regression
from brickline.plans import additive


def test_penalised_fit_meets_its_optimality_conditions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 80, 9))
    y = x[:, :, 2] * 0.8 - x[:, :, 5] * 0.3 + rng.normal(0, 0.2, (6, 80))
    full, rhs, yy = x.transpose(0, 2, 1) @ x, (x * y[:, :, None]).sum(1), (y * y).sum(1)
    chosen, width = np.arange(9) >= 3, 0.01
    ridge = np.where(chosen, 0.0, 0.1)
    coefs, variance = regression.sparse_fit(full, rhs, np.full(6, 80), yy, ridge, chosen, width)
    slope = rhs - (full @ coefs[:, :, None])[:, :, 0] - ridge * coefs
    bound = variance / width
    assert np.abs(slope[:, ~chosen]).max() < 1e-7
    for row in range(6):
        zero = chosen & (coefs[row] == 0)
        live = chosen & (coefs[row] != 0)
        assert zero.any() and live[5]
        assert (np.abs(slope[row, zero]) <= bound[row] * 1.01).all()
        assert np.allclose(slope[row, live], bound[row] * np.sign(coefs[row, live]), rtol=0.01)


def knots_of(panel):
    rows = additive._clock(panel, None)
    design, names = additive._design(rows, [])
    model = additive._fit(design, names, None).select("city", "turn", "coefs").collect()
    at = [i for i, n in enumerate(names) if n.startswith("x_knot")]
    return {r.city: np.array(r.coefs)[at] for r in model}


def test_a_planted_break_is_found_and_a_line_has_none(panel_of):
    rng = np.random.default_rng(9)
    t, n = np.arange(130), 130
    noise = rng.normal(0, 1.5, (2, n))
    # The eighth of twelve candidates lies at 0.8 * 8 / 13 of the span.
    at = 0.8 * 8 / 13 * (n - 1)
    panel = panel_of(broken=list(500 + 2 * t - 5 * np.maximum(0, t - at) + noise[0]), line=list(500 + 2 * t + noise[1]))
    got = knots_of(panel)
    assert got["broken"].argmin() == 7
    # Every other change, and each one of the line, is under a twentieth of the planted one.
    assert np.abs(np.append(np.delete(got["broken"], 7), got["line"])).max() < 0.05 * np.abs(got["broken"][7])
    assert (got["broken"] == 0).sum() >= 6


def test_bands_hold_at_one_and_five_years(spark):
    """Trends that turn at random: near four fifths of the later values lie inside, and the band widens."""
    rng = np.random.default_rng(12)
    train, rows, later = 160, [], {}
    for k in range(120):
        turns = rng.laplace(0, 1.2, 220) * (rng.random(220) < 12 / (0.8 * train))
        y = 3000 + np.cumsum(np.cumsum(turns) + rng.normal()) + rng.normal(0, 15, 220)
        rows += [(f"c{k}", "price", month(i), float(v)) for i, v in enumerate(y[:train])]
        later[f"c{k}"] = y[train:]
    panel = spark.createDataFrame(rows, "city string, target string, ds date, y double")
    out = additive.forecast_additive(panel, [], 60).filter(F.col("horizon_months").isin(12, 60)).collect()
    for h in (12, 60):
        held = [r.yhat_lower <= max(0, later[r.city][h - 1]) <= r.yhat_upper for r in out if r.horizon_months == h]
        assert len(held) == 120 and 0.65 <= np.mean(held) <= 0.95, (h, np.mean(held))
    wide = {(r.city, r.horizon_months): r.yhat_upper - r.yhat for r in out}
    assert np.mean([wide[c, 60] > wide[c, 12] for c in later]) > 0.95


def test_empty_and_short_panels(panel_of):
    panel = panel_of(short=[1.0] * 10)
    assert additive.forecast_additive(panel, [], 6).collect() == []
    assert additive.forecast_additive(panel.limit(0), [], 6).collect() == []


@pytest.mark.parametrize("value", [0.0, 40.0])
def test_a_level_series_stays_level(panel_of, value):
    for r in additive.forecast_additive(panel_of(a=[value] * 40), [], 12).collect():
        assert r.yhat is None or r.yhat == pytest.approx(value, abs=0.01)
