"""Seasonal models by exact likelihood: against a dense Gaussian, planted coefficients, and the contract of results."""

from __future__ import annotations

import numpy as np
import pytest
from months import month

from brickline.plans import statespace
from brickline.plans.statespace import PLAIN, SEASONAL, Orders

ALL_ORDERS = [PLAIN, SEASONAL, Orders("two", (2, 0, 1)), Orders("none", (0, 1, 0)), Orders("ma_season", (1, 0, 2), (0, 1, 1))]


def simulated(coefs, spec, n, rng, sigma=1.0):
    """Differenced values of the model after a long run-in."""
    phi, theta = (p[0] for p in statespace.polynomials(np.array([coefs], float), spec))
    shocks = rng.normal(0, sigma, n + 600)
    w = np.zeros(n + 600)
    for t in range(30, n + 600):
        w[t] = shocks[t] + phi @ w[t - len(phi) : t][::-1] + theta @ shocks[t - len(theta) : t][::-1]
    return w[-n:]


def autocovariances(phi, theta, n):
    """From the moving-average form, summed far enough."""
    size = 6000
    psi = np.zeros(size)
    for k in range(size):
        psi[k] = (1.0 if k == 0 else theta[k - 1] if k <= len(theta) else 0.0) + sum(
            phi[j] * psi[k - j - 1] for j in range(min(k, len(phi)))
        )
    return np.array([psi[: size - k] @ psi[k:] for k in range(n)])


@pytest.mark.parametrize("spec", ALL_ORDERS, ids=lambda s: s.name)
def test_likelihood_equals_a_dense_gaussian(spec):
    rng = np.random.default_rng(3)
    coefs = statespace.coefficients(rng.normal(0, 0.7, (3, sum(spec.blocks))), spec)
    lengths = np.array([40, 25, 33])
    w = rng.normal(size=(3, 40))
    got, variance = statespace.log_likelihood(w, lengths, coefs, spec)
    phi, theta = statespace.polynomials(coefs, spec)
    for k, n in enumerate(lengths):
        gamma = autocovariances(phi[k], theta[k], n)
        cov = variance[k] * gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
        x = w[k, :n]
        want = -0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + x @ np.linalg.solve(cov, x))
        assert got[k] == pytest.approx(want, rel=1e-6)


def test_planted_seasonal_coefficients_are_found():
    """Within 0.05; where the two seasonal factors nearly cancel, coefficients are loose and only the likelihood counts."""
    rng = np.random.default_rng(8)
    planted = np.array([[0.5, 0.4, 0.3, 0.5], [-0.4, 0.6, 0.6, -0.2], [0.7, -0.5, -0.3, 0.4], [0.5, 0.4, 0.3, -0.5]])
    w, lengths = np.array([simulated(c, SEASONAL, 4000, rng) for c in planted]), np.full(4, 4000)
    got = statespace.fit_batch(w, lengths, SEASONAL)
    assert np.abs(got - planted)[:3].max() < 0.05
    best, true = (statespace.log_likelihood(w, lengths, c, SEASONAL)[0] for c in (got, planted))
    assert (best >= true).all()


@pytest.mark.parametrize("spec", ALL_ORDERS, ids=lambda s: s.name)
def test_mapped_coefficients_are_stationary_and_invertible(spec):
    rng = np.random.default_rng(1)
    phi, theta = statespace.polynomials(statespace.coefficients(rng.normal(0, 9, (200, sum(spec.blocks))), spec), spec)
    for sign, side in ((-1, phi), (1, theta)):
        for row in side:
            roots = np.roots(np.append(1, sign * row))
            assert not len(roots) or np.abs(roots).max() < 1


@pytest.fixture(scope="module")
def seasonal_panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(4):
        w = simulated([0.3, 0.2, -0.4, -0.5], SEASONAL, 120, rng, 2.0)
        y = list(500 + 20 * np.sin(np.arange(13) / 2))
        for v in w:
            y.append(v + y[-1] + y[-12] - y[-13])
        rows += [(f"c{k}", "price", month(i, 1995), float(v)) for i, v in enumerate(y)]
    rows += [("short", "price", month(i), 1.0) for i in range(20)]
    rows += [("flat", "price", month(i, 1995), 7.0) for i in range(100)]
    return spark.createDataFrame(rows, "city string, target string, ds date, y double").cache()


def test_bands_hold_shock_variance_first_and_widen(seasonal_panel):
    fits = {r.city: r for r in statespace.fit_state_space(seasonal_panel, SEASONAL, 36).collect()}
    assert set(fits) == {"c0", "c1", "c2", "c3", "flat"}
    assert all(p.yhat == pytest.approx(7.0) for p in fits["flat"].path)
    for city, r in fits.items():
        if city != "flat":
            spreads = [p.sd for p in r.path]
            assert spreads[0] >= np.sqrt(r.sigma2) * (1 - 1e-9) and spreads[0] < 1.3 * np.sqrt(r.sigma2)
            assert all(b >= a for a, b in zip(spreads, spreads[1:]))
            assert r.sigma2 == pytest.approx(4.0, rel=0.4)


def test_fixed_forecast_contract(seasonal_panel):
    rows = statespace.forecast_fixed(seasonal_panel, {"price": SEASONAL, "rent": PLAIN}, 36, "2003-12-01").collect()
    ahead = [r for r in rows if r.y_true is None]
    tested = [r for r in rows if r.y_true is not None]
    assert len(ahead) == 5 * 36 and {r.horizon_months for r in ahead} == set(range(1, 37))
    assert {r.city for r in tested} == {"c0", "c1", "c2", "c3"} and all(r.predict_date > month(0, 2003) for r in tested)
    errors = [abs(r.yhat - r.y_true) for r in tested]
    assert np.mean(errors) < 3.5 and np.mean([r.yhat_lower <= r.y_true <= r.yhat_upper for r in tested]) > 0.85


def test_one_step_predictions_use_no_later_value(spark, seasonal_panel):
    """A changed last month leaves every earlier prediction as it was."""
    first = statespace.backtest_state_space(seasonal_panel, SEASONAL, "2003-12-01").collect()
    last = max(r.predict_date for r in first)
    changed = seasonal_panel.selectExpr("city", "target", "ds", f"case when ds = date '{last}' then y + 50 else y end as y")
    second = {(r.city, r.predict_date): r for r in statespace.backtest_state_space(changed, SEASONAL, "2003-12-01").collect()}
    assert all(second[r.city, r.predict_date].yhat == pytest.approx(r.yhat, rel=1e-9) for r in first)


def test_nulls_repeats_and_empty_panels(spark, seasonal_panel):
    holes = seasonal_panel.selectExpr("city", "target", "ds", "case when month(ds) = 5 and year(ds) = 1999 then null else y end as y")
    assert statespace.fit_state_space(holes, PLAIN).count() == 5
    assert statespace.forecast_fixed(seasonal_panel.limit(0), {"price": SEASONAL}, 36).collect() == []
