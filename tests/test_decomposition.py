"""Robust decomposition and the augmented unit-root test against plain versions and planted series."""

from __future__ import annotations

import numpy as np
import pytest
from months import month

from brickline.plans import decomposition, loess


def plain_line(y, robust, span, target):
    """A weighted straight line at one target, solved as it stands."""
    x, n = np.arange(len(y)), len(y)
    away = np.abs(x - target)
    width = np.sort(away)[min(span, n) - 1] + max(0, span - n) / 2
    weight = np.where(away / width >= 0.999, 0, (1 - np.minimum(away / width, 1) ** 3) ** 3) * robust
    design = np.stack([np.ones(n), x - target], 1) * np.sqrt(weight)[:, None]
    return np.linalg.lstsq(design, y * np.sqrt(weight), rcond=None)[0][0]


@pytest.mark.parametrize("n, span, out", [(40, 13, 0), (40, 23, 0), (9, 7, 1), (5, 7, 1)])
def test_local_line_equals_weighted_least_squares(n, span, out):
    rng = np.random.default_rng(n)
    y, robust = rng.normal(size=(2, n)), rng.uniform(0.1, 1, (2, n))
    got = loess.local_line(y, robust, span, out, out)
    for row in range(2):
        want = [plain_line(y[row], robust[row], span, t) for t in range(-out, n + out)]
        assert np.allclose(got[row], want, atol=1e-3)


def season(n):
    return 30 * np.sin(2 * np.pi * np.arange(n) / 12)


def test_trend_and_season_come_back():
    t = np.arange(120)
    y = (1000 + 2.5 * t + season(120))[None]
    trend, seasonal, weight = loess.seasonal_trend(y)
    assert np.abs(trend[0] - 1000 - 2.5 * t).max() < 1 and np.abs(seasonal[0] - season(120)).max() < 1


def test_an_outlier_moves_neither_season_nor_trend():
    rng = np.random.default_rng(2)
    t = np.arange(144)
    y = 1000 + 2.5 * t + season(144) + rng.normal(0, 2, 144)
    spiked = y.copy()
    spiked[70] += 600
    trends, seasons, weights = loess.seasonal_trend(np.stack([y, spiked]))
    assert weights[1, 70] == 0
    assert np.abs(seasons[1] - seasons[0]).max() < 3 and np.abs(trends[1] - trends[0]).max() < 3
    _, plain, _ = loess.seasonal_trend(np.stack([y, spiked]), outer=0)
    assert np.abs(plain[1] - plain[0]).max() > 60


def test_robust_panel_contract(panel_of):
    long = [500 + i + float(season(60)[i]) for i in range(60)]
    panel = panel_of(a=long, short=[1.0] * 20, flat=[4.0] * 30)
    rows = loess.robust_decomposition(panel).collect()
    assert len(rows) == 110
    for r in rows:
        if r.city == "short":
            assert r.trend is None and r.seasonal is None and r.resid is None
        else:
            assert r.trend + r.seasonal + r.resid == pytest.approx(r.y)
    assert all(r.trend == pytest.approx(4) and r.seasonal == pytest.approx(0, abs=1e-9) for r in rows if r.city == "flat")
    assert loess.robust_decomposition(panel.limit(0)).collect() == []
    plan = loess.robust_decomposition(panel)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def plain_test(y, max_lag):
    d, best = np.diff(y), None
    for lags in range(max_lag + 1):
        t = np.arange(max_lag, len(d))
        design = np.stack([np.ones(len(t)), y[t], *[d[t - k] for k in range(1, lags + 1)]], 1)
        b, *_ = np.linalg.lstsq(design, d[t], rcond=None)
        sse = ((d[t] - design @ b) ** 2).sum()
        aic = len(t) * np.log(sse / len(t)) + 2 * design.shape[1]
        if best is None or aic < best[0]:
            inverse = np.linalg.inv(design.T @ design)
            best = aic, lags, b[1] / np.sqrt(sse / (len(t) - design.shape[1]) * inverse[1, 1]), len(t)
    return best[1:]


def test_augmented_test_equals_regressions_from_rows(panel_of):
    rng = np.random.default_rng(6)
    walk = 900 + np.cumsum(rng.normal(size=200))
    steady, hidden = [900.0, 900.0, 900.0], [0.0] * 4
    for _ in range(197):
        steady.append(900 + 0.4 * (steady[-1] - 900) + rng.normal())
        hidden.append(0.7 * hidden[-1] - 0.6 * hidden[-2] + 0.5 * hidden[-3] + rng.normal())
    lagged = 900 + np.cumsum(hidden[:200])
    series = {"walk": walk, "steady": np.array(steady), "lagged": lagged}
    got = {r.city: r for r in decomposition.augmented_unit_root(panel_of(**{k: list(v) for k, v in series.items()})).collect()}
    for city, y in series.items():
        lags, t, n = plain_test(y, decomposition.MAX_LAG)
        assert (got[city].lags, got[city].n_obs) == (lags, n)
        assert got[city].t_stat == pytest.approx(t, rel=1e-6)
    assert got["lagged"].lags >= 3
    assert got["steady"].is_stationary and not got["walk"].is_stationary
    assert got["walk"].critical_1 < got["walk"].critical_5 < got["walk"].critical_10


def test_p_values_agree_with_the_critical_values():
    for name, p in (("critical_1", 0.01), ("critical_5", 0.05), ("critical_10", 0.10)):
        assert decomposition.unit_root_p(decomposition.CRITICAL[name][0]) == pytest.approx(p, abs=0.002)
    values = [decomposition.unit_root_p(t) for t in np.linspace(-20, 4, 200)]
    assert all(b >= a - 1e-3 for a, b in zip(values, values[1:])) and values[0] == 0 and values[-1] == 1


def test_flat_straight_short_and_empty_series(panel_of):
    panel = panel_of(flat=[5.0] * 60, line=[float(i) for i in range(60)], short=[1.0, 2.0, 4.0])
    rows = {r.city: r for r in decomposition.augmented_unit_root(panel).collect()}
    assert set(rows) == {"flat", "line"}
    assert all(r.t_stat is None and r.p_value is None and not r.is_stationary for r in rows.values())
    assert decomposition.augmented_unit_root(panel.limit(0)).collect() == []
