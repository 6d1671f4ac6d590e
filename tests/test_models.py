"""Properties of the modelling jobs, and the contracts of forecast, risk and anomaly results."""

from __future__ import annotations

import numpy as np
import pytest
from months import month
from pyspark.sql import functions as F

from brickline.operators.joins import scale_by_ratio
from brickline.operators.regression import fit_ridge
from brickline.plans import additive, anomalies, arima, baselines, evaluate, risk, sequence, statespace

CUT = "2005-12-01"


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(7)
    rows = []
    for city, phi in (("a", 0.6), ("b", 0.9)):
        y = 500.0
        for i in range(96):
            y = 500 * (1 - phi) + phi * y + rng.normal(0, 10)
            rows.append((city, "price", month(i), float(y + 5 * np.sin(2 * np.pi * i / 12))))
    return spark.createDataFrame(rows, "city string, target string, ds date, y double").cache()


def check_forecast(df, series, horizon=60):
    rows = df.collect()
    assert len(rows) == series * horizon
    assert {r.horizon_months for r in rows} == set(range(1, horizon + 1))
    for r in rows:
        assert 0 <= r.yhat_lower <= r.yhat <= r.yhat_upper
    return rows


def test_arima_forecast_contract(noisy):
    rows = check_forecast(arima.forecast_arima(noisy), 2)
    again = {(r.city, r.horizon_months): r.yhat for r in arima.forecast_arima(noisy).collect()}
    assert all(again[r.city, r.horizon_months] == pytest.approx(r.yhat, rel=1e-9) for r in rows)


def test_arima_extends_a_line_exactly(panel_of):
    line = panel_of(a=[100 + 3 * i for i in range(60)])
    spec = arima.fixed_spec("line", (1, 0), (), ())
    rows = arima.forecast_arima(line, spec, 12).collect()
    for r in rows:
        assert r.yhat == pytest.approx(100 + 3 * (59 + r.horizon_months), rel=1e-5)


def test_first_order_arima_agrees_with_the_closed_form(noisy):
    """The long autoregression drops early rows, so both are fitted on the same later sample."""
    spec = arima.fixed_spec("ar1", (0, 0), (1,), ())
    rows = arima.with_lags(noisy, spec)
    got = {r.city: r.coefs[1] for r in arima.select_order(rows, spec).collect()}
    sample = rows.filter("in_fit").groupBy("city").agg(F.regr_slope("z", "z1").alias("b"))
    for r in sample.collect():
        assert got[r.city] == pytest.approx(r.b, abs=1e-4)


def test_arima_recovers_the_coefficient(spark):
    rng = np.random.default_rng(3)
    y, rows = 0.0, []
    for i in range(1200):
        y = 0.7 * y + rng.normal()
        rows.append(("a", "price", month(i, 1900), float(1000 + y)))
    df = spark.createDataFrame(rows, "city string, target string, ds date, y double")
    spec = arima.fixed_spec("ar1", (0, 0), (1,), ())
    coefs = arima.select_order(arima.with_lags(df, spec), spec).first().coefs
    assert coefs[1] == pytest.approx(0.7, abs=0.07)


def test_arima_backtest_beats_nothing_by_cheating(noisy):
    rows = arima.backtest_arima(noisy, cutoff=CUT).collect()
    assert len(rows) == 2 * 24
    err = np.mean([abs(r.yhat - r.y_true) for r in rows])
    assert 1 < err < 25


def test_seasonal_order_runs(noisy):
    check_forecast(statespace.forecast_state_space(noisy, statespace.SEASONAL, 36), 2, 36)


def test_additive_follows_trend_and_season(spark):
    rows = [("a", "price", month(i), float(1000 + 4 * i + 50 * np.sin(2 * np.pi * i / 12)), float(i % 5)) for i in range(96)]
    df = spark.createDataFrame(rows, "city string, target string, ds date, y double, rate double")
    out = {r.horizon_months: r for r in check_forecast(additive.forecast_additive(df, ["rate"]), 1)}
    for h in (1, 6, 12):
        want = 1000 + 4 * (95 + h) + 50 * np.sin(2 * np.pi * (95 + h) / 12)
        assert out[h].yhat == pytest.approx(want, rel=0.05)
    back = additive.backtest_additive(df, ["rate"], CUT).collect()
    assert len(back) == 24 and all(r.y_true is not None for r in back)


def test_sequence_steps_are_clipped(noisy):
    df = noisy.withColumn("rate", F.lit(1.0))
    rows = check_forecast(sequence.forecast_sequence(df, ["rate"]), 2)
    for r in rows:
        assert r.yhat_upper - r.yhat_lower <= 0.1 * r.yhat / 0.7 + 1e-9
    assert len(sequence.backtest_sequence(noisy, CUT).collect()) == 48


def test_short_series_are_left_out(panel_of):
    s = panel_of(a=[100 + i for i in range(35)])
    assert arima.forecast_arima(s).count() == 0
    assert sequence.forecast_sequence(s.withColumn("r", F.lit(0.0)), ["r"]).count() == 0


def test_drift_contract_on_a_trend(panel_of):
    s = panel_of(a=[100 + 5 * i for i in range(24)])
    rows = baselines.forecast_drift(s, 12).orderBy("horizon_months").collect()
    assert [r.yhat for r in rows] == [pytest.approx(100 + 5 * (23 + h)) for h in range(1, 13)]
    names = {"model_name", "target", "horizon_months", "city", "predict_date", "yhat", "yhat_lower", "yhat_upper"}
    assert names <= set(rows[0].asDict())


def test_pooled_ridge_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.1
    rows = [("g", 1.0, *map(float, r), float(t)) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, "g string, one double, a double, b double, c double, y double")
    coefs = fit_ridge(df, ["g"], ["one", "a", "b", "c"], "y", 1e-9).first().coefs
    assert coefs == pytest.approx([0.1, 1.0, -2.0, 0.5], abs=1e-6)


def test_planted_spikes_are_flagged(panel_of):
    s = panel_of(a=[100] * 20 + [500, 600, 700, 800])
    for detect in (anomalies.detect_zscore, anomalies.detect_forest):
        rows = detect(s).collect()
        assert len(rows) == 24
        assert any(r.is_anomaly and r.value >= 500 for r in rows)
    forest = anomalies.detect_forest(s).collect()
    assert 1 <= sum(r.is_anomaly for r in forest) <= 3
    assert all(r.value >= 500 for r in forest if r.is_anomaly)


def test_short_and_tied_series_by_forest(panel_of):
    spike = anomalies.detect_forest(panel_of(a=[1] * 8 + [900])).collect()
    assert [r.value for r in spike if r.is_anomaly] == [900]
    assert not any(r.is_anomaly for r in anomalies.detect_forest(panel_of(a=[7] * 12, b=[3])).collect())


def test_price_model_learns_only_from_labels_known_by_the_cutoff(spark):
    import datetime as dt

    from brickline.plans.learned import prediction_scores, train_price_model

    months = [dt.date(2000 + k // 12, k % 12 + 1, 1) for k in range(60)]
    cutoff = dt.date(2003, 12, 1)
    # Labels of rows within a year of the cutoff are absurd: a model that had seen them would not predict about 100.
    rows = [("a", m, float(k % 7), 1e6 if dt.date(2002, 12, 1) < m <= cutoff else 100.0 if k < 59 else None) for k, m in enumerate(months)]
    history = spark.createDataFrame(rows, "city string, date date, x double, target_12m double")
    got = train_price_model(history, ["x"], "target_12m", "2003-12-01").collect()
    assert [r["date"] for r in sorted(got)] == [m for m in months if m > cutoff]
    assert all(abs(r["prediction"] - 100) < 1 for r in got)
    scores = {r["metric"]: r["value"] for r in prediction_scores(spark.createDataFrame(got)).collect()}
    assert scores["n"] == 11 and scores["mae"] < 1


def test_risk_values_stay_between_zero_and_one(panel_of):
    s = panel_of(a=[500000 + 10000 * i for i in range(12)], b=[2e6])
    got = {r.city: r.risk_value for r in risk.affordability(s, ["city"]).collect()}
    assert got == {"a": pytest.approx(0.61), "b": 1.0}


def test_composite_ignores_itself_and_defaults_to_zero(spark):
    rows = [("a", None, "affordability", 0.2), ("a", None, "inventory", 0.4), ("a", None, "composite_index", 9.0), ("b", None, "composite_index", 1.0)]
    df = spark.createDataFrame(rows, "city string, predict_date date, risk_type string, risk_value double")
    assert {r.city: r.risk_value for r in risk.composite_risk(df).collect()} == {"a": pytest.approx(0.3), "b": 0.0}


def test_scaling_by_segment_ratio(spark):
    macro = spark.createDataFrame([("x", month(i), 1500 + 10 * i) for i in range(12)], "city string, date date, value long")
    ratios = spark.createDataFrame([("x", "Condo", 1, 0.9), ("x", "House", 2, 1.2)], "city string, property_type string, beds int, rent_ratio double")
    out = scale_by_ratio(macro, ratios)
    assert out.count() == 24
    assert out.filter("property_type = 'Condo'").orderBy("date").first().value_scaled == pytest.approx(1350.0)


def test_r2_is_null_without_variance(spark):
    rows = [("m", "a", "price", 1, 10.0, 11.0)]
    df = spark.createDataFrame(rows, "model_name string, city string, target string, horizon_months int, yhat double, y_true double")
    r = evaluate.score_models(df).first()
    assert (r.mae, r.r2) == (1.0, None)


def test_zero_base_does_not_break_mape(spark):
    rows = [("m", "a", "price", 1, 10.0, 0.0), ("m", "a", "price", 1, 10.0, 20.0)]
    df = spark.createDataFrame(rows, "model_name string, city string, target string, horizon_months int, yhat double, y_true double")
    assert evaluate.score_models(df).first().mape == 50.0
