"""Registered queries against their check SQL on the smallest data; ``CHECK_ALL=1`` runs every one."""

from __future__ import annotations

import os

import pytest
from compare import compare, oracle_connection

import brickline.catalog as catalog

SAMPLE = [
    "listings_monthly", "price_index_from_sales", "price_yoy_flagship", "score_models", "best_model_per_metric",
    "composite_risk", "describe_numeric", "quality_report", "build_features", "model_features", "fill_missing_members",
    "upsert_last_wins", "upsert_coalesce", "upsert_partial", "insert_ignore", "parse_month", "normalise_listings",
    "normalise_rents", "flatten_observations", "write_facts", "write_replace_slice",
    "rolling_mean", "annual_to_monthly", "extrapolate_last3", "zscore_by_city", "sample_horizon", "repeat_sales_pairs",
    "backtest_ar1", "forecast_drift", "stl_panel", "stationarity_panel", "stationarity_one_lag", "lexicon_sentiment", "serve_risk_gauge",
    "serve_risk_gauge_oldest", "city_report", "stream_daily_sentiment", "stream_sessions", "stream_upsert",
]
NAMES = sorted(catalog.ORACLES) if os.environ.get("CHECK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(folder):
    return oracle_connection(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, folder, con, name):
    result = compare(catalog.QUERIES[name](spark, folder), con, catalog.ORACLES[name])
    assert result in ("", "both empty")


def test_every_entry_is_callable():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
