"""Registered queries on tables without a row: right columns, no crash; ``CHECK_ALL=1`` runs every one."""

from __future__ import annotations

import os

import pytest
from compare import TABLES

import brickline.catalog as catalog

# Reading back what was written, reshaping by found names, learning, streams.
SAMPLE = [
    "read_json_records", "union_sheets", "write_facts", "write_facts_risk", "write_facts_anomaly", "write_replace_slice",
    "snapshot_raw", "melt_years", "melt_measures", "melt_city_matrix", "train_price_model", "train_price_model_scores",
    "hedonic_regression", "hedonic_by_city", "repeat_sales_index", "repeat_sales_sums", "lexicon_sentiment", "stream_upsert",
    "forecast_sequence_panel", "backtest_sequence_panel", "quality_report",
    "forecast_sarima_fixed", "stl_robust_panel", "stationarity_augmented", "stationarity_one_lag",
    "forecast_additive_panel", "backtest_additive_panel", "detect_anomalies_forest", "period_profile", "period_matches",
    "store_model_scores",
]
NAMES = sorted(catalog.QUERIES) if os.environ.get("CHECK_ALL") else SAMPLE
# Queries whose result has rows without any data: counts, fixed lists, measures of nothing.
WITH_ROWS = {"quality_report", "train_price_model_scores"}


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        spark.createDataFrame([], spark.read.parquet(f"{folder}/{name}.parquet").schema).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_query_on_empty_tables(spark, empty, name):
    df = catalog.QUERIES[name](spark, empty)
    rows = df.collect()
    if name in SAMPLE and name not in WITH_ROWS:
        assert rows == [] and df.columns
