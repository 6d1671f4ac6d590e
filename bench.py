"""Headline queries at ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm the code paths and then ``BENCH_RUNS`` times; the
median counts. The result is written to Spark's no-op sink, so every row is
computed and none is brought to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brickline.catalog import QUERIES  # noqa: E402
from brickline.session import local_session  # noqa: E402

HEADLINE = [
    "listings_monthly", "price_index_from_sales", "price_yoy_flagship", "describe_numeric", "correlation_matrix",
    "upsert_last_wins", "upsert_coalesce", "dedupe_keep_last", "normalise_listings", "normalise_statcan",
    "rolling_mean", "zscore_by_city", "annual_to_monthly", "build_features", "model_features", "build_history",
    "backtest_ar1", "score_models", "forecast_drift", "forecast_arima_panel", "forecast_additive_panel",
    "forecast_sequence_panel", "detect_anomalies_forest", "stl_panel", "lexicon_sentiment", "repeat_sales_pairs",
    "serve_forecast", "city_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, max(4, int(cpus)))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
