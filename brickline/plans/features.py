"""The month x city feature table and the model features derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import FIRST_MONTH, LAST_MONTH, Tables
from brickline.operators.aggregates import collapse_to_city
from brickline.operators.joins import broadcast_national, chain_left, month_city_grid
from brickline.operators.panel import drop_warmup, forward_fill, lagged, rolling_mean, yoy, zscore
from brickline.operators.reshape import pivot_metrics
from brickline.schemas import DERIVED_MEASURES, FEATURE_METRICS, FILL_ZERO, RAW_MEASURES
from brickline.session import settle

FEATURES_SOURCE = "features_v1"
MODEL_FEATURES_VERSION = "model_features_city_v1"


def pivot_city_metrics(metrics: DataFrame, cities: DataFrame, names=FEATURE_METRICS) -> DataFrame:
    """One column per metric; a city's own row wins over the national copy."""
    everywhere = broadcast_national(metrics, cities).filter(F.col("city") != "Canada")
    return pivot_metrics(everywhere, ["date", "city"], names, order="source")


def macro_by_city(macro: DataFrame, cities: DataFrame) -> DataFrame:
    """City rows and copies of the national rows folded into one row per key."""
    everywhere = broadcast_national(macro, cities).filter(F.col("city") != "Canada")
    return everywhere.groupBy("date", "city").agg(
        F.max("gdp_growth").alias("gdp_growth"), F.max("cpi_yoy").alias("cpi_yoy")
    )


def build_features(
    cities: DataFrame,
    price: DataFrame,
    rent: DataFrame,
    metrics: DataFrame,
    demographics: DataFrame,
    macro: DataFrame,
    first: str,
    last: str,
) -> DataFrame:
    """Left joins of five sources on the month x city grid, zero fills and yearly changes.

    Every source is brought to one row per (date, city) first, so no join
    multiplies rows. Price change does not pad gaps, rent change does.
    """
    grid = month_city_grid(cities, first, last)
    sources = [
        price.select("date", "city", F.col("y").alias("hpi_benchmark")),
        rent.select("date", "city", F.col("y").alias("rent_avg_city")),
        pivot_city_metrics(metrics, cities),
        demographics,
        macro_by_city(macro, cities),
    ]
    wide = chain_left(grid, sources, ["date", "city"])
    wide = wide.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FILL_ZERO})
    padded = wide.withColumn("__rent", forward_fill("rent_avg_city", ["city"]))
    return (
        padded.withColumn("population", F.col("population").cast("bigint"))
        .withColumn("hpi_change_yoy", F.coalesce(yoy("hpi_benchmark", ["city"]) * 100, F.lit(0.0)))
        .withColumn("rent_change_yoy", F.coalesce(yoy("__rent", ["city"]) * 100, F.lit(0.0)))
        .withColumn("source", F.lit(FEATURES_SOURCE))
        .drop("__rent")
    )


def build_features_from(t: Tables) -> DataFrame:
    t.stage("price_panel", "sales_monthly", "shipments")
    return build_features(
        t.cities.select("city"), t.price_panel, t.rent_panel, t.metrics, t.demographics, t.macro, FIRST_MONTH, LAST_MONTH
    )


def model_features(features: DataFrame, warmup: int = 12, fit=None) -> DataFrame:
    """Collapse to city, lags 1/3/6, rolling means 3/6, yearly change, z-scores, warm-up dropped.

    All windows share ``city`` partitions ordered by date: one shuffle. Yearly
    change pads gaps forward; z-scores use the whole history unless ``fit`` limits it.
    """
    k = ["city"]
    base = collapse_to_city(features, RAW_MEASURES)
    padded = base.withColumns({f"__{c}": forward_fill(c, k) for c in ("hpi_benchmark", "rent_avg_city")})
    derived = padded.withColumns(
        {
            "hpi_benchmark_yoy": yoy("__hpi_benchmark", k),
            "rent_avg_city_yoy": yoy("__rent_avg_city", k),
            "lag_1": lagged("hpi_benchmark", 1, k),
            "lag_3": lagged("hpi_benchmark", 3, k),
            "lag_6": lagged("hpi_benchmark", 6, k),
            "roll_3": rolling_mean("hpi_benchmark", 3, k),
            "roll_6": rolling_mean("hpi_benchmark", 6, k),
        }
    ).drop("__hpi_benchmark", "__rent_avg_city")
    scored = derived.withColumns({f"{c}_z": zscore(c, k, fit) for c in RAW_MEASURES + DERIVED_MEASURES})
    return drop_warmup(scored, k, warmup).withColumn("etl_version", F.lit(MODEL_FEATURES_VERSION))


def model_features_from(t: Tables) -> DataFrame:
    """Both jobs in sequence; the feature table is stored between them."""
    return model_features(settle(build_features_from(t), "features"))
