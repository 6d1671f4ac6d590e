"""Series loaders over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_timeseries(price: DataFrame, rent: DataFrame, metrics: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """All targets as one long frame ``city, target, ds, y``; a filter on target or city pushes down.

    Of the feature table, the adjusted composite index of all property types is the target ``features``.
    """
    parts = [
        price.select("city", F.lit("price").alias("target"), F.col("date").alias("ds"), "y"),
        rent.select("city", F.lit("rent").alias("target"), F.col("date").alias("ds"), "y"),
        metrics.select("city", F.col("metric").alias("target"), F.col("date").alias("ds"), F.col("value").alias("y")),
    ]
    if features is not None:
        whole = features.filter("property_type = 'All'") if "property_type" in features.columns else features
        parts.append(whole.select("city", F.lit("features").alias("target"), F.col("date").alias("ds"), F.col("hpi_composite_sa").alias("y")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("y is not null")


def discover_targets(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Distinct cities per table; an absent table is skipped."""
    out = None
    for name, df in tables.items():
        if df is None:
            continue
        part = df.select(F.lit(name).alias("target"), "city").distinct()
        out = part if out is None else out.unionByName(part)
    return out
