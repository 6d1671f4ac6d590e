"""Risk components, their composite and the gauge labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import Tables
from brickline.functions.numbers import price_to_rent
from brickline.operators.panel import minmax
from brickline.session import settle

# Fixed value: price at which affordability risk saturates.
AFFORDABILITY_CAP = 1_000_000


def affordability(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last value of each series over the cap, at most 1."""
    return series.filter("y is not null").groupBy(*keys).agg(
        F.least(F.max_by("y", "ds") / AFFORDABILITY_CAP, F.lit(1.0)).alias("risk_value"),
        F.max("ds").alias("predict_date"),
    )


def horizon_risks(forecasts: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Affordability risk at the end of each forecast horizon: the path up to it is the series."""
    path = forecasts.select(
        "city", "target", "model_name", F.col("predict_date").alias("ds"), F.col("yhat").alias("y"), "horizon_months",
        F.explode(F.array(*map(F.lit, horizons))).alias("horizon"),
    ).filter("horizon_months <= horizon")
    risks = affordability(path, ["city", "target", "model_name", "horizon"])
    return risks.select(
        "city", "target", "model_name", F.col("horizon").alias("horizon_months"), "predict_date",
        F.lit("affordability").alias("risk_type"), "risk_value",
    )


def risk_panel(price: DataFrame, rent: DataFrame, listings: DataFrame) -> DataFrame:
    """city, date and one 0..1 column per component."""
    joined = (
        price.withColumnRenamed("y", "price")
        .join(rent.withColumnRenamed("y", "rent"), ["city", "date"], "left")
        .join(listings, ["city", "date"], "left")
        .withColumn("ratio", price_to_rent(F.col("price"), F.col("rent")))
    )
    return joined.select(
        "city",
        "date",
        F.least(F.col("price") / AFFORDABILITY_CAP, F.lit(1.0)).alias("affordability"),
        minmax("ratio", ["city"]).alias("price_to_rent"),
        minmax("listings", ["city"]).alias("inventory"),
    )


def risk_components(t: Tables) -> DataFrame:
    """city, predict_date, risk_type, risk_value; missing components have no row."""
    wide = risk_panel(t.price_panel, t.rent_panel, t.sales_monthly.select("city", "date", F.col("n").alias("listings")))
    long = wide.unpivot(
        ["city", "date"], ["affordability", "price_to_rent", "inventory"], "risk_type", "risk_value"
    )
    return long.filter("risk_value is not null").withColumnRenamed("date", "predict_date")


def composite_risk(components: DataFrame) -> DataFrame:
    """Mean of the components without the composite itself, 0 when there are none."""
    parts = F.when(F.col("risk_type") != "composite_index", F.col("risk_value"))
    return components.groupBy("city", "predict_date").agg(
        F.lit("composite_index").alias("risk_type"), F.coalesce(F.avg(parts), F.lit(0.0)).alias("risk_value")
    )


def all_risks(t: Tables) -> DataFrame:
    parts = settle(risk_components(t), "risk-components")
    return parts.unionByName(composite_risk(parts).select(*parts.columns))
