"""Supervised history: monthly means of each source, joined, with future targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import Tables
from brickline.operators.aggregates import mean_by_key
from brickline.operators.joins import chain_left
from brickline.operators.panel import densify_months, lead_by
from brickline.plans.features import pivot_city_metrics

# Forecast horizons of the supervised set in months.
TARGET_MONTHS = {"12m": 12, "24m": 24, "5y": 60, "10y": 120}


def add_lead_targets(df: DataFrame, value: str, prefix: str) -> DataFrame:
    """Value 12/24/60/120 months ahead; rows without a 12-month target are dropped."""
    leads = {f"{prefix}_{label}": lead_by(value, k, ["city"]) for label, k in TARGET_MONTHS.items()}
    return df.withColumns(leads).filter(F.col(f"{prefix}_12m").isNotNull())


def build_history(price: DataFrame, rent: DataFrame, demo: DataFrame, macro: DataFrame) -> DataFrame:
    """Each source is averaged to (city, month) before the joins, the price panel is gap-free."""
    dense = densify_months(price, ["city"])
    joined = chain_left(dense, [rent, demo, macro], ["city", "date"])
    return add_lead_targets(joined, "price", "target")


def build_history_from(t: Tables) -> DataFrame:
    t.stage("sales_monthly", "shipments")
    price = t.sales_monthly.select("city", "date", (F.col("total") / F.col("n")).alias("price"))
    rent = t.rent_panel.withColumnRenamed("y", "rent")
    demo = mean_by_key(t.demographics, ["city", "date"], ["median_income"])
    macro = pivot_city_metrics(t.metrics, t.cities, ["mortgage_rate"])
    return build_history(price, rent, demo, macro)
