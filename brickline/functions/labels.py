"""Threshold ladders that turn values into labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def affordability_label(v: Column) -> Column:
    return F.when(v >= 0.8, "Tight").when(v >= 0.5, "Moderate").otherwise("Comfortable")


def price_to_rent_label(v: Column) -> Column:
    return F.when(v >= 0.7, "Elevated").when(v >= 0.4, "Balanced").otherwise("Attractive")


def inventory_label(v: Column) -> Column:
    return F.when(v < 0.4, "Low").when(v < 0.7, "Adequate").otherwise("High")


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.05, "POS").when(score < -0.05, "NEG").otherwise("NEU")
