"""Numeric coercion, clipping and change rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed a single time, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_number(c: Column) -> Column:
    """Text to double: thousands separators removed, anything else unreadable is null."""
    return nan_to_null(F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")).try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(float("nan")))


def clip_non_negative(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def pct_change(now: Column, before: Column) -> Column:
    """``now / before - 1``; a zero or missing base gives null, never infinity."""
    return F.try_divide(now, before) - 1


def signed_component(component: Column) -> Column:
    """-1 for an outflow (emigrants), else 1."""
    return F.when(F.lower(component).contains("emigrants"), -1).otherwise(1)


def price_to_rent(price: Column, monthly_rent: Column) -> Column:
    return F.try_divide(price, monthly_rent * 12)


def annuity_payment(principal: Column, annual_rate: Column, years: int) -> Column:
    """Monthly payment of a fully amortising loan; a zero rate divides evenly."""
    r = annual_rate / 12
    n = years * 12
    return F.when(r == 0, principal / n).otherwise(principal * r / (1 - F.pow(1 + r, F.lit(-n))))
