"""What-if tables: each panel row generates its scenario rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.functions.numbers import annuity_payment

# Loan share of the price and term in years.
LOAN_TO_VALUE = 0.8
TERM_YEARS = 25


def _per_case(df: DataFrame, cases: Sequence[float], name: str) -> DataFrame:
    return df.select("*", F.explode(F.array(*[F.lit(float(c)) for c in cases])).alias(name))


def mortgage_scenario(price: DataFrame, rates: Sequence[float]) -> DataFrame:
    """Monthly payment of a typical loan under each annual rate."""
    rows = _per_case(price, rates, "rate")
    payment = annuity_payment(F.col("y") * LOAN_TO_VALUE, F.col("rate"), TERM_YEARS)
    return rows.select("city", "date", "rate", payment.alias("payment"))


def price_stress(price: DataFrame, shocks: Sequence[float]) -> DataFrame:
    rows = _per_case(price, shocks, "shock")
    return rows.select("city", "date", "shock", (F.col("y") * (1 - F.col("shock"))).alias("stressed"))
