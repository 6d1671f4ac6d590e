"""Predicates of the ingest and serving reads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_dimensions(df: DataFrame, **wanted) -> DataFrame:
    """Equality, membership (list) or inclusive range (tuple of two) per column."""
    for c, v in wanted.items():
        if isinstance(v, tuple):
            df = df.filter(F.col(c).between(*v))
        elif isinstance(v, list):
            df = df.filter(F.col(c).isin(v))
        else:
            df = df.filter(F.col(c) == v)
    return df


def filter_contains(df: DataFrame, name_part: str, text: str) -> DataFrame:
    """Case-insensitive substring on every column whose name holds ``name_part``."""
    for c in [c for c in df.columns if name_part.lower() in c.lower()]:
        df = df.filter(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())))
    return df


def open_range(c: Column, low: float, high: float) -> Column:
    return (c > low) & (c < high)


def filter_geo_with_fallback(df: DataFrame, targets: Sequence[str], national: str = "Canada") -> DataFrame:
    """Target cities; if there are none the national rows; if none of those, all rows.

    The presence flags are two booleans from one aggregate, attached as a scalar.
    """
    is_target, is_national = F.col("city").isin(list(targets)), F.col("city") == national
    flags = df.agg(
        F.struct(
            F.coalesce(F.bool_or(is_target), F.lit(False)).alias("t"),
            F.coalesce(F.bool_or(is_national), F.lit(False)).alias("n"),
        )
    ).scalar()
    return (
        df.withColumn("__f", flags)
        .filter(F.when(F.col("__f.t"), is_target).when(F.col("__f.n"), is_national).otherwise(True))
        .drop("__f")
    )


def drop_null_subset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def select_valid(df: DataFrame, columns: Sequence[Column], required: Sequence[str]) -> DataFrame:
    """Project, then drop rows with a null in a required column, computing each expression once.

    A plain filter after a projection is pushed below it together with a copy of
    every expression it needs, which doubles the cost of parsing.
    """

    def complete(row: Column) -> Column:
        return reduce(lambda a, b: a & b, [row[c].isNotNull() for c in required])

    return df.select(F.inline(F.filter(F.array(F.struct(*columns)), complete)))


def filter_segment_or_any(
    df: DataFrame,
    property_type: str | None = None,
    beds: int = -1,
    baths: int = -1,
    sqft_min: int | None = None,
    sqft_max: int | None = None,
    year_built_min: int | None = None,
    year_built_max: int | None = None,
) -> DataFrame:
    """Optional segment predicates; -1 means the unsegmented rows (null)."""
    if property_type:
        df = df.filter(F.col("property_type") == property_type)
    for c, v in (("beds", beds), ("baths", baths)):
        df = df.filter(F.col(c).isNull() if v == -1 else F.col(c) == v)
    if sqft_min:
        df = df.filter(F.col("sqft_min") >= sqft_min)
    if sqft_max:
        df = df.filter(F.col("sqft_max") <= sqft_max)
    if year_built_min:
        df = df.filter(F.col("year_built_min") >= year_built_min)
    if year_built_max:
        df = df.filter(F.col("year_built_max") <= year_built_max)
    return df


def filter_ci(df: DataFrame, **wanted: str) -> DataFrame:
    """Case-insensitive equality per column."""
    for c, v in wanted.items():
        df = df.filter(F.lower(c) == v.lower())
    return df


def negative_forecasts(df: DataFrame) -> DataFrame:
    return df.filter("yhat < 0 or yhat_lower < 0 or yhat_upper < 0")
