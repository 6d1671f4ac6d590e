"""Lookup joins and grids.

No side is forced to broadcast: dimension sides are small and Spark broadcasts
them only when their measured size is under the session's threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.operators.panel import month_range


def month_city_grid(cities: DataFrame, first: str, last: str) -> DataFrame:
    """Every city with every month of the range, generated row by row."""
    return cities.select(F.explode(month_range(first, last)).alias("date"), "city")


def to_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows of a group (province, country) repeated for each of its cities."""
    return df.join(members.select(key, "city"), key).drop(key)


def to_every_city(df: DataFrame, cities: DataFrame) -> DataFrame:
    """Each row repeated for every city of the dimension, generated from its name list."""
    names = cities.agg(F.sort_array(F.collect_set("city"))).scalar()
    return df.select("*", F.explode(names).alias("city"))


def broadcast_national(df: DataFrame, cities: DataFrame, national: str = "Canada") -> DataFrame:
    """Append the national rows once per city."""
    country = df.filter(F.lower("city") == national.lower()).drop("city")
    return df.unionByName(to_every_city(country, cities).select(*df.columns))


def attach_province_rate(cities: DataFrame, rates: DataFrame, default: float = 1.0) -> DataFrame:
    """City, its province and the province rate; unknown provinces get the default."""
    return cities.join(rates, "province", "left").select(
        "city", "province", F.coalesce("rate", F.lit(default)).alias("rate")
    )


def year_to_month_lookup(monthly: DataFrame, annual: DataFrame, value: str) -> DataFrame:
    """Monthly grid with the value of its calendar year."""
    keyed = monthly.withColumn("year", F.year("date"))
    return keyed.join(annual.select("city", "year", value), ["city", "year"], "left").drop("year")


def fill_missing_members(df: DataFrame, members: DataFrame, year: str, value: str) -> DataFrame:
    """For cities absent from the data, add each year's mean over the present ones."""
    absent = members.select("city").join(df.select("city").distinct(), "city", "left_anti")
    yearly = df.groupBy(year).agg(F.round(F.avg(value), 2).alias(value))
    # Pair by generating the year list on each absent city: years are a calendar, not data volume.
    per_year = yearly.agg(F.collect_list(F.struct(year, value)).alias("__years"))
    filler = absent.select("city", F.explode(per_year.scalar()).alias("__y")).select(
        "city", F.col("__y")[year].alias(year), F.col("__y")[value].alias(value)
    )
    return df.select("city", year, value).unionByName(filler)


def missing_members(expected: DataFrame, present: DataFrame, key: str = "city") -> DataFrame:
    return expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def scale_by_ratio(macro: DataFrame, ratios: DataFrame, value: str = "value", ratio: str = "rent_ratio") -> DataFrame:
    """Each city forecast scaled by every segment ratio of the city."""
    return macro.join(ratios, "city").withColumn("value_scaled", F.col(value) * F.col(ratio))


def chain_left(base: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left joins on the same key; each source must already hold one row per key."""
    out = base
    for s in sources:
        out = out.join(s, list(keys), "left")
    return out
