"""Annual and provincial series brought to the monthly city grid, with provenance flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickline.operators.joins import month_city_grid, to_every_city, to_members, year_to_month_lookup
from brickline.operators.panel import forward_fill, reindex_months, whole, yoy


def fill_and_flag(df: DataFrame, keys: Sequence[str], value: str, tag: str, suffix: str = "_FF") -> DataFrame:
    """Forward fill; rows after the last real one carry the suffixed source tag."""
    last_real = F.max(F.when(F.col(value).isNotNull(), F.col("date"))).over(whole(keys))
    return (
        df.withColumn("__last", last_real)
        .withColumn(value, forward_fill(value, keys))
        .withColumn("source", F.when(F.col("date") > F.col("__last"), f"{tag}{suffix}").otherwise(tag))
        .drop("__last")
    )


def cpi_by_city(index: DataFrame, cities: DataFrame, first: str, last: str) -> DataFrame:
    """Province index on the full month range, filled, yearly change in percent, copied to its cities."""
    full = reindex_months(index, ["province"], first, last)
    filled = fill_and_flag(full, ["province"], "cpi_index", "cpi")
    change = filled.withColumn("cpi_yoy", yoy("cpi_index", ["province"]) * 100).filter("cpi_yoy is not null")
    return to_members(change.select("province", "date", "cpi_yoy", "source"), cities, "province")


def gdp_by_city(output: DataFrame, cities: DataFrame, first: str, last: str) -> DataFrame:
    """One national series: month means, full range, filled, yearly change, copied to every city."""
    national = output.groupBy("date").agg(F.avg("gdp").alias("gdp")).withColumn("country", F.lit("national"))
    full = reindex_months(national, ["country"], first, last).withColumn("gdp", forward_fill("gdp", ["country"]))
    change = full.select("date", (yoy("gdp", ["country"]) * 100).alias("gdp_growth"))
    return to_every_city(change, cities)


def expand_annual(annual: DataFrame, cities: DataFrame, first: str, last: str) -> DataFrame:
    """City months with the value of their year; the tail repeats the last year and is flagged LOCF."""
    grid = month_city_grid(cities, first, last)
    keyed = year_to_month_lookup(grid, annual, "value")
    last_real = F.max(F.when(F.col("value").isNotNull(), F.col("date"))).over(whole(["city"]))
    flagged = keyed.withColumn(
        "data_flag",
        F.when(F.col("value").isNull() & (F.col("date") > last_real), "LOCF").otherwise("DERIVED_ANNUAL"),
    )
    return flagged.withColumn("value", forward_fill("value", ["city"])).select("city", "date", "value", "data_flag")


def impute_group_mean(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Missing values take the mean of their group."""
    return df.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(group))))
