"""Migration and population tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.bindings import NATIONAL, Tables
from brickline.functions.numbers import signed_component
from brickline.operators.aggregates import net_migration
from brickline.operators.joins import attach_province_rate
from brickline.operators.topk import latest_per_group


def migration_components(t: Tables) -> DataFrame:
    """province, year, component, sign, value: one row per supplier, year and flow."""
    line = (
        t.raw("lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("flag"))
        .agg(F.sum("l_quantity").alias("value"))
    )
    component = F.when(F.col("flag") == "R", "Emigrants").otherwise("Immigrants")
    return (
        line.join(t.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.cities, F.col("s_nationkey") == F.col("city_key"))
        .select("province", "city", "year", "flag", component.alias("component"), "value")
        .withColumn("sign", signed_component(F.col("component")))
    )


def net_migration_by_province(t: Tables) -> DataFrame:
    return net_migration(migration_components(t))


def population_snapshot(annual: DataFrame, cities: DataFrame, rates: DataFrame) -> DataFrame:
    """Latest population per city with its province rate, and the national row."""
    latest = latest_per_group(annual.select("city", "year", "population"), ["city"], ["year"])
    named = attach_province_rate(cities, rates)
    day = F.make_date(F.col("year"), F.lit(1), F.lit(1)).alias("date")
    city = latest.join(named, "city").select("city", day, "population", F.col("rate").alias("migration_rate"))
    by_year = annual.groupBy("year").agg(F.sum("population").alias("population"))
    total = latest_per_group(by_year.withColumn("city", F.lit(NATIONAL)), ["city"], ["year"])
    return city.unionByName(total.select("city", day, "population", F.lit(1.0).alias("migration_rate")))
