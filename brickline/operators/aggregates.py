"""Grouped aggregates of the monthly tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.functions.dates import month_floor
from brickline.functions.labels import sentiment_label
from brickline.operators.quantiles import exact_median


def listings_monthly(listings: DataFrame) -> DataFrame:
    """Count, sale count and their ratio per month and city."""
    clean = listings.filter("price is not null and city is not null and date_posted is not null")
    sale = F.count_if(F.lower("listing_type") == "sale")
    return clean.groupBy(month_floor(F.col("date_posted")).alias("date"), "city").agg(
        F.count(F.lit(1)).alias("listings_count"),
        sale.alias("new_listings"),
        F.round(F.try_divide(sale, F.count(F.lit(1))), 3).alias("sales_to_listings_ratio"),
    )


def price_index_from_sales(listings: DataFrame, segments: Sequence[str] = ("House", "Condo")) -> DataFrame:
    """Median price overall and per segment, and the listing count, per city and month.

    Every row counts once for ``All`` and once for its segment, so the medians
    come from one grouped quantile and not from one pass per segment.
    """
    keyed = listings.select("city", month_floor(F.col("date_posted")).alias("date"), "property_type", "price")
    expanded = keyed.select(
        "city",
        "date",
        "price",
        F.explode(
            F.when(F.col("property_type").isin(*segments), F.array(F.lit("All"), F.col("property_type"))).otherwise(
                F.array(F.lit("All"))
            )
        ).alias("segment"),
    )
    med = exact_median(expanded, ["city", "date", "segment"], "price", "m")
    cells = [F.max(F.when(F.col("segment") == s, F.col("m"))).alias(f"median_price_{s.lower()}") for s in segments]
    return med.groupBy("city", "date").agg(
        F.max(F.when(F.col("segment") == "All", F.col("m"))).alias("index_value"),
        *cells,
        F.max(F.when(F.col("segment") == "All", F.col("n"))).alias("active_listings_count"),
    )


def median_price_panel(listings: DataFrame) -> DataFrame:
    """``city, date, y``: the median price per city and month."""
    keyed = listings.select("city", month_floor(F.col("date_posted")).alias("date"), "price")
    return exact_median(keyed, ["city", "date"], "price", "y").drop("n")


def collapse_to_city(features: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Median of each measure over the property types of a city and month.

    (date, city, property_type) is the key of the table, so a group is bounded by
    the number of property types and the plain median aggregate is right.
    """
    return features.groupBy("city", "date").agg(*[F.median(m).alias(m) for m in measures])


def mean_by_key(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])


def daily_sentiment(news: DataFrame, score: str = "sentiment_score") -> DataFrame:
    """Mean score per day and city, labelled from the rounded mean.

    Scores have two digits, so float noise is cut first and ties round up.
    """
    day = news.groupBy("date", "city").agg(F.round(F.round(F.avg(score), 9), 2).alias("sentiment_score"))
    return day.withColumn("sentiment_label", sentiment_label(F.col("sentiment_score")))


def net_migration(components: DataFrame) -> DataFrame:
    """Signed sum per province and year, in thousands."""
    return components.groupBy("province", "year").agg(
        F.round(F.sum(F.col("value") * F.col("sign")) / 1000, 2).alias("migration_rate")
    )


def value_counts_top(df: DataFrame, c: str, n: int) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(c)).limit(n)
