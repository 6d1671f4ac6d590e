"""Listing and rent rows from posting text and survey tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickline.functions import text
from brickline.functions.dates import parse_month, parse_posted_date
from brickline.functions.numbers import parse_number, pct_change
from brickline.operators.filters import select_valid
from brickline.operators.merge import dedupe_keep_last, require_columns
from brickline.operators.reshape import first_present
from brickline.session import settle

# Accepted column names of rent files, best first.
CITY_NAMES = ["city", "location", "market", "metro"]
BEDROOM_NAMES = ["bedroom", "bedrooms", "bedroom_type", "type"]
MEDIAN_NAMES = ["median_rent", "median", "median rent", "median_rent_$", "median ($)"]
AVERAGE_NAMES = ["average_rent", "avg", "average rent", "avg_rent", "average_rent_$"]
MONTH_NAMES = ["month", "date", "period"]


def normalise_listings(
    postings: DataFrame, source: str, city: str, listing_type: str = "rent", city_names: Sequence[str] = ()
) -> DataFrame:
    """Listing rows from ``url, title, body, details, city``.

    Fields of the details panel override those found in the posting text. An
    unreadable date stays null and is marked. Only rows of the wanted city pass;
    null wanted city keeps all.
    """
    body, details = F.col("body"), F.col("details")
    chunk = F.coalesce(F.when(body != "", body), details, F.lit(""))
    native = text.details_field(details, "ad number")
    posted = parse_posted_date(F.coalesce(text.details_field(details, "post date"), body))
    beds = text.details_field(details, "bedrooms").try_cast("double")
    baths = text.details_field(details, "bathrooms").try_cast("double")
    postal = text.extract_postal_code(F.concat_ws(" ", body, details))
    kind = F.coalesce(
        text.normalise_property_type(F.coalesce(F.when(F.col("title") != "", F.col("title")), body)),
        text.breadcrumb_property_type(F.coalesce("breadcrumb", F.lit(""))),
    )
    names = [n.lower() for n in (city_names or [city])] if city else []
    wanted = F.lower(F.trim("city")).isin(names) if names else F.lit(True)
    return postings.filter(wanted).select(
        text.listing_id(source, F.col("url"), native).alias("listing_id"),
        "url",
        posted.alias("date_posted"),
        posted.isNull().alias("is_date_missing"),
        (F.lit(city) if city else F.col("city")).alias("city"),
        postal.alias("postal_code"),
        kind.alias("property_type"),
        F.lit(listing_type).alias("listing_type"),
        text.parse_price(F.regexp_extract(body, r"(\$\s?\d[\d,]*)", 1)).alias("price"),
        F.coalesce(beds, text.parse_beds(chunk)).alias("bedrooms"),
        F.coalesce(baths, text.parse_baths(chunk)).alias("bathrooms"),
        text.parse_area_sqft(chunk).alias("area_sqft"),
        F.lit(None).cast("int").alias("year_built"),
        F.nullif(F.trim(details), F.lit("")).alias("description"),
    )


def postings_from_pages(pages: DataFrame) -> DataFrame:
    """``url, title, body, details, breadcrumb`` text of raw pages."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    crumb = F.regexp_extract("html", r"(?is)<nav[^>]*>(.*?)</nav>", 1)
    return pages.select(
        "page_id",
        "url",
        title.alias("title"),
        text.strip_tags(F.col("html")).alias("body"),
        F.lit(None).cast("string").alias("details"),
        text.strip_tags(crumb).alias("breadcrumb"),
    )


def normalise_rents(raw: DataFrame, source: str, cities: Sequence[str] | None = None, month: Column | None = None) -> DataFrame:
    """Rent survey rows to ``city, date, bedroom_type, median_rent, source``.

    Columns are found by name, the median column is preferred over the average;
    ``month`` serves files without a month column. Later rows replace earlier ones
    by the ``seq`` column if there is one, else by the larger rent.
    """
    names = raw.columns
    rent = first_present(names, MEDIAN_NAMES) or first_present(names, AVERAGE_NAMES)
    if rent is None:
        raise ValueError("no median or average rent column")
    city, bed, when = (first_present(names, c) for c in (CITY_NAMES, BEDROOM_NAMES, MONTH_NAMES))
    date = parse_month(F.col(f"`{when}`")) if when else month
    columns = [
        text.map_city_or_title(F.col(f"`{city}`")).alias("city"),
        date.alias("date"),
        text.normalise_bedrooms(F.col(f"`{bed}`")).alias("bedroom_type"),
        parse_number(F.col(f"`{rent}`")).alias("median_rent"),
        F.lit(source).alias("source"),
        (F.col("seq") if "seq" in names else F.lit(0)).alias("seq"),
    ]
    tidy = select_valid(raw, columns, ["bedroom_type", "median_rent", "date"])
    if cities is not None:
        tidy = tidy.filter(F.col("city").isin(list(cities)))
    return dedupe_keep_last(tidy, ["city", "date", "bedroom_type"], ["seq", "median_rent"]).drop("seq")


def rents_for_upsert(rows: DataFrame) -> DataFrame:
    """Rows for the rent table, ``city, date, bedroom_type, median_rent, source``; an older ``value`` column serves as the rent.

    Dates and rents are read from text; rows without either are left out.
    """
    names = rows.columns
    rent = "median_rent" if "median_rent" in names else "value"
    require_columns(rows, ["city", "date", "bedroom_type", rent, "source"])
    day = F.coalesce(F.col("date").cast("string").try_cast("date"), parse_month(F.col("date")))
    columns = ["city", day.alias("date"), "bedroom_type", parse_number(F.col(rent)).alias("median_rent"), "source"]
    return rows.select(*columns).filter("date is not null and median_rent is not null")


def normalise_statcan(raw: DataFrame, metric: str) -> DataFrame:
    """``REF_DATE, GEO, VALUE`` to metric rows of the target geographies; no GEO column means national.

    One pass: each label, date and value is parsed once in its row.
    """
    by_upper = {c.upper(): c for c in raw.columns}
    if "REF_DATE" not in by_upper or "VALUE" not in by_upper:
        raise ValueError("REF_DATE and VALUE are required")
    geo = F.col(by_upper["GEO"]) if "GEO" in by_upper else F.lit("Canada")
    columns = [
        text.canonical_geo(geo).alias("city"),
        parse_month(F.col(by_upper["REF_DATE"])).alias("date"),
        F.lit(metric).alias("metric"),
        parse_number(F.col(by_upper["VALUE"])).alias("value"),
        F.lit(f"StatCan_{metric.split('_', 1)[-1]}").alias("source"),
    ]
    return select_valid(raw, columns, ["city", "date", "value"])


def derived_row_metrics(listings: DataFrame, ref_year: int, types: Sequence[str]) -> DataFrame:
    """Price per square foot, age and property-type indicator columns."""
    flags = [(F.col("property_type") == k).cast("int").alias(f"is_{k.lower()}") for k in types]
    return listings.select(
        "*",
        F.try_divide(F.col("price"), F.col("area_sqft")).alias("price_per_sqft"),
        (F.lit(ref_year) - F.col("year_built")).alias("property_age"),
        *flags,
    )


def repeat_sales_pairs(sales: DataFrame, segments: int = 4096, keep: Sequence[str] = ()) -> DataFrame:
    """Consecutive sales of the same unit with their log price difference, and the columns to keep of the later sale.

    A unit may hold a large share of the sales, so its history is cut into time
    ranges: pairs inside a range come from one window per (unit, range), and only
    the first and last sale of each range meet those of the next one.
    """
    order = ["date_posted", "listing_id"]
    sales = settle(sales.select("unit_id", *order, "price", *keep), "sales")  # read for the bounds and twice below
    bounds = sales.agg(F.struct(F.min("date_posted").alias("lo"), F.max("date_posted").alias("hi"))).scalar()
    cut = (
        sales.select("unit_id", *order, "price", *keep, bounds.alias("__b"))
        .withColumn("__days", F.greatest(F.lit(1), F.date_diff(F.col("__b.hi"), F.col("__b.lo")) + 1))
        .withColumn(
            "__seg", F.floor(F.date_diff(F.col("date_posted"), F.col("__b.lo")) * segments / F.col("__days")).cast("int")
        )
        .drop("__b", "__days")
    )
    inner = Window.partitionBy("unit_id", "__seg").orderBy(*order)
    row = F.struct(*order, "price", *keep)
    inside = cut.withColumn("__prev", F.lag(row).over(inner))
    ends = cut.groupBy("unit_id", "__seg").agg(F.min(row).alias("__first"), F.max(row).alias("__last"))
    across = ends.withColumn(
        "__prev", F.lag("__last").over(Window.partitionBy("unit_id").orderBy("__seg"))
    ).select("unit_id", "__first.*", "__prev")
    pairs = inside.select("unit_id", *order, "price", *keep, "__prev").unionByName(across).filter("__prev is not null")
    return pairs.select(
        "unit_id",
        "listing_id",
        F.col("__prev.date_posted").alias("first_date"),
        F.col("date_posted").alias("second_date"),
        F.log(F.col("price") / F.col("__prev.price")).alias("log_change"),
        pct_change(F.col("price"), F.col("__prev.price")).alias("change"),
        *keep,
    )
