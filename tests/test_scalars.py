from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brickline.functions import dates, labels, numbers, text


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_parse_month(spark):
    aug = dt.date(2025, 8, 1)
    inputs = ["2025-08", "2025-08-31", "2025/8", "Aug 2025", "August 2025", "45870", "31 Dec 1934", "n/a", "", None, "2025-13"]
    want = [aug, aug, aug, aug, aug, aug, dt.date(1934, 12, 1), None, None, None, None]
    assert values(spark, dates.parse_month, inputs) == want


def test_month_from_filename(spark):
    names = ["rents_2025-08.csv", "r_2025_10.csv", "aug_2025.json", "Sep2024.csv", "latest.csv"]
    got = values(spark, lambda c: dates.month_from_filename(c, F.lit("2025-03-15")), names)
    assert got == [dt.date(2025, 8, 1), dt.date(2025, 10, 1), dt.date(2025, 8, 1), dt.date(2024, 9, 1), dt.date(2025, 2, 1)]


def test_canonical_geo(spark):
    inputs = ["Kelowna (CMA), British Columbia", "City of Kelowna", "Greater Vancouver, BC", "TORONTO", "Canada", "Montréal", None, "Tóronto, ON"]
    assert values(spark, text.canonical_geo, inputs) == ["Kelowna", "Kelowna", "Vancouver", "Toronto", "Canada", None, None, "Toronto"]


def test_accents(spark):
    assert values(spark, text.strip_accents, ["Œuvre Łódź Ångström Straße", "Québec"]) == ["OEuvre Lodz Angstrom Strasse", "Quebec"]


def test_clean_geo_label(spark):
    inputs = ["CMA of Toronto, Ontario", "Ottawa – Gatineau (map)"]
    assert values(spark, text.clean_geo_label, inputs) == ["Toronto", "Ottawa - Gatineau"]


def test_bedrooms(spark):
    inputs = ["Studio", "1 Bedroom", "two bedroom", "3br", "5 bedroom", "4+", "7 rooms", "loft", "zero bedroom", "Bachelor suite"]
    want = ["0BR", "1BR", "2BR", "3BR", "4BR+", "4BR+", None, None, "0BR", "0BR"]
    assert values(spark, text.normalise_bedrooms, inputs) == want


def test_listing_fields(spark):
    assert values(spark, text.parse_price, ["$1,995 /month", "$2,100", "", None]) == [1995, 2100, None, None]
    assert values(spark, text.parse_beds, ["2 Bed 1.5 Bath", "3BR", "x"]) == [2.0, 3.0, None]
    assert values(spark, text.parse_baths, ["2 Bed 1.5 Bath", "2 ba"]) == [1.5, 2.0]
    assert values(spark, text.parse_area_sqft, ["850 sq ft", "1,200 sqft", "78 m2", "none"]) == [850, 1200, 840, None]
    assert values(spark, text.extract_postal_code, ["near v1y1a1.", "V1Y 1A1", "12345", "V1Y 1 1", "D1Y 1A1"]) == ["V1Y 1A1", "V1Y 1A1", None, None, None]
    assert values(spark, text.normalise_property_type, ["Town house", "Condo apartment", "Basement suite", "lake home", "yurt"]) == [
        "Townhouse", "Condo", "Apartment", "Detached", "Yurt",
    ]
    assert values(spark, text.breadcrumb_property_type, ["Rentals / Apartment-Condo", "Rentals / Town", "Rentals / Yurt"]) == [
        "Condo", "Townhouse", "Yurt",
    ]


def test_posted_date(spark):
    got = values(spark, dates.parse_posted_date, ["Posted: Sep 10, 2025", "September 10, 2025", "today"])
    assert got == [dt.date(2025, 9, 10), dt.date(2025, 9, 10), None]


def test_numbers(spark):
    assert values(spark, numbers.parse_number, ["1,234.5", "..", None, "NaN"]) == [1234.5, None, None, None]
    assert values(spark, lambda c: numbers.pct_change(F.lit(2.0), c), [0.0, 1.0, None], "double") == [None, 1.0, None]
    assert values(spark, numbers.clip_non_negative, [-1.0, 0.0, None], "double") == [0.0, 0.0, None]
    assert values(spark, numbers.signed_component, ["Net emigrants", "Emigrants", "Immigrants"]) == [-1, -1, 1]


def test_annuity(spark):
    got = values(spark, lambda c: numbers.annuity_payment(c, F.lit(0.06), 25), [100000.0], "double")
    assert got[0] == pytest.approx(644.30, abs=0.01)


def test_threshold_edges(spark):
    assert values(spark, labels.sentiment_label, [0.05, -0.05, 0.06, -0.06], "double") == ["NEU", "NEU", "POS", "NEG"]
    assert values(spark, labels.affordability_label, [0.8, 0.5, 0.49], "double") == ["Tight", "Moderate", "Comfortable"]
    assert values(spark, labels.price_to_rent_label, [0.7, 0.4, 0.39], "double") == ["Elevated", "Balanced", "Attractive"]
    assert values(spark, labels.inventory_label, [0.39, 0.4, 0.7], "double") == ["Low", "Adequate", "High"]


def test_pid_and_horizon(spark):
    assert values(spark, text.normalise_pid, ["18-10-0004-01", "1810"]) == ["18100004", None]
    assert values(spark, dates.parse_horizon, ["1y", "10Y", "3y"]) == [12, 120, None]
