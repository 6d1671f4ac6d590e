"""Wide to long, long to wide, and nesting."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column names that are measures and not cities.
MEASURE_WORDS = ["date", "sa", "nsa", "hpi", "benchmark", "composite", "index", "price", "average"]
# Words of housing types, whose columns are no cities and no overall index.
HOUSING_WORDS = ["apartment", "condo", "detached", "family", "house", "row", "single", "storey", "story", "townhouse", "unit"]
# What an overall index column is named by, best first.
INDEX_WORDS = [("composite", "hpi", "sa"), ("composite", "hpi"), ("composite", "benchmark", "sa"), ("composite", "benchmark"),
               ("hpi", "sa"), ("hpi",), ("benchmark", "sa"), ("benchmark",)]


def _words(name: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", name.lower()))


def melt_years(df: DataFrame, ids: Sequence[str], value: str) -> DataFrame:
    """Year columns (all-digit names) to ``ids, year, value``; a frame with no column but the ids gives no rows."""
    years = [c for c in df.columns if c.strip().isdigit()]
    if not years:
        if set(df.columns) - set(ids):
            raise ValueError("no year columns found")
        return df.select(*ids, F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias(value)).where("false")
    long = df.unpivot([F.col(i) for i in ids], [F.col(f"`{y}`") for y in years], "year", value)
    return long.withColumn("year", F.trim("year").cast("int"))


def melt_measures(
    df: DataFrame, ids: Sequence[str], measures: dict[str, str], name: str = "measure", value: str = "value"
) -> DataFrame:
    """Measure columns to rows under their mapped names; null values dropped, no measure gives no rows."""
    if not measures:
        return df.select(*ids, F.lit(None).cast("string").alias(name), F.lit(None).cast("double").alias(value)).where("false")
    renamed = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(n) for c, n in measures.items()])
    long = renamed.unpivot([F.col(i) for i in ids], [F.col(n) for n in measures.values()], name, value)
    return long.filter(F.col(value).isNotNull())


def melt_city_matrix(df: DataFrame, date: str, value: str = "value") -> DataFrame:
    """City columns to rows; columns whose name holds a word of a measure or a housing type are left out."""
    other = {*MEASURE_WORDS, *HOUSING_WORDS}
    cities = [c for c in df.columns if c != date and not other & _words(c)]
    return melt_measures(df, [date], {c: c for c in cities}, "city", value)


def pivot_metrics(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], order: str, name: str = "metric", value: str = "value"
) -> DataFrame:
    """One column per metric: the first non-null value by ``order``.

    The metric list is given, so no extra job discovers it; ``min_by`` makes the
    choice independent of the arrival order.
    """
    return df.groupBy(*keys).agg(
        *[
            F.min_by(F.col(value), F.when((F.col(name) == m) & F.col(value).isNotNull(), F.col(order))).alias(m)
            for m in metrics
        ]
    )


def pick_best_column(columns: Sequence[str]) -> str | None:
    """The overall index column: composite before plain, HPI before benchmark, adjusted before raw; never a housing type's."""
    overall = [c for c in columns if not _words(c) & set(HOUSING_WORDS)]
    for wanted in INDEX_WORDS:
        for c in overall:
            if set(wanted) <= _words(c):
                return c
    return None


def first_present(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate present, ignoring case and outer blanks."""
    have = {c.strip().lower(): c for c in columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def nest_points(df: DataFrame, keys: Sequence[str], model: str, points: Sequence[str], order: str) -> DataFrame:
    """Rows to ``{model: [points]}`` and the sorted distinct ``order`` values per key."""
    cells = df.groupBy(*keys, model).agg(
        F.sort_array(F.collect_list(F.struct(order, *points))).alias("__points")
    )
    nested = cells.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(model, "__points")))).alias("models"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col(f"__points.{order}"))))).alias("horizons"),
    )
    return nested


def pivot_by_key(
    df: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], value: str
) -> DataFrame:
    """One column per listed name, aligned by key; one value per key and name."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def pivot_models_by_horizon(forecasts: DataFrame, models: Sequence[str], horizon: int | None = None) -> DataFrame:
    """One column per model and one row per series and horizon, up to the selected horizon or all of them."""
    near = forecasts if horizon is None else forecasts.filter(F.col("horizon_months") <= horizon)
    return pivot_by_key(near, ["city", "target", "horizon_months"], "model_name", models, "yhat")
