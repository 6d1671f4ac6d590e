"""Windows, fills and calendar operators over panels keyed by series and month.

A panel holds one row per series and month, so a window partition is bounded by
the calendar and not by the number of raw rows. All operators share the same
partitioning and ordering: Spark shuffles once per chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from brickline.functions.numbers import pct_change

# Fixed value: added to the standard deviation before dividing.
Z_EPSILON = 1e-6


def by_date(keys: Sequence[str], date: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(date)


def whole(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def lagged(c: str, k: int, keys: Sequence[str], date: str = "date") -> Column:
    return F.lag(c, k).over(by_date(keys, date))


def lead_by(c: str, k: int, keys: Sequence[str], date: str = "date") -> Column:
    return F.lead(c, k).over(by_date(keys, date))


def diff(c: str, keys: Sequence[str], date: str = "date") -> Column:
    return F.col(c) - lagged(c, 1, keys, date)


def rolling(agg, c: str, k: int, keys: Sequence[str], date: str = "date") -> Column:
    """Trailing aggregate of ``k`` rows, null until ``k`` values are present."""
    frame = by_date(keys, date).rowsBetween(-k + 1, 0)
    return F.when(F.count(c).over(frame) == k, agg(c).over(frame))


def rolling_mean(c: str, k: int, keys: Sequence[str], date: str = "date") -> Column:
    return rolling(F.avg, c, k, keys, date)


def rolling_std(c: str, k: int, keys: Sequence[str], date: str = "date") -> Column:
    return rolling(F.stddev_samp, c, k, keys, date)


def forward_fill(c: str | Column, keys: Sequence[str], date: str = "date") -> Column:
    return F.last(c, ignorenulls=True).over(by_date(keys, date).rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(c: str | Column, keys: Sequence[str], date: str = "date") -> Column:
    return F.first(c, ignorenulls=True).over(by_date(keys, date).rowsBetween(0, Window.unboundedFollowing))


def fill_both(c: str, keys: Sequence[str], date: str = "date") -> Column:
    return F.coalesce(forward_fill(c, keys, date), backward_fill(c, keys, date))


def rolling_centered(df: DataFrame, c: str, alias: str, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Mean of the previous and the current row, gaps filled backward then forward."""
    raw = df.withColumn(alias, rolling_mean(c, 2, keys, date))
    return raw.withColumn(alias, F.coalesce(backward_fill(alias, keys, date), forward_fill(alias, keys, date)))


def yoy(c: str, keys: Sequence[str], date: str = "date", months: int = 12) -> Column:
    """Change over ``months`` rows as a fraction; the panel must be gap-free."""
    return pct_change(F.col(c), lagged(c, months, keys, date))


def densify_months(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Insert the missing months inside each series; added rows carry nulls.

    Each row generates the months up to the next row, so one shuffle by the
    series key does it and no join against a calendar is needed.
    """
    until = F.coalesce(F.add_months(F.col("__next"), -1), F.col(date))
    span = F.sequence(F.col(date), until, F.expr("interval 1 month"))
    rest = [c for c in df.columns if c not in (*keys, date)]
    opened = df.withColumn("__next", F.lead(date).over(by_date(keys, date))).select(
        *df.columns, F.posexplode(span).alias("__pos", "__month")
    )
    return opened.select(
        *keys,
        F.col("__month").alias(date),
        *[F.when(F.col("__pos") == 0, F.col(c)).alias(c) for c in rest],
    ).select(*df.columns)


def reindex_months(df: DataFrame, keys: Sequence[str], first: str, last: str, date: str = "date") -> DataFrame:
    """Every series on the same month range; months outside it are dropped."""
    grid = df.select(*keys).distinct().withColumn(date, F.explode(month_range(first, last)))
    return grid.join(df, [*keys, date], "left").select(*df.columns)


def month_range(first: str, last: str) -> Column:
    return F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))


def annual_to_monthly(df: DataFrame, year: str = "year", date: str = "date") -> DataFrame:
    """Each annual row repeated for its twelve months."""
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("__m")
    rest = [c for c in df.columns if c != year]
    return df.select(*df.columns, months).select(F.make_date(F.col(year), F.col("__m"), F.lit(1)).alias(date), *rest)


def extrapolate_last3(df: DataFrame, keys: Sequence[str], year: str, value: str, target_year: int) -> DataFrame:
    """Append the straight line through the last three years at ``target_year``."""
    latest = Window.partitionBy(*keys).orderBy(F.col(year).desc())
    last3 = df.withColumn("__rn", F.row_number().over(latest)).filter("__rn <= 3")
    line = last3.groupBy(*keys).agg(
        F.count(value).alias("__n"),
        F.regr_slope(F.col(value), F.col(year)).alias("__b"),
        F.avg(year).alias("__x"),
        F.avg(value).alias("__y"),
    )
    added = line.filter("__n = 3").select(
        *keys,
        F.lit(target_year).cast(dict(df.dtypes)[year]).alias(year),
        (F.col("__y") + F.col("__b") * (target_year - F.col("__x"))).alias(value),
    )
    return df.select(*keys, year, value).unionByName(added)


def zscore(c: str, keys: Sequence[str], fit: Column | None = None) -> Column:
    """(x - mean) / (sample sd + epsilon) over the whole series, or over ``fit`` rows only."""
    base = F.col(c) if fit is None else F.when(fit, F.col(c))
    w = whole(keys)
    return (F.col(c) - F.avg(base).over(w)) / (F.stddev_samp(base).over(w) + Z_EPSILON)


def minmax(c: str, keys: Sequence[str], fit: Column | None = None) -> Column:
    base = F.col(c) if fit is None else F.when(fit, F.col(c))
    w = whole(keys)
    low, high = F.min(base).over(w), F.max(base).over(w)
    return F.try_divide(F.col(c) - low, high - low)


def drop_warmup(df: DataFrame, keys: Sequence[str], rows: int = 12, date: str = "date") -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(by_date(keys, date))).filter(F.col("__rn") > rows).drop("__rn")


def sequence_windows(c: str, length: int, keys: Sequence[str], date: str = "date") -> Column:
    """The ``length`` values before the current row, null until complete."""
    frame = by_date(keys, date).rowsBetween(-length, -1)
    return F.when(F.count(c).over(frame) == length, F.collect_list(c).over(frame))


def series_with_min_history(
    df: DataFrame, keys: Sequence[str], value: str, cutoff: str, min_train: int, min_valid: int, date: str = "date"
) -> DataFrame:
    """Series with enough points on both sides of the cutoff, with a ``split`` column."""
    train = F.col(date) <= F.lit(cutoff).cast("date")
    w = whole(keys)
    return (
        df.withColumn("split", F.when(train, "train").otherwise("valid"))
        .withColumn("__t", F.count(F.when(train, F.col(value))).over(w))
        .withColumn("__s", F.count(F.when(~train, F.col(value))).over(w))
        .filter((F.col("__t") >= min_train) & (F.col("__s") >= min_valid))
        .drop("__t", "__s")
    )


def sample_horizon(df: DataFrame, keys: Sequence[str], months: int, date: str = "date") -> DataFrame:
    """Thin a monthly path: 12 all, 24 every second, from 60 on twelve evenly spaced."""
    if months == 24:
        keep = F.col("__i") % 2 == 0
    elif months >= 60:
        step = F.greatest(F.lit(1), F.floor(F.col("__n") / 12).cast("int"))
        keep = (F.col("__i") % step == 0) & (F.floor(F.col("__i") / step) < 12)
    else:
        keep = F.lit(True)
    numbered = df.withColumn("__i", F.row_number().over(by_date(keys, date)) - 1).withColumn(
        "__n", F.count(F.lit(1)).over(whole(keys))
    )
    return numbered.filter(keep).drop("__i", "__n")
