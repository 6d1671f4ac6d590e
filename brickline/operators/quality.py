"""Data-quality profiles. Each is one or two aggregate passes over the table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.operators.quantiles import quantile_profile


def key_uniqueness(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows and distinct keys per table. Distinct keys are counted by grouping on the key."""
    out = None
    for name, (df, keys) in tables.items():
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
        row = per_key.agg(
            F.lit(name).alias("table_name"),
            F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
            F.count(F.lit(1)).alias("n_keys"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def freshness(df: DataFrame, key: str, date: str = "date") -> DataFrame:
    return df.groupBy(key).agg(F.max(date).alias("last_date"))


def time_coverage(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """First and last date and null count of the value per table."""
    out = None
    for name, (df, date, value) in tables.items():
        row = df.agg(
            F.lit(name).alias("table_name"),
            F.min(date).alias("first_date"),
            F.max(date).alias("last_date"),
            F.count_if(F.col(value).isNull()).alias("n_null"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def validate_prices(df: DataFrame, keys: Sequence[str], price: str, limit: float = 2_000_000) -> DataFrame:
    """Violation counts: duplicate keys, non-positive and too large prices."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(F.col(price) <= 0).alias("low"),
        F.count_if(F.col(price) >= limit).alias("high"),
    )
    wide = per_key.agg(
        F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias("duplicate_key"),
        F.coalesce(F.sum("low"), F.lit(0)).alias("not_positive"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("too_large"),
    )
    return wide.unpivot([], ["duplicate_key", "not_positive", "too_large"], "rule", "n_rows")


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and share per column."""
    columns = list(columns or df.columns)
    one = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    long = one.unpivot(["__rows"], columns, "column_name", "n_null")
    return long.select(
        "column_name", "n_null", F.round(F.try_divide(F.col("n_null"), F.col("__rows")), 6).alias("null_share")
    )


def describe_numeric(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max per column (and group), one row each.

    The values are laid out as (column, value) rows so all quartiles come from the
    skew-safe quantile operator instead of one buffer per column.
    """
    keys = list(keys)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [F.col(k) for k in keys], [F.col(c) for c in columns], "column_name", "v"
    )
    group = [*keys, "column_name"]
    moments, q = quantile_profile(
        long, group, "v", [0.25, 0.5, 0.75], {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    )
    quartiles = q.groupBy(*group).agg(
        *[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    named = quartiles.select(*[F.col(c).alias(f"__of_{c}" if c in group else c) for c in quartiles.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in group]
    return moments.join(named, same, "left").drop(*[f"__of_{c}" for c in group])


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max; the maximum falls into the last bin."""
    v = F.col(column).cast("double")
    edges = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    placed = df.filter(v.isNotNull()).select(v.alias("v"), edges.alias("e"))
    width = F.try_divide(F.col("v") - F.col("e.lo"), F.col("e.hi") - F.col("e.lo"))
    bin_no = F.least(F.lit(bins - 1), F.floor(F.coalesce(width, F.lit(0.0)) * bins).cast("int"))
    return placed.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, pairwise complete, from one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(
        F.array(
            *[
                F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("corr"))
                for a, b in pairs
            ]
        ).alias("m")
    )
    return one.select(F.inline("m"))


def top_correlations(matrix: DataFrame, k: int = 5) -> DataFrame:
    return matrix.filter("corr is not null").orderBy(F.desc(F.abs("corr")), "a", "b").limit(k)


def outlier_counts(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Rows whose population z-score magnitude exceeds ``limit``, per column."""
    stats = df.agg(
        F.struct(
            *[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]
        )
    ).scalar()
    scored = df.select(*columns, stats.alias("__st"))
    one = scored.agg(
        *[
            F.count_if(F.abs(F.try_divide(F.col(c) - F.col(f"__st.{c}.m"), F.col(f"__st.{c}.s"))) > limit).alias(c)
            for c in columns
        ]
    )
    return one.unpivot([], list(columns), "column_name", "n_outliers")


def quality_report(df: DataFrame, columns: Sequence[str], date: str = "date", k: int = 5) -> DataFrame:
    """Row and column counts, missing values of every column, correlations and outliers of the given ones, and time range.

    Of the columns and pairs, the ``k`` with most to report.
    """

    def rows(frame: DataFrame, section: str, name, value) -> DataFrame:
        return frame.select(
            F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value")
        )

    size = df.agg(F.count(F.lit(1)).alias("v"))
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    missing = missing_profile(df, df.columns).orderBy(F.desc("n_null"), "column_name").limit(k)
    corr = top_correlations(correlation_matrix(df, columns), k)
    worst = outlier_counts(df, columns).orderBy(F.desc("n_outliers"), "column_name").limit(k)
    parts = [
        rows(size, "size", F.lit("rows"), F.col("v")),
        rows(size, "size", F.lit("columns"), F.lit(len(df.columns))),
        rows(missing, "missing", F.col("column_name"), F.col("n_null")),
        rows(corr, "correlation", F.concat_ws("~", "a", "b"), F.format_number("corr", 3)),
        rows(worst, "outliers", F.col("column_name"), F.col("n_outliers")),
        rows(span, "time", F.lit("first"), F.col("lo")),
        rows(span, "time", F.lit("last"), F.col("hi")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
