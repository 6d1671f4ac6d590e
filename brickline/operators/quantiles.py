"""Exact grouped quantiles that never bring a whole group to one task.

``median``/``percentile`` keep every distinct value of a group in one buffer,
which fails for a group that holds a large share of the data. Here a mergeable
sketch (partial aggregation, a few kilobytes per group) brackets each quantile.
One more pass collapses what lies below and above the bracket to one slot each,
with its count and its value next to the bracket, and keeps the values inside.
The ranks inside are counted by ranges of the bracket, so no task holds a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickline.functions.numbers import nan_to_null
from brickline.session import settle

# A sketch's rank error is n/ACCURACY at most. Five times that on each side holds every rank that interpolation needs
# but, for groups too small for the sketch to err, the one next to the bracket; the outer slots know its value.
ACCURACY = 10_000
MARGIN = 5 / ACCURACY
# Ranges that a bracket is ranked by.
RANGES = 1024
BELOW, INSIDE, ABOVE = 0, 1, 2


def _same(keys: Sequence[str], other: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys]


def _beside(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with the table's row of its group; null keys are a group. Without keys the table's single row."""
    if not keys:
        rest = table.columns
        return df.select("*", table.select(F.struct(*rest).alias("r")).scalar().alias("__r")).select(*df.columns, *[F.col(f"__r.{c}").alias(c) for c in rest])
    named = table.select(*[F.col(c).alias(f"__of_{c}" if c in keys else c) for c in table.columns])
    return df.join(named, _same(keys, "__of_")).drop(*[f"__of_{k}" for k in keys])


def _picked(data: DataFrame, cuts: DataFrame, keys: list[str], qs: Sequence[float]) -> DataFrame:
    """``keys, q_no, n, lo, hi, frac, missed`` from the values ``__v`` and the brackets ``__n, __cuts`` of their groups."""
    v, cut = F.col("__v"), F.col("__cut")
    part = F.when(v < cut["lo"], BELOW).when(v <= cut["hi"], INSIDE).otherwise(ABOVE)
    inside = F.col("__part") == INSIDE
    width = F.try_divide(v - cut["lo"], cut["hi"] - cut["lo"])
    rows = _beside(data, cuts, keys).select(*keys, "__v", "__n", F.posexplode("__cuts").alias("__q", "__cut"))
    slots = (
        rows.withColumn("__part", part)
        .withColumn("__range", F.when(inside, F.floor(F.coalesce(width, F.lit(0.0)) * RANGES).cast("int")).otherwise(-1))
        .groupBy(*keys, "__q", "__n", "__part", "__range", F.when(inside, v).alias("__slot"))
        .agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        .withColumn("__value", F.when(F.col("__part") == ABOVE, F.col("__least")).otherwise(F.col("__most")))
    )
    slots = settle(slots.drop("__slot", "__least", "__most"), "quantile-slots")
    # Counts before each range, then before each value of a range: two prefix sums, the first over a few ranges only.
    group = [*keys, "__q"]
    before = Window.partitionBy(*group).orderBy("__part", "__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = slots.groupBy(*group, "__part", "__range").agg(F.sum("__c").alias("__sum"))
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    within = Window.partitionBy(*group, "__part", "__range").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = _beside(slots, ranges, [*group, "__part", "__range"])
    ranked = ranked.withColumn("__cum", F.col("__before") + F.sum("__c").over(within))
    # Rank positions are integers; the tiny term undoes float noise such as 0.95 * 20.
    share = F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("__q") + 1)
    pos = share * (F.col("__n") - 1)
    need_lo = F.floor(pos + 1e-9) + 1
    frac = F.greatest(F.lit(0.0), pos - need_lo + 1)
    need_hi = F.when(frac > 1e-9, need_lo + 1).otherwise(need_lo)
    needed = ranked.select(*group, "__n", "__part", "__c", "__value", "__cum", need_lo.alias("__lo"), need_hi.alias("__hi"), frac.alias("__f"))
    first = F.col("__cum") - F.col("__c") + 1
    unknown = ((F.col("__part") == BELOW) & (F.col("__lo") < F.col("__cum"))) | ((F.col("__part") == ABOVE) & (F.col("__hi") > first))
    return needed.groupBy(*group).agg(
        F.max("__n").alias("n"),
        F.max("__f").alias("frac"),
        F.min(F.when(F.col("__cum") >= F.col("__lo"), F.col("__value"))).alias("lo"),
        F.min(F.when(F.col("__cum") >= F.col("__hi"), F.col("__value"))).alias("hi"),
        F.bool_or(unknown).alias("missed"),
    )


def quantile_profile(
    df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], extra: dict[str, Callable[[Column], Column]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Per group the ``extra`` aggregates, taken in the pass of the sketch; and ``keys, q, n, quantile`` where it has values.

    NaN and null are no values. Quantiles are interpolated linearly.
    """
    keys = list(keys)
    rows = df.select(*keys, nan_to_null(F.col(value).cast("double")).alias("__v"))
    data = rows.filter("__v is not null")
    points = [min(1.0, max(0.0, q + step)) for q in qs for step in (-MARGIN, MARGIN)]
    heads = rows.groupBy(*keys).agg(
        F.count("__v").alias("__n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", points, ACCURACY).alias("__s"),
        *[make(F.col("__v")).alias(name) for name, make in (extra or {}).items()],
    )
    # A few hundred bytes per group; the written size decides between broadcast and shuffle.
    heads = settle(heads, "quantile-cuts")
    bracket = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    tight = [bracket(F.element_at("__s", 2 * k + 1), F.element_at("__s", 2 * k + 2)) for k in range(len(qs))]
    whole = [bracket(F.col("__min"), F.col("__max")) for _ in qs]
    found = settle(_picked(data, heads.filter("__n > 0").select(*keys, "__n", F.array(*tight).alias("__cuts")), keys, qs), "quantile-ranks")
    # A sketch that erred by more than it may: the group is ranked over its whole range. As a rule there is none.
    again = found.filter("missed").select(*keys).distinct()
    if not again.isEmpty():
        wide = _beside(heads, again, keys) if keys else heads
        more = _picked(data, wide.select(*keys, "__n", F.array(*whole).alias("__cuts")), keys, qs)
        wrong = again.select(*[F.col(k).alias(f"__of_{k}") for k in keys])
        kept = found.join(wrong, _same(keys, "__of_"), "left_anti") if keys else found.limit(0)
        found = kept.unionByName(more)
    exact = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")
    share = F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("__q") + 1)
    return heads.select(*keys, *(extra or {})), found.select(*keys, share.alias("q"), "n", exact.alias("quantile"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """One row per group and quantile: ``keys, q, n, quantile`` (linear interpolation)."""
    return quantile_profile(df, keys, value, qs)[1]


def exact_median(df: DataFrame, keys: Sequence[str], value: str, alias: str = "median") -> DataFrame:
    """One row per group: ``keys, n, <alias>``."""
    return exact_quantiles(df, keys, value, [0.5]).select(*keys, "n", F.col("quantile").alias(alias))
