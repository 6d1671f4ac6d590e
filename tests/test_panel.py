from __future__ import annotations

import pytest
from months import month
from pyspark.sql import functions as F

from brickline.operators import panel
from brickline.plans.features import model_features
from brickline.schemas import RAW_MEASURES

K = ["city"]


@pytest.fixture
def frame(panel_of):
    return lambda **s: panel_of(**s).select("city", F.col("ds").alias("date"), "y")


def column(df, name):
    return [r[name] for r in df.orderBy("city", "date").collect()]


def test_densify_fills_inner_gaps_only(frame):
    df = panel.densify_months(frame(a=[1, None, None, None, 5], b=[None, 2]), K)
    assert column(df, "y") == [1.0, None, None, None, 5.0, 2.0]
    assert [r["date"] for r in df.filter("city = 'a'").orderBy("date").collect()] == [month(i) for i in range(5)]


def test_rolling_needs_a_full_window(spark, frame):
    dense = panel.densify_months(frame(a=[1, 2, 3, None, 5]), K)
    assert column(dense.withColumn("r", panel.rolling_mean("y", 3, K)), "r") == [None, None, 2.0, None, None]


def test_yoy_never_infinite(frame):
    df = frame(a=[0] + [1] * 12 + [2])
    assert column(df.withColumn("r", panel.yoy("y", K)), "r")[12:] == [None, 1.0]


@pytest.mark.parametrize("n,left", [(1, 0), (11, 0), (12, 0), (13, 1)])
def test_warmup_on_short_series(frame, n, left):
    assert panel.drop_warmup(frame(a=range(1, n + 1)), K).count() == left


def test_zscore_of_a_single_row_is_null(frame):
    assert column(frame(a=[3]).withColumn("z", panel.zscore("y", K)), "z") == [None]


def test_fills(frame):
    dense = panel.reindex_months(frame(a=[None, 1, None, 3]), K, "2000-01-01", "2000-05-01")
    assert column(dense.withColumn("f", panel.forward_fill("y", K)), "f") == [None, 1.0, 1.0, 3.0, 3.0]
    assert column(dense.withColumn("f", panel.fill_both("y", K)), "f") == [1.0, 1.0, 1.0, 3.0, 3.0]


def test_extrapolation_is_a_line_through_three_years(spark):
    df = spark.createDataFrame([("a", y, 10.0 * y) for y in (2020, 2021, 2022)] + [("b", 2022, 1.0)], "city string, year int, v double")
    out = panel.extrapolate_last3(df, K, "year", "v", 2025).filter("year = 2025").collect()
    assert [(r.city, r.v) for r in out] == [("a", pytest.approx(20250.0))]


def test_sampling(frame):
    df = frame(a=range(60))
    assert len(column(panel.sample_horizon(df, K, 60), "y")) == 12
    assert column(panel.sample_horizon(df, K, 60), "y")[:3] == [0.0, 5.0, 10.0]
    assert column(panel.sample_horizon(frame(a=range(24)), K, 24), "y") == [float(v) for v in range(0, 24, 2)]
    assert column(panel.sample_horizon(frame(a=range(7)), K, 60), "y") == [float(v) for v in range(7)]


def test_min_history_boundaries(panel_of):
    s = panel_of(a=range(42), b=range(41))
    kept = panel.series_with_min_history(s, ["city", "target"], "y", "2002-12-01", 36, 6, "ds")
    assert {r.city for r in kept.collect()} == {"a"}


def test_stacked_windows_share_one_shuffle_and_stay_in_the_jvm(spark, frame):
    wide = frame(a=range(1, 30)).select("city", "date", *[F.col("y").alias(c) for c in RAW_MEASURES])
    plan = model_features(wide)._jdf.queryExecution().executedPlan().toString()
    # one exchange for the collapse to (city, date), one for all city windows
    assert plan.count("Exchange hashpartitioning") <= 2
    assert "Python" not in plan and "Pandas" not in plan
