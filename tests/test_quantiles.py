from __future__ import annotations

import numpy as np
import pytest

from brickline.operators import quantiles
from brickline.operators.quantiles import exact_median, exact_quantiles


def values(kind, n, rng):
    if kind == "equal":
        return np.full(n, 7.0)
    if kind == "tail":
        return np.r_[1e15, -1e15, rng.normal(0, 1, n)][:n]
    if kind == "ties":
        return rng.integers(0, 5, n).astype(float)
    return rng.lognormal(0, 3, n)


@pytest.mark.parametrize("kind", ["equal", "tail", "ties", "skew"])
@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_grouped_quantiles_match_numpy(spark, kind, n):
    rng = np.random.default_rng(n)
    data = {g: values(kind, max(n, 1), rng) for g in ("a", "b")}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.q): r.quantile for r in exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for g, vs in data.items():
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert got[g, q] == pytest.approx(np.quantile(vs, q), rel=1e-12)


def test_large_groups_are_exact(spark):
    df = spark.range(200_001).selectExpr("id % 2 = 0 and id > 10 as g", "cast((id * 7919) % 200003 as double) as v")
    pdf = df.toPandas()
    want = pdf.groupby("g")["v"].median().to_dict()
    got = {r.g: r["median"] for r in exact_median(df, ["g"], "v").collect()}
    assert got == want


def test_no_task_holds_the_slice_of_a_hot_group(spark, monkeypatch):
    """Millions of distinct values in one group: the slice inside the bracket is ranked by ranges of it."""
    slots = []
    plain = quantiles.settle

    def kept(df, name):
        out = plain(df, name)
        if name == "quantile-slots":
            slots.append(out)
        return out

    monkeypatch.setattr(quantiles, "settle", kept)
    n = 3_000_001
    df = spark.range(n).selectExpr(f"cast((id * 1000003) % {n} as double) as v")
    assert [r.quantile for r in exact_quantiles(df, [], "v", [0.5]).collect()] == [(n - 1) / 2]
    sizes = [r["count"] for r in slots[0].where("__part = 1").groupBy("__range").count().collect()]
    assert sum(sizes) > 1000 and max(sizes) < sum(sizes) / 50


def test_a_sketch_that_errs_is_made_good(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 5)
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    df = spark.range(50_000).selectExpr("id % 3 as g", "cast((id * 7919) % 50021 as double) as v")
    want = df.toPandas().groupby("g")["v"].median().to_dict()
    assert {r.g: r["median"] for r in exact_median(df, ["g"], "v").collect()} == want


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("a", None)], "g string, v double")
    assert [(r.n, r["median"]) for r in exact_median(df, ["g"], "v").collect()] == [(1, 2.0)]


def test_null_keys_and_null_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", 5.0)], "g string, v double")
    got = {r.g: (r.n, r["median"]) for r in exact_median(df, ["g"], "v").collect()}
    assert got == {None: (2, 2.0), "a": (1, 5.0)}


def test_global_group(spark):
    df = spark.range(1001).selectExpr("cast(id as double) as v")
    assert [r.quantile for r in exact_quantiles(df, [], "v", [0.5]).collect()] == [500.0]
