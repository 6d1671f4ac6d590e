"""Hedonic regression against one-hot least squares, and the repeat-sales index against a dense solve."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickline.bindings import Tables
from brickline.plans.hedonic import hedonic_regression
from brickline.plans.repeat_sales import components, fit_index, pair_sums, repeat_sales_index, solve_laplacian

LISTING = "listing_id long, price double, kind string, city string, month string, area double, unit_id long, date_posted date, province string"


def one_hot(rows, dummies, numbers, cluster):
    """Least squares with a column for every value but the first; errors as documented."""
    rows = [r for r in rows if r["price"] and r["price"] > 0 and all(r[c] is not None for c in numbers)]
    names, columns = ["one"], [np.ones(len(rows))]
    for c in numbers:
        names, columns = [*names, c], [*columns, np.array([r[c] for r in rows])]
    for c in dummies:
        for v in sorted({str(r[c] or "missing") for r in rows})[1:]:
            names, columns = [*names, f"{c}={v}"], [*columns, np.array([float(str(r[c] or "missing") == v) for r in rows])]
    x, y = np.stack(columns, axis=1), np.log([r["price"] for r in rows])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e, bread = y - x @ beta, np.linalg.pinv(x.T @ x)
    groups = [r[cluster] for r in rows] if cluster else list(range(len(rows)))
    meat = np.zeros_like(bread)
    for g in set(groups):
        s = x[[k for k, v in enumerate(groups) if v == g]].T @ e[[k for k, v in enumerate(groups) if v == g]]
        meat += np.outer(s, s)
    n, g, k = len(rows), len(set(groups)), np.linalg.matrix_rank(x)
    v = bread @ meat @ bread * (g / (g - 1) * (n - 1) / (n - k))
    return {name: (b, s) for name, b, s in zip(names, beta, np.sqrt(v.diagonal()))}


def check(found, want):
    for r in found:
        b, s = want[r.term]
        assert r.coefficient == pytest.approx(b, rel=1e-6, abs=1e-9)
        assert r.std_error == pytest.approx(s, rel=1e-6)
        assert r.t_value == pytest.approx(b / s, rel=1e-5, abs=1e-6)


def made_listings(n=400, seed=1):
    rng = random.Random(seed)
    city = {f"c{k}": rng.gauss(0, 1) for k in range(30)}
    month = {f"2020-{k:02d}": 0.1 * k for k in range(1, 13)}
    out = []
    for i in range(n):
        c, m = rng.choice(sorted(city)[: 5 + i % 25]), rng.choice(sorted(month))
        kind, area = rng.choice(["flat", "house", None]), rng.uniform(1, 9)
        price = math.exp(3 + city[c] + month[m] + 0.2 * area + (0.4 if kind == "house" else 0) + rng.gauss(0, 0.3))
        out.append((i, price, kind, c, m, area, i % 40, dt.date(2020, 1, 1), "p"))
    return out


@pytest.mark.parametrize("cluster", [None, "city"])
def test_absorbed_effects_equal_one_hot_columns(spark, cluster):
    rows = made_listings() + [(900, None, "flat", "c1", "2020-01", 1.0, 1, None, "p"), (901, -5.0, "flat", "c1", "2020-01", 1.0, 1, None, "p"), (902, 9.0, "flat", "c1", "2020-01", None, 1, None, "p")]
    df = spark.createDataFrame(rows, LISTING)
    found = hedonic_regression(df, ["kind"], ["area"], ["city", "month"], cluster).collect()
    assert [r.term for r in found] == ["area", "kind=house", "kind=missing"]
    check(found, one_hot([r.asDict() for r in df.collect()], ["kind", "city", "month"], ["area"], cluster))


def test_equals_one_hot_on_the_table(spark, folder):
    sales = Tables(spark, folder).sales.withColumn("month", F.date_format("date_posted", "yyyy-MM"))
    found = hedonic_regression(sales, ["property_type", "listing_type"], absorbed=["city", "month"], cluster="city").collect()
    assert len(found) == 5
    check(found, one_hot([r.asDict() for r in sales.collect()], ["property_type", "listing_type", "city", "month"], [], "city"))


def test_terms_that_cannot_be_told_apart_and_empty_input(spark):
    df = spark.createDataFrame(made_listings(120), LISTING).withColumn("one", F.lit("x")).withColumn("twice", F.col("area") * 2)
    got = {r.term: r for r in hedonic_regression(df, ["one", "kind", "city"], ["area", "twice"], ["city"]).collect()}
    assert not any(t.startswith("one") for t in got)
    assert got["twice"].coefficient is None and got["city=c1"].coefficient is None and got["area"].coefficient is not None
    for empty in (df.where("false"), df.withColumn("price", F.lit(None).cast("double"))):
        assert hedonic_regression(empty, ["kind"], ["area"], ["city"]).collect() == []
    assert hedonic_regression(df, ["one"]).collect() == []
    alone = hedonic_regression(df.limit(1), [], ["area"]).collect()
    assert [(r.coefficient, r.std_error) for r in alone] == [(None, None)]


def dense_index(pairs, size):
    """Three stages with full matrices; ``pairs`` are ``(first, second, change)``."""
    a, b, d = (np.array(c) for c in zip(*pairs))
    x = np.zeros((len(pairs), size))
    x[np.arange(len(pairs)), a], x[np.arange(len(pairs)), b] = -1, 1
    label = components(a, b, size)
    free = [k for k in range(size) if label[k] != k]

    def solve(w):
        out = np.zeros(size)
        out[free] = np.linalg.lstsq(x[:, free] * np.sqrt(w)[:, None], d * np.sqrt(w), rcond=None)[0]
        return out

    e2 = (d - x @ solve(np.ones(len(d)))) ** 2
    gap = np.stack([np.ones(len(d)), b - a], axis=1)
    fitted = gap @ np.linalg.lstsq(gap, e2, rcond=None)[0]
    return solve(1 / np.maximum(fitted, 1e-3 * e2.mean()))


def made_pairs(seed, size=30, n=300):
    rng = random.Random(seed)
    level = np.cumsum([rng.gauss(0.01, 0.05) for _ in range(size)])
    out = []
    for _ in range(n):
        a, b = sorted(rng.sample(range(size), 2))
        out.append((a, b, level[b] - level[a] + rng.gauss(0, 0.02 * math.sqrt(b - a))))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_index_equals_dense_solve(seed):
    pairs = made_pairs(seed)
    cells = {}
    for a, b, d in pairs:
        n, s, q = cells.get((a, b), (0, 0.0, 0.0))
        cells[a, b] = n + 1, s + d, q + d * d
    a, b = (np.array(c) for c in zip(*cells))
    x, label = fit_index(a, b, *(np.array(c, dtype=float) for c in zip(*cells.values())), 30)
    assert np.allclose(x, dense_index(pairs, 30), atol=1e-8) and set(label) == {min(a)} | {k for k in range(30) if k not in {*a, *b}}


def test_conjugate_gradients_on_a_long_chain():
    size = 600
    a, b = np.arange(size - 1), np.arange(1, size)
    rhs = np.zeros(size)
    rhs[-1] = 1.0
    x = solve_laplacian(a, b, np.ones(size - 1), rhs, np.arange(size) == 0)
    assert np.allclose(x, np.arange(size), rtol=1e-8)


def test_index_of_planted_levels_and_separate_months(spark):
    """Exact prices give the planted index; months that no pair connects have a base of their own."""
    level = [1.0, 1.1, 1.3, 1.2]
    rows = [(10 * u + m, 100.0 * (u + 1) * level[m], u, dt.date(2020, 1 + m, 3), "north") for u in range(5) for m in range(4) if (u + m) % 3]
    rows += [(500, 10.0, 77, dt.date(2021, 1, 1), "north"), (501, 20.0, 77, dt.date(2021, 6, 1), "north")]
    rows += [(600, 10.0, 78, dt.date(2021, 1, 1), "south"), (601, None, 78, dt.date(2021, 6, 1), "south"), (602, 11.0, 78, dt.date(2021, 1, 20), "south")]
    sales = spark.createDataFrame(rows, "listing_id long, price double, unit_id long, date_posted date, province string")
    got = {r.date: r for r in repeat_sales_index(sales).collect()}
    assert {r.province for r in got.values()} == {"north"}
    for m, v in enumerate(level):
        assert got[dt.date(2020, 1 + m, 1)].price_index == pytest.approx(100 * v)
    assert got[dt.date(2021, 6, 1)].price_index == pytest.approx(200) and got[dt.date(2021, 6, 1)].base_date == dt.date(2021, 1, 1)
    assert repeat_sales_index(sales.where("false")).collect() == []


def test_normal_equations_hold_on_the_table(spark, folder):
    """At the index the weighted errors of a plain fit's stage sum to zero round every month but the base."""
    sales = Tables(spark, folder).sales
    sums = pair_sums(sales, ["province"]).collect()
    index = repeat_sales_index(sales).collect()
    assert {r.province for r in index} == {r.province for r in sums}
    assert sum(r.n for r in sums) * 2 == sum(r.n_pairs for r in index)
    assert all(r.log_index == 0 for r in index if r.date == r.base_date)
