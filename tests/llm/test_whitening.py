from __future__ import annotations

import math

import numpy as np
import pytest

from brickline.llm.whitening import eigen, one_sided_jacobi, pivoted_cholesky, whiten


def plain(rows, components=4):
    """Rows ``(vec_id, vector)`` whitened in memory: whole numbers, distinct vectors, numpy's own eigenvectors."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(256 * c) for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    out = {}
    for (i, _), x in zip(rows, xs):
        num = [n * c - s for c, s in zip(x, sums)]
        for k, j in enumerate(order, 1):
            out[i, k] = (n, sum(c * c for c in num), np.dot([c / n for c in num], vectors[:, j]) / math.sqrt(values[j]), values[j] / v.trace())
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def check(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    signs = {}
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
        if abs(whitened) > 1e-6:
            signs.setdefault(r["component"], set()).add(np.sign(whitened) * np.sign(r["whitened"]))
        assert abs(r["whitened"]) == pytest.approx(abs(whitened), rel=1e-7, abs=1e-9)
    assert all(len(s) == 1 for s in signs.values())


def test_equals_plain_version(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(300, 12)) * np.linspace(3, 0.1, 12) + 7).astype(np.float32).tolist()
    rows = [(k, v[k % 250]) for k in range(300)]
    check(whiten(table(spark, rows)).collect(), plain(rows))


def test_equals_plain_version_on_the_table(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    check(whiten(df).collect(), plain([(r["vec_id"], r["embedding"]) for r in df.collect()]))


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = [(k, rng.normal(size=3).tolist()) for k in range(20)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0])]
    rows = [*good, good[3], (None, [0.5, 0.5, 0.5])]
    df = table(spark, rows + odd).selectExpr("*", "'?' as n", "'?' as x", "'?' as component", "'?' as whitened")
    got = whiten(df).collect()
    assert len(got) == 3 * len(rows)
    check(got, plain([(i, np.float32(v).tolist()) for i, v in rows]))


def test_few_directions_and_none(spark):
    line = [(k, [float(k), 2.0 * k, 0.0, 1.0, 5.0]) for k in range(9)]
    got = whiten(table(spark, line)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(k, 1) for k in range(9)]
    assert all(r["explained"] == pytest.approx(1) for r in got)
    assert whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, None), (2, [])])).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 3.0]), (3, [5e11, -7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {i: v[1] for (i, _), v in plain(rows).items()}
    got = whiten(df).collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == want
    assert {r["component"] for r in got} == {1}  # the other direction's share of the variance is below a double's rounding


@pytest.mark.parametrize("rank", [1, 4, 7])
def test_factor_and_rotation(rank):
    rng = np.random.default_rng(rank)
    a = rng.normal(size=(7, rank)) * 10.0 ** np.arange(0, -rank, -1)
    v = a @ a.T
    factor, order = pivoted_cholesky(v)
    assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-12 * v.max())
    turned = one_sided_jacobi(factor)
    gram = turned.T @ turned
    assert np.abs(gram - np.diag(gram.diagonal())).max() <= 1e-13 * gram.max()
    directions, values = eigen(v, rank)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9, atol=1e-15)
    assert np.allclose(directions @ directions.T, np.eye(rank), atol=1e-12)
