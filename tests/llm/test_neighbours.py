from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickline.llm import neighbours
from brickline.llm.neighbours import nearest


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, node string")


def exact(rows, top=10, every=100):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[k]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != k][:top]
        out[int(ids[k])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.fixture
def vectors():
    rng = np.random.default_rng(4)
    return [(k, [float(v) for v in rng.normal(size=24).astype(np.float32)], "?", "?") for k in range(1500)]


def test_recall_against_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_NODES", 400)
    monkeypatch.setattr(neighbours, "RANGE_ROWS", 600)
    got, want = listed(nearest(table(spark, vectors), every=20)), exact(vectors, every=20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    for found in got.values():
        assert found == sorted(found, key=lambda p: (p[1], p[0])) and len(found) == 10


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    plain = [(k, [float(v) for v in rng.normal(size=4).astype(np.float32)], None, None) for k in range(30)]
    same = [(k, [1.0, 2.0, 3.0, 4.0], None, None) for k in range(100, 160)]
    odd = [(1000, None, None, None), (1100, [0.0] * 4, None, None), (1200, [1.0, None, 2.0, 3.0], None, None),
           (1300, [1.0, float("nan"), 2.0, 3.0], None, None), (1400, [1.0, float("inf"), 2.0, 3.0], None, None),
           (None, [1.0, 1.0, 1.0, 1.0], None, None), (1500, [1.0, 2.0], None, None), (1600, [], None, None)]
    got = listed(nearest(table(spark, plain + same + odd + plain[:3])))
    want = exact(plain + same)
    assert set(got) == {0, 100}
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found]
        assert np.allclose([d for _, d in got[q]], [d for _, d in found], atol=1e-12)
    assert [i for i, _ in got[100]] == list(range(101, 111))


def test_few_or_no_candidates(spark):
    assert listed(nearest(table(spark, [(0, [1.0, 2.0], None, None), (5, [2.0, 2.0], None, None)]))) == {0: [(5, 1.0)]}
    assert nearest(table(spark, [(0, [1.0], None, None)])).collect() == []
    assert nearest(table(spark, [(0, [1.0], None, None)]).where("false")).collect() == []


def test_descent_goes_on_while_links_change(spark, vectors, monkeypatch):
    """Ten rounds that say that links still change are followed by an eleventh, which says that none does."""
    rounds, write = [], neighbours.settle

    def noted(df, name):
        out = write(df, name)
        if name == "graph":
            rounds.append(name)
            out = out.withColumn("changed", F.lit(10_000 if len(rounds) <= 10 else 0).cast("long"))
        return out

    monkeypatch.setattr(neighbours, "settle", noted)
    assert len(listed(nearest(table(spark, vectors[:60])))) == 1
    assert len(rounds) == 11


def test_cells_leave_few_rounds(spark, vectors, monkeypatch):
    """Three rounds at most send vectors to blocks, where each cell of a tree holds a fourth of the nodes."""
    names, write = [], neighbours.settle
    monkeypatch.setattr(neighbours, "CELL_ROWS", 375)
    monkeypatch.setattr(neighbours, "settle", lambda df, name: (names.append(name), write(df, name))[1])
    got, want = listed(nearest(table(spark, vectors), every=20)), exact(vectors, every=20)
    assert names.count("graph-start") == 2 and names.count("graph") <= 3
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)


def test_a_node_near_all_others_meets_few_a_round(spark):
    """The sample of a hub's reverse links is taken before they are shuffled, and differs from round to round."""
    rows = [(0, k, 2) for k in range(1, 5000)] + [(k, 0, 0) for k in range(1, 5000)]
    meetings = spark.createDataFrame(rows, "centre long, member long, kind int").repartition(4)
    first, again, other = ({tuple(r) for r in neighbours._sampled(meetings, n).collect()} for n in (1, 1, 2))
    assert first == again != other and len(first) == len(other) == neighbours.SAMPLED + 4999
    plan = neighbours._sampled(meetings, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_hub_among_scattered_points(spark):
    rng = np.random.default_rng(8)
    around = rng.normal(size=(700, 24))
    around /= np.linalg.norm(around, axis=1, keepdims=True)
    rows = [(0, [1e-3] * 24, "?", "?")] + [(k + 1, [float(v) for v in p.astype(np.float32)], "?", "?") for k, p in enumerate(around)]
    got, want = listed(nearest(table(spark, rows), every=50)), exact(rows, every=50)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
