"""Distances of windows of months against all pairs of windows, and a planted repeat."""

from __future__ import annotations

import numpy as np
import pytest
from months import month

from brickline.plans import periods


def every_pair(values, length):
    """All windows that do not overlap, by plain loops: ``{end: [(squared, other end)]}``."""
    ends = range(length - 1, len(values))
    window = {e: values[e - length + 1 : e + 1] for e in ends}
    return {
        e: sorted((round(float(((window[e] - window[o]) ** 2).sum()), periods.DIGITS), o) for o in ends if abs(o - e) >= length) for e in ends
    }


@pytest.mark.parametrize("n", [5, 24, 25, 60, 75])
def test_nearest_windows_equal_all_pairs(n):
    values = np.random.default_rng(n).normal(size=(n, 3))
    got = {(length, end): (squared, match) for length, end, match, squared in periods.nearest_windows(values, (12, 24))}
    want = {(length, e): pairs[0] for length in (12, 24) for e, pairs in every_pair(values, length).items() if pairs}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=2e-6) for k in got)


def test_equal_windows_go_to_the_earlier():
    values = np.tile(np.arange(12.0), 5)[:, None]
    for length, end, match, squared in periods.nearest_windows(values, (12,)):
        same = [o for o in range(end % 12, 60, 12) if o >= 11 and abs(o - end) >= 12]
        assert squared == 0 and match == min(same)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    rows = []
    for city, n in (("a", 90), ("b", 70), ("short", 20)):
        x = rng.normal(size=(n, 2))
        if city == "a":
            x[-12:] = x[30:42] + 0.01
        rows += [(city, month(i), float(v[0]), float(v[1]) if i else None) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "city string, date date, p double, q double").cache()


def test_a_planted_repeat_is_first(scored):
    rows = [r for r in periods.period_matches(scored, ["p", "q"], top=3).collect() if r.city == "a" and r.months == 12]
    assert sorted(r["rank"] for r in rows) == [1, 2, 3]
    first = min(rows, key=lambda r: r["rank"])
    assert first.match_date == month(41) and first.date == month(89) and first.distance < 0.1
    profile = {(r.city, r.months, r.date): r for r in periods.period_profile(scored, ["p", "q"]).collect()}
    assert profile["a", 12, month(89)].match_date == month(41)
    assert profile["a", 12, month(41)].match_date == month(89)


def test_short_cities_and_empty_tables(scored):
    assert {r.city for r in periods.period_profile(scored, ["p", "q"]).collect()} == {"a", "b"}
    assert periods.period_profile(scored.limit(0), ["p"]).collect() == []
    assert periods.period_matches(scored.limit(0), ["p"]).collect() == []
