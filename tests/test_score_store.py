"""The stored score table over several evaluations."""

from __future__ import annotations

from brickline.plans.evaluate import SCORE_COLUMNS, SCORE_KEYS, store_scores

SCHEMA = "city string, target string, horizon_months int, model_name string, " + ", ".join(f"{c} double" for c in SCORE_COLUMNS)


def scores(spark, *rows):
    return spark.createDataFrame([(c, "price", 1, m, *[v] * len(SCORE_COLUMNS)) for c, m, v in rows], SCHEMA)


def listed(df):
    return sorted((r.city, r.model_name, r.mae, str(r.evaluated_at)[:10]) for r in df.collect())


def test_scored_again_keys_are_replaced_and_stamped(spark):
    empty = spark.createDataFrame([], SCHEMA + ", evaluated_at timestamp")
    first = store_scores(empty, scores(spark, ("a", "m", 1.0), ("b", "m", 2.0)), "2001-01-01")
    assert listed(first) == [("a", "m", 1.0, "2001-01-01"), ("b", "m", 2.0, "2001-01-01")]
    again = scores(spark, ("a", "m", 5.0), ("a", "n", 3.0), ("a", "n", 3.0), (None, "m", 9.0))
    second = store_scores(first, again, "2002-01-01")
    want = [("a", "m", 5.0, "2002-01-01"), ("a", "n", 3.0, "2002-01-01"), ("b", "m", 2.0, "2001-01-01")]
    assert listed(second) == want and second.columns == [*SCORE_KEYS, *SCORE_COLUMNS, "evaluated_at"]
    assert listed(store_scores(second, again.limit(0), "2003-01-01")) == want
