from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brickline.operators import merge
from brickline.session import new_table_path
from brickline.sources import sinks

SCHEMA = "k string, seq int, v int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def stored(spark):
    return spark.createDataFrame([("a", 0, 1), ("b", 0, 2)], SCHEMA)


@pytest.fixture
def incoming(spark):
    return spark.createDataFrame([("b", 1, 20), ("b", 2, 21), ("c", 1, 30), (None, 1, 9)], SCHEMA)


def test_last_wins_drops_null_keys_and_replaces(stored, incoming):
    out = merge.upsert_last_wins(stored, incoming, ["k"], ["seq"])
    assert rows(out) == [("a", 0, 1), ("b", 2, 21), ("c", 1, 30)]


def test_upsert_is_idempotent(stored, incoming):
    once = merge.upsert_last_wins(stored, incoming, ["k"], ["seq"])
    twice = merge.upsert_last_wins(once, incoming, ["k"], ["seq"])
    assert rows(once) == rows(twice)


def test_upsert_needs_its_columns(stored):
    with pytest.raises(ValueError):
        merge.upsert_last_wins(stored, stored.drop("seq"), ["k"], ["seq"])


def test_one_key_with_most_rows_is_reduced_before_the_shuffle(spark):
    hot = spark.range(50_000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as k", "cast(id as int) as seq", "1 as v")
    out = merge.dedupe_keep_last(hot, ["k"], ["seq"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by") >= 1
    assert [r.seq for r in out.filter("k = 'hot'").collect()] == [49_998]


def test_coalesce_policies(spark):
    schema = "k int, city string, d date, price int"
    old = spark.createDataFrame([(1, "x", dt.date(2020, 5, 1), 10), (2, "y", None, 20)], schema)
    new = spark.createDataFrame([(1, None, dt.date(2020, 1, 1), None), (3, "z", None, 30)], schema)
    out = merge.upsert_coalesce(old, new, ["k"], replace=["city"], greatest=["d"])
    assert rows(out) == [(1, None, dt.date(2020, 5, 1), 10), (2, "y", None, 20), (3, "z", None, 30)]


def test_partial_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, 5, 7), (2, 6, 8)], "k int, a int, b int")
    new = spark.createDataFrame([(2, 60), (3, 70)], "k int, a int")
    assert rows(merge.upsert_partial(old, new, ["k"], ["a"])) == [(1, 5, 7), (2, 60, 8), (3, 70, None)]


def test_replace_slice_on_disk_keeps_other_slices(spark):
    path = new_table_path(spark, "slice-test")
    df = spark.createDataFrame([("p", "x", 1), ("p", "y", 2), ("r", "x", 3)], "target string, city string, v int")
    sinks.write_replace_slice(df, path, ["target", "city"])
    sinks.write_replace_slice(spark.createDataFrame([("p", "x", 9)], df.schema), path, ["target", "city"])
    assert rows(spark.read.parquet(path).select("target", "city", "v")) == [("p", "x", 9), ("p", "y", 2), ("r", "x", 3)]


def test_facts_need_their_key(spark):
    with pytest.raises(ValueError):
        sinks.write_facts(spark.range(1), new_table_path(spark, "none"), {"id": "bigint"}, ["city"])


def test_align_turns_nan_into_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert rows(merge.align_columns(df, {"v": "double", "w": "string"})) == [(1.0, None), (None, None)]


def test_retain_keeps_the_boundary_day(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)], "d date")
    kept = merge.retain_recent(df, "d", F.lit("2024-04-01").cast("date"), 90)
    assert rows(kept) == [(dt.date(2024, 1, 2),)]


def test_copies_of_an_incoming_key_count_once(spark):
    old = spark.createDataFrame([("a", 0, 1)], SCHEMA)
    new = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 2, 7), ("b", 1, 8), (None, 1, 1)], SCHEMA)
    assert rows(merge.insert_ignore(old, new, ["k"], ["seq"])) == [("a", 0, 1), ("b", 1, 8)]
    assert rows(merge.upsert_coalesce(old, new, ["k"], order=["seq"])) == [("a", 2, 1), ("b", 2, 7)]
    assert rows(merge.upsert_partial(old, new, ["k"], ["v"], ["seq"])) == [("a", 0, None), ("b", None, 7)]


@pytest.mark.parametrize("name", ["upsert_last_wins", "upsert_coalesce", "upsert_partial", "insert_ignore"])
def test_stored_rows_do_not_move_for_a_small_refresh(spark, name):
    path = new_table_path(spark, "stored-rows")
    spark.range(20_000).selectExpr("cast(id as string) as k", "0 as seq", "1 as v").write.parquet(path)
    new = spark.createDataFrame([("7", 1, 5), ("x", 1, 6)], SCHEMA)
    arguments = {"upsert_last_wins": [["seq"]], "upsert_partial": [["v"]]}.get(name, [])
    out = getattr(merge, name)(spark.read.parquet(path), new, ["k"], *arguments)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert out.count() == 20_001


def test_long_listing_text_is_kept_whole(spark):
    from brickline.plans.listings import normalise_listings

    url, details = "http://x.example/" + "u" * 600, "d" * 6000
    posts = spark.createDataFrame([(url, "t" * 80, "b", details, "Kelowna", None)], "url string, title string, body string, details string, city string, breadcrumb string")
    row = normalise_listings(posts, "shop", "Kelowna").first()
    assert (row["url"], row["description"], len(row["property_type"])) == (url, details, 80)
