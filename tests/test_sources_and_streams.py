from __future__ import annotations

import datetime as dt

import pytest

from brickline.plans import serve
from brickline.session import new_table_path, shared_dir
from brickline.sources import readers
from brickline.streaming import jobs


def test_quoted_separators_do_not_count_and_files_may_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"Rent, median";City\n5;Kelowna\n')
    (tmp_path / "b.csv").write_text("City,Other\nToronto,1\n")
    rows = readers.read_delimited(spark, str(tmp_path)).select("`Rent, median`", "City", "Other").collect()
    assert sorted(map(tuple, rows), key=str) == [("5", "Kelowna", None), (None, "Toronto", "1")]


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_separator_is_taken_from_the_header(spark, tmp_path, sep):
    (tmp_path / "f.csv").write_text(f"a{sep}b\n1{sep}2\n")
    assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / "f.csv")).collect()] == [("1", "2")]


@pytest.mark.parametrize("body", ['[{"a": 1}, {"a": 2}]', '{"data": [{"a": 1}, {"a": 2}]}', '{"rows": [{"a": 1}, {"a": 2}]}'])
def test_json_shells(spark, tmp_path, body):
    (tmp_path / "f.json").write_text(body)
    assert sorted(r.a for r in readers.read_json_records(spark, str(tmp_path / "f.json")).collect()) == [1, 2]


def test_metric_csv_drops_bad_rows_and_checks_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Date,Value\n"31 Dec 1934",2.5\n1935-03-01,n/a\n')
    rows = readers.read_metric_csv(spark, [str(tmp_path / "m.csv")], "rate", "file").collect()
    assert [(r.date, r.city, r.metric, r.value, r.source) for r in rows] == [(dt.date(1934, 12, 1), "Canada", "rate", 2.5, "file")]
    (tmp_path / "n.csv").write_text("Day,Value\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_metric_csv(spark, [str(tmp_path / "n.csv")], "rate", "file")


def test_observations_skip_missing_values(spark):
    payload = '{"observations":[{"d":"2024-01-02","A":{"v":"2.5"},"B":{"v":null}},{"d":"2024-01-03","A":{"v":"x"}}]}'
    df = spark.createDataFrame([(payload,)], "p string")
    rows = readers.flatten_observations(df, "p", {"A": "overnight"}, "raw_").collect()
    assert [(r.date, r.metric, r.value) for r in rows] == [(dt.date(2024, 1, 2), "overnight", 2.5)]


def test_shared_folder_comes_from_the_session(spark):
    folder = shared_dir(spark)
    assert new_table_path(spark, "t").startswith(folder)
    assert new_table_path(spark, "t") != new_table_path(spark, "t")


def write_events(spark, folder, rows):
    schema = jobs.EVENT_SCHEMA
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def event(i, ts, value=6.0, user=1, kind="view"):
    return (i, ts, user, kind, value, "{}")


def test_late_row_is_dropped_and_the_rest_equals_batch(spark, tmp_path):
    day = dt.datetime(2024, 1, 1, 12)
    folder = str(tmp_path)
    write_events(spark, folder, [event(1, day), event(2, day + dt.timedelta(days=10))])
    stream = jobs.daily_sentiment_stream(jobs.event_stream(spark, folder))
    path = new_table_path(spark, "late")
    start = lambda w: w.format("parquet").outputMode("append").option("path", path)
    jobs.run_available(spark, start, stream, path)
    write_events(spark, folder, [event(3, day, value=100.0), event(4, day + dt.timedelta(days=30))])
    jobs.run_available(spark, start, stream, path)
    got = {r.date: r.sentiment_score for r in spark.read.parquet(path).collect()}
    assert got[dt.date(2024, 1, 1)] == pytest.approx(0.1)
    assert dt.date(2024, 1, 11) in got


def test_top3_breaks_ties_by_target(spark):
    d = dt.date(2024, 1, 1)
    rows = [("a", t, d, True) for t in ("rent", "price", "x", "y")] + [("a", "price", dt.date(2025, 1, 1), False)]
    df = spark.createDataFrame(rows, "city string, target string, detect_date date, is_anomaly boolean")
    assert [r.target for r in serve.top3_anomalies(df).orderBy("rank").collect()] == ["price", "rent", "x"]


def test_gauge_counts_missing_components_as_zero(spark):
    rows = [("a", dt.date(2024, 1, 1), "affordability", 0.9), ("a", dt.date(2024, 2, 1), "affordability", 0.5)]
    df = spark.createDataFrame(rows, "city string, predict_date date, risk_type string, risk_value double")
    new, old = serve.serve_risk_gauge(df).first(), serve.serve_risk_gauge(df, keep="oldest").first()
    assert (new.score, new.affordability, new.inventory) == (0, "Moderate", "Low")
    assert (old.affordability, old.date) == ("Tight", dt.date(2024, 2, 1))


def test_zero_bound_is_kept(spark):
    df = spark.createDataFrame([(5.0, 0.0, None)], "yhat double, yhat_lower double, yhat_upper double")
    assert tuple(serve.fill_interval(df).first()) == (5.0, 0.0, 5.0)


def test_national_table_has_no_geography_column(spark):
    from brickline.plans.listings import normalise_statcan

    df = spark.createDataFrame([("2024-01", "1,000.5"), ("bad", "1"), ("2024-02", "..")], "REF_DATE string, VALUE string")
    rows = normalise_statcan(df, "gdp").collect()
    assert [(r.city, r.date, r.value) for r in rows] == [("Canada", dt.date(2024, 1, 1), 1000.5)]
    with pytest.raises(ValueError):
        normalise_statcan(df.drop("VALUE"), "gdp")
