"""The keyed table of a stream: batches, repeats, late rows, expiry, and what a batch writes."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from brickline.streaming import jobs, upsert
from brickline.streaming.upsert import upsert_stream, upsert_table

T0 = dt.datetime(2024, 1, 15)


def event(i, days, value, user, kind="view"):
    return (i, T0 + dt.timedelta(days=days) if days is not None else None, user, kind, value, "{}")


@pytest.fixture
def stream(spark, tmp_path):
    """``put(rows)`` adds a file to the input, ``run(...)`` takes what is new and gives ``{user: value}``."""

    class Stream:
        folder, path = str(tmp_path / "in"), str(tmp_path / "table")

        def put(self, rows):
            spark.createDataFrame(rows, jobs.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/events.parquet")

        def run(self, **kw):
            rows = upsert_stream(jobs.event_stream(spark, self.folder), self.path, **kw).collect()
            assert len({(r.user_id, r.event_type) for r in rows}) == len(rows)
            return {r.user_id: r.value for r in rows}

        def size(self, part):
            return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{self.path}/{part}") for f in names if f.endswith(".parquet"))

        def files(self, part="rows"):
            return {os.path.relpath(os.path.join(d, f), self.path) for d, _, names in os.walk(f"{self.path}/{part}") for f in names if f.endswith(".parquet")}

    return Stream()


def test_several_batches_late_and_repeated_rows(stream):
    stream.put([event(k, 0, float(k), k) for k in range(4)])
    assert stream.run() == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0}
    stream.put([event(10, 1, 10.0, 0), event(11, -5, 11.0, 1), event(12, 0, 12.0, 2), event(3, 0, 3.0, 3)])
    want = {0: 10.0, 1: 1.0, 2: 12.0, 3: 3.0}  # user 1's row is late, user 3's is a copy
    assert stream.run() == want
    assert stream.run() == want  # nothing new
    stream.put([event(20, None, 20.0, 0), event(21, None, 21.0, 9), event(22, 2, 22.0, None)])
    assert stream.run() == want | {9: 21.0, None: 22.0}


def test_a_batch_writes_what_it_changed(stream):
    """Months that a batch doesn't touch keep their files; its changes are as large as the batch."""
    stream.put([event(k, -31 * (k % 6), float(k), k) for k in range(6000)])
    stream.run(merge_every=1000)
    first, months = stream.size("rows"), stream.files()
    stream.put([event(10_000 + k, 1, -1.0, 6 * k) for k in range(20)])
    sizes = []
    add = jobs.run_available

    def spy(*args):
        add(*args)
        sizes.append(stream.size("changes"))

    import brickline.streaming.upsert as upsert

    upsert.run_available, before = spy, upsert.run_available
    try:
        got = stream.run(merge_every=1000)
    finally:
        upsert.run_available = before
    assert sizes[0] < first / 5 and sum(v == -1.0 for v in got.values()) == 20 and len(got) == 6000
    kept = stream.files() & months
    assert {f.split("month=")[1][:7] for f in months - kept} == {"2024-01"}
    assert not stream.files("changes") and len(stream.files()) < 2 * len(months)


def test_old_folders_go_and_interrupted_merges_are_done_again(stream, spark):
    stream.put([event(1, 0, 1.0, 1), event(2, 0, 2.0, 2)])
    stream.run()
    stream.put([event(3, 40, 3.0, 1)])
    # A merge that died before its mark was written leaves a folder that doesn't count.
    rows = jobs.event_stream(spark, stream.folder).schema
    spark.createDataFrame([], rows).write.parquet(f"{stream.path}/rows/upto=999/month=2024-01")
    assert stream.run() == {1: 3.0, 2: 2.0}
    assert {f.split("/")[2] for f in stream.files()} == {"month=2024-01", "month=2024-02"}
    assert "upto=999" not in str(stream.files())
    stream.put([event(4, 40, 4.0, 2)])
    assert stream.run() == {1: 3.0, 2: 4.0}  # January is empty now
    assert {f.split("/")[2] for f in stream.files()} == {"month=2024-02"}


def test_keys_expire(stream):
    stream.put([event(1, 0, 1.0, 1), event(2, 0, 2.0, 2)])
    assert stream.run(keep_days=30) == {1: 1.0, 2: 2.0}
    stream.put([event(3, 29, 3.0, 1)])
    assert stream.run(keep_days=30) == {1: 3.0, 2: 2.0}
    stream.put([event(4, 50, 4.0, 3)])
    assert stream.run(keep_days=30) == {1: 3.0, 3: 4.0}
    stream.put([event(5, 10, 5.0, 7), event(6, 51, 6.0, 3)])  # older than any kept key may be
    assert stream.run(keep_days=30) == {1: 3.0, 3: 6.0}


def test_rows_come_out_whole(stream, spark):
    rows = [(1, T0 + dt.timedelta(seconds=1, microseconds=7), 5, "view", 1.5, "a"), (2, None, 6, None, None, None)]
    stream.put(rows)
    events = jobs.event_stream(spark, stream.folder)
    got = upsert_stream(events, stream.path).drop("city").collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


def test_no_events_give_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], jobs.EVENT_SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    out = upsert_table(spark, jobs.event_stream(spark, str(tmp_path)))
    assert out.columns == ["event_id", "ts", "user_id", "event_type", "value", "props", "city"] and out.collect() == []


def test_few_events_of_a_key_go_to_its_state(spark, monkeypatch):
    """A task sends one row per key however many Arrow batches its events fill; held in small portions it sends the last too."""
    rows = [(k, (k * 7919) % 1000 if k % 11 else None, k % 7 or None, "view") for k in range(30_000)]
    events = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string").coalesce(1)
    last = {}
    for e, t, u, _ in rows:
        last[u] = max(last.get(u, (False, 0, 0)), (t is not None, t or 0, e))
    got = upsert.last_in_tasks(events, ["user_id", "event_type"], ["ts", "event_id"]).collect()
    assert {r.user_id: r.event_id for r in got} == {u: e for u, (_, _, e) in last.items()} and len(got) == 7
    monkeypatch.setattr(upsert, "HELD_BYTES", 300)
    some = upsert.last_in_tasks(events, ["user_id", "event_type"], ["ts", "event_id"]).collect()
    assert {(r.user_id, r.event_id) for r in got} <= {(r.user_id, r.event_id) for r in some}
