"""The last event of each key, kept up to date by a stream.

Spark's state store holds the order of each key's last event; a batch reads and writes the state of its own keys only and
emits the keys that it changed. These go to a folder of the batch. Every few batches the changed rows are merged into
the table, which lies by the month of the event: only months that gain or lose a row are written again, as a new folder
that counts once its mark is written. Folders that a newer one replaces go after that, so a job that dies in between
finds either the old or the new rows and merges again.

A restart goes on from the checkpoint; a repeated batch writes its own folder again, and merging the same rows twice
changes nothing.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from brickline.operators.merge import dedupe_keep_last
from brickline.session import new_table_path
from brickline.streaming.jobs import run_available

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Batches whose changes wait until they are merged into the table.
MERGE_EVERY = 8
# Events of a task that are held to find the last of each key, and rows that it sends on at once.
HELD_BYTES, SENT_ROWS = 32 * 1024 * 1024, 10_000
NO_MONTH = "none"
MARKS = "month string, upto long"


def _rank(row: Any, order: Sequence[str]) -> tuple:
    """Comparable position of a row; nulls come first."""
    return tuple((row[c] is not None, row[c]) for c in order)


class LastEvent(StatefulProcessor):
    """Emits a key's row when it comes after the one held; ``was`` is the month that the replaced row lies in.

    ``at`` is the event's time in microseconds and comes first in the order. With ``expire`` a timer at that time removes
    the key once the watermark has passed it.
    """

    def __init__(self, columns: Sequence[str], order: Sequence[str], kinds: dict[str, str], keys: Sequence[str], expire: bool):
        self.columns, self.order, self.kinds, self.keys, self.expire = list(columns), ["at", *order], kinds, list(keys), expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = ", ".join(f"`{c}` {self.kinds[c]}" for c in self.order)
        self.last = handle.getValueState("last", f"{held}, month string")

    def _held(self) -> Row:
        return Row(*self.order, "month")(*self.last.get())

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best = max(rows, key=lambda r: _rank(r, self.order))
        old = self._held() if self.last.exists() else None
        if old is not None and _rank(best, self.order) <= _rank(old, self.order):
            return
        self.last.update(tuple(best[c] for c in (*self.order, "month")))
        if self.expire:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if best["at"] is not None:
                self.handle.registerTimer(best["at"] // 1000)
        yield Row(**{c: best[c] for c in self.columns}, was=old["month"] if old is not None else None, gone=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self._held()
        self.last.clear()
        known = dict(zip(self.keys, key)) | held.asDict()
        yield Row(**{c: known.get(c) for c in self.columns}, was=held["month"], gone=True)

    def close(self) -> None:
        pass


def _last_rows(rows: pa.Table, keys: Sequence[str], order: Sequence[str]) -> pa.Table:
    """One row per key, the last in the order; nulls come first, and null keys are a key."""
    by_order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
    place = np.empty(rows.num_rows, np.int64)
    place[by_order.to_numpy()] = np.arange(rows.num_rows)
    keyed = pa.table({**{f"k{i}": rows[k] for i, k in enumerate(keys)}, "place": pa.array(place)})
    last = keyed.group_by([f"k{i}" for i in range(len(keys))], use_threads=False).aggregate([("place", "max")])
    return rows.take(by_order.take(last["place_max"].combine_chunks()))


def last_in_tasks(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key of each task's events, as far as ``HELD_BYTES`` of them reach, so that few go to the state.

    What is held is reduced when it is full, and goes out once the reduced rows alone fill half of it.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size >= HELD_BYTES:
                rows = _last_rows(pa.concat_tables(held), keys, order)
                held, size = [rows], rows.nbytes
                if size >= HELD_BYTES // 2:
                    yield from rows.combine_chunks().to_batches(SENT_ROWS)
                    held, size = [], 0
        if held:
            yield from _last_rows(pa.concat_tables(held), keys, order).combine_chunks().to_batches(SENT_ROWS)

    return events.mapInArrow(reduce, events.schema)


class MonthTable:
    """Rows by key in folders ``rows/upto=<batch>/month=<month>``; of each month the newest marked folder counts."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[str]):
        self.spark, self.path, self.schema, self.keys, self.time = spark, path, schema, list(keys), order[0]
        # A key that expired comes after its own last row.
        self.order = ["at", *order[1:], "gone"]
        self.changed = StructType([f for f in schema.fields if f.name != self.time])
        for name, kind in (("at", "long"), ("month", "string"), ("was", "string"), ("gone", "boolean")):
            self.changed = self.changed.add(name, kind)

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def folders(self, pattern: str) -> list[str]:
        fs, at = self._fs()
        return sorted(str(s.getPath().toString()) for s in (fs.globStatus(at(f"{self.path}/{pattern}")) or []))

    def _drop(self, folders: list[str]) -> None:
        fs, at = self._fs()
        for folder in folders:
            fs.delete(at(folder), True)

    def newest(self) -> dict[str, int]:
        """Month to the batch of its newest folder; as many entries as the calendar has months."""
        marks = self.folders("marks/upto=*")
        if not marks:
            return {}
        found = self.spark.read.schema(MARKS).parquet(*marks).groupBy("month").agg(F.max("upto").alias("upto"))
        return {r["month"]: r["upto"] for r in found.collect()}

    def rows(self, months: set[str] | None = None) -> DataFrame:
        """Rows of all months, or of some, with ``month``."""
        there = set(self.folders("rows/upto=*/month=*"))
        parts = [
            self.spark.read.schema(self.schema).parquet(folder).withColumn("month", F.lit(month))
            for month, upto in sorted(self.newest().items())
            if (months is None or month in months) and (folder := self._folder(there, upto, month))
        ]
        out = self.spark.createDataFrame([], self.schema).withColumn("month", F.lit(None).cast("string"))
        for part in parts:
            out = out.unionByName(part)
        return out

    def _folder(self, there: set[str], upto: int, month: str) -> str | None:
        return next((f for f in there if f.endswith(f"/rows/upto={upto}/month={month}")), None)

    def add_batch(self, batch: DataFrame, batch_id: int) -> None:
        batch.select(self.changed.names).write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")

    def merge(self, upto: int) -> None:
        """Merge waiting changes into the months they touch."""
        waiting = self.folders("changes/batch=*")
        if not waiting:
            return
        changes = self.spark.read.schema(self.changed).parquet(*waiting)
        touched = changes.select(F.explode(F.array("month", "was")).alias("month")).where("month is not null").distinct()
        months = sorted(r["month"] for r in touched.collect())
        if months:
            newest = dedupe_keep_last(changes, self.keys, self.order).withColumn(self.time, F.timestamp_micros("at"))
            stored = self.rows(set(months))
            same = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in self.keys]
            kept = stored.alias("s").join(newest.select(*self.keys).alias("c"), same, "left_anti")
            merged = kept.unionByName(newest.where("not gone").select(*self.schema.names, "month"))
            merged.repartitionByRange("month").write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/rows/upto={upto}")
            marks = self.spark.createDataFrame([(m, upto) for m in months], MARKS)
            marks.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/upto={upto}")
            live = self.newest()
            keep = {f"/rows/upto={u}/month={m}" for m, u in live.items()}
            self._drop([f for f in self.folders("rows/upto=*/month=*") if f[f.rindex("/rows/") :] not in keep])
            self._drop([f for f in self.folders("marks/upto=*") if int(f.rpartition("=")[2]) not in live.values()])
        self._drop(waiting)


@contextlib.contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """State on disk for the queries that start inside; the session's own choice comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def upsert_stream(
    events: DataFrame, path: str, keys: Sequence[str] = ("user_id", "event_type"), order: Sequence[str] = ("ts", "event_id"),
    keep_days: int | None = None, merge_every: int = MERGE_EVERY,
) -> DataFrame:
    """Bring the table below ``path`` up to date with everything available; returns its rows, one per key.

    The first column of ``order`` is the event's time, a timestamp. With ``keep_days`` a key leaves the table once its last event lies that
    far behind the newest of the stream, and events older than that are late and change nothing. Without it nothing is
    late. Null keys are a key; null times come before all others. No event at all gives an empty table.
    """
    spark, time = events.sparkSession, order[0]
    table, expire = MonthTable(spark, path, events.schema, keys, order), keep_days is not None
    month = F.coalesce(F.date_format(time, "yyyy-MM"), F.lit(NO_MONTH))
    dated = last_in_tasks(events.withColumns({"at": F.unix_micros(time), "month": month}), keys, order)
    dated = last_in_tasks(dated.repartition(*keys), keys, order)
    processor = LastEvent([f.name for f in table.changed][:-2], order[1:], dict(dated.dtypes), keys, expire)
    if expire:
        dated = dated.withWatermark(time, f"{keep_days} days")
    changes = dated.groupBy(*keys).transformWithState(processor, table.changed, "Update", "EventTime" if expire else "None")

    def take(batch: DataFrame, batch_id: int) -> None:
        table.add_batch(batch, batch_id)
        if (batch_id + 1) % merge_every == 0:
            table.merge(batch_id)

    with rocks_state(spark):
        run_available(spark, lambda w: w.outputMode("update").foreachBatch(take), changes, path)
    waiting = table.folders("changes/batch=*")
    if waiting:
        table.merge(max(int(f.rpartition("=")[2]) for f in waiting))
    return table.rows().drop("month")


def upsert_table(spark: SparkSession, events: DataFrame, name: str = "latest") -> DataFrame:
    """A table of its own below the shared folder."""
    return upsert_stream(events, new_table_path(spark, name))
