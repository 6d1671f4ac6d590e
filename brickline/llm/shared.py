"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.session import settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


_HELD: dict[object, object] = {}


def only(name: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks, of one operator at a time.

    Workers outlive the stages of a pipeline; when another operator's tasks come, what the last one had kept goes.
    """
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def portions(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, so that a task holds few texts as Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def held_out() -> Column:
    """True for the third of the documents that no model may learn from; a null doc_id is not among them."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def texts_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key as a long and the whole text, a null text as the empty one. Every other column is left behind."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups only, with the row at which each group starts and the row count at the end.

    The batches must be sorted by the keys, as a task sees them after a repartition and a sort within the
    partition. A group that runs over the end of a batch is carried to the next, so memory is one batch and one group.
    """
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        starts = _starts(pa.Table.from_batches([batch]), keys)
        joins = bool(pending) and all(pending[-1][k][-1].as_py() == batch[k][0].as_py() for k in keys)
        if len(starts) == 1 and (joins or not pending):
            pending.append(batch)
            continue
        cut = starts[-1]
        if joins or not pending:
            yield from _out([*pending, batch.slice(0, cut)], keys)
            pending = [batch.slice(cut)]
        elif cut == 0:
            yield from _out(pending, keys)
            pending = [batch]
        else:
            yield from _out([*pending, batch.slice(0, cut)], keys)
            pending = [batch.slice(cut)]
    yield from _out(pending, keys)


def _out(parts: list[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    parts = [p for p in parts if p.num_rows]
    if parts:
        table = pa.Table.from_batches(parts).combine_chunks()
        yield table, np.append(_starts(table, keys), table.num_rows)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for key in keys:
        column = table[key].combine_chunks()
        if table.num_rows > 1:
            new[1:] |= ~np.asarray(pc.equal(column[1:], column[:-1]).fill_null(False))
    return np.flatnonzero(new)


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, label`` of every node on an edge ``a, b``; the label is the smallest node of its component.

    Alternating large and small stars: each step is a grouped minimum, which sums up before the shuffle, and a
    join that Spark splits where one node has most of the edges. Each round is a written table, so lineage stays
    short and a lost executor costs one re-read. The rounds grow with the logarithm of the longest chain.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, f"{name}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        edges = settle(small.distinct(), f"{name}-small")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _mark(edges: DataFrame):
    """Two numbers that change when the set of edges does."""
    found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return found["n"], found["s"]
