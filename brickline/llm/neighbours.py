"""Nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node; their ids come back at the end. The neighbour graph starts from cells of the nodes in the
order of several random hyperplane trees, each vector in one cell a tree, and from windows in the order of a hash. So
most links are there before the descent, whose rounds send vectors to many blocks, and few rounds are left. It descends: each round joins neighbours with neighbours. Every
node is a centre that meets a sample of its new neighbours, forward and reverse, with its others; whatever pairs are
nearer than what either end holds go back to those ends. It ends when a round changes less than ``DONE`` of the links.

A search walks the graph, links taken both ways, from the query's own node: it opens the nearest nodes not yet
opened, measures their neighbours, and stops when the ``width`` nearest it knows are all opened.

Centres are dealt to blocks of bounded size, and each block gets every vector that it needs once, however many of its
centres need it. Lists have a fixed length in the graph, and reverse links are cut to their sample in every task before
they are shuffled, so a node that is near a third of all others is no larger than any other. A search sends a query and
the nodes it asks for only to the blocks where they meet. All is exact but the choice of what is compared.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickline.llm.shared import whole_groups
from brickline.session import settle

LINKS = 48
SAMPLED = 24
DONE = 0.02
WINDOW_ROWS = 256
RANGE_ROWS = 20_000
# Trees, those merged at once, rows of a tree's cell, and links that it gives a node.
TREES, AT_ONCE, CELL_ROWS, CELL_LINKS = 10, 5, 8_192, 32
BLOCK_NODES = 8_192
WIDTH = 128
OPENED = 24
PLANES = 30
NONE = np.iinfo(np.int64).max


def _vector_rows(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, vec`` of the vectors that take part: no null, no null or non-finite component, not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = [], []
            for i, v in zip(batch["vec_id"].to_pylist(), batch["v"].to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.asarray(v, np.float64) + 0.0  # -0.0 becomes 0.0
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vectors.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["vec_id", "vec"])

    return embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).mapInArrow(run, "vec_id long, vec binary")


def _matrix(column, dtype=np.float64) -> np.ndarray:
    """Equally long binary values as rows of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), dtype)
    first = int(np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0])
    width = len(column[0].as_buffer())
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, first).view(dtype).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(-1)[:, None] + (b * b).sum(-1)[None, :] - 2 * (a @ b.T), 0)


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished rounds; their tables are written and read again."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# --- the graph ---------------------------------------------------------------------------------------------------

GRAPH = "node long, ids binary, ds binary, fresh binary"


def _window_links(nodes: DataFrame, order: list[Column], ranges: int, planes: np.ndarray | None, rows: int, most: int) -> DataFrame:
    """``node, ids, ds``: the ``most`` nearest nodes of each within a window of at least ``rows`` neighbours in an order."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["vec32"], np.float32)
            bits = (x @ planes[:, :-1].T > planes[:, -1]) @ (1 << np.arange(len(planes))[::-1]) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["node"], batch["vec32"], pa.array(bits, pa.int64())], names=["node", "vec32", "bits"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"node": pa.array([], pa.int64()), "vec32": pa.array([], pa.binary())})
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch]).select(["node", "vec32"])])
            while len(held) >= 2 * rows:
                yield from links(held.slice(0, rows))
                held = held.slice(rows).combine_chunks()
        if len(held):
            yield from links(held)

    def links(part: pa.Table) -> Iterator[pa.RecordBatch]:
        x, ids = _matrix(part["vec32"], np.float32), part["node"].to_numpy()
        k = min(most, len(x) - 1)
        for lo in range(0, len(x), WINDOW_ROWS):
            own = x[lo : lo + WINDOW_ROWS]
            d = _squares(own, x)
            d[np.arange(len(own)), lo + np.arange(len(own))] = np.inf
            at = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(own), 0), np.int64)
            near_ids = np.full((len(own), most), NONE)
            near_ds = np.full((len(own), most), np.inf, np.float32)
            near_ids[:, :k], near_ds[:, :k] = ids[at], np.take_along_axis(d, at, 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + WINDOW_ROWS]), _binary(near_ids), _binary(near_ds)], names=["node", "ids", "ds"])

    keys = nodes.select("node", "vec32")
    if planes is not None:
        keys = keys.mapInArrow(keyed, "node long, vec32 binary, bits long")
    ordered = keys.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return ordered.select("node", "vec32").mapInArrow(near, "node long, ids binary, ds binary")


def _picked(node: int, number: int, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links that a round samples: of the new ones and of the old ones; the same in any retry."""
    order = np.random.default_rng([node & 0x7FFFFFFFFFFFFFFF, number]).permutation(len(fresh))
    return order[fresh[order]][:SAMPLED], order[~fresh[order]][:SAMPLED]


def _merge(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """Of each node's lists (its own has ``fresh``, found ones have not) the nearest; links not held before are new."""
    for table, starts in whole_groups(batches, ["node"]):
        nodes, flags = table["node"].to_numpy()[starts[:-1]], table["fresh"].to_pylist()
        lists, lengths = table["ids"].to_pylist(), table["ds"].to_pylist()
        out_ids = np.full((len(nodes), LINKS), NONE)
        out_ds = np.full((len(nodes), LINKS), np.inf, np.float32)
        out_fresh = np.zeros((len(nodes), LINKS), bool)
        changed = np.zeros(len(nodes), np.int64)
        for k, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
            ids = np.frombuffer(b"".join(lists[lo:hi]), np.int64)
            ds = np.frombuffer(b"".join(lengths[lo:hi]), np.float32)
            fresh, at = np.ones(len(ids), bool), 0
            held = np.zeros(len(ids), bool)
            for r in range(lo, hi):
                n = len(lists[r]) // 8
                if flags[r] is not None:
                    own = np.frombuffer(flags[r], bool).copy()
                    own[_picked(int(nodes[k]), number, own & (ids[at : at + n] != NONE))[0]] = False
                    fresh[at : at + n], held[at : at + n] = own, True
                at += n
            order = np.lexsort((~held, ids))
            ids, ds, fresh, held = ids[order], ds[order], fresh[order], held[order]
            keep = ids != NONE
            keep[1:] &= ids[1:] != ids[:-1]
            ids, ds, fresh, held = ids[keep], ds[keep], fresh[keep], held[keep]
            order = np.lexsort((ids, ds))[:LINKS]
            n = len(order)
            out_ids[k, :n], out_ds[k, :n], out_fresh[k, :n] = ids[order], ds[order], fresh[order]
            changed[k] = int((~held[order]).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes), _binary(out_ids), _binary(out_ds), _binary(out_fresh), pa.array(changed)],
            names=["node", "ids", "ds", "fresh", "changed"],
        )


def _merged(lists: DataFrame, number: int) -> DataFrame:
    by_node = lists.select("node", "ids", "ds", "fresh").repartition("node").sortWithinPartitions("node")
    return by_node.mapInArrow(lambda it: _merge(it, number), GRAPH + ", changed long")


def _meetings(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """Sampled links both ways as ``centre, member, kind``: 0 new, 1 old, and 2, 3 the same for reverse links."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            centre, member, kind = [], [], []
            for node, ids, fresh in zip(*(part[c].to_pylist() for c in ("node", "ids", "fresh"))):
                ids, fresh = np.frombuffer(ids, np.int64), np.frombuffer(fresh, bool)
                for k, places in enumerate(_picked(node, number, fresh & (ids != NONE))):
                    there = ids[places]
                    there = there[there != NONE]
                    here = np.full(len(there), node)
                    centre += [here, there]
                    member += [there, here]
                    kind.append(np.repeat([k, k + 2], len(there)))
            columns = [np.concatenate(centre), np.concatenate(member), np.concatenate(kind).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["centre", "member", "kind"])


def _sampled(meetings: DataFrame, number: int) -> DataFrame:
    """Of each centre's meetings of a kind ``SAMPLED``, in the order of a hash, the same in any retry.

    Spark keeps the first of each in every task before it shuffles them, so a centre of any fame sends few rows.
    """
    order = Window.partitionBy("centre", "kind").orderBy(F.xxhash64("centre", "member", F.lit(number)), "member")
    return meetings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLED).drop("place")


def _local_join(meetings: pa.Table, vectors: pa.Table) -> pa.Table:
    """Within a block of centres, the pairs that are nearer than the farthest link of an end.

    What was found goes out as one row for each block that has such ends, however many they are.
    """
    member = vectors["member"].to_numpy()
    order = np.argsort(member)
    member, x = member[order], _matrix(vectors["vec32"], np.float32)[order]
    worst, home = vectors["worst"].to_numpy()[order], vectors["home"].to_numpy()[order]
    centre, kind = meetings["centre"].to_numpy(), meetings["kind"].to_numpy()
    place = np.searchsorted(member, meetings["member"].to_numpy())
    by_centre = np.lexsort((place, kind, centre))
    centre, kind, place = centre[by_centre], kind[by_centre], place[by_centre]
    starts = np.flatnonzero(np.append(True, centre[1:] != centre[:-1])) if len(centre) else []
    ends, near, far, length = np.append(starts[1:], len(centre)), [], [], []
    for lo, hi in zip(starts, ends):
        fresh = kind[lo:hi] % 2 == 0
        new = np.unique(place[lo:hi][fresh])
        old = np.setdiff1d(place[lo:hi][~fresh], new)
        both = np.concatenate([new, old])
        if len(new) and len(both) > 1:
            d = _squares(x[new], x[both])
            better = d < np.maximum(worst[new][:, None], worst[both][None, :])
            better[:, : len(new)] &= np.tri(len(new), k=-1, dtype=bool)
            a, b = np.nonzero(better)
            near.append(new[a])
            far.append(both[b])
            length.append(d[a, b])
    if not near:
        return pa.table({n: pa.array([], t) for n, t in zip(("home", "nodes", "ids", "ds"), (pa.int32(), *3 * [pa.binary()]))})
    near, far, length = map(np.concatenate, (near, far, length))
    a, b, d = np.concatenate([near, far]), np.concatenate([far, near]), np.concatenate([length, length])
    good = d < worst[a]
    a, b, d = a[good], b[good], d[good]
    _, once = np.unique(a * np.int64(len(member)) + b, return_index=True)
    a, b, d = a[once], b[once], d[once]
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order].astype(np.float32)
    nearest_few = np.arange(len(a)) - np.searchsorted(a, a) < LINKS
    a, b, d = a[nearest_few], b[nearest_few], d[nearest_few]
    to = home[a]
    order = np.argsort(to, kind="stable")
    a, b, d, to = a[order], b[order], d[order], to[order]
    homes, starts = np.unique(to, return_index=True)
    rows = [(int(h), member[a[lo:hi]].tobytes(), member[b[lo:hi]].tobytes(), d[lo:hi].tobytes()) for h, lo, hi in zip(homes, starts, np.append(starts[1:], len(a)))]
    columns = zip(*rows) if rows else [[]] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("home", "nodes", "ids", "ds"), columns, (pa.int32(), *3 * [pa.binary()]))})


def _merge_block(graph: pa.Table, found: pa.Table, number: int) -> pa.Table:
    """The nearest of what the nodes of a block held and what was found for them; links not held before are new."""
    nodes = graph["node"].to_numpy()
    ids, ds, fresh = _matrix(graph["ids"], np.int64), _matrix(graph["ds"], np.float32), _matrix(graph["fresh"], bool).copy()
    for k, node in enumerate(nodes):
        fresh[k, _picked(int(node), number, fresh[k] & (ids[k] != NONE))[0]] = False
    more = [np.frombuffer(b"".join(found[c].to_pylist()), t) for c, t in (("nodes", np.int64), ("ids", np.int64), ("ds", np.float32))]
    order = np.argsort(nodes)
    row = np.concatenate([np.repeat(np.arange(len(nodes)), ids.shape[1]), order[np.searchsorted(nodes[order], more[0])]])
    link, d = np.concatenate([ids.ravel(), more[1]]), np.concatenate([ds.ravel(), more[2]])
    new = np.concatenate([fresh.ravel(), np.ones(len(more[0]), bool)])
    held = np.concatenate([np.ones(ids.size, bool), np.zeros(len(more[0]), bool)])
    keep = np.flatnonzero(link != NONE)
    keep = keep[np.lexsort((~held[keep], link[keep], row[keep]))]
    keep = keep[np.append(True, (row[keep][1:] != row[keep][:-1]) | (link[keep][1:] != link[keep][:-1]))[: len(keep)]]
    keep = keep[np.lexsort((link[keep], d[keep], row[keep]))]
    place = np.arange(len(keep)) - np.searchsorted(row[keep], row[keep])
    keep, place = keep[place < LINKS], place[place < LINKS]
    out_ids = np.full((len(nodes), LINKS), NONE)
    out_ds = np.full((len(nodes), LINKS), np.inf, np.float32)
    out_fresh = np.zeros((len(nodes), LINKS), bool)
    at = row[keep], place
    out_ids[at], out_ds[at], out_fresh[at] = link[keep], d[keep], new[keep]
    changed = np.bincount(row[keep][~held[keep]], minlength=len(nodes)).astype(np.int64)
    columns = [pa.array(nodes), _binary(out_ids), _binary(out_ds), _binary(out_fresh), pa.array(changed)]
    return pa.table(dict(zip(("node", "ids", "ds", "fresh", "changed"), columns)))


def _merger(number: int):
    """The merge of one round; a function of the two tables alone, as a cogroup takes it."""
    return lambda graph, found: _merge_block(graph, found, number)


def build_graph(nodes: DataFrame, n: int, dim: int) -> DataFrame:
    """``node, ids, ds, fresh``: each node's nearest other nodes, by NN-descent over ``node, vec32``."""
    spark = nodes.sparkSession
    ranges, blocks = max(1, -(-n // RANGE_ROWS)), max(1, -(-n // BLOCK_NODES))
    some = nodes.orderBy(F.xxhash64("node"), "node").limit(4 * PLANES).select("vec32").collect()
    sample = np.array([np.frombuffer(r["vec32"], np.float32) for r in some]).reshape(-1, dim)
    none = F.lit(None).cast("binary")

    def tree(number: int) -> DataFrame:
        pick = np.random.default_rng([3, number]).integers(0, max(1, len(sample)), (2, PLANES))
        a, b = (sample[p] if len(sample) else np.zeros((PLANES, dim), np.float32) for p in pick)
        planes = np.concatenate([a - b, (((a + b) / 2) * (a - b)).sum(1, keepdims=True)], 1)
        return _window_links(nodes, [F.col("bits"), F.col("node")], ranges, planes, CELL_ROWS, CELL_LINKS)

    graph = _window_links(nodes, [F.xxhash64("node", F.lit(17)), F.col("node")], ranges, None, WINDOW_ROWS, LINKS)
    for first in range(0, TREES, AT_ONCE):
        graph = graph.select("node", "ids", "ds", none.alias("fresh"))
        for number in range(first, min(first + AT_ONCE, TREES)):
            graph = graph.unionByName(tree(number).withColumn("fresh", none))
        graph = settle(_merged(graph, -1), "graph-start").select("node", "ids", "ds", "fresh")
        _release(spark)
    for number in count():
        home = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        meetings = graph.select("node", "ids", "fresh").mapInArrow(lambda it, k=number: _meetings(it, k), "centre long, member long, kind int")
        meetings = settle(_sampled(meetings, number).withColumn("block", home("centre")), "meetings")
        worst = graph.select(F.col("node").alias("member"), _last("ds").alias("worst"))
        sent = meetings.select(F.col("block").alias("at"), F.col("member").alias("m")).distinct().toDF("block", "member")
        sent = sent.join(nodes.select(F.col("node").alias("member"), "vec32"), "member").join(worst, "member")
        sent = sent.select("block", "member", "vec32", "worst", home("member").alias("home"))
        found = (
            meetings.groupBy("block")
            .cogroup(sent.groupBy("block"))
            .applyInArrow(_local_join, "home int, nodes binary, ids binary, ds binary")
        )
        held = graph.select(home("node").alias("home"), "node", "ids", "ds", "fresh")
        merged = held.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(_merger(number), GRAPH + ", changed long")
        graph = settle(merged, "graph")
        changed = graph.agg(F.sum("changed")).first()[0] or 0
        _release(spark)
        if not changed or changed < DONE * LINKS * n:
            break
    return graph


def _last(column: str) -> Column:
    """The last of a binary list of 32-bit numbers: the farthest link's length."""

    @F.pandas_udf("float")
    def last(values):
        return values.map(lambda v: np.frombuffer(v, np.float32)[-1]).astype("float32")

    return last(F.col(column))


def links_both_ways(graph: DataFrame) -> DataFrame:
    """``node, link``: every link of the graph, and reverse links, the shortest ``LINKS`` of each node."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ds = _matrix(batch["ids"], np.int64), _matrix(batch["ds"], np.float32)
            node = np.repeat(batch["node"].to_numpy(zero_copy_only=False), ids.shape[1] if len(ids) else 0)
            there, d = ids.ravel(), ds.ravel()
            good = there != NONE
            columns = [pa.array(node[good]), pa.array(there[good]), pa.array(d[good])]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "link", "d"])

    forward = graph.select("node", "ids", "ds").mapInArrow(pairs, "node long, link long, d float")
    shortest = Window.partitionBy("node").orderBy("d", "link")
    reverse = forward.select(F.col("link").alias("node"), F.col("node").alias("link"), "d")
    reverse = reverse.withColumn("rank", F.row_number().over(shortest)).where(F.col("rank") <= LINKS)
    return forward.select("node", "link").unionByName(reverse.select("node", "link"))


# --- the search --------------------------------------------------------------------------------------------------

STATE = "query long, ids binary, ds binary, opened binary"


def _measure(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
    """Distances of ``query, node`` pairs of a block; ``vectors`` holds the vectors of both, ``is_query`` tells which."""
    is_query = vectors["is_query"].to_numpy()
    sides = []
    for name, rows in (("query", is_query), ("node", ~is_query)):
        chosen = vectors.filter(pa.array(rows))
        ids = chosen["node"].to_numpy()
        order = np.argsort(ids)
        place = order[np.searchsorted(ids, pairs[name].to_numpy(), sorter=order)]
        sides.append((_matrix(chosen["vec"]), place))
    (q, at_q), (x, at_x) = sides
    d = np.concatenate([[], *(np.sqrt(((q[at_q[k : k + 20_000]] - x[at_x[k : k + 20_000]]) ** 2).sum(1)) for k in range(0, len(at_q), 20_000))])
    return pa.table({"query": pairs["query"], "node": pairs["node"], "d": pa.array(d, pa.float64())})


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query's list after a round: what it held and what was measured, the nearest ``WIDTH``."""
    for table, starts in whole_groups(batches, ["query"]):
        query, node, d = (table[c].to_numpy() for c in ("query", "node", "d"))
        held = [table[c].to_pylist() for c in ("ids", "ds", "opened")]
        out = []
        for lo, hi in zip(starts[:-1], starts[1:]):
            ids, ds, opened = [], [], []
            for r in range(lo, hi):
                if held[0][r] is not None:
                    ids.append(np.frombuffer(held[0][r], np.int64))
                    ds.append(np.frombuffer(held[1][r], np.float64))
                    opened.append(np.frombuffer(held[2][r], bool))
            measured = np.array([held[0][r] is None for r in range(lo, hi)])
            ids.append(node[lo:hi][measured].astype(np.int64))
            ds.append(d[lo:hi][measured])
            opened.append(np.zeros(int(measured.sum()), bool))
            ids, ds, opened = map(np.concatenate, (ids, ds, opened))
            order = np.lexsort((~opened, ids))
            keep = np.append(True, ids[order][1:] != ids[order][:-1])
            order = order[keep]
            order = order[np.lexsort((ids[order], ds[order]))][:WIDTH]
            out.append((int(query[lo]), ids[order].tobytes(), ds[order].tobytes(), opened[order].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
            names=["query", "ids", "ds", "opened"],
        )


def _frontier(opened: bytes) -> np.ndarray:
    """Places of the nearest nodes that a round opens."""
    return np.flatnonzero(~np.frombuffer(opened, bool))[:OPENED]


def _opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        query, node = [], []
        for q, ids, opened in zip(*(batch[c].to_pylist() for c in ("query", "ids", "opened"))):
            there = np.frombuffer(ids, np.int64)[_frontier(opened)]
            node.append(there)
            query.append(np.full(len(there), q))
        if node:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.array(np.concatenate(node))], names=["query", "node"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States with this round's frontier marked as opened."""
    for batch in batches:
        marked = []
        for opened in batch["opened"].to_pylist():
            flags = np.frombuffer(opened, bool).copy()
            flags[_frontier(opened)] = True
            marked.append(flags.tobytes())
        yield pa.RecordBatch.from_arrays([batch["query"], batch["ids"], batch["ds"], pa.array(marked, pa.binary())], names=["query", "ids", "ds", "opened"])


def search(queries: DataFrame, nodes: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """``query, ids, ds, opened``: the nearest nodes found from each query node, itself first."""
    spark = nodes.sparkSession
    blocks = max(1, -(-n // BLOCK_NODES))
    own = np.zeros(1).tobytes()
    asking = queries.select("query").join(nodes, F.col("query") == F.col("node")).select("query", "vec")
    asking = settle(asking, "asking")
    own_id = F.udf(lambda q: int(q).to_bytes(8, "little", signed=True), "binary")
    state = settle(
        asking.select("query", own_id("query").alias("ids"), F.lit(own).alias("ds"), F.lit(b"\x00").alias("opened")), "search-start"
    )
    while True:
        frontier = state.mapInArrow(_opening, "query long, node long")
        pairs = frontier.join(links, "node").select("query", F.col("link").alias("node")).distinct()
        pairs = settle(pairs.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")), "search-pairs")
        if pairs.isEmpty():
            break
        asked_for = pairs.select("block", "node").distinct().toDF("at", "node").join(nodes.select("node", "vec"), "node")
        there = pairs.select("block", "query").distinct().toDF("at", "query").join(asking, "query")
        vectors = asked_for.select(F.col("at").alias("block"), "node", "vec", F.lit(False).alias("is_query")).union(
            there.select("at", "query", "vec", F.lit(True))
        )
        measured = pairs.groupBy("block").cogroup(vectors.groupBy("block")).applyInArrow(_measure, "query long, node long, d double")
        held = state.mapInArrow(_opened, STATE)
        rows = held.select("query", F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("d"), "ids", "ds", "opened")
        none = F.lit(None).cast("binary")
        rows = rows.unionByName(measured.select("query", "node", "d", none.alias("ids"), none.alias("ds"), none.alias("opened")))
        state = settle(rows.repartition("query").sortWithinPartitions("query").mapInArrow(_advance, STATE), "search")
        _release(spark)
    return state


def nearest(embeddings: DataFrame, top: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``top`` nearest found to every vector whose id ``every`` divides.

    ``score`` is the Euclidean distance in double precision, ties go to the smaller vec_id, a query is no neighbour of
    itself. Null ids, null vectors, vectors with null or non-finite components and zero vectors take no part, nor do
    vectors of another length than most have (of equally frequent lengths the smaller counts). Repeated rows count
    once. Fewer candidates than ``top`` all come back; an empty table gives an empty result.
    """
    rows = settle(_vector_rows(embeddings, key, vector).distinct(), "vectors")
    sizes = rows.groupBy(F.octet_length("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    dim = sizes["size"] // 8 if sizes else 1
    rows = rows.where(F.octet_length("vec") == 8 * dim)
    narrow = F.pandas_udf(lambda s: s.map(lambda v: np.frombuffer(v).astype(np.float32).tobytes()), "binary")
    nodes = settle(rows.groupBy("vec").agg(F.min("vec_id").alias("node")).select("node", "vec", narrow("vec").alias("vec32")), "nodes")
    n = nodes.count()
    of_node = rows.join(nodes.select("node", "vec"), "vec").select("vec_id", "node")
    smallest = Window.partitionBy("node").orderBy("vec_id")
    members = of_node.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= top + 1).select("node", "vec_id")
    asked = settle(of_node.where(F.pmod("vec_id", F.lit(every)) == 0), "asked")
    links = settle(links_both_ways(build_graph(nodes, n, dim)), "graph-links")
    state = search(asked.select(F.col("node").alias("query")).distinct(), nodes, links, n)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, ids, ds in zip(*(batch[c].to_pylist() for c in ("query", "ids", "ds"))):
                ids, ds = np.frombuffer(ids, np.int64), np.frombuffer(ds, np.float64)
                columns = [pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(ds)]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "node", "score"])

    found = state.mapInArrow(listed, "query long, node long, score double").join(members, "node")
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top + 1)
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(found, "query").where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
