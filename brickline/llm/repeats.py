"""Removal of byte strings that occur more than once in a corpus.

Every window of LENGTH bytes is named by its least k-byte hash, so equal windows have equal names wherever they
stand; neighbouring windows mostly share one, and a run of them is a piece. Spark groups pieces by name: names met once
hold nothing repeated and go before any text moves. Equal pieces become one with a mark. What is left is dealt out by
name, in batches of whole groups of bounded size, and each batch's repeats are found on a Burrows-Wheeler transform
(``bwt``). A name with more different pieces than a task should hold (a common line in many contexts) isn't gathered: its
pieces are named again by longer strings, level by level up to the window itself, whose equal pieces Spark merges.

Texts are read twice, moved once, and only texts that share a name with another place are kept for the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.llm.bwt import repeated_starts
from brickline.llm.shared import portions, whole_groups
from brickline.session import settle

LENGTH = 400
# Different pieces that a group may have before it is named again by longer strings.
GROUP = 2048
# Names and texts with over one in SHARE of all rows, fewer than SHARE, are sent to their rows instead of shuffled with them.
SHARE = 4096
# Bytes of pieces that are searched at once, and that one task is dealt on average.
BATCH_BYTES, TASK_BYTES = 2_000_000, 8_000_000
# Bytes of text that are hashed at once; longer texts are taken in overlapping stretches.
STRETCH = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
PIECES = "name long, piece binary, owner binary, place long, folds boolean, body binary"


def levels(length: int) -> list[int]:
    """Lengths of the strings that name windows, from a third of a window up to the whole."""
    out = [max(1, length * 8 // 25)]
    while out[-1] < length:
        out.append(out[-1] + (length - out[-1] + 1) // 2)
    return out


def hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes from each place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size = 1
    while size < k:
        step = min(size, k - size)
        h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + (h[step:] ^ (h[step:] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        size += step
    return h


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The ``best`` (``np.minimum``, ``np.maximum``) of the ``width`` values from each place, by doubling."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values = best(values[:-step], values[step:])
        size += step
    return values


def cut(bodies: list[bytes], k: int, length: int) -> tuple[np.ndarray, ...]:
    """``(body, start, end, name, folds)`` of every piece: the windows that start in ``[start, end)`` of that body.

    Pieces hold at most as many windows as strings of ``k`` bytes in a window, so long repetitive texts have bounded ones.
    Only a piece that ``folds``, where a least string occurs twice, can hold the same window twice.
    """
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none
    width = length - k + 1
    strings = hashes(data, k)
    names = sliding(strings, width, np.minimum)
    begins = np.append(0, np.cumsum(sizes)[:-1])
    body = np.repeat(np.arange(len(bodies)), sizes)[: len(names)]
    at = np.arange(len(names)) - begins[body]
    whole = at + length <= sizes[body]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (names[1:] != names[:-1]) | (at[1:] == 0)
    run = np.maximum.accumulate(np.where(first, np.arange(len(names)), 0))
    first |= whole & ((np.arange(len(names)) - run) % width == 0)
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(first | ~whole)
    ends = np.append(stops, len(names))[np.searchsorted(stops, starts, side="right")]
    margin = np.zeros(width - 1, dtype=np.uint64)
    least = np.flatnonzero(sliding(np.concatenate([margin, names, margin]), width, np.maximum) == strings)
    again = least[:-1][(strings[least[1:]] == strings[least[:-1]]) & (np.diff(least) <= width)]
    folds = np.searchsorted(again, starts) < np.searchsorted(again, ends - 1 + width)
    begin = begins[body[starts]]
    return body[starts], starts - begin, ends - begin, names[starts].view(np.int64), folds


def stretches(bodies: Iterable[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """``(body, offset, bytes)`` in lists of about STRETCH bytes; a longer body is cut so that each window is in one."""
    held, size = [], 0
    for i, body in enumerate(bodies):
        for offset in range(0, max(len(body) - length + 1, 0), STRETCH):
            held.append((i, offset, body[offset : offset + STRETCH + length - 1]))
            size += len(held[-1][2])
            if size >= STRETCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def pieces(bodies: list[bytes], k: int, length: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """``(body, start, end, name, folds)`` of every piece of some bodies of any size."""
    for held in stretches(bodies, length):
        for w, s, e, name, folds in zip(*(column.tolist() for column in cut([b for _, _, b in held], k, length))):
            yield held[w][0], held[w][1] + s, held[w][1] + e, name, folds


def named_texts(docs: DataFrame, length: int) -> DataFrame:
    """``doc, key, n_bytes, names`` of every row: the digest of the whole text and the names of its pieces,
    that of a piece that folds twice."""
    k = levels(length)[0]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            bodies = batch.column("body").to_pylist()
            names: list[list[int]] = [[] for _ in bodies]
            for i, _, _, name, folds in pieces(bodies, k, length):
                names[i] += [name, name] if folds else [name]
            yield pa.record_batch({
                "doc": batch.column("doc"),
                "key": pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary()),
                "n_bytes": pa.array([len(b) for b in bodies], pa.int64()),
                "names": pa.array(names, pa.list_(pa.int64())),
            })

    return docs.mapInArrow(out, "doc long, key binary, n_bytes long, names array<long>")


def common(counted: DataFrame, n: str) -> DataFrame:
    """The rows of ``counted`` whose ``n`` is over one in SHARE of its sum: at most SHARE - 1, however large the table.

    All rows of such a key would meet in one task of a join, so it is broadcast and they stay where they lie.
    """
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]
    return counted.where(F.col(n) * SHARE > total)


def shared_names(named: DataFrame) -> DataFrame:
    """The rows of ``key, name`` whose name has another row."""
    shared = settle(named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "repeats-shared")
    often = F.broadcast(common(shared, "n").select("name"))
    rest = named.join(often, "name", "left_anti").join(shared.select("name"), "name")
    return rest.unionByName(named.join(often, "name", "left_semi"))


def cut_pieces(owners: DataFrame, k: int, length: int) -> DataFrame:
    """The pieces of ``owner, body`` rows; where there is a column ``names``, only pieces of those names."""
    some = "names" in owners.columns

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 200):
            bodies = batch.column("body").to_pylist()
            keys = batch.column("owner").to_pylist()
            wanted = [set(w) for w in batch.column("names").to_pylist()] if some else None
            rows = []
            for i, start, end, name, folds in pieces(bodies, k, length):
                if wanted is None or name in wanted[i]:
                    text = bodies[i][start : end + length - 1]
                    rows.append((name, hashlib.blake2b(text, digest_size=16).digest(), keys[i], start, folds, text))
            yield arrow(rows)

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"name": pa.int64(), "piece": pa.binary(), "owner": pa.binary(), "place": pa.int64(), "folds": pa.bool_(), "body": pa.binary()}
        return pa.record_batch({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(kinds.items())})

    return owners.mapInArrow(out, PIECES)


def batched(groups: Iterator[tuple[pa.Table, np.ndarray]], size: int) -> Iterator[pa.Table]:
    """Tables of whole groups, each of about ``size`` bytes of pieces."""
    for table, starts in groups:
        bytes_of = np.add.reduceat(pc.binary_length(table["body"]).to_numpy(), starts[:-1])
        at = total = 0
        for g, size_of in enumerate(bytes_of.tolist()):
            total += size_of
            if total >= size:
                yield table.slice(at, int(starts[g + 1]) - at)
                at, total = int(starts[g + 1]), 0
        if at < table.num_rows:
            yield table.slice(at)


def ranges_of(starts: np.ndarray) -> list[int]:
    """Ascending starts as ``[first, last, first, last, ...]`` of their runs."""
    if len(starts) == 0:
        return []
    new = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.append(0, new + 1)], starts[np.append(new, len(starts) - 1)]], axis=1).ravel().tolist()


def repeated_windows(merged: DataFrame, length: int) -> DataFrame:
    """``name, piece, ranges``: where in each piece windows start that occur elsewhere; pieces without are left out.

    ``merged`` has ``name, piece, body, folds, twice``; its groups of one name are of bounded size.
    """
    total = merged.agg(F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("n")).first()["n"]
    dealt = merged.repartition(max(1, total // TASK_BYTES), "name").sortWithinPartitions("name")

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batched(whole_groups(batches, ["name"]), BATCH_BYTES):
            names, bodies = table["name"].to_numpy(), table["body"].to_pylist()
            twice = table["twice"].to_pylist()
            alone = np.ones(len(names), dtype=bool)
            alone[1:] &= names[1:] != names[:-1]
            alone[:-1] &= names[1:] != names[:-1]
            searched = np.flatnonzero(~alone | table["folds"].to_numpy())
            found = dict(zip(searched.tolist(), repeated_starts([bodies[i] for i in searched], length))) if len(searched) else {}
            ranges = [[0, len(b) - length] if w else ranges_of(found[i]) if i in found else [] for i, (b, w) in enumerate(zip(bodies, twice))]
            keep = [i for i, r in enumerate(ranges) if r]
            yield pa.record_batch({
                "name": pa.array(names[keep], pa.int64()), "piece": pa.array([table["piece"][i].as_py() for i in keep], pa.binary()),
                "ranges": pa.array([ranges[i] for i in keep], pa.list_(pa.int64())),
            })

    return dealt.mapInArrow(out, "name long, piece binary, ranges array<long>")


def ranges_by_owner(owners: DataFrame, length: int, group: int, depth: int = 0) -> DataFrame:
    """``owner, ranges``: where windows start that occur more than once, ``[first, last, ...]`` in no order."""
    k = levels(length)[depth]
    found = settle(cut_pieces(owners, k, length), f"repeats-pieces-{depth}")
    merged = found.groupBy("name", "piece").agg(F.first("body").alias("body"), F.first("folds").alias("folds"), (F.count("*") > 1).alias("twice"))
    merged = settle(merged, f"repeats-merged-{depth}")
    large = settle(merged.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > group).select("name"), f"repeats-large-{depth}")
    results = repeated_windows(merged.join(large, "name", "left_anti"), length)
    if k < length and large.first() is not None:
        again = merged.join(large, "name", "left_semi")
        again = again.select(F.concat(F.encode(F.hex("name"), "UTF-8"), "piece").alias("owner"), "name", "piece", "body")
        deeper = ranges_by_owner(again.select("owner", "body"), length, group, depth + 1)
        whole = again.join(merged.where("twice").select("name", "piece"), ["name", "piece"], "left_semi")
        results = results.unionByName(deeper.join(again.drop("body"), "owner").select("name", "piece", "ranges")).unionByName(
            whole.select("name", "piece", F.array(F.lit(0).cast("long"), F.length("body").cast("long") - length).alias("ranges"))
        )
    results = settle(results, f"repeats-found-{depth}")
    placed = found.select("name", "piece", "owner", "place").join(results, ["name", "piece"])
    moved = placed.select("owner", F.transform("ranges", lambda r: r + F.col("place")).alias("ranges"))
    return moved.groupBy("owner").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def merge_ranges(ranges: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs ``[from, to)`` of covered bytes, from starts of windows."""
    runs: list[list[int]] = []
    for first, last in sorted(zip(ranges[::2], ranges[1::2])):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last + length)
        else:
            runs.append([first, last + length])
    return [(a, b) for a, b in runs]


def without(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for run in runs for e in run), len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeated_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``doc, n_bytes, n_removed, n_spans, spans, kept_sha256`` of every row.

    ``spans`` are the maximal removed runs ``[from, to, from, to, ...]`` in bytes. A string counts as repeated if it
    starts at any other place: in another row, whatever its id, or elsewhere in the same text. So rows with equal texts
    of ``length`` bytes and more lose them whole. A null text is empty; shorter texts lose nothing. Repeated rows and null
    ids stay, each with its row. Other columns are left behind, whatever their names; an empty table gives none.
    """
    bodies = docs.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    rows = settle(named_texts(bodies, length), "repeats-texts")
    texts = rows.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("copies"), F.first("names").alias("names"))
    texts = settle(texts, "repeats-keys")
    named = texts.select("key", F.explode("names").alias("name"))
    wanted = shared_names(named).groupBy("key").agg(F.collect_set("name").alias("names"))
    digest = F.unhex(F.sha2("body", 256))
    whole = bodies.where(F.length("body") >= length).select(digest.alias("key"), "body").groupBy("key").agg(F.first("body").alias("body"))
    owners = settle(whole.join(wanted, "key").select(F.col("key").alias("owner"), "body", "names"), "repeats-candidates")
    ranges = ranges_by_owner(owners, length, group)
    cuts = settle(apply_ranges(owners.select("owner", "body").join(ranges, "owner"), length), "repeats-cuts")
    texts = texts.select("key", "copies")
    marked = rows.select("doc", "key", "n_bytes").join(F.broadcast(common(texts.where("copies > 1"), "copies")), "key", "left")
    known = F.col("copies").isNotNull() | (F.col("n_bytes") < length)
    out = marked.where(~known).drop("copies").join(texts, "key", "left").join(cuts, "key", "left")
    out = out.unionByName(marked.where(known), allowMissingColumns=True)
    lost = F.col("copies") > 1
    nothing = F.array().cast("array<long>")
    return out.select(
        F.col("doc").alias(doc), "n_bytes",
        F.when(lost, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(lost, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(lost, F.array(F.lit(0).cast("long"), "n_bytes")).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when(lost, EMPTY).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
    )


def apply_ranges(owned: DataFrame, length: int) -> DataFrame:
    """``key, n_removed, n_spans, spans, kept_sha256`` from ``owner, body, ranges``."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            runs = [merge_ranges(r, length) for r in batch.column("ranges").to_pylist()]
            bodies = batch.column("body").to_pylist()
            yield pa.record_batch({
                "key": batch.column("owner"),
                "n_removed": pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                "n_spans": pa.array([len(r) for r in runs], pa.int64()),
                "spans": pa.array([[e for run in r for e in run] for r in runs], pa.list_(pa.int64())),
                "kept_sha256": pa.array([hashlib.sha256(without(b, r)).hexdigest() for b, r in zip(bodies, runs)]),
            })

    return owned.mapInArrow(out, "key binary, n_removed long, n_spans long, spans array<long>, kept_sha256 string")
