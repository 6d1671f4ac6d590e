"""Best-fit packing of documents into training sequences of several permitted lengths.

Pieces are placed from the longest down, each into the open bin that it leaves the least room in. Where none has room,
a bin is opened, and the permitted lengths are weighed against each other by what each could hold: the piece, and of
the pieces still to be placed that no open bin counts on, always the longest that fits. The length of the least cost
per token wins, where a sequence costs its length and a fixed part, and the bin counts on those pieces from then on; so
a large bin is opened while there is something to fill it with, and a smaller one where the pieces left would leave it
half empty. At the end every bin takes the smallest permitted length that holds what is in it. Documents longer than
the largest length are cut into pieces of it.

Pieces are numbered over the whole table by doc_id and packed in windows of consecutive numbers, so memory and the work
of a task are bounded, windows are independent, and partitions change nothing. A window of thousands of pieces leaves
few bins unfilled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickline.session import settle

CAPACITIES = (512, 1024, 2048, 4096)
#: Tokens that a sequence costs beside its length.
SEQUENCE_COST = 32
WINDOW = 8192
PACKED = "doc_id long, piece long, start long, length long, window long, bin long, offset long, capacity long, used long"


class _Room:
    """Open bins by free space, and among equal ones the one opened last."""

    def __init__(self):
        self.sizes: list[int] = []
        self.bins: dict[int, list[int]] = {}

    def put(self, free: int, number: int) -> None:
        if free:
            if free not in self.bins:
                insort(self.sizes, free)
                self.bins[free] = []
            self.bins[free].append(number)

    def take(self, length: int) -> tuple[int, int] | None:
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        free = self.sizes[at]
        number = self.bins[free].pop()
        if not self.bins[free]:
            del self.bins[free], self.sizes[at]
        return free, number


def filled(pool: list[int], room: int) -> tuple[int, list[int]]:
    """What a room would hold of an ascending pool of lengths, always the longest that fits: tokens and places, descending."""
    total, places, end = 0, [], len(pool)
    while room:
        end = bisect_right(pool, room, 0, end) - 1
        if end < 0:
            break
        places.append(end)
        total += pool[end]
        room -= pool[end]
    return total, places


def opened(length: int, pool: list[int], capacities: tuple[int, ...], cost: int) -> tuple[int, list[int]]:
    """The permitted capacity of the least cost per token with what it would hold, and the places of that in the pool.

    A sequence costs the capacity that its contents need in the end, and ``cost``. Ties go to the smaller capacity.
    """
    best = None
    for capacity in capacities:
        if capacity >= length:
            total, places = filled(pool, capacity - length)
            size = capacities[bisect_left(capacities, length + total)]
            each = (size + cost) / (length + total)
            if best is None or each < best[0]:
                best = each, capacity, places
    return best[1:]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: int = SEQUENCE_COST) -> tuple[list[int], list[int], list[int], list[int]]:
    """For pieces no longer than the largest capacity: each piece's bin and offset; each bin's capacity and contents.

    Equal lengths are placed in the order given. Pieces of no length lie at the start of the first bin, or in a bin
    of their own of the smallest capacity where there is nothing else.
    """
    capacities = tuple(sorted(capacities))
    room, bins, offsets = _Room(), [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    pool = sorted(n for n in lengths if n)
    counted: Counter[int] = Counter()  # pieces still to be placed that an open bin counts on, by length
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        length = lengths[k]
        if length == 0:
            if not used:
                used.append(0)
            continue
        if counted[length]:
            counted[length] -= 1
        else:
            pool.pop()
        found = room.take(length)
        if found is None:
            capacity, places = opened(length, pool, capacities, cost)
            for place in places:
                counted[pool.pop(place)] += 1
            found = capacity, len(used)
            used.append(0)
        free, number = found
        bins[k], offsets[k] = number, used[number]
        used[number] += length
        room.put(free - length, number)
    return bins, offsets, [capacities[bisect_left(capacities, n)] for n in used], used


def numbered(lengths: DataFrame, largest: int) -> DataFrame:
    """``doc_id, n_tokens, start, pieces``: rows counted once each, with the number of the first of their pieces.

    Numbers ascend by (doc_id, n_tokens) over the whole table: two prefix sums, over ranges of it, one row each, and
    inside each range. Equal rows are one row with the pieces of all, however many there are.
    """
    rows = lengths.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"),
    )
    rows = rows.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("pieces", F.expr(f"copies * greatest(1, (n_tokens + {largest - 1}) div {largest})")).drop("copies")
    rows = settle(rows, "lengths")  # sampling for the ranges would compute them twice
    ranges = settle(rows.repartitionByRange("doc_id", "n_tokens").withColumn("range", F.spark_partition_id()), "length-ranges")
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("range").agg(F.sum("pieces").alias("n"))
    bases = sums.select("range", F.coalesce(F.sum("n").over(before(Window.orderBy("range"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("pieces").over(before(Window.partitionBy("range").orderBy("doc_id", "n_tokens"))), F.lit(0))
    return ranges.withColumn("inside", inside).join(bases, "range").selectExpr("doc_id", "n_tokens", "base + inside as start", "pieces")


def pack_documents(
    lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: int = SEQUENCE_COST, window: int = WINDOW
) -> DataFrame:
    """Where every token of ``doc_id, n_tokens`` lies: one row per piece of a document (columns in ``PACKED``).

    ``start`` and ``length`` are the piece's tokens in the document, ``offset`` its place in the bin, ``window, bin``
    name the bin. A null or negative length counts as 0 and gives one piece of no tokens. Null doc_ids sort first;
    repeated rows are packed each. An empty table gives an empty result, other columns are left behind, and a document
    of any length is cut inside the windows that its pieces fall in. Only the numbers of each row are shuffled.
    """
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]

    def packed(rows: pa.Table) -> pa.Table:
        held, number = [], rows["window"][0].as_py()
        lo, hi = number * window, (number + 1) * window
        for doc, n, start, pieces in sorted(zip(*(rows[c].to_pylist() for c in ("doc_id", "n_tokens", "start", "pieces"))), key=lambda r: r[2]):
            each = max(1, -(-n // largest))
            for k in range(max(lo, start) - start, min(hi, start + pieces) - start):
                at = k % each * largest
                held.append((doc, k % each, at, min(largest, n - at)))
        bins, offsets, size, used = pack([p[3] for p in held], capacities, cost)
        columns = [*zip(*held), [number] * len(held), bins, offsets, [size[b] for b in bins], [used[b] for b in bins]]
        return pa.table({f.split()[0]: pa.array(c, pa.int64()) for f, c in zip(PACKED.split(", "), columns)})

    touched = F.explode(F.expr(f"sequence(start div {window}, (start + pieces - 1) div {window})"))
    return numbered(lengths, largest).withColumn("window", touched).groupBy("window").applyInArrow(packed, PACKED)
