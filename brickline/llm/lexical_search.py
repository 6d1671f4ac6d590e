"""Exact ranked lexical search by sequential reads of impact-sorted lists (NRA), in shards of documents.

Spark reads the texts once and keeps, of each document, its length and how often it holds the terms that some item
asks for. Corpus counts come from that table. Then each task takes its documents in shards of bounded size. In a shard
every asked term has a list of its documents, highest impact first. All lists of an item are read block by block; each
document has a lower bound, what has been read of it, and an upper bound, which adds for every list not yet seen to
hold it the highest impact still unread there. Reading ends when no unread document and no other document can reach
the last rank and every document that can has an exact score, so that ties are settled. The best of a shard raise the
bound at which the next shard of the task gives up; Spark keeps the best of all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickline.llm.shared import portions
from brickline.session import settle

# Weights in thousandths, k1 = 0.8 and b = 0.9.
SCALE, PARTS, K1, B = 1000, 1_000_000_000, 8, 90
# Documents of a shard, and list entries that a shard holds at most (one document may hold more).
SHARD_DOCS, SHARD_ENTRIES = 1 << 15, 4_000_000
# First block of a list; each further block is as many times longer than all before it.
FIRST, GROWTH = 256, 4
# Different terms that one pass over the documents looks for; more items are searched in further passes.
BLOCK_TERMS = 500_000

# Bytes that end a term become blanks, capital letters of ASCII become small ones; bytes above 0x7F belong to terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def item_blocks(items: DataFrame, item: str, text: str, bound: int) -> Iterator[tuple[list[tuple[int, list[int]]], dict[bytes, int]]]:
    """Blocks of distinct items, ``[(item_id, term numbers)]`` with the numbers of their terms; no block holds more
    than ``bound`` different terms, but for an item that has more by itself."""
    block: list[tuple[int, list[int]]] = []
    numbers: dict[bytes, int] = {}
    for row in items.select(F.col(item).cast("long"), F.col(text)).distinct().toLocalIterator(prefetchPartitions=False):
        asked = sorted(set(terms(row[1])))
        new = sum(t not in numbers for t in asked)
        if block and len(numbers) + new > bound:
            yield block, numbers
            block, numbers = [], {}
        block.append((row[0], [numbers.setdefault(t, len(numbers)) for t in asked]))
    if block:
        yield block, numbers


def term_counts(docs: DataFrame, doc: str, text: str, numbers: dict[bytes, int]) -> DataFrame:
    """``doc, n, terms, counts`` of every document with a term: its length, and the asked terms it holds."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids, lengths, found, counts = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words := terms(t):
                    held = Counter(map(numbers.get, words))
                    held.pop(None, None)
                    ids.append(i)
                    lengths.append(len(words))
                    found.append(list(held))
                    counts.append(list(held.values()))
            yield pa.record_batch({
                "doc": pa.array(ids, pa.int64()), "n": pa.array(lengths, pa.int64()),
                "terms": pa.array(found, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int32())),
            })

    texts = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("text is not null")
    return texts.mapInArrow(out, "doc long, n long, terms array<int>, counts array<int>")


def weights(counted: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """``floor(1000 ln((2 N + 2) / (2 df + 1)))`` of each asked term."""
    df = np.zeros(size, dtype=np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    return np.array([math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.tolist()], dtype=np.int64)


class Shard:
    """Some documents, and each asked term's list of them by falling impact."""

    def __init__(self, ids: list, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        m = 100 - B + (B * n * n_docs) // n_terms
        impact = weight[term] * ((PARTS * tf) // (SCALE * tf + K1 * m[row]))
        order = np.lexsort((-impact, term))
        self.row, self.impact = row[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(weight) + 1))

    def search(self, asked: list[int], k: int, known: list[int]) -> tuple[list[tuple[int, int]], int]:
        """``(score, row)`` of every document of the shard that may be among the best ``k``, given the scores
        ``known`` of other shards' best; and how many list entries were read."""
        lists = [(self.starts[t], self.starts[t + 1]) for t in asked if self.starts[t + 1] > self.starts[t]]
        lower = np.zeros(len(self.ids), dtype=np.int64)
        done, depth, read = 0, FIRST, 0
        known_scores = np.array(known, dtype=np.int64)
        while True:
            seen = np.zeros(len(self.ids), dtype=np.int64)
            unread = 0
            for lo, hi in lists:
                a, b = min(lo + done, hi), min(lo + depth, hi)
                lower[self.row[a:b]] += self.impact[a:b]
                read += b - a
                if b < hi:
                    unread += self.impact[b]
                    seen[self.row[lo:b]] += self.impact[b]
            touched = np.flatnonzero(lower)
            best = np.concatenate([known_scores, lower[touched]])
            least = int(np.partition(best, len(best) - k)[len(best) - k]) if len(best) >= k else 0
            if unread == 0:
                rows = touched[lower[touched] >= least]
                break
            if unread < least:
                # What may still come to a document is what is unread in the lists that have not shown it.
                rows = touched[lower[touched] + (unread - seen[touched]) >= least]
                if (seen[rows] == unread).all():
                    break
            done, depth = depth, depth * GROWTH
        return [(int(lower[r]), int(r)) for r in rows], read


def shards(batches: Iterator[pa.RecordBatch], weight: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Shard]:
    """The documents of a task in shards of bounded size."""
    held: list[tuple] = []
    docs = entries = 0

    def build() -> Shard:
        ids, n, sizes, term, tf = zip(*held)
        rows = np.repeat(np.arange(docs), np.concatenate(sizes))
        return Shard([i for part in ids for i in part], np.concatenate(n), rows, np.concatenate(term), np.concatenate(tf), weight, n_docs, n_terms)

    for batch in portions(batches, 2000):
        if batch.num_rows == 0:
            continue
        lists, counts = batch.column("terms"), batch.column("counts")
        sizes = np.diff(lists.offsets.to_numpy())
        if held and (docs + batch.num_rows > SHARD_DOCS or entries + int(sizes.sum()) > SHARD_ENTRIES):
            yield build()
            held, docs, entries = [], 0, 0
        held.append((
            batch.column("doc").to_pylist(), batch.column("n").to_numpy(), sizes,
            lists.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64),
        ))
        docs, entries = docs + batch.num_rows, entries + int(sizes.sum())
    if held:
        yield build()


def best_of(found: list[tuple[int, int | None]], k: int) -> list[tuple[int, int | None]]:
    """The first ``k`` of ``(score, doc)``: by falling score, then by id, null ids last."""
    return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]


def search_block(counted: DataFrame, block: list[tuple[int, list[int]]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``no, item, doc, score``: every task's best documents of each item."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int | None]]] = [[] for _ in block]
        for shard in shards(batches, weight, n_docs, n_terms):
            for at, (_, asked) in enumerate(block):
                found, _ = shard.search(asked, k, [score for score, _ in best[at]])
                best[at] = best_of(best[at] + [(score, shard.ids[row]) for score, row in found], k)
        rows = [(at, block[at][0], doc, score) for at, found in enumerate(best) for score, doc in found]
        names = ("no", "item", "doc", "score")
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(zip(names, kinds))})

    return counted.mapInArrow(out, "no int, item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item, rank, doc, score``: each item's ``k`` best documents with a score above 0, equal scores by ascending id.

    A null or empty text, of an item or a document, has no term: such a document isn't counted, such an item has no
    rows. Every row of ``docs`` is a document of its own, so repeated rows take a rank each, and null ids come last
    among equal scores. Equal rows of ``items`` are one item; a repeated item id with another text is ranked apart. Texts
    count whole, however long. Other columns are left behind, whatever their names. Empty tables give no rows.
    """
    spark = docs.sparkSession
    ranked: DataFrame | None = None
    for block, numbers in item_blocks(items, item, "text", block_terms):
        counted = settle(term_counts(docs, doc, text, numbers), "lexical-counts")
        totals = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        if totals["n"] == 0:
            break
        found = search_block(counted, block, weights(counted, totals["n"], len(numbers)), totals["n"], totals["l"], k)
        order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = top.select(F.col("item").alias(item), "rank", F.col("doc").alias(doc), "score")
        ranked = top if ranked is None else ranked.unionByName(top)
    return ranked if ranked is not None else spark.createDataFrame([], f"`{item}` long, rank int, `{doc}` long, score long")
