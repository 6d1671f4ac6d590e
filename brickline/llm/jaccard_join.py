"""Near-duplicate join of documents by the Jaccard similarity of their word n-grams, with a MinHash LSH forest.

1. Each text becomes the set of its hashed word n-grams. Documents with equal sets are copies; one stands for all.
2. Each tree is a prefix trie over its stretch of the signatures: a branch is the representatives that share a prefix,
   sorted by the rest. The tries are matched at their full depth first, then at prefixes one value shorter at a time,
   until a pair at the threshold shares a branch of some tree with the target probability.
3. Within a branch, signatures are compared; members that look alike are linked to a family by spanning links only.
   A shorter prefix compares only what the longer ones left in different families, and a branch that lies within one
   family is not opened again.
4. Families, components of those links, are verified: every pair of a family is compared exactly on its n-gram sets.
   Rows that come out are sums for each member and spanning links, never the pairs.

A branch or family of any size is cut into blocks of bounded size and each pair of blocks is one group, so no group
is gathered in one task and none is cut short. Signatures are compared far below the threshold (``slack``), so that an
estimate that is off by six standard errors still leads to the exact comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickline.llm.bpe import Kept
from brickline.llm.shared import WORD, components, only, portions, texts_of, whole_groups
from brickline.session import settle

N_GRAM = 5
#: The threshold as a fraction, so that the comparison is one of whole numbers.
THRESHOLD = (4, 5)
TREES = 24
DEPTH = 6
TARGET_RECALL = 0.9999
SLACK = 0.2
#: Members of a branch compared as one block, and n-grams and members of a family's block.
BRANCH_BLOCK = 1024
FAMILY_BLOCK = 256
FAMILY_BLOCK_GRAMS = 1_000_000
_SEED = np.random.Generator(np.random.PCG64(20240229))
_A = _SEED.integers(1, 1 << 63, TREES * DEPTH, np.uint64) | np.uint64(1)
_B = _SEED.integers(0, 1 << 63, TREES * DEPTH, np.uint64)


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Sorted distinct 64-bit hashes of a text's word n-grams; a text with fewer words is one n-gram of them all."""

    def __init__(self, size: int = N_GRAM):
        self.size = size
        self.words = Kept(lambda w: xxhash.xxh3_64_intdigest(w.encode()), 400_000)

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text)
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.size + 1)
        out = np.full(n, min(len(h), self.size), np.uint64)
        for k in range(min(self.size, len(h))):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def signature(grams: np.ndarray) -> np.ndarray:
    """Lowest value of each of the hash functions over the set, cut to 16 bits."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):
        low = np.minimum(low, (grams[at : at + 512, None] * _A + _B).min(0))
    return (low >> np.uint64(48)).astype(">u2")


SKETCH = "doc_id long, mark long, key binary, n_grams int, signature binary"


def sketches(docs: DataFrame, size: int = N_GRAM) -> DataFrame:
    """``doc_id, mark, key, n_grams, signature``; ``mark`` is the text's hash, the key names the n-gram set and is null
    for a text without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of = only(("grams", size), lambda: Grams(size))
        for batch in portions(batches):
            keys, sizes, signatures = [], [], []
            for text in batch["text"].to_pylist():
                grams = grams_of(text)
                sizes.append(len(grams))
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                signatures.append(signature(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["mark"], pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())],
                names=["doc_id", "mark", "key", "n_grams", "signature"],
            )

    return texts_of(docs).withColumn("mark", F.xxhash64("text")).mapInArrow(sketch, SKETCH)


def _block_pairs(df: DataFrame, blocks: Column, member: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: ``i <= j``."""
    df = df.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def _spanning(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect what a symmetric matrix connects: a star for each of its components."""
    waiting = linked.any(1)
    while waiting.any():
        first = int(waiting.argmax())
        reached = np.zeros(len(linked), bool)
        reached[first] = True
        edge = reached
        while edge.any():
            edge = linked[edge].any(0) & ~reached
            reached |= edge
        waiting &= ~reached
        for other in np.flatnonzero(reached):
            if other != first:
                yield first, int(other)


def _binary_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Equally long binary values as rows of bytes."""
    column = column.combine_chunks()
    first = int(np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0])
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, first).reshape(len(column), width)


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Spanning links of each branch's members of different families whose signatures agree in at least that share of
    their values."""
    for table, starts in whole_groups(batches, ["branch", "i", "j"]):
        keys = table["key"].to_pylist()
        marks = _binary_matrix(table["signature"], 2 * TREES * DEPTH).view(np.uint16)
        family = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        block, lower, upper = (table[c].to_numpy() for c in ("block", "i", "j"))
        links: set[tuple[bytes, bytes]] = set()
        sizes = np.diff(starts)
        pair = starts[:-1][sizes == 2]
        pair = pair[family[pair] != family[pair + 1]]
        agree = (marks[pair] == marks[pair + 1]).mean(1) >= least if len(pair) else []
        links.update((keys[k], keys[k + 1]) for k in pair[agree])
        for lo, hi in zip(starts[:-1][sizes > 2], starts[1:][sizes > 2]):
            own = marks[lo:hi]
            linked = np.zeros((hi - lo, hi - lo), bool)
            for r in range(hi - lo):
                others = r + 1 + np.flatnonzero(family[lo + r + 1 : hi] != family[lo + r])
                linked[r, others] = (own[others] == own[r]).mean(1) >= least
            if lower[lo] != upper[lo]:  # pairs inside one block are compared where i = j
                linked &= block[lo:hi, None] != block[None, lo:hi]
            links.update((keys[lo + a], keys[lo + b]) for a, b in _spanning(linked | linked.T))
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _matches(reps: DataFrame, families: DataFrame | None, depth: int, least: float) -> DataFrame:
    """Spanning links ``a, b`` of representatives that share a prefix of that depth in some tree and look alike.

    ``families`` holds ``node, label`` of what longer prefixes have linked; everything else is a family of its own.
    """
    width = 2 * DEPTH
    stretch = lambda t: F.xxhash64(F.lit(t), F.substring("signature", t * width + 1, 2 * depth))
    own = reps.select("key", "signature").withColumn("label", F.col("key"))
    if families is not None:
        own = own.drop("label").join(families.withColumnRenamed("node", "key"), "key", "left")
        own = own.withColumn("label", F.coalesce("label", "key"))
    branches = own.select("key", "label", F.explode(F.array(*(stretch(t) for t in range(TREES)))).alias("branch"))
    shared = branches.groupBy("branch").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    shared = shared.where("low <> high").select("branch", "n")
    members = branches.join(shared, "branch").join(reps.select("key", "signature"), "key")
    members = _block_pairs(members, F.ceil(F.col("n") / BRANCH_BLOCK), "key")
    return (
        members.select("branch", "i", "j", "block", "key", "label", "signature")
        .repartition("branch", "i", "j")
        .sortWithinPartitions("branch", "i", "j", "signature")
        .mapInArrow(lambda it: _alike(it, least), "a binary, b binary")
    )


def _families(reps: DataFrame, threshold: float, least: float) -> DataFrame:
    """``node, label`` of every representative that looks like another one, from the full depth of the tries up."""
    families = None
    for depth in range(DEPTH, prefix_depth(threshold) - 1, -1):
        links = settle(_matches(reps, families, depth, least), "matches")
        if families is not None:
            if links.isEmpty():
                continue
            links = links.unionByName(families.select(F.col("node").alias("a"), F.col("label").alias("b")))
        families = settle(components(links, "families"), "families")
    return families


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets; n-grams that only one set has play no part."""
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    shared = times[place] > 1
    member, place, n = member[shared], column[place[shared]], int((times > 1).sum())
    order = np.argsort(place, kind="stable")
    member, place = member[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, n, 4096):
        a, b = np.searchsorted(place, [lo, min(n, lo + 4096)])
        part = np.zeros((len(sets), min(n, lo + 4096) - lo), np.float32)
        part[member[a:b], place[a:b] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verified(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """For each member of a block pair its exact links; and spanning links, as rows with a ``peer``."""
    num, den = THRESHOLD
    grams_of = only(("grams", size), lambda: Grams(size))
    for table, starts in whole_groups(batches, ["label", "i", "j"]):
        for lo, hi in zip(starts[:-1], starts[1:]):
            part = table.slice(lo, hi - lo)
            seen: dict[bytes, int] = {}
            sets: list[np.ndarray] = []
            rows = []
            for k, (key, text) in enumerate(zip(part["key"].to_pylist(), part["text"].to_pylist())):
                if key not in seen:
                    grams = grams_of(text)
                    if xxhash.xxh3_128_digest(grams.tobytes()) == key:  # rows that share an id but not their text
                        seen[key] = len(sets)
                        sets.append(grams)
                        rows.append(k)
            if len(sets) < 2:
                continue
            block, copies = (part[c].to_numpy()[rows] for c in ("block", "copies"))
            sizes = np.array([len(s) for s in sets], np.int64)
            inner = _overlaps(sets)
            linked = den * inner >= num * (sizes[:, None] + sizes[None, :] - inner)
            np.fill_diagonal(linked, False)
            if part["i"][0] != part["j"][0]:
                linked &= block[:, None] != block[None, :]
            keys = list(seen)
            texts, docs = linked.sum(1), linked @ copies
            found = [(keys[k], None, int(texts[k]), int(docs[k])) for k in np.flatnonzero(texts)]
            found += [(keys[a], keys[b], 0, 0) for a, b in _spanning(linked)]
            if found:
                types = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found), types)], names=["key", "peer", "n_texts", "n_docs"]
                )


def near_duplicates(docs: DataFrame, size: int = N_GRAM) -> DataFrame:
    """``doc_id, class_id, copy_of, n_text_links, n_links`` for every document.

    ``class_id`` is the smallest doc_id that links lead to, ``copy_of`` the smallest doc_id with the same n-gram set.
    ``n_text_links`` counts the other n-gram sets of a similarity of at least the threshold, ``n_links`` the other
    documents, copies included. A text without words (null, empty, blank) is alone. Repeated rows count as copies.
    Words are compared as written. Other columns are left behind, and an empty table gives an empty result.
    """
    return _classes(docs, size).drop("mark", "class_key")


def _classes(docs: DataFrame, size: int) -> DataFrame:
    """The near duplicates with their text's ``mark``, and ``class_key``, which names the class and is null for a text
    without words."""
    num, den = THRESHOLD
    threshold = num / den
    sketched = settle(sketches(docs, size), "sketches")
    reps = (
        sketched.where("key is not null")
        .groupBy("key")
        .agg(F.min(F.struct("doc_id", "n_grams", "signature")).alias("first"), F.count("*").alias("copies"))
        .select("key", "first.*", "copies")
    )
    reps = settle(reps, "representatives")
    families = _families(reps, threshold, threshold - SLACK)
    members = families.withColumnRenamed("node", "key").join(reps.select("key", "doc_id", "n_grams", "copies"), "key")
    sizes = members.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
    members = settle(members.join(sizes, "label"), "family-members")
    blocks = F.greatest(F.ceil(F.col("n") / FAMILY_BLOCK), F.ceil(F.col("grams") / FAMILY_BLOCK_GRAMS))
    texts = texts_of(docs).withColumnRenamed("doc_id", "text_id")
    # Merged at every size: the members grow with the documents, so they are never broadcast.
    with_text = members.hint("merge").join(texts, F.col("doc_id").eqNullSafe(F.col("text_id")))
    with_text = _block_pairs(with_text, blocks, "key")
    found = (
        with_text.select("label", "i", "j", "block", "key", "copies", "text")
        .repartition("label", "i", "j")
        .sortWithinPartitions("label", "i", "j")
        .mapInArrow(lambda it: _verified(it, size), "key binary, peer binary, n_texts long, n_docs long")
    )
    found = settle(found, "links")
    classes = components(found.where("peer is not null").select(F.col("key").alias("a"), F.col("peer").alias("b")), "classes")
    sums = found.where("peer is null").groupBy("key").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    linked = settle(
        classes.withColumnRenamed("node", "key").join(sums, "key").join(reps.select("key", "doc_id"), "key"), "linked"
    )
    lowest = linked.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    by_key = reps.select("key", F.col("doc_id").alias("copy_of"), "copies").join(
        linked.join(lowest, "label").select("key", "label", "class_id", "n_texts", "n_docs"), "key", "left"
    )
    # Written, so that the join below is one of two plain shuffles: Spark splits a key that a third of the documents have.
    by_key = settle(by_key, "by-key")
    alone = F.col("key").isNull()
    return sketched.select("doc_id", "mark", "key").join(by_key, "key", "left").select(
        "doc_id",
        "mark",
        F.coalesce("label", "key").alias("class_key"),
        F.when(alone, F.col("doc_id")).when(F.col("n_texts").isNull(), F.col("copy_of")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_text_links"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the first of their class, with all their columns; of equal rows one stays.

    First is the smallest doc_id, and among different texts of one class that share it the one of the smallest hash.
    Documents without words are in no class, so they all stay. A null doc_id counts as the smallest.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__own_id")
    marked = docs.withColumns({"__own_id": own, "__mark": F.xxhash64(F.coalesce("text", F.lit("")))})
    row = F.struct(own, F.col("mark").alias("__mark"))
    alone = F.when(F.col("class_key").isNull(), row)
    first = _classes(docs, N_GRAM).groupBy("class_key", alone.alias("alone")).agg(F.min(row).alias("first")).select("first.*")
    kept = marked.join(first.hint("merge"), ["__own_id", "__mark"], "left_semi")
    equal = Window.partitionBy("__own_id", "__mark", "text").orderBy(F.lit(0))
    return kept.withColumn("__copy", F.row_number().over(equal)).where("__copy = 1").drop("__own_id", "__mark", "__copy")
