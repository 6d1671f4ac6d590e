"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages; only the bag has a label. Every passage is encoded by the shapes of its characters
and words. A gated attention, learned from the bags' labels alone, weighs the passages, and the weighted passage
representation is scored. So a few bad passages can decide, and the weights tell which ones did.

The network is fitted on a bounded sample of the labelled documents: of ``sample`` rows in the order of a hash of doc_id
those whose bags fit into ``sample_passages`` passages together, each with all its passages. A row whose bag no longer
fits, or would take over a sixteenth of them, is not learned from. Every passage of every document is scored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.llm.shared import WORD, held_out
from brickline.session import settle

PASSAGE_WORDS = 64
SHAPE_BUCKETS = 96
WORD_FEATURES = 8
FEATURES = SHAPE_BUCKETS + WORD_FEATURES
HIDDEN = 24
SAMPLE = 6_000
SAMPLE_PASSAGES = 160_000

# Character shapes: small letter, capital, other letter, digit, blank, line end, and the marks one by one or in kinds.
_KINDS = 24
_MARKS = {c: 6 + k for k, c in enumerate("#*$%&|<>.,!?;:-_/")}


def _shape_table() -> np.ndarray:
    table = np.full(0x250, 23, np.uint16)
    for code in range(len(table)):
        c = chr(code)
        if c in _MARKS:
            table[code] = _MARKS[c]
        elif c == "\n":
            table[code] = 5
        elif c.isspace():
            table[code] = 4
        elif c.isdigit():
            table[code] = 3
        elif c.isupper():
            table[code] = 1
        elif c.isalpha():
            table[code] = 0
    return table


_SHAPES = _shape_table()
_BUCKET = np.array([zlib.crc32(k.to_bytes(4, "little")) % SHAPE_BUCKETS for k in range(_KINDS**3)], np.int64)


def encode_passages(text: str) -> np.ndarray:
    """One row of ``FEATURES`` values for each passage of ``PASSAGE_WORDS`` words; at least one row."""
    spans = [m.span() for m in WORD.finditer(text)]
    if not spans:
        return np.zeros((1, FEATURES), np.float32)
    bounds = np.array(spans, np.int64)
    words = [text[a:b] for a, b in spans]
    passage = np.arange(len(words)) // PASSAGE_WORDS
    n = int(passage[-1]) + 1
    size = np.bincount(passage, minlength=n).astype(np.float64)

    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    shapes = np.where(codes < len(_SHAPES), _SHAPES[np.minimum(codes, len(_SHAPES) - 1)], 2).astype(np.int64)
    chars_to = np.append(bounds[PASSAGE_WORDS::PASSAGE_WORDS, 0], len(codes))
    at = np.searchsorted(chars_to, np.arange(len(codes)), side="right").clip(max=n - 1)
    rows = np.zeros((n, FEATURES))
    if len(shapes) > 2:
        bucket = _BUCKET[(shapes[:-2] * _KINDS + shapes[1:-1]) * _KINDS + shapes[2:]]
        shares = np.bincount(at[:-2] * SHAPE_BUCKETS + bucket, minlength=n * SHAPE_BUCKETS).reshape(n, SHAPE_BUCKETS)
        rows[:, :SHAPE_BUCKETS] = np.sqrt(shares / np.maximum(1, shares.sum(1, keepdims=True)))

    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    length = bounds[:, 1] - bounds[:, 0]
    same = np.zeros(len(ids))
    same[1:] = ids[1:] == ids[:-1]
    again = np.zeros(len(ids))
    if len(ids) > 3:
        _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, found, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        again[: len(found)] = times[found] > 1
    first = np.zeros(len(ids))
    first[np.unique(ids, return_index=True)[1]] = 1
    by_word = (length / 10, (length / 10) ** 2, same, again, first, length > 15, length < 3, np.ones(len(ids)))
    for k, values in enumerate(by_word):
        rows[:, SHAPE_BUCKETS + k] = np.bincount(passage, np.asarray(values, np.float64), n) / size
    rows[:, FEATURES - 1] = np.log1p(len(words)) / 10
    return rows.astype(np.float32)


def whole_bags(sizes: list[int], most: int) -> list[int]:
    """Places of the bags that fit together into ``most`` passages, in the order given, none over a sixteenth of it."""
    places, total = [], 0
    for place, size in enumerate(sizes):
        if size <= max(1, most // 16) and total + size <= most:
            places.append(place)
            total += size
    return places


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Gated attention over passages: ``h = tanh(xA)``, weights from ``w (tanh(hV) * sigmoid(hU))``, score of the mean."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        make = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"A": make(FEATURES, HIDDEN), "V": make(HIDDEN, HIDDEN), "U": make(HIDDEN, HIDDEN), "w": make(HIDDEN), "c": make(HIDDEN), "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.constant: float | None = None

    def _forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
        p = self.p
        h = np.tanh(x @ p["A"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, e)
        a = np.exp(e - top[bag])
        a /= np.bincount(bag, a, n)[bag]
        z = np.zeros((n, HIDDEN))
        np.add.at(z, bag, a[:, None] * h)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["b"])}

    def _gradients(self, x: np.ndarray, bag: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, bag, len(label))
        dy = (f["y"] - label) * weight
        dz = dy[:, None] * p["c"]
        da = (dz[bag] * f["h"]).sum(1)
        de = f["a"] * (da - np.bincount(bag, f["a"] * da, len(label))[bag])
        gate = de[:, None] * p["w"]
        dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
        return {
            "A": x.T @ (dh * (1 - f["h"] ** 2)), "V": f["h"].T @ dv, "U": f["h"].T @ du,
            "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ dy, "b": np.array([dy.sum()]),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, rounds: int = 30, batch: int = 128, rate: float = 0.01) -> AttentionModel:
        """Adam over shuffled batches, the two labels weighing the same. One label or none gives a constant score."""
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels[0]) if len(labels) else 0.5
            return self
        stacked = np.concatenate(bags).astype(np.float64)
        self.mean, self.scale = stacked.mean(0), stacked.std(0) + 1e-3
        bags = [(b - self.mean) / self.scale for b in bags]
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        rng, step = np.random.default_rng(11), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(rounds):
            for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
                step += 1
                x = np.concatenate([bags[k] for k in part])
                bag = np.repeat(np.arange(len(part)), [len(bags[k]) for k in part])
                for k, g in self._gradients(x, bag, labels[part], weight[part] / len(part)).items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None or not bags:
            return np.full(len(bags), self.constant if self.constant is not None else 0.5)
        x = (np.concatenate(bags) - self.mean) / self.scale
        return self._forward(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags))["y"]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_passages: int = SAMPLE_PASSAGES) -> AttentionModel:
    """Fit on a bounded sample of the labelled documents that may be learned from.

    Null labels are left out; labels that differ for one document count by their majority, a tie as 1. Of rows that share
    an id, the text with the lowest hash is learned from, a null one only where there is no other.
    """
    known = labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [encode_passages(t or "") for t in batch["text"].to_pylist()]
            columns = [pa.array([len(b) for b in bags], pa.int64()), pa.array([b.tobytes() for b in bags], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["quality"], *columns], names=["id", "quality", "n", "bag"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    order = F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")
    texts = texts.groupBy("id", "quality").agg(F.min_by("text", order).alias("text"))
    encoded = settle(texts.select("id", "quality", "text").mapInArrow(encode, "id long, quality int, n long, bag binary"), "quality-bags")
    sizes = encoded.select("id", "n").orderBy(F.xxhash64("id"), "id").collect()
    taken = [(sizes[k]["id"],) for k in whole_bags([r["n"] for r in sizes], sample_passages)]
    rows = encoded.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "id long")), "id").collect()
    rows = sorted(rows, key=lambda r: r["id"])
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    return AttentionModel().fit(bags, np.array([r["quality"] for r in rows], np.float64))


def score_documents(docs: DataFrame, labels: DataFrame, model: AttentionModel | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    A null or empty text is a bag of one empty passage. Without labels every score is 0.5. Each row stands alone,
    repeated rows alike; other columns are left behind.
    """
    model = model or learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = shared.value.score([encode_passages(t or "") for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
