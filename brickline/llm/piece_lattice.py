"""Sampled SentencePiece segmentations, and their decoding.

All ways to cut a text into pieces of the vocabulary form a lattice. A forward pass sums the weights of all paths to
each place; sampling then goes backward from the end and takes each piece with its share of that sum, which draws a
whole segmentation with exactly its probability. The random numbers are a hash of the row's key, the word's place in
the text and the step, and no share depends on the batches before, so a row's segmentation is the same on any cluster and
in any retry.

Pieces do not reach over the start of a run of blanks, nor over characters outside the vocabulary (those become byte
pieces), so the lattice falls into words; a word's sums are computed once, those of all new words of a batch side by side,
and all places of a batch are sampled side by side. The vocabulary's order stands for frequency: a piece's weight is the
inverse of its rank (Zipf's law), raised to ``1 / temperature``. Decoding joins the pieces' bytes, so it gives back every
text, also one that holds the mark that SentencePiece writes for a blank.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickline.llm.shared import only, texts_of

BLANK_MARK = "▁"
KEPT_NODES = 1_500_000
LONG_WORD = 64
#: Characters of text sampled side by side.
BATCH_CHARS = 1_000_000
#: Words that are still sampled one by one when all others of a batch are done.
FEW_WORDS = 4
_STEP, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(state: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(state + np.asarray(step).astype(np.uint64) * _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Lattice:
    """A vocabulary with byte pieces, and the sampling of segmentations with it."""

    def __init__(self, path: str, temperature: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.prefix = " " if model.encode("a", out_type=str)[0].startswith(BLANK_MARK) else ""
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.piece = {model.id_to_piece(i).replace(BLANK_MARK, " "): i for i in plain}
        first = min(plain)
        self.weight = {p: -math.log(2 + i - first) / temperature for p, i in self.piece.items()}
        #: Every end of a piece, numbered from the shortest up; the empty one is 0.
        self.tails: dict[str, int] = {"": 0}
        for tail in sorted({p[k:] for p in self.piece for k in range(len(p))}, key=len):
            self.tails[tail] = len(self.tails)
        chars = sorted({c for p in self.piece for c in p})
        self.code = np.zeros(ord(chars[-1]) + 1, np.int64)
        self.code[[ord(c) for c in chars]] = np.arange(len(chars))
        #: A tail and the character before it, ascending, and the tail that they make.
        self.longer = np.array([self.tails[t[1:]] * len(chars) + self.code[ord(t[0])] for t in self.tails if t], np.int64)
        self.made = np.argsort(self.longer) + 1
        self.longer, self.chars = np.sort(self.longer), len(chars)
        #: Of a tail that is a piece, its id and weight; other tails have -1.
        self.whole = np.array([self.piece.get(t, -1) for t in self.tails], np.int32)
        self.log = np.array([self.weight.get(t, 0.0) for t in self.tails])
        known = "".join(re.escape(p) for p in self.piece if len(p) == 1 and p != " ")
        self.word = re.compile(f" +[{known}]*|[{known}]+|[^ {known}]")
        self.as_bytes = {i: p.encode() for p, i in self.piece.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        self._clear()

    def _clear(self) -> None:
        """Forget all nodes. Node 0 is the start of every word; a node is a prefix, and words share their prefixes."""
        self.node: dict[str, int] = {}
        self.nodes, self.arrivals = 1, 0
        #: Of each node: log of the sum of all ways to it, the prefix shorter by one, its last character, its first arrival.
        self.sum, self.parent, self.last, self.first = np.zeros(1), np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int32)
        #: Of each arriving piece, those of a node side by side, shortest first: share of the sums up to it, the last 1;
        #: node before it; piece.
        self.share, self.before, self.taken = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _room(self, nodes: int, arrivals: int) -> tuple[slice, slice]:
        """Room for new nodes and arriving pieces."""
        new = slice(self.nodes, self.nodes + nodes), slice(self.arrivals, self.arrivals + arrivals)
        for names, to in ((("sum", "parent", "last", "first"), new[0].stop), (("share", "before", "taken"), new[1].stop)):
            for name in names:
                if len(held := getattr(self, name)) < to:
                    setattr(self, name, np.concatenate([held, np.zeros(max(to, 2 * len(held)) - len(held), held.dtype)]))
        self.nodes, self.arrivals = new[0].stop, new[1].stop
        return new

    def _add(self, words: list[str]) -> dict[str, int]:
        """Nodes for all new prefixes of some words; returns the ends of those that are not kept by name.

        Prefixes up to ``LONG_WORD`` are kept by name, so only new ones are computed; a longer word has nodes of its own.
        """
        known, new, longs = self.node, self.nodes, {}
        rests, tops, sizes = [], [], []
        odd = [w for w in words if len(w) == 1 and w not in self.piece]
        for word in words:
            size = done = len(word)
            if size == 1 and word not in self.piece:
                continue
            if size > LONG_WORD:
                done = 0
                longs[word] = new + size - 1
            while done and word[:done] not in known:
                done -= 1
            if done == size:
                continue
            rests.append(word[done:])
            tops.append(known[word[:done]] if done else 0)
            sizes.append(done)
            if size <= LONG_WORD:
                for end in range(done + 1, size + 1):
                    known[word[:end]] = new
                    new += 1
            else:
                new += size
        if rests:
            self._extend(rests, np.array(tops), np.array(sizes))
        for word in odd:
            ids = [self.byte_ids[b] for b in word.encode()]
            at, arrivals = self._room(len(ids), len(ids))
            self.first[at] = np.arange(arrivals.start, arrivals.stop)
            self.share[arrivals], self.taken[arrivals] = 1.0, ids
            self.before[arrivals] = np.append(0, np.arange(at.start, at.stop - 1))
            known[word] = at.stop - 1
        return longs

    def _extend(self, rests: list[str], tops: np.ndarray, sizes: np.ndarray) -> None:
        """A chain of nodes for each rest, below the node ``top`` of that many characters; all summed side by side.

        From every new node the tails are followed back, a character a step, as far as a piece can reach; that gives the
        arriving pieces. Their sums then go from the shortest prefixes up.
        """
        lengths = np.array([len(r) for r in rests])
        begins, n, old = np.cumsum(lengths) - lengths, int(lengths.sum()), self.nodes
        nodes, _ = self._room(n, 0)
        self.parent[nodes] = np.arange(old - 1, old + n - 1)
        self.parent[old + begins] = tops
        self.last[nodes] = self.code[np.frombuffer("".join(rests).encode("utf-32-le"), "<u4")]
        depth = np.arange(n) + np.repeat(sizes - begins, lengths)
        by_depth = np.argsort(depth, kind="stable")
        # From here on new nodes are counted by depth.
        depth, ids = depth[by_depth], old + by_depth
        place, at, tail = np.arange(n), ids, np.zeros(n, np.int64)
        places, befores, tails = [], [], []
        while len(place):
            key = tail * self.chars + self.last[at]
            found = np.minimum(np.searchsorted(self.longer, key), len(self.longer) - 1)
            reached = self.longer[found] == key
            place, at, tail = place[reached], self.parent[at[reached]], self.made[found[reached]]
            piece = self.whole[tail] >= 0
            places.append(place[piece])
            befores.append(at[piece])
            tails.append(tail[piece])
            inner = at > 0
            place, at, tail = place[inner], at[inner], tail[inner]
        place = np.concatenate(places)
        order = np.argsort(place, kind="stable")
        before, tail = np.concatenate(befores)[order], np.concatenate(tails)[order]
        counts = np.bincount(place, minlength=n)
        starts = np.append(0, np.cumsum(counts))
        _, arrivals = self._room(0, len(place))
        self.first[ids] = arrivals.start + starts[:-1]
        self.before[arrivals], self.taken[arrivals] = before, self.whole[tail]
        share, logs, sums, totals = self.share[arrivals], self.log[tail], self.sum, np.empty(n)
        levels = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [n]])
        own = starts[:-1] - starts[levels[:-1]].repeat(np.diff(levels))
        bounds = list(zip(levels.tolist(), starts[levels].tolist()))
        for (lo, a), (hi, b) in zip(bounds, bounds[1:]):
            begin, through = own[lo:hi], sums[before[a:b]] + logs[a:b]
            top, size = np.maximum.reduceat(through, begin), counts[lo:hi]
            through -= top if hi - lo == 1 else top.repeat(size)
            share[a:b] = parts = np.exp(through)
            totals[lo:hi] = total = np.add.reduceat(parts, begin)
            sums[ids[lo:hi]] = top + np.log(total)
        share /= np.repeat(totals, counts)
        for k in range(1, int(counts.max())):
            at = starts[:-1][counts > k] + k
            share[at] += share[at - 1]
        share[starts[1:] - 1] = 1.0

    def sample(self, texts: list[str], keys: np.ndarray, seed: int = 0) -> list[np.ndarray]:
        """A segmentation of each text; ``keys`` are the rows' keys."""
        if self.nodes > KEPT_NODES:
            self._clear()
        listed = [self.word.findall(self.prefix + t) if t else [] for t in texts]
        words, known = set().union(*listed), self.node
        if not words:
            return [np.zeros(0, np.int32) for _ in texts]
        longs = self._add([w for w in words if w not in known])
        ends = {w: longs[w] if w in longs else known[w] for w in words}
        node = np.fromiter(map(ends.__getitem__, chain.from_iterable(listed)), np.int64)
        per_text = np.array([len(words) for words in listed])
        within = np.arange(len(node)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        with np.errstate(over="ignore"):
            base = _mixed(keys.astype(np.uint64) + np.uint64(seed) * _WORD)
            state = _mixed(np.repeat(base, per_text) + within.astype(np.uint64) * _WORD)
        alive = np.arange(len(node))
        steps, drawn, step = np.zeros(len(node), np.int64), [], 0
        while len(alive) > FEW_WORDS:
            draw = _draws(state[alive], step)
            at = self.first[node[alive]]
            beyond = np.flatnonzero(self.share[at] <= draw)
            while len(beyond):
                at[beyond] += 1
                beyond = beyond[self.share[at[beyond]] <= draw[beyond]]
            drawn.append((alive, self.taken[at]))
            steps[alive] += 1
            node[alive] = self.before[at]
            alive = alive[node[alive] > 0]
            step += 1
        rest = {i: self._walk(int(node[i]), state[i], step) for i in alive.tolist()}
        for i, found in rest.items():
            steps[i] += len(found)
        last = np.cumsum(steps)
        out = np.empty(int(last[-1]), np.int32)
        for k, (which, found) in enumerate(drawn):
            out[last[which] - 1 - k] = found
        for i, found in rest.items():
            out[last[i] - steps[i] : last[i] - step] = found[::-1]
        bounds = np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), per_text), steps, len(texts))).astype(np.int64)
        return np.split(out, bounds[:-1])

    def _walk(self, node: int, state: np.uint64, step: int) -> list[int]:
        """The pieces from a node back to the start of its word, drawn one by one: for the few words that outlast the others."""
        first, share, before, taken, found = self.first, self.share, self.before, self.taken, []
        while node:
            for draw in _draws(state, np.arange(step, step + 64)).tolist():
                at = int(first[node])
                while share[at] <= draw:
                    at += 1
                found.append(int(taken[at]))
                node = int(before[at])
                if not node:
                    break
            step += 64
        return found

    def decode(self, ids) -> str:
        text = b"".join([self.as_bytes[i] for i in ids]).decode()
        return text.removeprefix(self.prefix)


def lattice(path: str, temperature: float = 1.0) -> Lattice:
    return only(("lattice", path, temperature), lambda: Lattice(path, temperature))


def _sampled(batch: pa.RecordBatch, held: Lattice, seed: int) -> Iterator[tuple[int, list[str], list[np.ndarray]]]:
    """Rows of a batch in portions of about ``BATCH_CHARS``: the first row, the texts, the ids."""
    texts, keys = batch["text"].to_pylist(), np.asarray(batch["doc_id"].fill_null(0)).astype(np.int64)
    lo, size = 0, 0
    for hi, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_CHARS or hi + 1 == len(texts):
            yield lo, texts[lo : hi + 1], held.sample(texts[lo : hi + 1], keys[lo : hi + 1], seed)
            lo, size = hi + 1, 0


def encode(docs: DataFrame, model: str, seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """``doc_id, ids`` of a sampled segmentation of every whole text.

    A null text counts as the empty one and has no ids. Rows with equal doc_id and text get equal ids; a null doc_id
    is seeded as 0. Other columns are left behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lattice(model, temperature)
        for batch in batches:
            for lo, texts, ids in _sampled(batch, held, seed):
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, len(texts)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; no ids, or a null list, are the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lattice(model)
        for batch in batches:
            texts = [held.decode(ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, lossless boolean"


def encode_digest(docs: DataFrame, model: str, seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """Per document the size of its sampled ids, their crc32 as little-endian 32-bit integers, and whether decoding them
    gives the text back. As ``encode`` and ``decode`` in one pass, without moving the ids out of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lattice(model, temperature)
        for batch in batches:
            for lo, texts, ids in _sampled(batch, held, seed):
                columns = [
                    batch["doc_id"].slice(lo, len(texts)),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([held.decode(x.tolist()) == t for t, x in zip(texts, ids)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in DIGEST.split(", ")])

    return texts_of(docs).mapInArrow(run, DIGEST)
