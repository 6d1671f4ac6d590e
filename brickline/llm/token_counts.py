"""Token counts of every prefix of a text, by dynamic programming.

For a piece of bytes ``b``, the encoding of ``b[:i]`` ends in the one token ``t`` that is a suffix of ``b[:i]`` and
that the encoding of ``b[:i - len(t)]`` may be followed by, and two tokens may follow each other exactly when encoding
their joined bytes gives the two back. So one pass over a piece finds the count of each of its prefixes from the count
of a shorter one. The library's pattern cuts a text into pieces; where cutting a text short changes the last pieces (in
white space before a word and in contractions of two letters), the count of those prefixes is taken from the pieces
that the cut text has. The stored counts answer every question about a prefix: its size, or the longest prefix within a
budget, without encoding again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.llm import bpe
from brickline.llm.shared import only, portions, texts_of

# Contractions that the library's pattern keeps whole only when they are complete.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
KEPT_PAIRS = 500_000
KEPT_STATES = 600_000
SHORT_PIECE = 64
# White space as the library sees it: Python counts four control characters too.
LIBRARY_SPACE = re.compile("[^\\S\x1c-\x1f]+")


class PrefixCounter:
    """Counts of tokens at every code point of a text."""

    def __init__(self, path: str):
        self.path, tokenizer = path, bpe.load(path)
        self.split, self.model = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model
        special = bpe.specials(path)
        self.ids = {p for p in tokenizer.get_vocab(with_added_tokens=False) if p not in special}
        ending: dict[str, set[int]] = {}
        for token in self.ids:
            ending.setdefault(token[-2:], set()).add(len(token))
            ending.setdefault(token[-1:], set()).add(len(token))
        #: By a token's last two letters, the lengths that such tokens have, longest first.
        self.ending = {k: sorted(v | {1}, reverse=True) for k, v in ending.items()}
        self.follows: dict[tuple[str, str], bool] = {}
        self.states = bpe.Kept(self._state, KEPT_STATES)
        self.total = bpe.Chunked(path, self._total, sum, lambda i: 1)
        self.totals = bpe.Kept(self._total, bpe.KEPT_CHUNKS // 8)

    def _may_follow(self, left: str, right: str) -> bool:
        found = self.follows.get((left, right))
        if found is None:
            if len(self.follows) >= KEPT_PAIRS:
                self.follows.clear()
            joined = self.model.tokenize(left + right)
            found = self.follows[left, right] = len(joined) == 2 and joined[0].value == left
        return found

    def _state(self, prefix: str) -> tuple[int, str]:
        """Count and last token of a short prefix, from the state of a shorter one; words share their prefixes."""
        ids, size = self.ids, len(prefix)
        for n in self.ending.get(prefix[-2:]) or (1,):
            if n <= size and (token := prefix[size - n :]) in ids:
                if n == size:
                    return 1, token
                count, left = self.states[prefix[: size - n]]
                if self._may_follow(left, token):
                    return count + 1, token
        raise AssertionError("the vocabulary holds every byte, so one token always fits")

    def piece(self, piece: str) -> list[int]:
        """Counts of the prefixes of 0, 1, ... bytes of a piece; its letters stand for bytes."""
        if len(piece) <= SHORT_PIECE:
            return [0, *(self.states[piece[:i]][0] for i in range(1, len(piece) + 1))]
        counts, last = [0], [""]
        for i in range(1, len(piece) + 1):
            for n in self.ending.get(piece[max(0, i - 2) : i]) or (1,):
                if n <= i and (token := piece[i - n : i]) in self.ids and (n == i or self._may_follow(last[i - n], token)):
                    counts.append(counts[i - n] + 1)
                    last.append(token)
                    break
        return counts

    def _total(self, chunk: str) -> int:
        return sum(self.states[p][0] if len(p) <= SHORT_PIECE else self.piece(p)[-1] for p in bpe.pieces(self.path, chunk))

    def chunk(self, chunk: str) -> np.ndarray:
        """Counts of the prefixes of 1, 2, ... code points of a chunk or of any text without special strings."""
        out = np.zeros(len(chunk) + 1, np.int64)
        base = 0
        for piece, (lo, hi) in self.split(chunk):
            counts, text = self.piece(piece), chunk[lo:hi]
            ends = np.cumsum([len(c.encode()) for c in text])
            out[lo + 1 : hi + 1] = base + np.asarray(counts)[ends]
            if text in LONG_CONTRACTIONS:
                out[lo + 2] = base + 2
            base += counts[-1]
        for run in LIBRARY_SPACE.finditer(chunk):
            if run.end() < len(chunk) and len(run.group()) > 1:
                lo, text = run.start(), run.group()
                counts = np.asarray(self.piece(bpe.as_letters(text)))
                out[lo + 1 : run.end() + 1] = out[lo] + counts[np.cumsum([len(c.encode()) for c in text])]
        return out[1:]

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Chunks with their whole counts; a special string has None in place of a count."""
        if not bpe.has_special(self.path, text):
            for c in bpe.chunks(text):
                yield c, self.totals[c]
            return
        for plain, special in bpe.segments(self.path, text):
            for c in bpe.chunks(plain):
                yield c, self.totals[c]
            if special is not None:
                yield special, None

    def prefixes(self, text: str) -> np.ndarray:
        """The count of each prefix of 0, 1, ... code points."""
        out, base, before, at = [np.zeros(1, np.int64)], 0, "", 0
        for part, n in self._parts(text):
            if n is None:  # cut inside, a special string is plain text that goes on from the chunk before it
                inner = self.chunk(before + part)[len(before) :] + at
                inner[-1] = base + 1
                out.append(inner)
                at, base, before = base + 1, base + 1, ""
            else:
                out.append(self.chunk(part) + base)
                at, base, before = base, base + n, part
        return np.concatenate(out)

    def longest_within(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens; only chunks near the budget are opened."""
        base, place, best, before, at = 0, 0, 0, "", 0
        for part, n in self._parts(text):
            if base > budget or base == budget and n is not None:
                break
            whole = base + (1 if n is None else n)
            if n is None:
                inner = np.append(self.chunk(before + part)[len(before) : -1] + at, whole)
            elif whole > budget:
                inner = self.chunk(part) + base
            else:
                inner = None
            if inner is None:
                best = place + len(part)
            elif len(within := np.flatnonzero(inner <= budget)):
                best = place + int(within[-1]) + 1
            at, before = (whole, "") if n is None else (base, part)
            base, place = whole, place + len(part)
        return best


def counter(path: str) -> PrefixCounter:
    return only(("counter", path), lambda: PrefixCounter(path))


def count_tokens(docs: DataFrame, tokenizer: str, budget: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fit_chars`` of every whole text.

    ``fit_chars`` is the number of code points of the longest prefix within the budget. A null text counts as the
    empty one: no bytes, no tokens, nothing over. Repeated rows are counted each; no row needs another.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in portions(batches):
            texts = batch["text"].to_pylist()
            n = [count.total(t) for t in texts]
            fit = [len(t) if k <= budget else count.longest_within(t, budget) for t, k in zip(texts, n)]
            size = pc.binary_length(batch["text"]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], size, pa.array(n, pa.int64()), pa.array([k > budget for k in n], pa.bool_()), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return texts_of(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, counts``: the token count of the prefix of 0, 1, ... code points of every whole text, as one list."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                counts = pa.array([count.prefixes(t).astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), counts], names=["doc_id", "counts"])

    return texts_of(docs).mapInArrow(count, "doc_id long, counts array<int>")


def tokens_of_prefix(counts: Column, n_chars: Column) -> Column:
    """The stored count of a prefix; null beyond the text's end."""
    return F.get(counts, n_chars.cast("int"))


def longest_prefix(counts: Column, budget: int) -> Column:
    """Code points of the longest prefix within a budget, from the stored counts."""
    return F.size(counts) - 1 - F.array_position(F.reverse(F.transform(counts, lambda c: c <= budget)), True).cast("int") + 1
