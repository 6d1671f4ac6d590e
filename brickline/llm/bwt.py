"""Repeated strings of a least length in a bounded batch, by a Burrows-Wheeler transform.

The batch's strings stand one after another, each with an end mark of its own. Suffixes are ordered to a depth of the
least length; the transform gives the letter before each. Breadth-first backward extension then finds, length by length,
where neighbouring suffixes stop being alike: an interval of suffixes that begin with a string is extended by each letter
before it, and the end of each new interval that was not known yet is a common prefix of just that length. An interval
whose end was known is dropped, so each boundary is found once. Extension stops at the least length: boundaries not
found by then lie between suffixes that have at least that much in common.
"""

from __future__ import annotations

import numpy as np

# Symbols that fit a 63-bit key: nine bits each, 0 for an end mark and 1 + byte otherwise.
PACKED, BITS = 7, 9


def suffix_order(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the ``depth`` symbols from there on; end marks differ from each other, earlier ones first.

    Prefix doubling: only suffixes still alike are sorted again, by the order of what follows.
    """
    n = len(symbols)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    key = np.zeros(n, dtype=np.int64)
    for k in range(PACKED):
        key <<= BITS
        if k < n:
            key[: n - k] |= np.where(to_end[: n - k] >= k, symbols[k:], 0)
    order = np.argsort(key)
    ended = to_end[order] < PACKED
    last = order[ended]
    order[ended] = last[np.lexsort((last, key[last]))]
    ordered = key[order]
    head = np.ones(n, dtype=bool)
    head[1:] = (ordered[1:] != ordered[:-1]) | ended[1:]
    rank = np.empty(n, dtype=np.int64)
    slots = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
    length = PACKED
    alike = slots[~(head & np.append(head[1:], True))]
    while length < depth and len(alike):
        at = order[alike]
        key = rank[at] * n + rank[at + length]
        turn = np.argsort(key)
        at, key = at[turn], key[turn]
        order[alike] = at
        head = np.ones(len(at), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        rank[at] = alike[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        alike = alike[~(head & np.append(head[1:], True))]
        length *= 2
    return order


def short_boundaries(letters: np.ndarray, marks: int, length: int) -> np.ndarray:
    """For each place in the suffix order, and the one past its end: whether the common prefix of the suffixes on both
    sides is shorter than ``length``. ``letters`` is the transform, 0 where an end mark precedes."""
    n = len(letters)
    known = np.zeros(n + 1, dtype=bool)
    known[[0, n]] = True
    back = np.empty(n, dtype=np.int64)
    back[np.argsort(letters, kind="stable")] = np.arange(n)
    blocks = np.cumsum(np.bincount(letters, minlength=1))
    first = np.append(0, blocks[:-1])[1:]
    last = blocks[1:] - 1
    first, last = first[last >= first], last[last >= first]
    # Every end mark is a string of its own, and every letter one of length 1.
    lo, hi = np.append(np.arange(marks), first), np.append(np.arange(marks), last)
    fresh = ~known[hi + 1]
    known[hi + 1] = True
    lo, hi = lo[fresh], hi[fresh]
    for _ in range(1, length):
        if len(lo) == 0:
            break
        sizes = hi - lo + 1
        owner = np.repeat(np.arange(len(lo)), sizes)
        rows = np.arange(len(owner)) + np.repeat(lo - np.append(0, np.cumsum(sizes)[:-1]), sizes)
        before = letters[rows]
        extends = before > 0
        rows, owner, before = rows[extends], owner[extends], before[extends]
        turn = np.argsort(before, kind="stable")
        to, owner, before = back[rows[turn]], owner[turn], before[turn]
        starts = np.ones(len(to), dtype=bool)
        starts[1:] = (owner[1:] != owner[:-1]) | (before[1:] != before[:-1])
        lo, hi = to[starts], to[np.append(starts[1:], True)[: len(to)]]
        fresh = ~known[hi + 1]
        lo, hi = lo[fresh], hi[fresh]
        known[hi + 1] = True
    return known


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, where in it a substring of ``length`` bytes starts that starts anywhere else too, ascending."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    symbols[ends] = 0
    order = suffix_order(symbols, ends, length)
    letters = symbols[order - 1]  # before the first place stands the last end mark
    known = short_boundaries(letters, len(strings), length)
    alike = np.sort(order[~(known[:-1] & known[1:])])
    cuts = np.searchsorted(alike, np.append(ends, len(symbols)) + 1)
    begins = np.append(0, ends + 1)
    found = np.split(alike, cuts[:-1])[: len(strings)]
    return [part - begin for part, begin in zip(found, begins)]
