from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from brickline.llm import lexical_search
from brickline.llm.lexical_search import Shard, search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_terms(text):
    return TERM.findall(text.translate(LOWER)) if text else []


def plain_search(docs, items, k=10):
    """Every item against every document, in memory."""
    docs = [(i, w) for i, t in docs if (w := plain_terms(t))]
    n_docs, n_terms = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, words in docs:
            tf, m = Counter(words), 10 + (90 * len(words) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in set(plain_terms(text)) & set(tf)
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'?' as terms", "'?' as score", "1 as rank")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'?' as no", "1 as doc_id")
    return sorted(map(tuple, search(d, i, **kw).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    text = lambda m: " ".join(rng.choices(words, [1 / (k + 1) for k in range(200)], k=m))
    docs = [(k, text(rng.randint(1, 40))) for k in range(n)]
    items = [(k, text(rng.randint(1, 25))) for k in range(12)]
    return docs + [(n + k, t) for k, (_, t) in enumerate(items)], items


@pytest.mark.parametrize("first", [1, 7, 256])
def test_equals_plain_search(spark, monkeypatch, first):
    monkeypatch.setattr(lexical_search, "FIRST", first)
    docs, items = corpus(first, 400)
    assert run(spark, docs, items) == plain_search(docs, items)


def test_blocks_and_shards_change_nothing(spark, monkeypatch):
    docs, items = corpus(9, 300)
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 50)
    monkeypatch.setattr(lexical_search, "FIRST", 2)
    assert run(spark, docs, items, block_terms=20) == plain_search(docs, items)


def test_ties_copies_nulls_and_odd_texts(spark):
    docs = [(9, "the same text"), (3, "the same text"), (3, "the same text"), (None, "the same text"), (5, None), (6, ""), (7, " .,\n"),
            (8, "THE Same É É é tExt"), (1, "x" * 50_000), (2, " ".join(["long"] * 60_000) + " tail"), (4, "naïve Ünder_score a1b2\x7fc")]
    items = [(1, "Same text"), (1, "Same text"), (1, "É"), (2, None), (None, "tail SCORE"), (3, "?!"), (4, "b2 a1b2 c")]
    assert run(spark, docs, items) == plain_search(docs, items)
    assert run(spark, docs, items, k=2) == plain_search(docs, items, 2)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_terms_fold_ascii_only():
    text = "".join(map(chr, range(1, 0x250))) + " ÀÉ’s İstanbul 😀x"
    assert [t.decode() for t in terms(text)] == plain_terms(text)


def test_reading_stops_before_the_lists_end():
    """Two documents hold a rare term; the common term's list is not read to its end for them."""
    n = 20_000
    row = np.concatenate([np.arange(n), [3, 5]])
    term = np.concatenate([np.zeros(n, dtype=np.int64), [1, 1]])
    tf = np.ones(n + 2, dtype=np.int64)
    tf[[3, 5]] = 9
    shard = Shard(list(range(n)), np.full(n, 10), row, term, tf, np.array([10, 9000]), n, 10 * n)
    found, read = shard.search([0, 1], 2, [])
    assert sorted(r for _, r in found) == [3, 5] and read < n // 10


def test_whole_table(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = search(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(docs, items)
