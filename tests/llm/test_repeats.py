from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from brickline.llm import repeats
from brickline.llm.bwt import repeated_starts
from brickline.llm.repeats import levels, repeated_spans


def plain_removal(rows, length):
    """Every window of every text counted in memory."""
    bodies = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s : s + length] for _, b in bodies for s in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        covered = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                covered[s : s + length] = b"\1" * length
        spans = sum(c and not p for p, c in zip(b"\0" + covered, covered))
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'?' as body", "'?' as key", "'?' as names", "1 as n")
    found = repeated_spans(docs, **kw)
    return sorted(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "bb", "é", "ccc", "zero", "ñandú", "x"]
    text = lambda m: " ".join(rng.choices(words, k=m))
    shared = [text(rng.randint(5, 30)) for _ in range(6)]
    rows = [(k, text(rng.randint(0, 20)) + rng.choice(shared) + text(rng.randint(0, 20)) + rng.choice(["", rng.choice(shared)])) for k in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("length", [1, 12, 40])
def test_equals_plain_removal(spark, length):
    rows = corpus(length)
    assert run(spark, rows, length=length) == plain_removal(rows, length)


def test_large_groups_go_on_by_longer_names(spark, monkeypatch):
    """With at most one or three pieces a group, nearly every group is named again, up to the window itself."""
    monkeypatch.setattr(repeats, "BATCH_BYTES", 500)
    rows = corpus(5, 30)
    for group in (1, 3):
        assert run(spark, rows, length=24, group=group) == plain_removal(rows, 24)


def test_repetitive_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 700)
    rows = [(1, "ab" * 900), (2, "b" * 500 + "c"), (3, "d" * 60), (4, "ba" * 40), (5, "".join(map(str, range(900))))]
    assert run(spark, rows, length=50) == plain_removal(rows, 50)


def test_nulls_copies_and_empty_tables(spark):
    line = "the same line of text, " * 30
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, line + "x"), (4, "y" + line), (5, "z" * 399), (6, "z" * 399), (7, "w" * 400), (7, "w" * 400)]
    got = run(spark, rows)
    assert got == plain_removal(rows, 400)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == plain_removal([(1, None)], 400)


def test_spans_are_the_removed_runs(spark):
    passage = "".join(chr(97 + i % 26) + str(i) for i in range(200))
    docs = spark.createDataFrame([(1, "left " + passage + " right"), (2, "other " + passage)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in repeated_spans(docs).collect()}
    # The blank before the passage stands in both texts.
    assert got == {1: [4, 5 + len(passage)], 2: [5, 6 + len(passage)]}


@pytest.mark.parametrize("share", [1, 12, 4096])
def test_common_names_and_texts_give_the_same_rows(spark, monkeypatch, share):
    """No name or text, some, and all of them are sent to their rows."""
    monkeypatch.setattr(repeats, "SHARE", share)
    line = "a line that stands in most of the texts, "
    rows = corpus(7) + [(100 + k, f"{k} " + line + f" {k}") for k in range(30)] + [(200 + k, line * 2) for k in range(9)] + [(300, None)] * 9
    assert run(spark, rows, length=30) == plain_removal(rows, 30)


def test_common_keys_are_few_and_the_rest_even(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARE", 10)
    counted = spark.createDataFrame([(k, 1 + 50 * (k < 9)) for k in range(500)], "name long, n long")
    assert sorted(r["name"] for r in repeats.common(counted, "n").collect()) == []
    counted = spark.createDataFrame([(k, 1 + 150 * (k < 3)) for k in range(500)], "name long, n long")
    assert sorted(r["name"] for r in repeats.common(counted, "n").collect()) == [0, 1, 2]
    assert repeats.common(counted.where("false"), "n").collect() == []


@pytest.fixture
def fullest(spark):
    """Rows of the fullest of eight partitions, where Spark neither broadcasts nor splits by itself."""
    ours = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    yield lambda df: max(len(part) for part in df.rdd.glom().collect())
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_of_a_common_text_do_not_meet_in_one_task(spark, fullest):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(200))
    docs = spark.createDataFrame([(k, text) for k in range(400)] + [(k, None) for k in range(400)], "doc_id long, text string")
    assert fullest(repeated_spans(docs.repartition(8))) <= 200


def test_rows_of_a_common_name_do_not_meet_in_one_task(spark, fullest):
    named = spark.createDataFrame([(b"%d" % k, 1 if k < 600 else k // 2) for k in range(1000)], "key binary, name long")
    found = repeats.shared_names(named.repartition(8))
    assert fullest(found) <= 200 and found.count() == 1000


def test_names_reach_the_window():
    assert levels(400)[0] == 128 and levels(400)[-1] == 400 and levels(1) == [1]
    assert all(a < b for a, b in zip(levels(400), levels(400)[1:]))


@pytest.mark.parametrize("seed", range(4))
def test_transform_equals_counting(seed):
    rng = random.Random(seed)
    for _ in range(150):
        letters = rng.choice([b"ab", b"a", b"abcd", bytes([0, 255, 1])])
        length = rng.randint(1, 20)
        strings = [bytes(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        strings += [strings[0] + b"a" + strings[0]] * rng.randint(0, 1)
        count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if count[s[i : i + length]] > 1] for s in strings]
        assert [r.tolist() for r in repeated_starts(strings, length)] == want
