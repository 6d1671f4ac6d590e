from __future__ import annotations

from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from brickline.llm.packing import opened, pack, pack_documents


def plain_best_fit(lengths, capacities, cost):
    """The same rule by scans over all open bins and over all pieces not yet counted on."""
    bins, used, free, turn = [None] * len(lengths), [], [], []
    left, counted = list(lengths), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        (counted if n in counted else left).remove(n)
        fits = [b for b in range(len(free)) if free[b] >= n and free[b] > 0]
        if fits:
            b = min(fits, key=lambda b: (free[b], -turn[b]))
        else:
            offers = []
            for c in capacities:
                if c >= n:
                    held, rest = [], list(left)
                    while any(x <= c - n - sum(held) for x in rest):
                        held.append(max(x for x in rest if x <= c - n - sum(held)))
                        rest.remove(held[-1])
                    total = n + sum(held)
                    offers.append(((next(s for s in capacities if s >= total) + cost) / total, c, held))
            _, c, held = min(offers, key=lambda o: o[:2])
            for x in held:
                left.remove(x)
                counted.append(x)
            b = len(free)
            free.append(c)
            used.append(0)
            turn.append(0)
        bins[k] = b
        free[b] -= n
        used[b] += n
        turn[b] = k_turn(turn)
    return bins, [next(c for c in capacities if c >= u) for u in used], used


def k_turn(turn):
    return max(turn, default=0) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_equals_the_plain_rule(lengths):
    bins, offsets, size, used = pack(lengths, (16, 32, 64), 4)
    assert (bins, size, used) == plain_best_fit(lengths, (16, 32, 64), 4)
    held = defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths):
        held[b].append((o, o + n))
    for b, spans in held.items():
        assert sorted(spans)[0][0] == 0 and all(x[1] == y[0] for x, y in zip(sorted(spans), sorted(spans)[1:]))
        assert max(s[1] for s in spans) == used[b] <= size[b]


def test_bins_are_downsized():
    assert pack([10], (16, 32, 64))[2] == [16]
    assert pack([60, 60, 3, 20], (16, 32, 64), 4)[2] == [64, 64, 32]


def test_lengths_are_weighed_while_much_is_left():
    """Where the pieces left would leave a large bin half empty, smaller ones are opened from the start."""
    assert opened(31, [17] * 50, (16, 32, 64), 4)[0] == 32
    assert opened(31, [16] * 2 + [17] * 50, (16, 32, 64), 4)[0] == 64
    _, _, size, used = pack([63, 31, 30] + [17] * 18, (16, 32, 64), 4)
    assert size == [64, 64] + [64] * 6 and used[1] == 61
    _, _, size, used = pack([63, 31] + [17] * 18, (16, 32, 64), 4)
    assert size == [64, 32] + [64] * 6 and used[1] == 31


def test_every_token_is_packed_once(spark):
    rows = [(1, 10_000), (2, 0), (3, None), (4, -5), (None, 7), (5, 4096), (5, 4096)] + [(k, k % 900) for k in range(10, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = pack_documents(df, window=500).collect()
    assert sum(r["length"] for r in got) == sum(max(0, n or 0) for _, n in rows)
    pieces = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 1)
    assert pieces == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 1808)]
    assert {r["doc_id"] for r in got} == {d for d, _ in rows}
    by_bin = defaultdict(list)
    for r in got:
        by_bin[r["window"], r["bin"]].append(r)
    for rows_here in by_bin.values():
        assert sum(r["length"] for r in rows_here) == rows_here[0]["used"] <= rows_here[0]["capacity"]
    assert pack_documents(df.where("false")).collect() == []


def test_partitions_change_nothing(spark):
    rows = [(k, (k * 7919) % 1500) for k in range(3000)] + [(5000, 9_000_000), (None, 3)] + [(6000, 40)] * 700
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    key = lambda r: tuple(-1 if v is None else v for v in r)
    one = sorted((tuple(r) for r in pack_documents(df.coalesce(1), window=500).collect()), key=key)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = sorted((tuple(r) for r in pack_documents(df.repartition(7), window=500).collect()), key=key)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert one == many
    sizes = {}
    for r in one:
        sizes[r[4]] = sizes.get(r[4], 0) + 1
    assert sorted(sizes) == list(range(len(sizes))) and {n for w, n in sizes.items() if w < len(sizes) - 1} == {500}
