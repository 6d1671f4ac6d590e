from __future__ import annotations

import random
import re

import numpy as np

from brickline.llm import jaccard_join
from brickline.llm.jaccard_join import keep_one_of_each, near_duplicates, prefix_depth


def plain_join(rows):
    """Links by comparing every pair of n-gram sets; ``doc_id: (class_id, copy_of, n_text_links, n_links)``."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    near = lambda a, b: bool(a) and 5 * len(a & b) >= 4 * len(a | b)
    label = list(range(len(rows)))
    links = [[o for o in range(len(rows)) if o != k and near(sets[k], sets[o])] for k in range(len(rows))]
    changed = True
    while changed:
        changed = False
        for k, own in enumerate(links):
            low = min([label[k], *(label[o] for o in own)])
            changed |= low != label[k]
            label[k] = low
    ids = [i for i, _ in rows]
    out = {}
    for k, own in enumerate(links):
        out[ids[k]] = (
            min(ids[o] for o in range(len(rows)) if label[o] == label[k]),
            min([ids[k], *(ids[o] for o in own if sets[o] == sets[k])]),
            len({sets[o] for o in own if sets[o] != sets[k]}),
            len(own),
        )
    return out


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for k in range(n):
        kind = rng.random()
        if rows and kind < 0.45:
            text = rng.choice(rows[:20])[1].split(" ")
            for _ in range(rng.randint(0, max(1, len(text) // 20))):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.randint(1, 200))]
            if kind > 0.8:
                text = text[:30] + passage + text[30:]
        rows.append((k, " ".join(text)))
    return rows


def as_dict(df):
    return {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_text_links"], r["n_links"]) for r in df.collect()}


def test_equals_all_pairs(documents):
    rows = corpus(260)
    assert as_dict(near_duplicates(documents(*rows))) == plain_join(rows)


def test_large_groups_are_cut_into_blocks(documents, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BRANCH_BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "FAMILY_BLOCK", 8)
    rng = random.Random(1)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(words)))
    want = plain_join(rows)
    assert as_dict(near_duplicates(documents(*rows))) == want
    assert max(v[3] for v in want.values()) > 60


def test_odd_rows(odd_documents):
    got = near_duplicates(odd_documents).collect()
    assert len(got) == 9
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[k]["n_links"] == 0 and by_id[k]["class_id"] == k for k in (1, 2, 3, 5, 6))
    assert by_id[4]["n_links"] == 2 and by_id[4]["class_id"] is None  # the null id is the smallest of the three copies
    kept = keep_one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 5, 6, 7]


def test_stage_keeps_the_first_of_each_class(documents):
    rows = corpus(120, 9)
    want = plain_join(rows)
    got = sorted(r["doc_id"] for r in keep_one_of_each(documents(*rows)).collect())
    assert got == sorted({v[0] for v in want.values()})


def test_texts_that_share_an_id_are_judged_apart(documents):
    words = [f"w{k}" for k in range(100)]
    near, other, alike = " ".join([*words[:-1], "x"]), " ".join(f"v{k}" for k in range(80)), " ".join([*words[:-1], "y"])
    got = keep_one_of_each(documents((2, " ".join(words)), (4, near), (4, other), (5, other), (2, alike))).collect()
    assert len(got) == 2 and {(r["doc_id"], r["text"][0]) for r in got} == {(2, "w"), (4, "v")}


def test_shorter_prefixes_open_only_what_longer_ones_left(spark, documents, monkeypatch):
    depths, match = [], jaccard_join._matches

    def noted(reps, families, depth, least):
        links = match(reps, families, depth, least)
        label = {} if families is None else {bytes(r["node"]): bytes(r["label"]) for r in families.collect()}
        pairs = [(bytes(r["a"]), bytes(r["b"])) for r in links.collect()]
        depths.append((depth, len(pairs)))
        assert all(label.get(a, a) != label.get(b, b) for a, b in pairs)
        return links

    monkeypatch.setattr(jaccard_join, "_matches", noted)
    rows = corpus(260)
    assert as_dict(near_duplicates(documents(*rows))) == plain_join(rows)
    assert [d for d, _ in depths] == list(range(jaccard_join.DEPTH, prefix_depth(0.8) - 1, -1)) and len(depths) > 1
    assert depths[0][1] > depths[-1][1]


def test_empty_table(documents):
    assert near_duplicates(documents((1, "a")).where("false")).collect() == []


def test_depth_reaches_the_target():
    depth = prefix_depth(0.8)
    recall = lambda d: 1 - (1 - 0.8**d) ** jaccard_join.TREES
    assert recall(depth) >= jaccard_join.TARGET_RECALL > recall(depth + 1)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    b = np.concatenate([a[:1600], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    alike = (jaccard_join.signature(a) == jaccard_join.signature(b)).mean()
    assert abs(alike - 1600 / 2200) < 0.15
