from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickline.llm.quality_model import FEATURES, AttentionModel, encode_passages, learn, score_documents, whole_bags


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = AttentionModel()
    x, bag = rng.normal(size=(9, FEATURES)) * 0.3, np.array([0, 0, 0, 1, 1, 2, 2, 2, 2])
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.5, 2.0])

    def loss():
        y = model._forward(x, bag, 3)["y"]
        return -(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum()

    found = model._gradients(x, bag, label, weight)
    for name, value in model.p.items():
        for place in list(np.ndindex(value.shape))[:: max(1, value.size // 7)]:
            old = value[place]
            value[place] = old + 1e-5
            up = loss()
            value[place] = old - 1e-5
            down = loss()
            value[place] = old
            assert found[name][place] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_one_bad_passage_is_found_by_attention():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for k in range(300):
        bag = rng.normal(0, 0.3, (rng.integers(1, 9), FEATURES))
        if k % 2:
            bag[rng.integers(len(bag)), :16] += 2
        bags.append(bag.astype(np.float32))
        labels.append(k % 2)
    scores = AttentionModel().fit(bags[:200], np.array(labels[:200], float)).score(bags[200:])
    assert ((scores >= 0.5) == np.array(labels[200:])).mean() > 0.9


def test_held_out_accuracy(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = score_documents(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == docs.count()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_odd_rows_and_labels(spark, odd_documents):
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (6, None), (None, 0), (2, 0)], "doc_id long, quality int")
    got = score_documents(odd_documents, labels).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    none = score_documents(odd_documents, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert score_documents(odd_documents.where("false"), labels).collect() == []


def test_labels_and_other_columns_are_no_inputs(spark, odd_documents):
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int")
    a = score_documents(odd_documents, labels).select("doc_id", "score").collect()
    b = score_documents(odd_documents.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), labels).select("doc_id", "score").collect()
    assert sorted(a, key=str) == sorted(b, key=str)


def test_passages_cover_the_whole_text():
    text = " ".join(f"word{k}" for k in range(1000))
    assert encode_passages(text).shape == (16, FEATURES)
    changed = encode_passages(text + " END!!")
    assert not np.allclose(changed[-1], encode_passages(text)[-1])
    assert encode_passages("").shape == (1, FEATURES)


def learned_bags(docs, labels, monkeypatch, **bounds):
    held = []
    monkeypatch.setattr(AttentionModel, "fit", lambda self, bags, labels: held.extend(bags) or self)
    learn(docs, labels, **bounds)
    return held


def test_an_id_is_learned_from_once(spark, documents, monkeypatch):
    learnable = [k for k in range(30) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(k, f"text {k} here") for k in learnable] + [(learnable[0], "again " * n) for n in range(1, 200)] + [(learnable[1], None)]
    labels = spark.createDataFrame([(k, k % 2) for k in learnable], "doc_id long, quality int")
    bags = learned_bags(documents(*rows), labels, monkeypatch)
    assert len(bags) == len(learnable) and all(b.any() for b in bags)


def test_learned_bags_are_whole(spark, documents, monkeypatch):
    learnable = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(k, " ".join(f"word{j}" for j in range(64 * (1 + k % 5)))) for k in learnable[1:]] + [(learnable[0], "long " * 64 * 200)]
    labels = spark.createDataFrame([(k, k % 2) for k in learnable], "doc_id long, quality int")
    whole = sorted(len(encode_passages(t)) for _, t in rows)
    assert sorted(map(len, learned_bags(documents(*rows), labels, monkeypatch))) == whole
    few = learned_bags(documents(*rows), labels, monkeypatch, sample_passages=80)
    assert 60 < sum(map(len, few)) <= 80 and set(map(len, few)) <= set(range(1, 6))
    assert whole_bags([5, 2, 90, 4], 96) == [0, 1, 3] and whole_bags([], 5) == []


def test_scores_equal_the_attention_by_hand(spark, documents):
    """Each document's score against sums over its passages, one by one, with the learned numbers."""
    rows = [(k, (f"good prose number {k}. " if k % 2 else f"#$% SPAM {k} !!! ") * (1 + 37 * (k % 7))) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    docs = documents(*rows)
    model = learn(docs, labels)
    p, texts = model.p, dict(rows)
    for r in score_documents(docs, labels, model).collect():
        weights, values = [], []
        for x in (encode_passages(texts[r["doc_id"]]) - model.mean) / model.scale:
            h = np.tanh(x @ p["A"])
            gate = np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))
            weights.append(np.exp(gate @ p["w"]))
            values.append(h @ p["c"])
        z = sum(w * v for w, v in zip(weights, values)) / sum(weights) + p["b"][0]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)
