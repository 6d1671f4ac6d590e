from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from brickline.llm.language_id import grams, identify, keep_identified, learn, word_counts, words_of

EN = "the house and the garden are near the river and the old bridge"
DE = "das haus und der garten sind bei dem fluss und der alten brücke"


def test_counts_are_of_all_learnable_documents(documents):
    rows = [(k, EN if k % 2 else DE, "en" if k % 2 else "de") for k in range(60)] + [(100, EN, None), (101, None, "en")]
    got = {(r["lang"], r["token"]): r["n"] for r in word_counts(documents(*rows)).collect()}
    want = Counter()
    for i, text, lang in rows:
        if text and lang and zlib.crc32(str(i).encode()) % 3 != 1:
            want.update((lang, w) for w in words_of(text))
    assert got == want


def test_known_words_then_n_grams(documents):
    docs = documents(*[(k, EN if k % 2 else DE, "en" if k % 2 else "de") for k in range(60)])
    model = learn(docs)
    assert model.langs == ["de", "en"]
    assert model.places("garden")[0] == 0
    table, known = model.places("gardeners")
    assert table == 1 and known
    assert model.places("qqq")[0] == 0 or model.places("qqq")[1] == [] or model.places("qqq")[0] > 1
    asked = documents((1, "the old garden"), (2, "der alte garten"), (3, None), (4, "12 !?"), (5, ""), (5, ""))
    got = {r["doc_id"]: r for r in identify(asked, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"]
    assert 0.5 < got[1]["score"] <= 1 and got[3]["score"] == 0
    assert got[1]["held_out"] == (zlib.crc32(b"1") % 3 == 1)


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_stage_drops_only_what_has_no_language(odd_documents):
    kept = keep_identified(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 4, 4, 5, 6]


def test_nothing_to_learn_from(documents):
    assert [r["lang_pred"] for r in identify(documents((1, "words here", None))).collect()] == ["und"]
    assert identify(documents((1, "a")).where("false")).collect() == []


def plain_totals(rows, asked):
    """Summed logs of each text by language, from whole counts in memory."""
    tables = [defaultdict(Counter) for _ in range(5)]
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for word in words_of(text):
                for size in range(5):
                    tables[size][lang].update(grams(word, size) if size else [word])
    langs = sorted(tables[0])

    def row(size, token):
        table, known = tables[size], set().union(*tables[size].values())
        if token in known:
            return [math.log((table[k][token] or 0.5) / (sum(table[k].values()) + 0.5 * len(known))) for k in langs]

    def of_word(word):
        for size in (0, 4, 3, 2, 1):
            found = [r for t in (grams(word, size) if size else [word]) if (r := row(size, t))]
            if found:
                return [sum(c) / len(found) for c in zip(*found)]
        return [0.0] * len(langs)

    held = {}
    for text in asked:
        for word in words_of(text):
            held[word] = held.get(word) or of_word(word)
    return langs, [[sum(c) for c in zip(*(held[w] for w in words_of(t)))] for t in asked]


def test_lists_change_no_result(documents):
    rng = random.Random(3)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 5)))
    known = {lang: [make(letters) for _ in range(60)] for lang, letters in (("a", "abcde"), ("b", "bcdef"), ("c", "abdfg"))}
    rows = [(k, " ".join(rng.choices(known[lang] + known["b"][:20], range(80, 0, -1), k=8)), lang) for k, lang in enumerate("abc" * 20)]
    asked = [(1000 + k, " ".join(rng.choices(known["a"] + known["c"], k=2) + [make("abcdefgh"), "zz"]), None) for k in range(30)]
    langs, totals = plain_totals(rows, [t for _, t, _ in asked])
    docs = documents(*rows)
    for lists in ((20_000, 5_000), (4, 3), (1, 1)):
        got = {r["doc_id"]: r for r in identify(documents(*asked), learn(docs, *lists)).collect()}
        for (i, _, _), total in zip(asked, totals):
            best = max(total)
            assert got[i]["score"] == pytest.approx(1 / sum(math.exp(x - best) for x in total), rel=1e-9)
            assert total[langs.index(got[i]["lang_pred"])] == pytest.approx(best)
