from __future__ import annotations

import math
import random
import sys
import zlib
from collections import Counter

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from brickline.llm.piece_lattice import Lattice, decode, encode, encode_digest, lattice
from brickline.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text(alphabet="ab ▁\n\té日😀<>", max_size=30)), st.integers(-(1 << 63), (1 << 63) - 1))
def test_decoding_is_lossless(text, key):
    held = lattice(PATH)
    ids = held.sample([text], np.array([key]))[0].tolist()
    assert held.decode(ids) == text
    assert (ids == []) == (text == "")


def test_the_library_decodes_the_same():
    text = "Several words,  and some 日本 and 😀.\nNext line"
    ids = lattice(PATH).sample([text], np.array([3]))[0].tolist()
    assert sentencepiece.SentencePieceProcessor(model_file=PATH).decode(ids) == text


def test_samples_follow_the_lattice():
    held = lattice(PATH)

    def paths(text):
        if not text:
            return [((), 0.0)]
        return [((held.piece[text[:k]], *p), held.weight[text[:k]] + w) for k in range(1, len(text) + 1) if text[:k] in held.piece for p, w in paths(text[k:])]

    every = paths(" then")
    total = sum(math.exp(w) for _, w in every)
    n = 20_000
    got = Counter(tuple(x.tolist()) for x in held.sample(["then"] * n, np.arange(n)))
    assert set(got) <= {p for p, _ in every}
    for p, w in every:
        assert abs(got[p] / n - math.exp(w) / total) < 0.015


def test_long_words_and_portions_make_no_difference():
    held = lattice(PATH)
    texts = ["x" * 5000 + "é" * 200, "plain words here", "ab" * 400]
    together = held.sample(texts, np.array([1, 2, 3]))
    for k, text in enumerate(texts):
        assert held.sample([text], np.array([k + 1]))[0].tolist() == together[k].tolist()
        assert held.decode(together[k].tolist()) == text


def test_a_place_asks_no_longer_strings_than_ends_of_pieces():
    """Of "qxqxqx..." few strings end a piece, so a node asks for few; the sums are those over all pieces."""

    class Asked(dict):
        n = 0

        def get(self, key):
            Asked.n += 1
            return super().get(key)

    held = Lattice(PATH)
    held.tails = Asked(held.tails)
    word = " then" + "qx" * 20
    held.sample([word.strip()], np.array([1]))
    plain = [0.0]
    for end in range(1, len(word) + 1):
        ways = [plain[b] + held.weight[word[b:end]] for b in range(end) if word[b:end] in held.weight]
        plain.append(max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)))
    assert np.allclose([held.sum[held.node[word[:k]]] for k in range(1, len(word) + 1)], plain[1:])
    assert Asked.n <= 5 * len(word)


def test_new_prefixes_of_a_batch_are_summed_side_by_side():
    """Python is called a fixed number of times a batch, not for each prefix; sums and shares are those of a plain loop."""
    held = Lattice(PATH)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgé日", k=k % 11 + 1)) for k in range(1500)]
    calls = Counter()
    sys.setprofile(lambda frame, event, _: calls.update([event]))
    try:
        ids = held.sample([" ".join(words)], np.array([1]))[0].tolist()
    finally:
        sys.setprofile(None)
    assert calls["call"] < 500
    assert held.decode(ids) == " ".join(words)
    for word in words[:400:7]:
        word, plain = f" {word}", [0.0]
        for end in range(1, len(word) + 1):
            begins = [b for b in reversed(range(end)) if word[b:end] in held.weight]
            ways = [plain[b] + held.weight[word[b:end]] for b in begins]
            plain.append(max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)))
            node = held.node[word[:end]]
            first = held.first[node]
            assert held.taken[first : first + len(ways)].tolist() == [held.piece[word[b:end]] for b in begins]
            assert held.before[first : first + len(ways)].tolist() == [held.node[word[:b]] if b else 0 for b in begins]
            shares = np.cumsum([math.exp(w - plain[-1]) for w in ways])
            assert np.allclose(held.share[first : first + len(ways)], shares) and held.share[first + len(ways) - 1] == 1.0


def test_shares_do_not_depend_on_the_batches_before():
    word, shares = " thenceforward", []
    for earlier in ([], ["other words", "the then thence"]):
        held = Lattice(PATH)
        for text in [*earlier, word.strip()]:
            held.sample([text], np.array([1]))
        shares.append([held.share[held.first[held.node[word[:k]]]] for k in range(1, len(word) + 1)])
    assert shares[0] == shares[1]


def test_spark_round_trip(odd_documents):
    encoded = encode(odd_documents, PATH, seed=4)
    again = {r["doc_id"]: r["ids"] for r in encode(odd_documents.repartition(5), PATH, seed=4).collect()}
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == again
    texts = {r["doc_id"]: r["text"] for r in decode(encoded, PATH).collect()}
    assert texts == {r["doc_id"]: r["text"] or "" for r in odd_documents.collect()}
    for r in encode_digest(odd_documents, PATH, seed=4).collect():
        ids = np.array(again[r["doc_id"]], "<u4")
        assert (r["n_tokens"], r["ids_crc32"], r["lossless"]) == (len(ids), zlib.crc32(ids.tobytes()), True)
    other = {r["doc_id"]: r["ids"] for r in encode(odd_documents, PATH, seed=5).collect()}
    assert other[5] != again[5]
    assert encode(odd_documents.where("false"), PATH).collect() == []
