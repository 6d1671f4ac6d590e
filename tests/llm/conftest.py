from __future__ import annotations

import pytest

from brickline.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def byte_bpe():
    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def piece_model():
    return tokenizer_path("piece_bpe_32k.model")


@pytest.fixture
def documents(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang)``, with the columns of the table."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture
def odd_documents(documents):
    """Null, empty and blank texts, a null id, repeated rows, one very long text, and columns with clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{k % 977}." for k in range(60_000))
    plain = "The quick brown fox jumps over the lazy dog. " * 3
    rows = [(1, None, None), (2, ""), (3, " \n\t "), (None, plain), (4, plain), (4, plain), (5, long), (6, "x" * 50_000), (7, "123 !!", None)]
    clash = ("n_words", "kept", "score", "key", "label", "n_tokens", "bin", "node", "a", "b", "ids", "held_out", "count", "copies")
    return documents(*rows).withColumns({c: F.lit("?") for c in clash})
