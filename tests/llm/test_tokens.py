from __future__ import annotations

import zlib

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brickline.llm import bpe
from brickline.llm.queries import tokenizer_path
from brickline.llm.token_counts import count_tokens, counter, longest_prefix, prefix_counts, tokens_of_prefix
from brickline.llm.token_files import encoder, read_token_files, token_lengths, write_token_files
from brickline.session import new_table_path

PATH = tokenizer_path("byte_bpe_50k.json")
PARTS = st.sampled_from(
    ["a", "b", "'re", "'ll", "'s", "'", " ", "  ", "\n", "\t", "1", "²", "½", "é", "日本", "😀", "<|endoftext|>", "<|endo",
     ".", "!!", "the", " of", "\x1c", "\x85", "　", "_", "\r\n", "\x00", "don't", "ॐ", "ा"]
)
TEXTS = st.one_of(st.lists(PARTS, max_size=14).map("".join), st.text(max_size=20))


def library(text):
    return bpe.load(PATH).encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_the_librarys(text):
    assert np.frombuffer(encoder(PATH)(text), "<u4").tolist() == library(text)


@settings(max_examples=250, deadline=None)
@given(TEXTS, st.integers(0, 9))
def test_every_prefix_has_the_librarys_count(text, budget):
    want = [len(library(text[:i])) for i in range(len(text) + 1)]
    count = counter(PATH)
    assert count.prefixes(text).tolist() == want
    assert count.total(text) == want[-1]
    assert count.longest_within(text, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_long_pieces_and_eviction(monkeypatch):
    text = "ab" * 3000 + " " + "é" * 500 + " " * 300 + "x"
    assert counter(PATH).total(text) == len(library(text))
    kept = bpe.Kept(len, 4)
    assert [kept[str(k) * 3] for k in range(10)] == [3] * 10 and len(kept) <= 2


def test_counts_of_odd_rows(odd_documents):
    got = {r["doc_id"]: r for r in count_tokens(odd_documents, PATH, 30).collect()}
    assert (got[1]["n_bytes"], got[1]["n_tokens"], got[1]["over_limit"], got[1]["fit_chars"]) == (0, 0, False, 0)
    for row in odd_documents.where("text is not null").collect():
        assert got[row["doc_id"]]["n_tokens"] == len(library(row["text"]))
        assert got[row["doc_id"]]["n_bytes"] == len(row["text"].encode())
        assert got[row["doc_id"]]["over_limit"] == (len(library(row["text"])) > 30)


def test_prefixes_within_white_space_before_a_control_character():
    for text in (" \x85\x1c", "a \x1c \t\x1fb", " \x1d "):
        assert counter(PATH).prefixes(text).tolist() == [len(library(text[:i])) for i in range(len(text) + 1)]


def test_stored_counts_answer_without_encoding(documents):
    text = "An answer that doesn't need  to be\nencoded again."
    rows = prefix_counts(documents((1, text), (2, None)), PATH)
    got = rows.select(
        "doc_id", tokens_of_prefix(F.col("counts"), F.lit(9)).alias("n"), longest_prefix(F.col("counts"), 5).alias("fit")
    ).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n"] == len(library(text[:9]))
    assert by_id[1]["fit"] == max(i for i in range(len(text) + 1) if len(library(text[:i])) <= 5)
    assert by_id[2]["n"] is None and by_id[2]["fit"] == 0


def test_token_files_round_trip(spark, odd_documents):
    path = new_table_path(spark, "token-files-test")
    files = write_token_files(odd_documents, PATH, path)
    got = [tuple(r) for r in read_token_files(files).orderBy("start").collect()]
    docs = sorted(odd_documents.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    start, want = 0, []
    for row in docs:
        ids = np.array([*library(row["text"] or ""), 2], "<u4")
        want.append((row["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert dict((r["doc_id"], r["n_tokens"]) for r in token_lengths(odd_documents, PATH).collect())[5] == want[[w[0] for w in want].index(5)][2] - 1


def test_token_file_layout(spark, folder):
    path = new_table_path(spark, "token-files-layout")
    write_token_files(spark.read.parquet(f"{folder}/documents.parquet"), PATH, path)
    import glob

    column = pq.ParquetFile(sorted(glob.glob(f"{path}/*.parquet"))[0]).metadata.row_group(0)
    by_name = {column.column(k).path_in_schema: column.column(k) for k in range(column.num_columns)}
    ids = next(v for k, v in by_name.items() if k.startswith("tokens"))
    assert any("DICTIONARY" in e for e in ids.encodings)
    assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings
    assert ids.has_offset_index and by_name["doc_id"].has_column_index


def test_empty_table(documents):
    none = documents((1, "a")).where("false")
    assert count_tokens(none, PATH).collect() == []
