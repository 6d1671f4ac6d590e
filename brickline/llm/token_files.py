"""Token ids of documents in Parquet files that can be read in part.

One row a document: its id, the position of its first id in the whole corpus's stream, its length and the ids as a
list. The ids are dictionary-encoded (the vocabulary is small), the other columns delta-encoded (they ascend), row
groups and pages are of a set size, and Parquet's page index is written, so a reader of some documents or of the
lengths alone touches only the pages that hold them. Files ascend by document id, in the order of their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickline.llm import bpe
from brickline.llm.shared import only, portions, texts_of
from brickline.session import new_table_path, settle

END_ID = 2
ROW_GROUP_BYTES = 16 * 1024 * 1024
PAGE_BYTES = 256 * 1024
PAGE_ROWS = 1_000


# Words whose ids a worker keeps, about 200 bytes each.
KEPT_WORDS = 800_000
# Marks that are a piece of their own after a word.
MARKS = ".,;:!?"


class Words(bpe.Chunked):
    """A value of a text from the tokens of its words.

    Most words are letters alone, or letters and a mark. Their pieces are known without the library's pattern, so a word
    not seen before costs one call, and with a mark after it the value of the word and that of the mark.
    """

    def __init__(self, path: str, of_tokens: Callable[[list], object], join: Callable, special: Callable[[int], object]):
        self.tokenize, self.of_tokens = bpe.load(path).model.tokenize, of_tokens
        self.pieces = bpe.Kept(self._piece, bpe.KEPT_CHUNKS // 8)
        super().__init__(path, self._chunk, join, special)
        self.marks = {m: self._piece(m) for m in MARKS}

    def _piece(self, piece: str):
        return self.of_tokens(self.tokenize(piece))

    def _chunk(self, chunk: str):
        return self.join([self.pieces[p] for p in bpe.pieces(self.path, chunk)])

    def _spaced(self, item: str):
        if item.isalpha():
            if item.isascii():
                return self.of_tokens(self.tokenize(bpe.BLANK + item))
            if max(item) < "\u0250":
                return self.of_tokens(self.tokenize(bpe.as_letters(" " + item)))
        elif item and item[-1] in self.marks and (word := item[:-1]).isalpha() and (word.isascii() or max(word) < "\u0250"):
            return self.join((self.spaced[word], self.marks[item[-1]]))
        return super()._spaced(item)


class Encoder(Words):
    """Ids of texts as the library gives them, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        ids = [i.to_bytes(4, "little") for i in range(bpe.load(path).get_vocab_size())]
        super().__init__(path, lambda tokens: b"".join([ids[t.id] for t in tokens]), b"".join, lambda i: ids[i])
        self.spaced.bound = KEPT_WORDS


def encoder(path: str) -> Encoder:
    return only(("encoder", path), lambda: Encoder(path))


def counter(path: str) -> Words:
    """Token counts of texts, as the library's ids would be counted."""
    return only(("lengths", path), lambda: Words(path, len, sum, lambda i: 1))


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens`` of every whole text.

    A null text counts as the empty one and has 0; a null id stays null. Every row stands for itself, repeated rows too;
    an empty table gives none, and other columns are left behind, whatever their names.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer)
        for batch in portions(batches):
            n = [tokens(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return texts_of(docs).mapInArrow(count, "doc_id long, n_tokens long")


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Encode every text, add the end id and write the files; returns the file table ``doc_id, n_tokens, tokens``.

    Null texts count as empty, so such a document is the end id alone. Rows with one doc_id lie next to each other.
    A null doc_id sorts first. The text is shuffled once, by ranges of (doc_id, text hash), so that copies of a row
    do not all fall to one task unless they are wholly equal, and the ids are never shuffled.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch["text"]
            for at in range(0, batch.num_rows, 500):
                ids = [encode(t) + end for t in texts.slice(at, 500).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, n.cumsum()), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, 500), pa.array(n), lists], names=["doc_id", "n_tokens", "tokens"]
                )

    ordered = texts_of(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    (
        ordered.select("doc_id", "text")
        .mapInArrow(encode_all, "doc_id long, n_tokens long, tokens array<int>")
        .write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("compression", "zstd")
        .parquet(path)
    )
    return docs.sparkSession.read.schema("doc_id long, n_tokens long, tokens array<int>").parquet(path)


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32`` as the files hold it; ``start`` counts the ids before it.

    The starts are two prefix sums: over files, one row each, and inside each file by its row order. The lengths and
    checksums are read once into a narrow table; the ids themselves are neither shuffled nor kept.
    """
    rows = files.select(
        "doc_id",
        "n_tokens",
        F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        _crc32("tokens").alias("ids_crc32"),
    )
    rows = settle(rows, "token-lengths")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "file")
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def _crc32(column: str) -> Column:
    """Unsigned crc32 of a list of ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("long")
    def crc(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())).astype("int64")

    return crc(F.col(column))


def token_stream(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files below the shared folder, read them back and return their per-document digest."""
    return read_token_files(write_token_files(docs, tokenizer, new_table_path(docs.sparkSession, "token-files")))
