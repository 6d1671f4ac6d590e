"""The corpus pipeline: clean by lines, name the language, keep one of each group of near duplicates, pack.

Each stage takes what the one before it kept, read again from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brickline.llm.jaccard_join import keep_one_of_each
from brickline.llm.language_id import keep_identified
from brickline.llm.packing import pack_documents
from brickline.llm.quality_rules import clean_documents
from brickline.llm.queries import table, tokenizer_path
from brickline.llm.token_files import token_lengths
from brickline.session import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail the base rules or lose too much text go."""
    return clean_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` as found, learned from these documents; documents without a language go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens, with one for its end, lie in training sequences."""
    lengths = token_lengths(docs, tokenizer_path("byte_bpe_50k.json"))
    return pack_documents(lengths.selectExpr("doc_id", "n_tokens + 1 as n_tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

# The tokenizer and the learned language model can't be said in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return settle(STAGES[-1][1](spark, docs, sf_dir), "pipeline-packed")
