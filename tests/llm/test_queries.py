from __future__ import annotations

import pytest
from compare import compare, oracle_connection

import corpus_pipeline
from brickline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    assert compare(QUERIES[name](spark, folder), oracle_connection(folder), ORACLES[name]) == ""


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_equals_its_stages_in_plain_form(spark, folder):
    """The stages against plain versions: rules by row, letters by row, links by all pairs, one row per token span."""
    import numpy as np
    import test_jaccard_join as plain

    from brickline.llm.quality_rules import judge
    from brickline.llm.queries import tokenizer_path
    from brickline.llm.token_files import encoder

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = [(i, judge(t or "")[1], lang) for i, t, lang in rows if judge(t or "")[0][-1]]
    rows = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t)]
    classes = plain.plain_join(rows)
    kept = {i: t for i, t in rows if classes[i][0] == i}
    got = corpus_pipeline.run(spark, folder).collect()
    sizes = {}
    for r in got:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    encode = encoder(tokenizer_path("byte_bpe_50k.json"))
    assert sizes == {i: len(np.frombuffer(encode(t), "<u4")) + 1 for i, t in kept.items()}


def test_stages_keep_the_columns(spark, odd_documents, folder):
    docs = odd_documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd_documents.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()
