"""The registered queries of this subpackage, one for each operator, with check SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickline.llm.jaccard_join import near_duplicates
from brickline.llm.language_id import identify
from brickline.llm.lexical_search import search
from brickline.llm.neighbours import nearest
from brickline.llm.packing import pack_documents
from brickline.llm.piece_lattice import encode_digest
from brickline.llm.quality_model import score_documents
from brickline.llm.quality_rules import quality_report
from brickline.llm.repeats import repeated_spans
from brickline.llm.token_counts import count_tokens
from brickline.llm.token_files import token_lengths, token_stream
from brickline.llm.warc import capture_index
from brickline.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; the folder can be set in ``TOKENIZER_DIR``."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


OP1_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
marked as (
  select doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from lines
),
judged as (
  select *, not regexp_matches(line, '[.!?…。！？]')
    or (n >= 3 and 2 * len(regexp_extract_all(line, '[!?]')) >= n)
    or (len(regexp_extract_all(line, '[|»›·•]')) >= 2 and 5 * len(regexp_extract_all(line, '[|»›·•]')) >= n)
    or 2 * len(regexp_extract_all(line, '[#*$%&|<>]')) > n
    or (n >= 3 and upper(line) = line and lower(line) <> line)
    or regexp_matches(lower(line), 'all rights reserved|click here|cookie policy|enable javascript|lorem ipsum|privacy policy|sign up for our newsletter|terms of service|terms of use') as bad
  from marked where n > 0
),
by_line as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines,
    count(*) filter (bad) as n_bad_lines, coalesce(sum(n) filter (bad), 0) as lost_words
  from judged group by doc_id
),
placed as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
windows as (
  select doc_id, i, word, lead(word, 1) over p as b, lead(word, 2) over p as c from placed window p as (partition by doc_id order by i)
),
again as (
  select doc_id, i + shift as i from (
    select doc_id, i, count(*) over (partition by doc_id, word, b, c) as times from windows where c is not null
  ), (select unnest([0, 1, 2]) as shift) where times > 1
),
repeated as (select doc_id, count(distinct i) as n_repeat_words from again group by doc_id),
counted as (
  select d.doc_id, cast(len(w) as bigint) as n_words,
    cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_bad_lines, 0) as bigint) as n_bad_lines,
    cast(coalesce(lost_words, 0) as bigint) as lost_words
  from d left join by_line using (doc_id) left join repeated using (doc_id)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_words <= 50 * n_words as kept
from counted
"""

# DuckDB has SHA-1 in base 16; 32 letters of five bits make the base-32 form of its 160 bits.
OP8_SQL = r"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as hex from pages),
first as (select hex, min(page_id) as least from p group by hex),
bits as (
  select page_id, string_agg(right(bin(('0x' || hex[i:i]) :: bigint + 16), 4), '' order by i) as b
  from (select page_id, hex, unnest(generate_series(1, 40)) as i from p) group by page_id
),
named as (
  select page_id, string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v:v], '' order by i) as payload_digest from (
    select page_id, i, 1 + 16 * b[5 * i + 1] :: integer + 8 * b[5 * i + 2] :: integer + 4 * b[5 * i + 3] :: integer + 2 * b[5 * i + 4] :: integer + b[5 * i + 5] :: integer as v
    from (select page_id, b, unnest(generate_series(0, 31)) as i from bits)
  ) group by page_id
)
select page_id, octet_length(encode(h)) as payload_bytes, payload_digest,
  case when page_id = least then 'response' else 'revisit' end as record_type,
  case when page_id = least then null else least end as refers_to
from p join first using (hex) join named using (page_id)
"""

OP11_SQL = """
with d as (select row_number() over () as row, doc_id, encode(coalesce(text, '')) as b from documents),
windows as (
  select row, s, sha256(b[s : s + 399]) as w
  from (select row, b, unnest(generate_series(1, octet_length(b) - 399)) as s from d where octet_length(b) >= 400)
),
again as (select row, s from (select row, s, count(*) over (partition by w) as times from windows) where times > 1),
runs as (
  select row, s, sum(fresh) over (partition by row order by s) as run
  from (select row, s, case when s <= lag(s) over (partition by row order by s) + 400 then 0 else 1 end as fresh from again)
),
spans as (select row, run, min(s) as lo, max(s) + 399 as hi from runs group by row, run),
kept as (
  select row, string_agg(hex(b[lo : hi]), '' order by lo) as kept from (
    select row, hi + 1 as lo, lead(lo, 1, 2000000000) over (partition by row order by lo) - 1 as hi from spans
    union all select row, 1, min(lo) - 1 from spans group by row
  ) join d using (row) where hi >= lo and lo <= octet_length(b) group by row
),
lost as (select row, sum(hi - lo + 1) as n_removed, count(*) as n_spans from spans group by row)
select doc_id, octet_length(b) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  case when n_removed is null then sha256(b) else sha256(unhex(coalesce(kept, ''))) end as kept_sha256
from d left join lost using (row) left join kept using (row)
"""

OP12_SQL = r"""
with d as (
  select row_number() over () as row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
),
c as (select count(*) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from d where len(terms) > 0),
held as (select row, term, count(*) as tf from (select row, unnest(terms) as term from d) group by row, term),
asked as (
  select distinct item_id, text, term from (
    select item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark
  )
),
weighed as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w
  from held, c where term in (select term from asked) group by term, n_docs
),
scored as (
  select item_id, text, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * cast(len(terms) as bigint) * n_docs) // n_terms)))) as score
  from asked join weighed using (term) join held using (term) join d using (row), c group by item_id, text, row
),
ranked as (
  select item_id, doc_id, score, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank
  from scored join d using (row) where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from ranked where rank <= 10
"""


@query("op1_quality_rules", OP1_SQL)
def op1_quality_rules(spark, folder):
    return quality_report(table(spark, folder, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark, folder):
    return count_tokens(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024)


@query("op3_sentencepiece_sampling")
def op3_sentencepiece_sampling(spark, folder):
    return encode_digest(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, folder):
    lengths = token_lengths(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pack_documents(lengths.selectExpr("doc_id", "n_tokens + 1 as n_tokens"))


@query("op5_nearest_neighbours")
def op5_nearest_neighbours(spark, folder):
    return nearest(table(spark, folder, "embeddings"))


@query("op6_quality_model")
def op6_quality_model(spark, folder):
    return score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_token_files")
def op7_token_files(spark, folder):
    return token_stream(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op8_warc_index", OP8_SQL)
def op8_warc_index(spark, folder):
    index = capture_index(table(spark, folder, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_language_id")
def op9_language_id(spark, folder):
    return identify(table(spark, folder, "documents"))


@query("op10_jaccard_join")
def op10_jaccard_join(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))


@query("op11_repeats", OP11_SQL)
def op11_repeats(spark, folder):
    return repeated_spans(table(spark, folder, "documents")).drop("spans")


@query("op12_lexical_search", OP12_SQL)
def op12_lexical_search(spark, folder):
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_whitening")
def op13_whitening(spark, folder):
    whitened = whiten(table(spark, folder, "embeddings"))
    return whitened.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
