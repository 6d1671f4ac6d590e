"""Line-first cleaning of documents.

Every line is judged alone by the punctuation, navigation, markup, capitals and boilerplate rules. Failing lines go,
and a document that loses too large a share of its words with them goes as a whole. Beside that stand the base counts
of the whole text: a document of too few words, or mostly of repeated three-word windows, is refused whatever its lines.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brickline.llm.shared import WORD, only, portions, texts_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_SHARE = 50
MAX_LOST_SHARE = 50
SEPARATOR = re.compile(r"[|»›·•]")
SENTENCE_MARK = re.compile(r"[.!?…。！？]")
SHOUT = re.compile(r"[!?]")
# Phrases of page furniture, in lower case.
BOILERPLATE = [
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "terms of service",
    "terms of use",
]
BOILERPLATE_LINE = re.compile("|".join(BOILERPLATE))
REPORT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_lines long, n_bad_lines long, lost_words long, kept boolean"
)


def line_fails(line: str, n_words: int) -> bool:
    """Whether a line with words breaks a rule: no sentence mark, shouting marks, separators, markup, capitals, phrases."""
    if SENTENCE_MARK.search(line) is None:
        return True
    if n_words >= 3 and 2 * len(SHOUT.findall(line)) >= n_words:
        return True
    separators = len(SEPARATOR.findall(line))
    if separators >= 2 and 5 * separators >= n_words:
        return True
    if 2 * sum(map(line.count, SYMBOLS)) > n_words:
        return True
    if n_words >= 3 and line.upper() == line and line.lower() != line:
        return True
    return BOILERPLATE_LINE.search(line.lower()) is not None


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, windows, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[windows] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def judge(text: str) -> tuple[tuple, str]:
    """The report of a text without its doc_id, and the text without its failing lines."""
    words = WORD.findall(text)
    n_words, seen, n_lines, n_dup, n_bad, lost, left = len(words), set(), 0, 0, 0, 0, []
    for line in text.split("\n"):
        here = len(WORD.findall(line))
        if here:
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
            if line_fails(line, here):
                n_bad += 1
                lost += here
                continue
        left.append(line)
    repeated = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED_SHARE * n_words
    kept = not failed and 100 * lost <= MAX_LOST_SHARE * n_words
    report = (n_words, sum(map(len, words)), sum(map(text.count, SYMBOLS)), n_dup, repeated, failed, n_lines, n_bad, lost, kept)
    return report, "\n".join(left)


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and verdict (columns in ``REPORT``).

    A null text has no words, so it fails the base rules like an empty one. Each row stands alone: repeated rows get
    equal reports, extra columns are left behind and an empty table gives an empty one.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in REPORT.split(", ")]
        for batch in portions(batches):
            rows = [judge(t)[0] for t in batch["text"].to_pylist()]
            columns = [batch["doc_id"], *(pa.array(c) for c in zip(*rows))]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts_of(docs).mapInArrow(report, REPORT)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The kept documents with all their columns; ``text`` without its failing lines and ``n_chars`` to match.

    A column ``n_chars`` is changed only where there is one, and keeps its type.
    """
    names, schema = docs.columns, docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("rules", dict)
        for batch in portions(batches):
            judged = [judge(t or "") for t in batch["text"].to_pylist()]
            keep = [k for k, (report, _) in enumerate(judged) if report[-1]]
            texts = [judged[k][1] for k in keep]
            out = batch.take(pa.array(keep, pa.int64()))
            columns = dict(zip(names, out.columns))
            columns["text"] = pa.array(texts, batch["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(list(map(len, texts)), pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(clean, schema)
