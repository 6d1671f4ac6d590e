from __future__ import annotations

import re
from collections import Counter

from brickline.llm.quality_rules import clean_documents, judge, quality_report

GOOD = "This is a plain sentence with quite a few different words in it, number {}."


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    covered = {i + s for i, w in enumerate(windows) if times[w] > 1 for s in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_a_plain_version(spark, odd_documents):
    rows = odd_documents.select("doc_id", "text").collect()
    got = sorted((tuple(r)[0] or -1, tuple(r)[1:6]) for r in quality_report(odd_documents).collect())
    assert got == sorted((r["doc_id"] or -1, plain_counts(r["text"])) for r in rows)


def test_each_rule_fails_its_line():
    for line in (
        "no sentence mark at all here", "STOP!! NOW!! HERE!!", "Home | About | News | More.", "a*** b### c$$$.",
        "ALL OF THIS IS IN CAPITALS.", "Read our Privacy Policy today.",
    ):
        assert judge(line)[0][7] == 1, line
    assert judge(GOOD.format(1))[0][7] == 0


def test_lines_go_and_documents_that_lose_too_much_go(documents):
    good = "\n".join(" ".join(f"{w}{k}" for w in "some ten words that no other line of this has".split()) + "." for k in range(8))
    menu = "Home | About | News | More"
    junk = "\n".join(f"menu{k} | item{k} | more{k} | last{k}" for k in range(40))
    docs = documents((1, good + "\n" + menu), (2, junk), (3, "too short."), (4, good + "\n" + good), (5, None))
    kept = {r["doc_id"]: r for r in clean_documents(docs).collect()}
    assert set(kept) == {1}
    assert kept[1]["text"] == good and kept[1]["n_chars"] == len(good)
    assert clean_documents(docs).columns == docs.columns


def test_empty_table(documents, spark):
    assert quality_report(documents((1, "a")).where("false")).collect() == []


def test_odd_rows_pass_through_with_their_columns(odd_documents):
    assert clean_documents(odd_documents).columns == odd_documents.columns
    clean_documents(odd_documents).collect()
