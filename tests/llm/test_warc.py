from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import random

from brickline.llm import warc
from brickline.llm.warc import capture_index, merge_index, merged, parsed, read_archives, url_key, write_archives
from brickline.session import new_table_path, settle

PAGES = "page_id long, url string, html string, file string, offset string, ts string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "?", "?", ts) for r, ts in zip(rows, ["?", None, "-5", "99999999999999", "1700000000"] * len(rows))], PAGES)


def entry(key, ts, page, file):
    return (page, "u", key, ts, "response", None, 0, "d", file, 0, 0)


def test_loser_tree_merges_any_runs():
    rng = random.Random(3)
    for k in range(40):
        runs = [sorted((entry(f"k{rng.randrange(9)}", rng.randrange(5), rng.randrange(50), f"f{r}") for _ in range(rng.randrange(7))), key=warc._order) for r in range(rng.randrange(9))]
        assert [warc._order(e) for e in merged(runs)] == sorted(warc._order(e) for run in runs for e in run), k


def test_round_trip_and_revisits(spark):
    html = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>"
    rows = [(3, "http://a.example/x", html), (1, "http://b.example/", html), (2, None, None), (7, "", ""), (9, "http://a.example/y\n", "z" * 300_000),
            (9, "http://a.example/y\n", "z" * 300_000), (None, "http://n.example", html), (11, "http://a.example/x", "z")]
    got = sorted(capture_index(pages(spark, rows)).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    named = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted(((i, len((h or "").encode()), named(h)) for i, _, h in rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert [(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got] == want
    kind = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kind[1] == ("response", None) and kind[3] == ("revisit", 1)
    assert kind[2] == ("response", None) and kind[7] == ("revisit", 2)
    assert kind[9] == ("response", None) and kind[None] == ("response", None)


def test_archives_are_plain_warc(spark):
    path = new_table_path(spark, "warc-test")
    write_archives(pages(spark, [(1, "http://a.example/", "one"), (2, "http://b.example/", "one")]), path)
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/part-*"))
    entries = {e[0]: e for e in parsed(data, "x")}
    head = data[entries[2][9] : entries[2][9] + entries[2][10]]
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n") and b"WARC-Refers-To: <urn:page:1>" in head
    assert data.endswith(b"\r\n\r\n")


def test_index_is_in_global_order(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 20)
    path = new_table_path(spark, "warc-order")
    table = spark.read.parquet(f"{folder}/pages.parquet")
    write_archives(table, path, file_bytes=100_000)
    runs = settle(read_archives(spark, path), "runs")
    index = [tuple(r)[:11] for r in merge_index(runs).orderBy("part", "place").collect()]
    assert len(index) == table.count() and len({e[8] for e in index}) > 1
    assert [warc._order(e) for e in index] == sorted(map(warc._order, index))


def test_archives_are_bounded_whatever_the_join(spark, folder):
    table = spark.read.parquet(f"{folder}/pages.parquet")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (held, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            path = new_table_path(spark, "warc-files")
            write_archives(table, path, file_bytes=20_000)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        sizes = [len(gzip.open(f).read()) for f in glob.glob(f"{path}/part-*")]
        assert len(sizes) >= 8 and max(sizes) < 60_000


def test_one_id_with_two_payloads(spark):
    got = capture_index(pages(spark, [(1, "u", "a"), (2, "u", "b"), (5, "u", "a"), (5, "u", "b"), (5, "u", "c")])).collect()
    assert sorted((r["page_id"], r["refers_to"] or 0) for r in got) == [(1, 0), (2, 0), (5, 0), (5, 1), (5, 2)]


def test_url_keys_sort_by_host_from_the_right():
    assert url_key("HTTPS://www.A.example.com:443/b?q=1#f") == "com,example,a)/b?q=1"
    assert url_key("http://x.example:8080") == "example,x:8080)/"
    assert url_key("http://[bad") == "http://[bad"


def test_small_payloads_are_not_revisited(spark):
    got = capture_index(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), least=3).collect()
    assert {r["page_id"]: r["record_type"] for r in got} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark):
    assert capture_index(pages(spark, [(1, "u", "h")]).where("false")).collect() == []
