"""WARC archives of page captures, and their index merged from locally sorted runs.

Writing: one record per capture, a ``response`` or, for a payload that an earlier page has, a ``revisit`` without it.
Both carry the HTTP header with the payload's length, and its digest. Spark's own text writer puts the records into
files, a record a row with the record end as line separator, so files land wherever Spark can write.

Index: each archive file gives one run of entries, sorted by URL key and time. Runs are cut at the same keys into
ranges, and each range is one task that merges its slices of all runs with a loser tree, so the ranges in order are
the captures of all archives in order of URL key, time and record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.session import new_table_path, settle

RECORD_END = "\r\n\r\n"
FILE_BYTES = 16 * 1024 * 1024
#: Payloads of fewer bytes are always stored, never revisited.
LEAST_REVISITED = 0
RANGE_ENTRIES = 200_000
LAST_SECOND = 253_402_300_799
ENTRY = (
    "page_id long, url string, url_key string, ts long, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, file string, offset long, length long"
)
ENTRY_NAMES = [f.split()[0] for f in ENTRY.split(", ")]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """A URL in sort order: host labels from the last, then path and query; scheme, ``www.`` and fragment go."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    port_part = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return f"{labels}{port_part}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(page_id: int, url: str, ts: int, payload: str, refers_to: int | None, named: str) -> str:
    """One record's text without the end that separates records."""
    size = len(payload.encode())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http + payload if refers_to is None else http
    when = datetime.fromtimestamp(ts, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x1f\x7f]', '', url)}",
        f"WARC-Date: {when}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{named}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {size * (refers_to is None) + len(http)}", "", block])


def captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, ts, html`` with nulls as empty text.

    Without a column ``ts`` of seconds, or where it holds no second of a year up to 9999, a page's time is its id in
    seconds.
    """
    ts = F.col("ts").try_cast("long") if "ts" in pages.columns else F.lit(None).cast("long")
    ts = F.when(ts.between(0, LAST_SECOND), ts)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(ts, F.pmod(F.col("page_id").cast("long"), F.lit(1 << 32)), F.lit(0)).alias("ts"),
        F.coalesce("html", F.lit("")).alias("html"),
    )


def _sha() -> Column:
    return F.unhex(F.sha1(F.col("html").cast("binary")))


def revisits(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """``page_id, sha, refers_to`` of the captures whose payload a smaller page_id has. Only digests are shuffled.

    Copies are counted before the shuffle; a payload that a third of the pages share is one row a task there, and in
    the join Spark splits its pages among tasks.
    """
    named = captures(pages).where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least))
    named = settle(named.select("page_id", _sha().alias("sha")), "page-digests")
    first = named.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.join(first, "sha").where("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISITED, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per page, in gzipped files of about ``file_bytes`` of pages each.

    Equal payloads: the smallest page_id is the response. Repeated rows with that page_id are responses too, since a
    record can't refer to itself. Null url or html count as empty; a null page_id is written as a response with no id.
    An empty table writes no record. Pages move once, dealt to as many files by id and payload, where they meet the
    narrow table of revisits dealt alike, at every size. Only rows equal in both always share a file.
    """
    pages = captures(pages)
    total = pages.agg(F.sum(F.octet_length("html") + 600)).first()[0] or 0
    dealt = max(1, -(-total // file_bytes)), "page_id", "sha"
    again = settle(revisits(pages, least), "revisits").repartition(*dealt).hint("shuffle_hash")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = zip(*(batch[c].slice(at, 500).to_pylist() for c in ("page_id", "url", "ts", "html", "refers_to")))
                texts = [
                    record("" if page is None else page, url, ts, html, refers, digest(html.encode()))
                    for page, url, ts, html, refers in rows
                ]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string()).cast(pa.string())], names=["value"])

    (
        pages.withColumn("sha", _sha())
        .repartition(*dealt)
        .join(again, ["page_id", "sha"], "left")
        .select("page_id", "url", "ts", "html", "refers_to")
        .mapInArrow(records, "value string")
        .write.option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .text(path)
    )


HEADER = re.compile(rb"([A-Za-z-]+): *([^\r\n]*)")


def parsed(data: bytes, name: str) -> Iterator[tuple]:
    """Entries of the records of one archive; the payload's size and digest are of the payload that is read back."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        head = {k.lower(): v.decode() for k, v in HEADER.findall(data[at:body])}
        size = int(head[b"content-length"])
        block = data[body : body + size]
        http = block.index(b"\r\n\r\n") + 4
        payload = block[http:]
        kind = head[b"warc-type"]
        told = head[b"warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and digest(payload) != told:
            raise ValueError(f"{name}, byte {at}: the payload does not have the digest of its record")
        length = int(dict(HEADER.findall(block[:http]))[b"Content-Length"])
        page, refers = (head.get(k, "").removeprefix("<urn:page:").rstrip(">") for k in (b"warc-record-id", b"warc-refers-to"))
        url = head[b"warc-target-uri"]
        ts = int(datetime.strptime(head[b"warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())
        yield (
            int(page) if page else None, url, url_key(url), ts, kind, int(refers) if refers else None, length, told, name, at,
            body + size - at,
        )
        at = body + size + len(RECORD_END)


def _order(entry: tuple) -> tuple:
    """Sort key of an entry: URL key, time, page_id (null first), file and place."""
    return entry[2], entry[3], entry[0] is not None, entry[0] or 0, entry[8], entry[9]


def read_archives(spark, path: str) -> DataFrame:
    """The run of every archive file: its entries (columns in ``ENTRY``), sorted by URL key and time."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"]):
                data = zlib.decompress(content.as_buffer(), 31)
                entries = sorted(parsed(data, name.rsplit("/", 1)[-1]), key=_order)
                for at in range(0, len(entries), 10_000):
                    yield _batch(entries[at : at + 10_000])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(runs, ENTRY)


def _batch(entries: list[tuple], names: list[str] = ENTRY_NAMES) -> pa.RecordBatch:
    strings = {"url", "url_key", "record_type", "payload_digest", "file"}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.string() if n in strings else pa.int64()) for n, c in zip(names, zip(*entries))], names=names
    )


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """The entries of sorted runs in order, by a loser tree: each inner node holds the run that lost there."""
    k = max(1, len(runs))
    iters = [iter(r) for r in runs]
    heads = [next(it, None) for it in iters]
    keys = [None if h is None else (_order(h), r) for r, h in enumerate(heads)]
    losers = [-1] * k

    def beats(a: int, b: int) -> bool:
        return keys[b] is None or (keys[a] is not None and keys[a] < keys[b])

    def play(run: int) -> int:
        """Send a run up from its leaf; whoever loses stays at the node, the winner goes on."""
        node = (run + k) // 2
        while node:
            if losers[node] == -1 and not built:
                losers[node] = run
                return -1
            if beats(losers[node], run):
                losers[node], run = run, losers[node]
            node //= 2
        return run

    built, winner = False, 0
    for run in range(len(runs)):
        found = play(run)
        winner = found if found != -1 else winner
    built = True
    while runs and keys[winner] is not None:
        yield heads[winner]
        heads[winner] = next(iters[winner], None)
        keys[winner] = None if heads[winner] is None else (_order(heads[winner]), winner)
        winner = play(winner)


def merge_index(runs: DataFrame) -> DataFrame:
    """All entries in ranges of URL key and time, merged from the runs; the rows of each partition are in order.

    ``part`` and ``place`` order the rows of the whole index. Captures of one URL are spread over ranges by their
    time and id, so a URL with a third of the captures is no single task's work.
    """
    n = max(1, -(-runs.count() // RANGE_ENTRIES))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        by_file: dict[str, list[tuple]] = {}
        for batch in batches:
            for entry in zip(*(batch[c].to_pylist() for c in ENTRY_NAMES)):
                by_file.setdefault(entry[8], []).append(entry)
        part, place, held = TaskContext.get().partitionId(), 0, []
        for entry in merged(list(by_file.values())):
            held.append((*entry, part, place))
            place += 1
            if len(held) == 10_000:
                yield _batch(held, [*ENTRY_NAMES, "part", "place"])
                held = []
        if held:
            yield _batch(held, [*ENTRY_NAMES, "part", "place"])

    ranged = runs.repartitionByRange(n, "url_key", "ts", "page_id", "file", "offset")
    return ranged.sortWithinPartitions("file", "url_key", "ts", F.asc_nulls_first("page_id"), "offset").mapInArrow(
        merge, f"{ENTRY}, part long, place long"
    )


def capture_index(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """Write the archives below the shared folder, read them back, and return the merged index of their records."""
    spark = pages.sparkSession
    path = new_table_path(spark, "archives")
    write_archives(pages, path, least)
    return merge_index(settle(read_archives(spark, path), "index-runs"))
