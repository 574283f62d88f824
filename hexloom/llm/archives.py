"""WARC archives of pages, and their capture index: sorted runs merged by a loser tree."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, shared_path, with_group

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
#: Page ids are taken as seconds after START, in rounds of this many, so that any of them has a date.
ROUND = 1 << 32
ARCHIVE_BYTES = 16 << 20
ENTRY = "urlkey string, ts string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, archive string, offset long, length long"
_FIELDS = [x.split()[0] for x in ENTRY.split(", ")]


def url_key(url: Column) -> Column:
    """Host labels from the top down, the port if there is one, then the path and query, in lower case: com,example,www:8080)/a?b=1."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^/?#]*?)(:[0-9]*)?(?:[/?#]|$)", 1)
    port = F.regexp_extract(rest, r"^([^/?#]*?)(:[0-9]*)?(?:[/?#]|$)", 2)
    path = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(path == "", "/").otherwise(path))


def _record(page_id: int | None, url: str | None, html: str | None, refers: int | None, digest: str) -> bytes:
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    when = START + timedelta(seconds=(page_id or 0) % ROUND)
    block = http if refers is not None else http + payload
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str) -> Callable:
    """Writes archives of about ARCHIVE_BYTES, each record a gzip member, and returns their names.

    Names are new in every attempt and only a finished task's names are kept, so a task that is run again, or twice at
    once, leaves no record double.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, size = None, "", 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                pack = zlib.compressobj(6, wbits=31)
                member = pack.compress(_record(*row)) + pack.flush()
                out.write(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name])], ["archive"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["archive"])

    return run


#: Compressed bytes that are read, or unpacked, at a time.
WINDOW = 1 << 16


def members(file) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of an archive, read in windows; each byte is unpacked once."""
    at, unpack, parts, window = 0, zlib.decompressobj(wbits=31), [], b""
    read = 0  # bytes of this member so far
    while True:
        if not window:
            window = file.read(WINDOW)
            if not window:
                break
        parts.append(unpack.decompress(window))
        read += len(window) - len(unpack.unused_data)
        window = unpack.unused_data
        if unpack.eof:
            yield at, read, b"".join(parts)
            at, read, unpack, parts = at + read, 0, zlib.decompressobj(wbits=31), []


def records(file) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive."""
    for at, length, raw in members(file):
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield at, length, fields, rest[: int(fields["Content-Length"])]


def _entries(name: str, file) -> Iterator[tuple]:
    """The entries of an archive, digests computed from the payloads themselves."""

    def number(urn: str) -> int | None:
        text = urn.removeprefix("<urn:page:").rstrip(">")
        return int(text) if text else None

    for offset, length, head, block in records(file):
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = head["WARC-Type"]
        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha256:")
        size = len(payload) if kind == "response" else int(http.rpartition(b"Content-Length: ")[2])
        refers = number(head["WARC-Refers-To"]) if kind == "revisit" else None
        ts = "".join(c for c in head["WARC-Date"] if c.isdigit())
        yield None, ts, number(head["WARC-Record-ID"]), kind, size, digest, refers, head["WARC-Target-URI"], name, offset, length


def _indexer(folder: str) -> Callable:
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        kinds = [pa.string() if x.endswith(" string") else pa.int64() for x in ENTRY.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as file:
                    found = _entries(name, file)
                    while rows := list(islice(found, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _FIELDS)

    return run


class LoserTree:
    """Merges sorted runs: each inner node keeps the run that lost there, so a step replays one path to the root."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key = [iter(r) for r in runs], key
        self.size = 1
        while self.size < len(self.runs):
            self.size *= 2
        self.heads: list = [None] * self.size
        self.keys: list = [None] * self.size  # None after a run's end: it loses to all
        for i in range(len(self.runs)):
            self._advance(i)
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else (self.key(self.heads[i]), i)

    def _beats(self, a: int, b: int) -> bool:
        return self.keys[a] is not None and (self.keys[b] is None or self.keys[a] < self.keys[b])

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return winner

    def __iter__(self):
        while self.keys[self.winner] is not None:
            yield self.heads[self.winner]
            winner = self.winner
            self._advance(winner)
            node = (winner + self.size) // 2
            while node:
                if self._beats(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.winner = winner


def _merge(batches) -> Iterator[pa.RecordBatch]:
    """The rows of one key range, run after run and each run sorted: in the order of URL key, time and page."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    runs: list[list[dict]] = []
    last = None
    schema = None
    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            if row["archive"] != last:
                runs.append([])
                last = row["archive"]
            runs[-1].append(row)
    done, at = [], 0
    if runs:
        schema = schema.append(pa.field("part", pa.int64())).append(pa.field("at", pa.int64()))
        for row in LoserTree(runs, lambda r: (r["urlkey"].encode(), r["ts"], r["page_id"] is not None, r["page_id"] or 0, r["offset"])):
            done.append(row | {"part": part, "at": at})
            at += 1
            if len(done) == 10_000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 100) -> DataFrame:
    """Write a WARC record for each row of pages (page_id, url, html) under folder; the names of the archives.

    Of records with equal payloads of ``least_revisit`` bytes or more, that of the least page_id is a response and the
    others revisit it (header block only); smaller ones are all responses. A null html is an empty payload, a null url
    an empty one. A row without an id is a response. Rows that repeat an id are written each, all as what that id is.
    The folder must be one that pyarrow's file systems open (file, hdfs, s3, gs) and that executors share.
    """
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    large = (F.coalesce(F.octet_length("html"), F.lit(0)) >= least_revisit) & F.col("page_id").isNotNull()
    # ids alone are grouped; the pages are joined with those that revisit another, and with nothing but their ids
    several = with_group(x.where(large).select("page_id", "digest").distinct(), ["digest"], "page_id").where("group_id < page_id")
    refers = several.select("page_id", "digest", F.col("group_id").alias("refers"))
    found = x.join(refers, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers", "digest")
    return materialise(map_arrow(found, _writer(folder), "archive string"), "archives")


def capture_history(folder: str, archives: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """The index of the archives: a row for each record, in history_rank's order of URL key, time and page.

    Each archive is read back into one locally sorted run. Runs are cut at the same URL key, time and page bounds
    (sampled by Spark), so a URL that a third of all captures share is cut too; a task holds one range of at most about
    ``range_rows`` entries and merges the runs' pieces of it by a loser tree. Ranks come from the few counts of ranges.
    """
    # an archive is a name here and megabytes there, so each gets a task of its own, or one of a few
    tasks = min(10_000, max(1, archives.count()))
    entries = map_arrow(archives.repartition(tasks, "archive"), _indexer(folder), ENTRY).withColumn("urlkey", url_key(F.col("url")))
    runs = materialise(entries.sortWithinPartitions("archive", "urlkey", "ts", "page_id", "offset"), "runs")
    ranges = max(4, -(-runs.count() // range_rows))
    cut = runs.repartitionByRange(ranges, "urlkey", "ts", "page_id").sortWithinPartitions("archive", "urlkey", "ts", "page_id", "offset")
    merged = materialise(map_arrow(cut, _merge, f"{ENTRY}, part long, at long"), "history")
    counts = merged.groupBy("part").count()
    first = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("first"))
    return merged.join(F.broadcast(first), "part").withColumn("history_rank", F.col("first") + F.col("at")).drop("part", "at", "first")


def op2_archive_index(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives, read back and indexed."""
    folder = shared_path(spark, "warc")
    history = capture_history(folder, write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "history_rank")
