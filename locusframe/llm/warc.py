"""WARC archives and their capture index.

Writing: every page becomes a WARC/1.1 record, a response or, where a response with an equal payload exists, a revisit of it.
Spark's own text writer writes the records of a task to archive files (a record ends with two line ends, which is the
writer's line separator), so files appear whole or not at all when tasks are lost.

Reading: an archive is read from its record headers, and its captures are sorted by URL key and time into a run. Runs are cut
into ranges of keys; the task of a range merges its pieces of all runs with a loser tree, so ranges read in order are the
capture histories of all URLs in one global order. A URL may hold most captures: ranges are cut by key, time and
record number, so that its history spans several of them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from locusframe.llm.common import materialise
from locusframe.session import scratch_dir

# Payload bytes of one archive file, on average, and captures of one merged range.
ARCHIVE_BYTES, RANGE_ROWS = 32 << 20, 100_000
# Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8: ten hexadecimal digits at a time make eight digits of base 32."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _BASE32_HEX, _BASE32)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the top down, then port, path and query, lower case; null is the empty key."""

    @arrow_udf("string")
    def key(urls: pa.Array) -> pa.Array:
        return pa.array([_url_key(u or "") for u in urls.to_pylist()], pa.string())

    return key(url)


def _url_key(url: str) -> str:
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    default = {"http": 80, "https": 443}.get(parts.scheme)
    return f"{labels}{'' if port in (None, default) else f':{port}'}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _line(text: Column) -> Column:
    """A header value: line ends and other controls, which would end the header, are percent-encoded blanks."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1F\x7F]", "%20")


def write_archives(pages: DataFrame, path: str, captured: Column, minimum: int = 0) -> None:
    """Write a record per row of ``page_id, url, html`` under ``path``.

    Payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least ``minimum`` bytes the one with the largest
    ``page_id`` is a response, and so are rows that repeat its id; the others are revisits, without payload, that name it. Smaller
    payloads are always responses. Null ids are smaller than all others. ``captured`` is the time of capture.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"), captured.cast("timestamp").alias("captured"))
    rows = rows.withColumn("digest", payload_digest(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    # one row per payload that several records share; joined by digest and length, without a limit on a payload's copies
    groups = rows.groupBy("digest", "bytes").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.where((F.col("n") > 1) & (F.col("bytes") >= minimum) & F.col("first_id").isNotNull()).drop("n"))
    both = rows.join(groups, ["digest", "bytes"], "left")
    is_revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))

    def record_id(page: str) -> Column:
        digest = F.sha1(F.concat(F.lit("page:"), F.coalesce(F.col(page).cast("string"), F.lit("null"))))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
                        F.lit(">"))

    headers = [
        (F.lit("WARC-Type"), F.when(is_revisit, "revisit").otherwise("response")),
        (F.lit("WARC-Record-ID"), record_id("page_id")),
        (F.lit("WARC-Date"), F.date_format(F.coalesce("captured", F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        (F.lit("WARC-Target-URI"), _line(F.col("url"))),
        (F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), F.col("digest"))),
        (F.lit("Content-Type"), F.lit("text/html; charset=utf-8")),
        (F.lit("X-Page-ID"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        (F.lit("X-Payload-Length"), F.col("bytes").cast("string")),
        (F.lit("WARC-Profile"), F.when(is_revisit, REVISIT_PROFILE)),
        (F.lit("WARC-Refers-To"), F.when(is_revisit, record_id("first_id"))),
        (F.lit("X-Refers-To-Page-ID"), F.when(is_revisit, F.col("first_id").cast("string"))),
        (F.lit("Content-Length"), F.when(is_revisit, "0").otherwise(F.col("bytes").cast("string"))),
    ]
    head = F.concat_ws(END, F.lit(VERSION), *(F.when(value.isNotNull(), F.concat(name, F.lit(": "), value)) for name, value in headers))
    value = F.concat(head, F.lit(2 * END), F.when(is_revisit, "").otherwise(F.col("html")))
    mean = rows.select(F.avg("bytes")).first()[0] or 1
    records = max(1, int(ARCHIVE_BYTES / (mean + 600)))
    both.select(value.alias("value")).write.mode("errorifexists").option("lineSep", 2 * END).option("maxRecordsPerFile", records).option(
        "compression", "gzip").text(path)


def _records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Position, headers and block of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(END)
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n" or len(block) != size:
            raise ValueError(f"the record at byte {at} is cut short")
        yield at, head, block
        at = end + 8 + size


_CAPTURE = ("run string, position long, page_id long, url string, url_key string, captured string, record_type string, payload_bytes long, "
            "payload_digest string, refers_to long")
_CAPTURE_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_NAMES = [c.split()[0] for c in _CAPTURE.split(", ")]


def _order(capture: tuple) -> tuple:
    """Key of the global order: URL key, time, page id (null first), and for rows that repeat an id the payload's digest."""
    return capture[4], capture[5], capture[2] is not None, capture[2] or 0, capture[8]


def _read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Captures of each archive, as a locally sorted run. Digests and lengths of responses are taken from the payload as read."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = content.as_py()
            run = []
            for at, head, block in _records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                page = int(head["X-Page-ID"]) if head["X-Page-ID"] else None
                url = head["WARC-Target-URI"]
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(head["X-Payload-Length"])
                refers = int(head["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in head else None
                if head["WARC-Type"] == "response":
                    read = base64.b32encode(hashlib.sha1(block).digest()).decode()
                    if read != digest:
                        raise ValueError(f"payload at byte {at} of {path} doesn't have its digest")
                    size = len(block)
                run.append((path, at, page, url, _url_key(url), head["WARC-Date"], head["WARC-Type"], size, digest, refers))
            run.sort(key=_order)
            for k in range(0, len(run), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*run[k : k + 10_000]), _CAPTURE_TYPES)], _NAMES)


class LoserTree:
    """K-way merge of sorted iterators. Inner nodes hold the losers of their matches; a step replays one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key = runs, key
        self.heads = [self._next(k) for k in range(len(runs))]
        self.losers = [-1] * len(runs)
        self.winner = -1
        for k in range(len(runs)):
            self._enter(k)

    def _next(self, k: int):
        row = next(self.runs[k], None)
        return None if row is None else (self.key(row), k, row)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; an exhausted run loses, ties go to the earlier run."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _enter(self, k: int) -> None:
        """First matches: a run climbs until it finds an empty place, where it waits as the loser to be."""
        node = (k + len(self.runs)) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = k
                return
            if self._beats(self.losers[node], k):
                k, self.losers[node] = self.losers[node], k
            node //= 2
        self.winner = k

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            k = self.winner
            yield self.heads[k][2]
            self.heads[k] = self._next(k)
            node = (k + len(self.runs)) // 2
            while node:
                if self._beats(self.losers[node], k):
                    k, self.losers[node] = self.losers[node], k
                node //= 2
            self.winner = k


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a range's pieces of the runs, which arrive run by run in their order; adds ``range`` and ``place``."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    pieces: dict[str, list[pa.RecordBatch]] = {}
    for batch in batches:
        runs = batch.column(0).to_pylist()
        start = 0
        for k in range(1, len(runs) + 1):
            if k == len(runs) or runs[k] != runs[start]:
                pieces.setdefault(runs[start], []).append(batch.slice(start, k - start))
                start = k

    def rows(own: list[pa.RecordBatch]) -> Iterator[tuple]:
        for piece in own:
            for k in range(0, len(piece), 1024):
                yield from zip(*(c.to_pylist() for c in piece.slice(k, 1024).columns))

    merged, place, out = LoserTree([rows(own) for own in pieces.values()], _order), 0, []

    def batch_of(out: list[tuple], place: int) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(_NAMES)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(list(c), t) for c, t in zip(cols, _CAPTURE_TYPES)), pa.array([number] * len(out), pa.int32()),
             pa.array(range(place, place + len(out)), pa.int64())], [*_NAMES, "range", "place"])

    for capture in merged:
        out.append(capture)
        if len(out) == 8192:
            yield batch_of(out, place)
            place, out = place + len(out), []
    yield batch_of(out, place)


def read_index(spark, path: str) -> DataFrame:
    """The captures of all archives under ``path`` in global order of URL key, time, page id and digest.

    Columns: those of a capture (archive ``run`` and ``position`` of the record in its uncompressed bytes, ``page_id, url, url_key, captured,
    record_type, payload_bytes, payload_digest, refers_to``), the ``range`` that merged it and its ``place`` in the whole
    order, from 0. Ranges count their own captures as they merge; a row per range gives where each starts. No archives give no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")
    runs = materialise(files.mapInArrow(_read_runs, _CAPTURE))
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    order = ["url_key", "captured", "page_id", "payload_digest"]
    pieces = runs.repartitionByRange(ranges, *order).sortWithinPartitions("run", *order)
    merged = materialise(pieces.mapInArrow(_merge, _CAPTURE + ", range int, place long"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(merged.groupBy("range").agg(F.count(F.lit(1)).alias("_n")).select(
        "range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return merged.join(starts, "range").withColumn("place", F.col("_start") + F.col("place")).select(*_NAMES, "range", "place")


def archive_round_trip(pages: DataFrame, captured: Column, minimum: int = 0, path: str | None = None) -> DataFrame:
    """Write the archives (into the shared scratch folder where no path is given), read them back, and index them."""
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, captured, minimum)
    return read_index(spark, path)
