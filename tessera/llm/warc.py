"""WARC archives of captured pages, and their merged index.

Writing: of equal payloads of ``least`` bytes or more, the one with the smallest
id is a ``response`` record, the others are ``revisit`` records that name it.
Which ones is found on ids and digests; payloads are shuffled once, to as many
tasks as there are archives of about ``ARCHIVE`` bytes.  Records are composed by
column expressions and go through Spark's text writer (the line separator is what
ends a WARC record), so any store that Spark reaches will do and a lost task is
written anew.

Reading: each archive is parsed by its record lengths, every payload is hashed
again, and its captures are sorted locally by URL key and time: one run.

Index: tasks own ranges of (URL key, time, id).  A task spools the slices of the
runs that fall into its range to a sequential file and merges them with a loser
tree, ``FAN`` runs at a time, in as many passes as that takes.  Tasks in range
order give the captures in global order.
"""

from __future__ import annotations

import gzip
import hashlib
import pickle
import re
import tempfile
import urllib.parse
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import batches, partitions
from tessera.session import materialize

#: Bytes of an archive, about; runs merged at a time; captures per spooled block.
ARCHIVE, FAN, BLOCK = 8 << 20, 64, 256
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CAPTURE = pa.schema([("run", pa.string()), ("step", pa.int32()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()),
                      ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                      ("payload_digest", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed (``com,example)/path?query``), in
    lower case, without scheme, credentials, fragment, leading ``www`` and
    default port, parameters sorted.  What doesn't parse is its own key."""
    if not url:
        return ""
    try:
        parts = urllib.parse.urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    port = "" if port in (None, 80, 443) else f":{port}"
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{host}{port}){parts.path or '/'}{'?' + query if query else ''}".lower()


def quoted(url: Column) -> Column:
    """The URL with blanks, control characters and ``%`` as ``%XX``."""
    every = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"%{ord(x):02X}")), "%" + "".join(map(chr, range(0x21))) + "\x7f", url)
    return F.when(url.rlike(r"[\x00-\x20\x7f%]"), every).otherwise(url)


def record(page_id: Column, url: Column, captured: Column, payload: Column, size: Column, digest: Column, refers_to: Column) -> Column:
    """One record without the ``END`` that closes it; a revisit (``refers_to``) has no payload."""
    revisit, line = refers_to.isNotNull(), lambda name, x: F.concat(F.lit(f"{name}: "), x)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(size)
    page = lambda i: F.concat(F.lit("<urn:page:"), i, F.lit(">"))
    head = F.concat_ws(  # a null is no line
        "\r\n", F.lit("WARC/1.1"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", page(F.coalesce(page_id.cast("string"), F.lit("-")))), line("WARC-Date", captured),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), F.lit("Content-Type: application/http; msgtype=response"),
        line("WARC-Target-URI", quoted(url)), F.when(revisit, f"WARC-Profile: {PROFILE}"), line("WARC-Refers-To", page(refers_to.cast("string"))),
        line("Content-Length", length.cast("string")))
    return F.concat(head, F.lit(END), http, F.when(revisit, "").otherwise(payload))


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], int, int, int, bytes]]:
    """(WARC headers, offset, length, size by the HTTP header, payload) of each record."""
    at = 0
    while at < len(archive):
        body = archive.index(END.encode(), at) + 4
        first, *lines = archive[at:body - 4].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        stop = body + int(head["Content-Length"])
        start = archive.index(END.encode(), body, stop) + 4
        size = int(re.search(rb"\r\nContent-Length: (\d+)", archive[body:start])[1])
        if archive[stop:stop + 4] != END.encode():
            raise ValueError(f"the record at byte {at} doesn't end where it should")
        yield head, at, stop - at, size, archive[start:stop]
        at = stop + 4


def write(pages: DataFrame, path: str, captured: Column | None = None, least: int = 100,
          id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record per row of ``pages`` to archives below ``path``.

    ``captured``: time of the capture, over ``page_id``; by default a second per
    id from the year 2000 on, as the pages have no time.  A null payload is empty;
    a null id comes after all others and no record refers to it (such copies are
    responses if no copy has an id); rows that repeat the smallest id are all
    responses; a null URL gives a record without target; an empty table gives no archive."""
    id_ = F.col("page_id")
    time = F.timestamp_seconds(946684800 + F.pmod(F.coalesce(id_, F.lit(0)), F.lit(10**9))) if captured is None else captured
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[payload_col], F.lit("")).alias("payload"))
    rows = rows.select("page_id", "url", F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
                       "payload", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    # null ids too have a key
    rows = rows.withColumn("k", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    keys = rows.where(F.col("size") >= least).select("k", "page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    revisits = keys.join(first, "digest").where(~F.col("first").eqNullSafe(F.col("page_id"))).select("k", "digest", F.col("first").alias("refers_to")).distinct()
    total = rows.agg(F.sum(F.col("size") + 512)).first()[0] or 0
    archives = -(-total // ARCHIVE) or 1
    # the revisits of a task are hashed, so its payloads aren't sorted
    rows, revisits = (x.repartition(archives, "k", "digest") for x in (rows, revisits))
    rows = rows.join(revisits.hint("shuffle_hash"), ["k", "digest"], "left")
    value = record(*map(F.col, ("page_id", "url", "captured", "payload", "size", "digest", "refers_to")))
    rows.select(F.format_string("%06d", F.spark_partition_id()).alias("archive"), value.alias("value")) \
        .write.partitionBy("archive").option("lineSep", END).option("compression", "gzip").text(path)


def _order(c: tuple) -> tuple:
    """Of a capture: URL key, time, id (null last)."""
    return c[2].encode(), c[3], c[4] is None, c[4] or 0


def read(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below ``path``: every archive's are sorted,
    ``step`` is the place in that run.  Sizes and digests are those of the whole
    payload, for a revisit those it states; offsets are in the unpacked archive."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                found = []
                for head, offset, length, size, payload in parse(gzip.decompress(content.as_py())):
                    id_ = head["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
                    digest, to = head["WARC-Payload-Digest"].removeprefix("sha256:"), head.get("WARC-Refers-To")
                    if to is None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"the payload of {id_} in {name} isn't what its record states")
                    url = head.get("WARC-Target-URI")
                    url = None if url is None else urllib.parse.unquote(url)
                    found.append((name.as_py(), 0, url_key(url), head["WARC-Date"], None if id_ == "-" else int(id_), url, head["WARC-Type"],
                                  None if to is None else int(to.removeprefix("<urn:page:").removesuffix(">")), size, digest, offset, length))
                found.sort(key=_order)
                if found:
                    yield batches(_CAPTURE, dict(zip(_CAPTURE.names, map(list, zip(*((c[0], i, *c[2:]) for i, c in enumerate(found)), strict=True)), strict=True)))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.regexp_extract("path", "archive=([^/]+)", 1), "content").mapInArrow(run, _ddl(_CAPTURE))


class LoserTree:
    """The items of several sorted iterators in order; equal ones by iterator.

    Node n holds the loser of the match there, node 0 the winner of all; taking
    the winner replays the matches between its leaf and the top."""

    def __init__(self, runs: Iterable[Iterator], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads = [self._next(i) for i in range(len(self.runs))]
        k = len(self.runs)
        self.losers = [-1] * max(k, 1)
        winner = [-1] * k + list(range(k))  # leaves k..2k-1
        for n in range(k - 1, 0, -1):
            a, b = winner[2 * n], winner[2 * n + 1]
            winner[n], self.losers[n] = (a, b) if self._before(a, b) else (b, a)
        self.losers[0] = winner[1] if k else -1

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def __iter__(self) -> Iterator:
        while self.losers[0] >= 0 and self.heads[i := self.losers[0]] is not None:
            yield self.heads[i][2]
            self.heads[i] = self._next(i)
            n = (i + len(self.runs)) // 2
            while n:
                if self._before(self.losers[n], i):
                    self.losers[n], i = i, self.losers[n]
                n //= 2
            self.losers[0] = i


class Spool:
    """Sorted runs in one temporary file, written and read block by block."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def add(self, rows: Iterable[tuple]) -> list[int]:
        """Offsets of the blocks of a new run.  Blocks are added at the end, while others are read."""
        blocks, held = [], []
        for row in rows:
            held.append(row)
            if len(held) == BLOCK:
                blocks.append(self._write(held))
                held = []
        return [*blocks, self._write(held)] if held else blocks

    def _write(self, rows: list[tuple]) -> int:
        at = self.file.seek(0, 2)
        pickle.dump(rows, self.file)
        return at

    def run(self, blocks: list[int]) -> Iterator[tuple]:
        for at in blocks:
            self.file.seek(at)
            yield from pickle.load(self.file)


def merge_runs(rows: Iterable[tuple], fan: int = FAN) -> Iterator[tuple]:
    """Captures that come run by run (the first field names it), each sorted, in order."""
    spool = Spool()
    runs = [spool.add(part) for _, part in groupby(rows, key=itemgetter(0))]
    while len(runs) > fan:
        runs = [spool.add(LoserTree(map(spool.run, runs[i:i + fan]), _order)) for i in range(0, len(runs), fan)]
    return iter(LoserTree(map(spool.run, runs), _order))


def histories(captures: DataFrame, fan: int = FAN) -> DataFrame:
    """The captures of :func:`read` with ``place``, from 0, in the order of URL
    key, time and id (null last); captures that are equal in these come in any order."""
    order = ["url_key", "captured", F.col("page_id").isNull(), "page_id"]
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), *_CAPTURE])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        merged = merge_runs((row for b in it for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), fan)
        for low, rows in enumerate(iter(lambda: list(islice(merged, 4096)), [])):
            values = {"part": [part] * len(rows), "row": [4096 * low + i for i in range(len(rows))]}
            yield batches(schema, values | dict(zip(_CAPTURE.names, map(list, zip(*rows, strict=True)), strict=True)))

    runs = materialize(captures, "capture-runs")
    merged = materialize(runs.repartitionByRange(partitions(runs), *order).sortWithinPartitions("run", "step").mapInArrow(run, _ddl(schema)), "captures")
    counts = merged.groupBy("part").agg(F.count("*").alias("n"))  # one row per task of the merge
    before = counts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("before"))
    return merged.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("row")) \
        .withColumnRenamed("run", "archive").drop("part", "row", "before", "step")
