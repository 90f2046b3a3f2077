"""WARC archives and their capture index.

Pages become WARC/1.1 records: a response with the payload, or a revisit (identical payload digest) that refers to the response of an equal payload. Each record
is a gzip member of its own, so that a reader may begin at any; archives are cut by their bytes. Spark's text sink writes them to a folder that the whole
cluster sees, with an empty gzip member as line separator, so its commit protocol covers lost executors.

Reading parses the archives by Content-Length and checks every payload's digest. Each archive gives a run of captures, sorted by URL key and time and written to scratch.
The merge is external: range partitioning by (URL key, time, id) deals the runs to tasks in global order, Spark's sorter, which spills, puts a task's piece of each run
in a row, and the task merges the k pieces with a loser tree, so the output is a globally ordered capture history. A URL key of any number of captures may cross
tasks; a task holds about `rows_a_task` rows of the index, and no payload.

Defined results: a null payload is empty; a null url has the empty key; of equal payloads of `least` bytes and more the
rows with the largest id are responses (all of them, if the id repeats, or if no row has one) and the others refer to it; smaller payloads are all
responses; a row without an id among larger ones revisits; line breaks and blanks in a url are percent-encoded; an empty table gives an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import zlib
from collections.abc import Iterator
from datetime import datetime
from typing import Any
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onceflow.llm.common import materialize, scratch_path

END = "\r\n\r\n"
#: Level of compression, and a gzip member of nothing.
LEVEL = 6
EMPTY = gzip.compress(b"", mtime=0)
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "url_key string, captured long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
KEY = ("url_key", "captured", "page_id")
#: Compressed bytes that are read at a time.
CHUNK = 1 << 16
#: Rows whose keys a cursor of the merge holds.
BLOCK = 512


def roles(pages: DataFrame, least: int) -> DataFrame:
    """Pages with payload, bytes, digest, and refers_to: the largest id with an equal payload, null for a response."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), payload.alias("payload"))
    p = p.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    slim = p.where(F.col("bytes") >= least).select("page_id", F.col("digest").alias("d"))
    # only digests that occur twice matter; a count and a maximum combine before the shuffle
    shared = slim.groupBy("d").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("d", "top")
    p = p.join(shared, (F.col("digest") == F.col("d")) & (F.col("bytes") >= least), "left")
    return p.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))).drop("d", "top")


def record(captured: Column) -> Column:
    """A WARC record without its last separator."""
    revisit = F.col("refers_to").isNotNull()
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]+", "%20")
    length = F.when(revisit, F.lit(len(HTTP))).otherwise(F.col("bytes") + len(HTTP))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    head = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Target-URI", url), line("WARC-Date", F.date_format(F.timestamp_seconds(captured), "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")), F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit(END + HTTP),
    )
    return F.concat(head, F.when(revisit, "").otherwise(F.col("payload")))


def write_warc(pages: DataFrame, path: str, captured: Column | None = None, least: int = 1000, file_bytes: int = 64 << 20) -> None:
    """Writes archives of file_bytes each, or of one larger record. captured: seconds since 1970; by default a second a page id after 2024-01-01."""
    captured = F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(10**9)) if captured is None else captured

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = size = n = 0
        for b in batches:
            files, members = [], []
            for value in b.column(0):
                member = gzip.compress((value.as_py() + END).encode(), LEVEL, mtime=0)
                if size and size + len(member) > file_bytes:
                    file, size = file + 1, 0
                size += len(member) + len(EMPTY)
                files.append(file)
                members.append(member)
            seq = pa.array(range(n, n + len(members)), pa.int64())
            n += len(members)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), seq, pa.array(members, pa.binary())], ["file", "seq", "value"])

    out = roles(pages, least).select(record(captured).alias("value")).mapInArrow(run, "file long, seq long, value binary")
    out = out.sortWithinPartitions("file", "seq").select("file", F.col("value").cast("string").alias("value"))
    out.write.partitionBy("file").option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


def url_key(url: str) -> str:
    """Host parts reversed, then path and query: com,example)/path?query."""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").split(".")
    except ValueError:
        return url
    return ",".join(reversed(host)) + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "") if u.hostname else url


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, offset) of each record of an archive's uncompressed bytes."""
    at, end = 0, END.encode()
    while at < len(raw):
        stop = raw.index(end, at)
        first, *lines = raw[at:stop].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        block = raw[stop + 4 : stop + 4 + size]
        if len(block) != size or raw[stop + 4 + size : stop + 8 + size] != end:
            raise ValueError(f"the record at byte {at} does not end after {size} bytes")
        yield headers, block, at
        at = stop + 8 + size


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the members of a gzip file that hold something."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        d = zlib.decompressobj(31)
        out, step = [], at
        while not d.eof:
            if step >= len(data):
                raise ValueError(f"the member at byte {at} has no end")
            out.append(d.decompress(view[step : step + CHUNK]))
            step += CHUNK
        step = min(step, len(data)) - len(d.unused_data)
        if content := b"".join(out):
            yield at, content
        at = step


def capture(headers: dict[str, str], block: bytes) -> tuple[Any, ...]:
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        payload = block[block.index(END.encode()) + 4 :]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(headers[name][10:-1]) if headers.get(name, "<urn:page:none>") != "<urn:page:none>" else None
    captured = int(datetime.fromisoformat(headers["WARC-Date"].replace("Z", "+00:00")).timestamp())
    return url_key(headers["WARC-Target-URI"]), captured, number("WARC-Record-ID"), int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], number("WARC-Refers-To")


def _order(row: tuple[Any, ...]) -> tuple[Any, ...]:
    """Nulls first, as Spark sorts; URL keys by their UTF-8 bytes."""
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each archive's captures, sorted."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    types = {"string": pa.string(), "long": pa.int64()}
    kinds = [types[c.split()[1]] for c in INDEX.split(", ")]
    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            *_, folder, name = path.as_py().split("/")
            name = f"{folder}/{name}" if folder.startswith("file=") else name
            rows = sorted(((*capture(h, block), name, at) for at, raw in members(content.as_py()) for h, block, _ in parse(raw)), key=_order)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class LoserTree:
    """Merges k sorted iterators: the losers of a tournament stay at the inner nodes, so each row costs one path of log2(k) comparisons."""

    def __init__(self, runs: list[Iterator[Any]], key: Any):
        self.key, self.runs, self.k = key, runs, max(1, len(runs))
        self.rows: list[Any] = [next(r, None) for r in runs] or [None]
        self.keys = [None if r is None else key(r) for r in self.rows]
        self.tree = [-1] * self.k  # tree[0]: the winner
        for run in range(self.k):
            self._replay(run)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; ended runs come last, ties to the earlier run."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _replay(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            if self.tree[node] < 0:  # while building: wait here for the opponent
                self.tree[node] = run
                return
            if self._beats(self.tree[node], run):
                self.tree[node], run = run, self.tree[node]
            node //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator[Any]:
        while (row := self.rows[run := self.tree[0]]) is not None:
            yield row
            self.rows[run] = following = next(self.runs[run], None)
            self.keys[run] = None if following is None else self.key(following)
            self._replay(run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the pieces of runs in a task's rows, which come archive by archive, each in order."""
    parts = list(batches)
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    archive = t["archive"].combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], archive[1:] != archive[:-1]])) if len(t) else np.zeros(0, np.int64)

    def cursor(start: int, end: int) -> Iterator[tuple[tuple[Any, ...], int]]:
        for s in range(start, end, BLOCK):
            block = [t[c].slice(s, min(BLOCK, end - s)).to_pylist() for c in KEY]
            yield from ((_order(k), s + i) for i, k in enumerate(zip(*block, strict=True)))

    tree = LoserTree([cursor(s, e) for s, e in zip(starts, [*starts[1:], len(t)], strict=True)], lambda row: row[0])
    order = (i for _, i in tree)
    while some := list(itertools.islice(order, 8192)):
        yield from t.take(pa.array(some)).to_batches()


def read_index(df: DataFrame, rows_a_task: int = 200_000) -> DataFrame:
    """The capture history of archives, read as binaryFile rows, in global order of (url_key, captured, page_id)."""
    runs = materialize(df.select("path", "content").mapInArrow(_runs, INDEX), "warc-runs")
    tasks = max(1, -(-runs.count() // rows_a_task))
    return runs.repartitionByRange(tasks, *KEY).sortWithinPartitions("archive", *KEY).mapInArrow(_merge, INDEX)


def capture_index(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the pages as archives, reads these back, and gives their merged index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, least=least)
    return read_index(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path))
