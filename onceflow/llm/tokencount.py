"""Token counts from flat, unindexed token files by a separator scan.

A token file is nothing but little-endian 16-bit ids; the end-of-document id closes each document. Files file=<number>/part-<stream>-... belong to one
stream of documents in the order of their numbers, which are the places of their first documents. The scan cuts files into
blocks, finds the separators of a block by one vectorised comparison, and keeps the lengths between them. A prefix scan over a
stream's blocks (tokens and separators before each, the last separator so far) then gives the documents that cross block or file boundaries
their lengths, and every document its place in the stream.

Writing tokenises whole texts with a public vocabulary, which the driver reads and ships with the tasks; Spark's text sink puts the separator after each row, and puts the
documents' ids, in the same order, in a folder beside the tokens. Files are cut by their bytes.

Defined results: null and empty texts have 0 tokens; tokens after a stream's last separator count as a last document; an
empty table or file gives no rows; a null id stays null; repeated rows are separate documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onceflow.llm.common import scratch_path, text_chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that the vocabulary's tokenizer splits texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: End of document: the id after the vocabulary's last.
END = 50256
_SEPARATOR = END.to_bytes(2, "little").decode("latin-1")
BLOCK = 1 << 20
#: Bytes of a file, far below what one row of a table can hold.
FILE_BYTES = 64 << 20


def shipped(vocabulary: str | bytes) -> bytes:
    """A vocabulary file's bytes, to go with the tasks, so that no executor needs the file."""
    if isinstance(vocabulary, bytes):
        return vocabulary
    with open(vocabulary, "rb") as f:
        return f.read()


def encoder(vocabulary: str | bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shipped(vocabulary).splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, path: str, vocabulary: str | bytes = VOCABULARY, file_bytes: int = FILE_BYTES) -> None:
    """Writes <path>/kind=tokens and <path>/kind=ids. Each task's documents are one stream; a file holds file_bytes of tokens, or one longer document."""
    words = shipped(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n, first, size = encoder(words), 0, 0, 0
        names = ["kind", "file", "seq", "value"]
        for b in batches:
            for s, e in text_chunks(b.column(1)):
                ids, texts = b.column(0).slice(s, e - s).to_pylist(), b.column(1).slice(s, e - s)
                values = [enc.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype("<u2").tobytes() for text in texts]
                files = []
                for i, v in enumerate(values):
                    if size and size + len(v) > file_bytes:
                        first, size = n + i, 0
                    size += len(v) + 2
                    files.append(first)
                at, n = [pa.array(files, pa.int64()), pa.array(np.arange(n, n + len(values)))], n + len(values)
                names_of = [b"" if i is None else b"i" + i.encode().hex().encode() for i in ids]
                yield pa.RecordBatch.from_arrays([pa.array(["tokens"] * len(values)), *at, pa.array(values, pa.binary())], names)
                yield pa.RecordBatch.from_arrays([pa.array(["ids"] * len(ids)), *at, pa.array(names_of, pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "kind string, file long, seq long, value binary")
    rows = rows.sortWithinPartitions("kind", "file", "seq").select("kind", "file", F.col("value").cast("string").alias("value"))
    rows.write.partitionBy("kind", "file").option("encoding", "ISO-8859-1").option("lineSep", _SEPARATOR).text(path)


def _blocks(size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, part, content in zip(*b.columns, strict=True):
                tokens = np.frombuffer(content.as_buffer(), "<u2")
                for n, at in enumerate(range(0, len(tokens), size)):
                    block = tokens[at : at + size]
                    found = np.flatnonzero(block == end)
                    few = lambda v: pa.array([int(v[0])] if len(v) else [None], pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([stream.as_py()], pa.int32()), pa.array([part.as_py()], pa.int64()), pa.array([n], pa.int32()), pa.array([len(block)], pa.int64()), pa.array([len(found)], pa.int64()),
                        few(found), few(found[::-1]), pa.array([(np.diff(found) - 1).tolist()], pa.list_(pa.int64())),
                    ], ["stream", "part", "block", "n_tokens", "n_ends", "first", "last", "inner"])

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(stream, part, content) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = lambda pattern: F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).cast("long")
    part = F.coalesce(number(r"/file=(\d+)/[^/]*$"), number(r"\.c(\d+)\.[^/]*$"))
    return files.select(number(r"part-(\d+)[^/]*$").cast("int").alias("stream"), part.alias("part"), "content")


def separator_scan(files: DataFrame, block: int = BLOCK, end: int = END) -> DataFrame:
    """(stream, place, n_tokens) of every document in files (stream, part, content)."""
    blocks = files.mapInArrow(_blocks(block, end), "stream int, part long, block int, n_tokens long, n_ends long, first long, last long, inner array<bigint>")
    before = Window.partitionBy("stream").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.withColumn("tokens_before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("ends_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    b = b.withColumn("last_end", F.col("tokens_before") + F.col("last"))
    b = b.withColumn("previous", F.coalesce(F.max("last_end").over(before), F.lit(-1)))
    # the document that the block's first separator ends began after the previous separator, in whichever block
    lengths = F.when(F.col("first").isNotNull(), F.concat(F.array(F.col("tokens_before") + F.col("first") - F.col("previous") - 1), F.col("inner")))
    done = b.select("stream", "ends_before", F.posexplode(lengths)).select("stream", (F.col("ends_before") + F.col("pos")).alias("place"), F.col("col").alias("n_tokens"))
    whole = b.groupBy("stream").agg(F.sum("n_tokens").alias("t"), F.sum("n_ends").alias("place"), F.max("last_end").alias("e"))
    open_ = whole.withColumn("n_tokens", F.col("t") - 1 - F.coalesce("e", F.lit(-1))).where("n_tokens > 0").select("stream", "place", "n_tokens")
    return done.unionByName(open_)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for stream, part, content in zip(*b.columns, strict=True):
            ids = content.as_py().split(_SEPARATOR.encode("latin-1"))[:-1]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([stream.as_py()] * n, pa.int32()), pa.array([part.as_py()] * n, pa.int64()), pa.array(np.arange(n)), pa.array([bytes.fromhex(i[1:].decode()).decode() if i else None for i in ids], pa.string())], ["stream", "part", "at", "id"])


def token_counts(docs: DataFrame, vocabulary: str | bytes = VOCABULARY, file_bytes: int = FILE_BYTES, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens): writes the documents as token files and counts them back from these alone."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, file_bytes)
    if not docs.take(1):
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens")).limit(0)
    counts = separator_scan(_files(spark, f"{path}/kind=tokens"), block)
    ids = _files(spark, f"{path}/kind=ids").mapInArrow(_ids, "stream int, part long, at long, id string")
    ids = ids.select("stream", (F.col("part") + F.col("at")).alias("place"), F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    return counts.join(ids, ["stream", "place"]).select("doc_id", "n_tokens")
