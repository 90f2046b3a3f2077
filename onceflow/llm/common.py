"""What several operators share: scratch tables, vectorised words, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; longer single texts are handled alone.
CHUNK_BYTES = 2 << 20

_MASK = (1 << 64) - 1


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is named, a local master gets one made here; elsewhere executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster sees")
        root = "file://" + tempfile.mkdtemp(prefix="onceflow-")
        spark.conf.set("spark.checkpoint.dir", root)
        _delete_on_exit(spark, root)
    return root.rstrip("/")


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/onceflow/{uuid.uuid4().hex}-{name}"
    _delete_on_exit(spark, path)
    return path


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes a table to the shared scratch folder and reads it back: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Deletes materialized tables that no later plan reads."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def scratch_bytes(df: DataFrame) -> int:
    """Bytes that a materialized table has on disk."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(doc_id: Column, mod: int = 5) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes of text each; a longer single text is a range of its own."""
    pa.set_memory_pool(pa.system_memory_pool())  # freed memory goes back at once: several workers share an executor's
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


def owned(texts: pa.Array) -> pa.Array:
    """A copy whose bytes begin at 0, without nulls: pyarrow's ascii_lower reads the wrong bytes of a slice."""
    return pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))


def lower_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, A-Z lowered, and the offsets of each text's words. Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(owned(texts)))
    offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values
    flat, base = flat.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        base = np.concatenate([[0], np.cumsum(full)])[base]
        flat = flat.filter(pa.array(full))
    return flat, base


def coded(flat: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Codes of words and the distinct words as bytes."""
    if not len(flat):
        return np.zeros(0, np.int64), []
    d = flat.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary.cast(pa.large_binary()).to_pylist()


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each range, in a row."""
    total = np.cumsum(sizes)
    return np.repeat(starts - np.concatenate([[0], total[:-1]]), sizes) + np.arange(total[-1] if len(total) else 0)


def fmix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3, on uint64 arrays."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; with fewer words the whole sequence is one."""
    flat, base = lower_words(texts)
    codes, words = coded(flat)
    w = word_hashes(words)[codes] if words else np.zeros(0, np.uint64)
    a = np.uint64(0x9E3779B97F4A7C15)
    n = len(w)
    h = np.full(max(0, n - k + 1), np.uint64(k))
    for i in range(k):
        h = h * a + w[i : n - k + 1 + i]
    h = fmix(h)
    out = []
    for s, e in zip(base[:-1], base[1:], strict=True):
        if e - s >= k:
            out.append(np.unique(h[s : e - k + 1]))
        elif e > s:
            x = int(e - s)
            for v in w[s:e]:
                x = (x * int(a) + int(v)) & _MASK
            out.append(fmix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def id_crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
