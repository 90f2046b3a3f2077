"""Join of documents on the Jaccard similarity of their n-gram sets, by T-occurrence search.

Rows are numbered and written once, and are told apart by their numbers, whatever their ids. Rows whose sorted shingle hashes have one signature of 128
bits are one node, named by its least row. Two nodes can only link if they share a token of their prefixes: the first n - T + 1 tokens in a
global order, T the least overlap. The order puts rare tokens first within regions of the hash space, so hot passages
stay out of the prefixes of all but their copies. Document frequencies are summed from chunks that have been counted beforehand: a token,
however hot, is one entry a chunk. Nodes of like size that share prefix tokens, directly or through others, form a shard.

A large shard is cut into blocks by size, since sets that link are of like sizes; neighbouring blocks meet in pairs. Within a shard (or a pair of
blocks) an inverted index answers the T-occurrence problem for each document with DivideSkip: the L longest of its lists are set aside, the short ones are
merged with a heap that skips ahead, ids that occur T - L times are probed in the long lists by binary search, and those that reach the overlap
link. Documents already in one component are not compared again: of all pairs across components one member at least has been a
query against all others, so no link between components is lost, while a group of n near copies costs a few queries, not n * n pairs.

Components of the links come from label propagation; one row a document goes out. No cap on lists, candidates or partners.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own component; texts with fewer words than
a shingle are one shingle; equal texts always link; a null id belongs to the component of its text but names none; rows that
repeat an id are separate rows, each with the result of its own text; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onceflow.llm.common import drop_scratch, fmix, materialize, ragged, scratch_bytes, shingle_sets, text_chunks
from onceflow.llm.components import connected_components

#: Shingles that a shard's block holds, about.
BLOCK_SHINGLES = 500_000
#: Rows of a chunk, whose places in it are 16-bit, and its text.
_CHUNK_ROWS, _CHUNK_BYTES = 60_000, 4 << 20
#: Bytes of numbered rows, compressed, whose tokens make a bucket.
_BUCKET_BYTES = 16 << 20
#: Postings that a window of the merge holds, about.
_WINDOW = 8192
#: Rows of the plan of large shards up to which it is broadcast.
_FEW = 100_000


def least_overlap(n: int, num: int, den: int) -> int:
    """The overlap that any set linked to a set of n shares with it, at least."""
    return -(-num * n // den)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set of hashes, as two signed integers."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(s))
        one = (s * np.uint64(0x9E3779B97F4A7C15)).sum() ^ np.bitwise_xor.reduce(fmix(s)) ^ n
        two = fmix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum() + n * np.uint64(0xA0761D6478BD642F)
        v = fmix(np.array([one, two], np.uint64)).astype(np.int64)
    return int(v[0]), int(v[1])


def regions(num: int, den: int) -> int:
    """Regions of the hash space: the first mostly holds a whole prefix."""
    return max(1, int(1 / (1.2 * (1 - num / den) + 1e-9)))


#: What a scan gives. Kind 0: a row, with its place in its chunk, the first place there with the same set (head), the set's signature and size, and
#: at a head the numbers of its tokens in the regions. Kind 1: a chunk's tokens of one bucket, packed little-endian: tokens u64, counts u16 (heads with
#: each), owners u64 (the signature of the only head with it, else 0), places u16 (of the heads, counts[i] for token i).
_SCAN = (
    ("kind", pa.int32()), ("row", pa.int64()), ("doc_id", None), ("chunk", pa.int64()), ("place", pa.int32()), ("head", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()),
    ("n", pa.int64()), ("shares", pa.list_(pa.int64())), ("bucket", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary()), ("places", pa.binary()),
)


def _scan_schema(id_kind: str) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", None: id_kind, pa.list_(pa.int64()): "array<bigint>"}
    return ", ".join(f"{n} {names[t]}" for n, t in _SCAN)


def _scan_rows(count: int, id_type: pa.DataType, /, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of a scan: the columns given, nulls elsewhere."""
    arrays = [columns[c].cast(t or id_type) if c in columns else pa.nulls(count, t or id_type) for c, t in _SCAN]
    return pa.RecordBatch.from_arrays(arrays, [c for c, _ in _SCAN])


def _packed(v: np.ndarray, kind: str, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([v[x:y].astype(kind).tobytes() for x, y in zip(starts, ends, strict=True)], pa.binary())


def _scan(k: int, num: int, den: int, buckets: int):
    r = regions(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s0, e0 in text_chunks(b.column(2), _CHUNK_BYTES):
                for s in range(s0, e0, _CHUNK_ROWS):
                    yield from chunk(*(b.column(i).slice(s, min(e0, s + _CHUNK_ROWS) - s) for i in range(3)))

    def chunk(rows: pa.Array, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        number, sets, n = uuid.uuid4().int >> 65, shingle_sets(texts, k), len(texts)
        keys = [signature(s) if len(s) else None for s in sets]
        first: dict[tuple[int, int], int] = {}
        heads = [i if key is None else first.setdefault(key, i) for i, key in enumerate(keys)]
        tokens, places, shares = [], [], []
        for i, s in enumerate(sets):
            if keys[i] is None or heads[i] != i:
                shares.append(None)
                continue
            region = ((s >> np.uint64(32)) * np.uint64(r)) >> np.uint64(32)
            per = np.bincount(region.astype(np.int64), minlength=r)
            shares.append(per.tolist())
            prefix = len(s) - least_overlap(len(s), num, den) + 1
            upto = int(np.searchsorted(np.cumsum(per), prefix)) + 1  # regions that hold the prefix; s is sorted, so they are its head
            tokens.append(s[: int(per[:upto].sum())])
            places.append(np.full(len(tokens[-1]), i, np.int64))
        yield _scan_rows(
            n, ids.type, kind=pa.array(np.zeros(n, np.int32)), row=rows, doc_id=ids, chunk=pa.array(np.full(n, number)), place=pa.array(np.arange(n)), head=pa.array(heads), n=pa.array([len(s) for s in sets]),
            s1=pa.array([x and x[0] for x in keys], pa.int64()), s2=pa.array([x and x[1] for x in keys], pa.int64()), shares=pa.array(shares, pa.list_(pa.int64())),
        )
        if not tokens:
            return
        t, p = np.concatenate(tokens), np.concatenate(places)
        bucket = (t % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((p, t, bucket))
        t, p, bucket = t[order], p[order], bucket[order]
        at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        count = np.diff(np.append(at, len(t)))
        owner = np.array([x[0] if x else 0 for x in keys], np.int64).view(np.uint64)[p[at]]
        owner[count > 1] = 0
        found, starts = np.unique(bucket[at], return_index=True)
        ends = np.append(starts[1:], len(at))
        posts, m = np.append(at, len(t)), len(found)
        yield _scan_rows(
            m, ids.type, kind=pa.array(np.ones(m, np.int32)), chunk=pa.array(np.full(m, number)), bucket=pa.array(found),
            tokens=_packed(t[at], "<u8", starts, ends), counts=_packed(count, "<u2", starts, ends), owners=_packed(owner, "<u8", starts, ends), places=_packed(p, "<u2", posts[starts], posts[ends]),
        )

    return run


def _frequencies(t: pa.Table) -> pa.Table:
    """For each chunk's tokens of one bucket: which are in two different nodes at least (chosen, u32 places), and their document frequency (freq, u32)."""
    parts = [np.frombuffer(x, "<u8") for x in t["tokens"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u2") for x in t["counts"].to_pylist()]).astype(np.int64)
    owners = np.concatenate([np.frombuffer(x, "<u8") for x in t["owners"].to_pylist()])
    tokens, at = np.unique(np.concatenate(parts), return_inverse=True)
    df = np.bincount(at, counts).astype(np.int64)
    low, high = np.full(len(tokens), np.iinfo(np.uint64).max), np.zeros(len(tokens), np.uint64)
    np.minimum.at(low, at, owners)
    np.maximum.at(high, at, owners)
    shared = (low != high) | (np.bincount(at, counts > 1) > 0)
    chosen, freq, s = [], [], 0
    for x in parts:
        own = at[s : s + len(x)]
        s += len(x)
        pick = np.flatnonzero(shared[own])
        chosen.append(pick.astype("<u4").tobytes())
        freq.append(np.minimum(df[own[pick]], 2**32 - 1).astype("<u4").tobytes())
    out = pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "chosen": pa.array(chosen, pa.binary()), "freq": pa.array(freq, pa.binary())})
    return out.filter(pa.array([bool(c) for c in chosen]))


def _shared_tokens(r: int):
    names = ["chunk", "place", "token", "region", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, place, token, region, df) of the tokens chosen."""
        for b in batches:
            for chunk, tokens, counts, places, chosen, freq in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens, counts, places = np.frombuffer(tokens, "<u8"), np.frombuffer(counts, "<u2").astype(np.int64), np.frombuffer(places, "<u2")
                pick, df = np.frombuffer(chosen, "<u4"), np.frombuffer(freq, "<u4").astype(np.int64)
                times = counts[pick]
                at = ragged(np.cumsum(counts)[pick] - times, times)  # places of the chosen tokens, in a row
                token = np.repeat(tokens[pick], times)
                region = ((token >> np.uint64(32)) * np.uint64(r)) >> np.uint64(32)
                columns = [np.full(len(at), chunk), places[at].astype(np.int32), token.view(np.int64), region.astype(np.int32), np.repeat(df, times)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


class Index:
    """Inverted lists over the sets of a shard or of two blocks, and T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None):
        self.n, self.num, self.den, self.side = np.array([len(s) for s in sets], np.int64), num, den, side
        doc = np.repeat(np.arange(len(sets)), self.n)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.lexsort((doc, token))
        token, self.post = token[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(token)))
        # lists of the tokens of each document that some other document has, shortest first
        self.start, self.size = start, size
        lists = np.repeat(np.arange(len(start)), size)
        shared = size[lists] > 1
        by = np.lexsort((size[lists[shared]], self.post[shared]))
        self.lists, of = lists[shared][by], self.post[shared][by]
        self.own = np.searchsorted(of, np.arange(len(sets) + 1))
        self.rank = np.repeat(np.arange(len(start)), size) * len(sets) + self.post  # ascending over all lists

    def list_(self, i: int) -> np.ndarray:
        return self.post[self.start[i] : self.start[i] + self.size[i]]

    def _merge_short(self, short: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids that occur `least` times or more in the short lists, and how often. A heap of the lists' heads gives the least-th smallest: ids below
        it are in fewer lists, so all lists skip to it by binary search; a window of ids from there on is then merged at once by counting."""
        n = len(self.n)
        at, ends, base = self.start[short], self.start[short] + self.size[short], short * n
        width = max(64, n * _WINDOW // max(1, int(self.size[short].sum())))
        ids, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while True:
            heap = self.post[at[at < ends]].tolist()
            if len(heap) < least:
                return np.concatenate(ids), np.concatenate(times)
            heapq.heapify(heap)
            for _ in range(least - 1):
                heapq.heappop(heap)
            low, at = np.searchsorted(self.rank, base + heap[0]), np.searchsorted(self.rank, base + min(heap[0] + width, n))
            seen = np.bincount(self.post[ragged(low, at - low)] - heap[0])
            often = np.flatnonzero(seen >= least)
            ids.append(often + heap[0])
            times.append(seen[often])

    def search(self, q: int, open_: np.ndarray) -> np.ndarray:
        """The documents among those open that link to q."""
        lists, n = self.lists[self.own[q] : self.own[q + 1]], int(self.n[q])
        t = least_overlap(n, self.num, self.den)
        if len(lists) < t:
            return np.zeros(0, np.int64)
        many = min(t - 1, int(t / (0.01 * math.log2(int(self.size[lists[-1]]) + 1) + 1)))
        short, long = lists[: len(lists) - many], lists[len(lists) - many :]
        ids, times = self._merge_short(short, t - many)
        keep = open_[ids] & (ids != q)
        ids, times = ids[keep], times[keep]
        for j, i in enumerate(long):  # binary probes; those that can no longer reach t are left
            if not len(ids):
                break
            x = self.list_(i)
            at = np.minimum(np.searchsorted(x, ids), len(x) - 1)
            times = times + (x[at] == ids)
            if j % 16 == 15:
                keep = times + len(long) - 1 - j >= t
                ids, times = ids[keep], times[keep]
        return ids[self.den * times >= self.num * (n + self.n[ids] - times)]

    def links(self) -> list[tuple[int, int]]:
        """Links that join all documents which links connect; with sides, only links between them count."""
        k = len(self.n)
        root, done, out = np.arange(k), np.zeros(k, bool), []
        follow: list[int] = []
        while True:
            if follow:
                q = follow.pop()
            else:  # all but the largest component are queries
                largest = int(np.bincount(root, minlength=k).argmax()) if k else 0
                rest = np.flatnonzero(~done & (root != largest))
                if not len(rest):
                    return out
                q = int(rest[0])
            open_ = ~done & (root != root[q])
            if self.side is not None:
                open_ &= self.side != self.side[q]
            done[q] = True
            if not open_.any():
                continue
            found = self.search(q, open_)
            roots, one = np.unique(root[found], return_index=True)
            out += [(q, int(found[i])) for i in one]
            if len(roots):
                root[np.isin(root, roots)] = root[q]
                if self.side is not None and len(out) == len(one):
                    follow.append(int(found[0]))  # the first find, of the other side, gathers this side's copies at once


def _links(k: int, num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        nodes, texts = t["node"].to_numpy(), t["text"].combine_chunks()
        sets = [s for a, b in text_chunks(texts) for s in shingle_sets(texts.slice(a, b - a), k)]
        side = None if t["a"][0].as_py() == t["b"][0].as_py() else t["upper"].to_numpy()
        pairs = np.array(Index(sets, num, den, side).links() if len(sets) > 1 else [], np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(nodes[pairs[:, 0]], pa.int64()), "b": pa.array(nodes[pairs[:, 1]], pa.int64())})

    return run


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number each, written once so that they stay the same."""
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", compression="zstd")


def _components(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """From numbered rows (row, doc_id, text): rows (row, doc_id, chunk, head, n), and heads (chunk, head, node, comp), which lack the empty sets."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    buckets, r = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-scratch_bytes(docs) // _BUCKET_BYTES)), regions(num, den)
    scan = materialize(docs.select("row", "doc_id", "text").mapInArrow(_scan(k, num, den, buckets), _scan_schema(kind)), "shingles")
    rows = materialize(scan.where("kind = 0").select("row", "doc_id", "chunk", "head", "n"), "rows")
    # a set is one entry a chunk before its copies meet, however many there are
    heads = scan.where("kind = 0 and s1 is not null and place = head").select("row", "chunk", "head", "s1", "s2", "n", "shares")
    heads = heads.join(heads.groupBy("s1", "s2").agg(F.min("row").alias("node")), ["s1", "s2"]).drop("s1", "s2")
    heads = materialize(heads, "heads")
    posts = scan.where("kind = 1")
    freq = posts.select("chunk", "bucket", "tokens", "counts", "owners").groupBy("bucket").applyInArrow(_frequencies, "chunk long, bucket int, chosen binary, freq binary")
    shared = posts.select("chunk", "bucket", "tokens", "counts", "places").join(freq, ["chunk", "bucket"]).select("chunk", "tokens", "counts", "places", "chosen", "freq")
    shared = shared.mapInArrow(_shared_tokens(r), "chunk long, head int, token long, region int, df long")
    shared = shared.join(heads.select("chunk", "head", "node", "n", "shares"), ["chunk", "head"])
    shared = shared.groupBy("node", "token").agg(*[F.first(c).alias(c) for c in ("region", "df", "n", "shares")])
    # a token's place in the order: regions before, tokens of one node in this region, rarer shared ones
    in_region = Window.partitionBy("node", "region")
    place = F.aggregate(F.slice("shares", 1, F.col("region")), F.lit(0).cast("long"), lambda x, y: x + y) + F.element_at("shares", F.col("region") + 1)
    place = place - F.count("*").over(in_region) + F.row_number().over(in_region.orderBy("df", "token"))
    prefix = shared.withColumn("at", place).where(F.col("at") <= F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(den)) + 1).select("node", "n", "token")
    prefix = materialize(prefix, "prefixes")
    drop_scratch(scan)
    shards = connected_components(candidate_edges(prefix, num, den))
    comps = connected_components(shard_links(docs, heads.where("row = node").select("node", "n"), shards, k, num, den))
    return rows, heads.select("chunk", "head", "node").join(comps, "node", "left").select("chunk", "head", "node", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link where den * intersection >= num * union of their sets of k-word shingles."""
    rows, heads = _components(numbered(docs.select("doc_id", "text"), "row"), k, num, den)
    # the smallest id: of a chunk's rows with one set, of a node, of a component
    least = rows.groupBy("chunk", "head").agg(F.min("doc_id").alias("least"))
    named = heads.join(least, ["chunk", "head"])
    comps = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.select("chunk", "head", "comp").join(comps, "comp").select("chunk", "head", "component_id", F.lit(True).alias("full"))
    d = rows.join(named, ["chunk", "head"], "left")
    return d.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("full"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the smallest id, the first of them if that repeats. Rows are told
    apart by number, so an id with different texts is different documents, and a row without an id goes only where another of its component stays."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for i in range(len(taken) + 1) if (n := f"__row{i}") not in taken)
    every = numbered(docs, name)
    slim = every.select(F.col(name).alias("row"), "doc_id", "text")
    slim.scratch = every.scratch
    rows, heads = _components(slim, k, num, den)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    best = rows.groupBy("chunk", "head").agg(first.alias("best"))
    stay = heads.join(best, ["chunk", "head"]).groupBy("comp").agg(F.min("best").alias("best")).select(F.col("best.row").alias(name))
    empty = rows.join(heads.select("chunk", "head"), ["chunk", "head"], "left_anti").select(F.col("row").alias(name))
    return every.join(stay.unionByName(empty), name, "left_semi").select(*docs.columns)


def size_class(n, num: int, den: int):
    """Sets that link differ in size by den / num at most, so by one class at most."""
    return F.floor(F.log(n) / math.log(den / num) + 1e-9).cast("int") if num < den else n.cast("int")


def candidate_edges(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): edges whose components hold every pair that shares a prefix token and whose sizes may link. A token's nodes of
    a class of sizes meet at their least node, and neighbouring classes at theirs."""
    sized = prefix.select("node", "token", size_class(F.col("n"), num, den).alias("size"))
    leads = sized.groupBy("token", "size").agg(F.min("node").alias("lead"))
    star = sized.join(leads, ["token", "size"]).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    larger = leads.select("token", (F.col("size") - 1).alias("size"), F.col("lead").alias("b"))
    return star.unionByName(leads.join(larger, ["token", "size"]).select(F.col("lead").alias("a"), "b")).where("a <> b").distinct()


def shard_links(docs: DataFrame, reps: DataFrame, shards: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): nodes that link, joining all that links connect; a task's unit is a shard, or two blocks of a large one. reps: (node, n)."""
    reps = reps.join(shards.withColumnRenamed("comp", "shard"), "node").withColumn("class", size_class(F.col("n"), num, den))
    # a large shard is cut by classes of sizes, and a class that is still large into parts; the plan of this has a row a class of a large shard, so
    # a share of 1 / BLOCK_SHINGLES of the shingles at most, times the classes
    sums = reps.groupBy("shard", "class").agg(F.sum("n").alias("s"))
    large = sums.groupBy("shard").agg(F.sum("s").alias("all")).where(F.col("all") > BLOCK_SHINGLES).select("shard")
    plan = materialize(sums.join(large, "shard", "left_semi").select("shard", "class", F.ceil(F.col("s") / BLOCK_SHINGLES).cast("int").alias("parts")), "blocks")
    small = F.broadcast if plan.count() <= _FEW else lambda df: df
    out = plan
    for d, name in ((1, "above"), (-1, "below")):
        beside = plan.select("shard", (F.col("class") - d).alias("class"), F.col("parts").alias(name))
        out = out.join(small(beside), ["shard", "class"], "left")
    reps = reps.join(small(out), ["shard", "class"], "left")
    block = lambda size, i: F.struct(size.cast("int").alias("size"), i.cast("int").alias("part"))
    others = lambda d, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: block(F.col("class") + d, i))
    none = F.array().cast("array<struct<size:int,part:int>>")
    beside = F.concat(others(0, F.col("parts")), *[F.when(F.col(c).isNotNull(), others(d, F.col(c))).otherwise(none) for d, c in ((1, "above"), (-1, "below"))])
    whole = block(F.lit(0), F.lit(0))
    reps = reps.withColumn("block", F.when(F.col("parts").isNull(), whole).otherwise(block(F.col("class"), F.pmod(F.xxhash64("node"), "parts"))))
    reps = reps.withColumn("meets", F.when(F.col("parts").isNull(), F.array(whole)).otherwise(beside))
    texts = docs.select("row", "text").join(reps.select("node", "shard", "block", "meets"), F.col("row") == F.col("node")).drop("row")
    # within its block, and against every block of its class and of the classes beside
    pairs = texts.select("node", "shard", "block", "text", F.explode("meets").alias("o"))
    pairs = pairs.select("node", "shard", (F.col("block") == F.greatest("block", "o")).alias("upper"), F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), "text")
    # searching costs far more than its input's bytes, by which adaptive execution would join partitions
    pairs = pairs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "a", "b")
    return materialize(pairs.groupBy("shard", "a", "b").applyInArrow(_links(k, num, den), "a long, b long"), "links")
