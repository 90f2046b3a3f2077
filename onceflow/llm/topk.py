"""Exact top-k by integer inner product, with MaxScore over shards.

Component x of a vector becomes floor(scale * x); a term is a dimension. Within a shard, a term's components are taken relative to
their median, so that its postings are the vectors that differ there; a term in which most vectors differ keeps its postings as a whole
column. A query's contribution from a term is bounded by the term's least and largest component.

For each query the terms are ordered by bound. Those whose bounds together stay below the threshold (the k-th best score so far) are
non-essential: a vector that stands in no list of the other terms can't reach the threshold. Only the essential lists are traversed; the exact
scores of the best vectors found there raise the threshold; then the non-essential terms are probed, the largest bound first, for those
vectors only that still compete. The threshold goes on from shard to shard, and begins from what one shard has given to all queries.

Vectors are packed into shards of bounded size, written once. Queries go to the shards in blocks of bounded size, a round each: a stated
query set against all rows, in blocks. A task keeps the k best of each query over all its shards, and the tasks' lists are merged.

Scores are exact whatever the components: sums that stay below 2**53 are made in float64, below 2**62 in int64, others in Python's integers. Vectors
with very large components have shards and blocks of their own. Where a score is beyond a long, the nearest long stands for it, ranked by the
exact value.

Defined results: null vectors, vectors without components, with null or non-finite ones, and rows without an id take no part; equal ids are
different rows (a query's own row alone is left out); a table without vectors or queries gives no rows; vectors of other lengths than
the query's take no part in its list; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onceflow.llm.common import drop_scratch, materialize, scratch_path

#: Bytes of a shard's components, and of a block's.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
#: Terms probed at a time.
TERMS = 8
#: Components from this size on make a vector a large one.
LARGE = 2**20
_LONG = 2**63 - 1


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: float64 where that holds the result, else Python's integers."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if np.isfinite(v).all():
        return v
    exact = [int(c) * scale if abs(c) >= 2**53 else math.floor(c * scale) for c in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def _integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([int(c) for c in x.ravel().tolist()], object).reshape(x.shape)


def same_kind(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries and vectors in the cheapest type in which every sum that a search makes is exact."""
    if q.dtype == object or x.dtype == object:
        return _integers(q), _integers(x)
    with np.errstate(over="ignore"):
        most = 4 * float(np.abs(q).max(0) @ np.abs(x).max(0)) if len(q) and len(x) else 0.0
    if most < 2**53 and max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < 2**53:
        return q, x
    if most < 2**62 and max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < 2**60:
        return q.astype(np.int64), x.astype(np.int64)
    return _integers(q), _integers(x)


class Shard:
    """Inverted lists over a shard's vectors (rows sorted by id), and MaxScore search in them."""

    def __init__(self, x: np.ndarray):
        self.n, self.dim = x.shape
        self.center = np.sort(x, 0)[self.n // 2]
        self.y = x - self.center
        self.low, self.high = self.y.min(0), self.y.max(0)
        self.lists: list[tuple[np.ndarray | None, np.ndarray]] = []
        for j in range(self.dim):
            column = np.ascontiguousarray(self.y[:, j])
            places = np.flatnonzero(column)
            self.lists.append((None, column) if 4 * len(places) > self.n else (places, column[places]))
        self.total = sum(len(v) for _, v in self.lists)
        #: Postings that searches have traversed or probed.
        self.touched = 0

    def search(self, q: np.ndarray, k: int, floor: int | None, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the query's k best vectors among those that reach floor (None: no threshold yet), ties to the
        smaller place. own: the query's own place here, or -1."""
        if floor is not None and q.dtype != object:  # no score of this shard is beyond these
            floor = max(-(2**62), min(2**62, floor))
        base = q @ self.center
        bound = np.maximum(np.maximum(q * self.low, q * self.high), 0)
        order = np.argsort(bound, kind="stable")
        below = np.cumsum(bound[order])  # bound of the i + 1 terms of the least bounds together
        split = 0 if floor is None else int(np.count_nonzero(base + below < floor))  # non-essential terms
        score = np.full(self.n, base, q.dtype)
        for j in order[split:]:
            places, values = self.lists[j]
            if not q[j]:
                continue
            self.touched += len(values)
            if places is None:
                score += q[j] * values
            else:
                score[places] += q[j] * values
        left = below[split - 1] if split else 0
        lead = self._best(score, min(self.n, k + 1))
        lead = lead[lead != own]
        if len(lead) >= k:  # the k best so far, in full, raise the threshold
            exact = score[lead] + self.y[lead[:, None], order[:split]] @ q[order[:split]] if split else score[lead]
            least = sorted(exact.tolist())[-k]
            floor = least if floor is None else max(floor, least)
        some = np.arange(self.n) if floor is None else np.flatnonzero(score + left >= floor)
        some = some[some != own]
        score = score[some]
        while split and len(some):  # probe the others while competitive
            to = max(0, split - TERMS)
            terms = order[to:split]
            self.touched += len(some) * len(terms)
            score = score + self.y[some[:, None], terms] @ q[terms]
            split, left = to, below[to - 1] if to else 0
            if floor is not None:
                keep = score + left >= floor
                some, score = some[keep], score[keep]
        best = np.argsort(-score, kind="stable")[:k]
        return some[best], score[best]

    @staticmethod
    def _best(score: np.ndarray, k: int) -> np.ndarray:
        if score.dtype == object:
            return np.argsort(-score, kind="stable")[:k]
        return np.argpartition(-score, k - 1)[:k]


class Best:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int, floors: list[int | None]):
        self.k, self.floors = k, list(floors)
        self.scores = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = scores if scores.dtype == object else scores.astype(np.int64)
        scores, ids = np.concatenate([self.scores[i], scores]), np.concatenate([self.ids[i], ids])
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(-scores[order], kind="stable")][: self.k]
        self.scores[i], self.ids[i] = scores[order], ids[order]
        if len(order) == self.k:
            least = int(self.scores[i][-1])
            self.floors[i] = least if self.floors[i] is None else max(self.floors[i], least)


#: What a search gives: the query's place in its block and id, the candidate, its score; over and digits order scores beyond a long.
FOUND = "q long, query_id long, vec_id long, score long, over int, digits string"


def _found(best: Best, q_ids: np.ndarray) -> pa.RecordBatch:
    q = np.repeat(np.arange(len(best.ids)), [len(x) for x in best.ids])
    ids = np.concatenate([np.zeros(0, np.int64), *best.ids])
    scores = [int(s) for x in best.scores for s in x]
    inside = [-_LONG - 1 <= s <= _LONG for s in scores]
    long = [s if ok else (_LONG if s > 0 else -_LONG - 1) for s, ok in zip(scores, inside, strict=True)]
    over = [0 if ok else len(str(abs(s))) * (1 if s > 0 else -1) for s, ok in zip(scores, inside, strict=True)]
    turned = str.maketrans("0123456789", "9876543210")  # of two negative numbers the one with the larger digits is less
    digits = ["" if ok else str(s) if s > 0 else str(-s).translate(turned) for s, ok in zip(scores, inside, strict=True)]
    columns = [pa.array(q, pa.int64()), pa.array(q_ids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(long, pa.int64()), pa.array(over, pa.int32()), pa.array(digits, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


def _pack(scale: int):
    """Rows of _PACKED: a shard's ids and components, and the places and components of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, ...]]] = {}

        def emit(key: tuple[int, bool], most: int) -> pa.RecordBatch:
            ids, x, q = (np.concatenate(p) for p in zip(*held[key], strict=True))
            held[key] = [(ids[most:], x[most:], q[most:])]
            order = np.argsort(ids[:most], kind="stable")
            ids, x, rows = ids[:most][order], x[:most][order], np.flatnonzero(q[:most][order])
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([key[0]], pa.int32()), "large": [key[1]], "n_queries": pa.array([len(rows)], pa.int64()),
                "ids": [ids.tobytes()], "x": [x.tobytes()], "q_rows": [rows.tobytes()], "q_ids": [ids[rows].tobytes()], "q_x": [x[rows].tobytes()],
            })

        for b in batches:
            ids, vectors, q = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            ends = vectors.offsets.to_numpy()
            lengths = np.diff(ends)
            for dim in np.unique(lengths):
                rows = np.nonzero(lengths == dim)[0]
                x = flat[ends[rows][:, None] + np.arange(dim)]
                is_large = np.abs(x).max(1) >= LARGE / scale
                for large in (False, True):
                    at, key, most = is_large == large, (int(dim), large), max(1, SHARD_BYTES // (8 * int(dim)))
                    if at.any():
                        held.setdefault(key, []).append((ids[rows][at], x[at], q[rows][at]))
                        while sum(len(p[0]) for p in held[key]) >= most:
                            yield emit(key, most)
        for key, parts in held.items():
            if rest := sum(len(p[0]) for p in parts):
                yield emit(key, rest)

    return run


_PACKED = "dim int, large boolean, n_queries long, ids binary, x binary, q_rows binary, q_ids binary, q_x binary"
#: A block: the shards that its queries stand in, their places there, ids and components.
_BLOCK = "dim int, large boolean, q_shards binary, q_rows binary, q_ids binary, q_x binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, bool], list[tuple[np.ndarray, ...]]] = {}

    def emit(key: tuple[int, bool]) -> Iterator[pa.RecordBatch]:
        parts, most = [np.concatenate(p) for p in zip(*held.pop(key), strict=True)], max(1, BLOCK_BYTES // (8 * key[0]))
        for s in range(0, len(parts[0]), most):
            blobs = {name: [p[s : s + most].tobytes()] for name, p in zip(("q_shards", "q_rows", "q_ids", "q_x"), parts, strict=True)}
            yield pa.RecordBatch.from_pydict({"dim": pa.array([key[0]], pa.int32()), "large": [key[1]]} | blobs)

    for b in batches:
        for shard, dim, large, rows, ids, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows = np.frombuffer(rows, np.int64)
            part = (np.full(len(rows), shard, np.int64), rows, np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, dim))
            held.setdefault((dim, large), []).append(part)
            if sum(p[3].nbytes for p in held[dim, large]) >= BLOCK_BYTES:
                yield from emit((dim, large))
    for key in list(held):
        yield from emit(key)


def _search(block: dict, floors: list[int | None], k: int, scale: int):
    """The k best of each of a block's queries over all the shards of a task."""
    shards, rows, q_ids = (np.frombuffer(block[c], np.int64) for c in ("q_shards", "q_rows", "q_ids"))
    queries = whole(np.frombuffer(block["q_x"]).reshape(-1, block["dim"]), scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), k, floors)
        for b in batches:
            for number, ids, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, x = np.frombuffer(ids, np.int64), whole(np.frombuffer(x).reshape(-1, block["dim"]), scale)
                qs, x = same_kind(queries, x)
                shard = Shard(x)
                for i in range(len(qs)):
                    places, scores = shard.search(qs[i], k, best.floors[i], int(rows[i]) if shards[i] == number else -1)
                    if len(places):
                        best.add(i, ids[places], scores)
        yield _found(best, q_ids)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores among all other rows, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    asks = F.coalesce(is_query, F.lit(False))
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), asks.alias("q"))
    unfit = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    clean = clean.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & ~F.exists("e", unfit))
    size = 8 * (clean.agg(F.sum(F.size("e"))).first()[0] or 0)
    packed = clean.repartition(max(1, -(-size // SHARD_BYTES))).mapInArrow(_pack(scale), _PACKED)
    shards = materialize(packed.withColumn("shard", F.monotonically_increasing_id()), "topk-shards")
    # a row a length of vectors: how many queries it has, and the shard that gives the first thresholds
    kinds = shards.groupBy("dim").agg(F.min("shard"), F.sum("n_queries"), F.count("*")).collect()
    lead, several = {dim: first for dim, first, _, _ in kinds}, {dim: n > 1 for dim, _, _, n in kinds}
    asked = shards.where("n_queries > 0").select("shard", "dim", "large", "q_rows", "q_ids", "q_x")
    asked = asked.coalesce(max(1, sum(8 * dim * n for dim, _, n, _ in kinds) // BLOCK_BYTES))
    blocks = materialize(asked.mapInArrow(_blocks, _BLOCK).withColumn("block", F.monotonically_increasing_id()), "topk-blocks")
    path = scratch_path(spark, "topk-found")
    schema = f"block long, {FOUND}"
    spark.createDataFrame([], schema).write.parquet(path)

    def search(df: DataFrame, block: dict, floors: list[int | None]) -> DataFrame:
        return df.mapInArrow(_search(block, floors, k, scale), FOUND).select(F.lit(block["block"]).cast("long").alias("block"), "*")

    for (number,) in blocks.select("block").collect():  # a round a block; a block is bounded in bytes
        block = blocks.where(F.col("block") == number).first().asDict()
        dim, n = block["dim"], len(block["q_ids"]) // 8
        mine = shards.where(F.col("dim") == dim).select("shard", "ids", "x")
        first = materialize(search(mine.where(F.col("shard") == lead[dim]), block, [None] * n), "topk-first")
        first.write.mode("append").parquet(path)
        if several[dim]:
            floors: list[int | None] = [None] * n
            for q, least, found in first.groupBy("q").agg(F.min("score"), F.count("*")).collect():
                if found == k and least > -_LONG - 1:
                    floors[q] = least
            search(mine.where(F.col("shard") != lead[dim]), block, floors).write.mode("append").parquet(path)
        drop_scratch(first)
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), F.desc("over"), F.desc("digits"), "vec_id")
    found = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
