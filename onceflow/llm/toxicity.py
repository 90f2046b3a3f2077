"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; a sample of all text, whatever its labels, is the unlabelled set. With the class
prior p, the risk of a classifier g is p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)]) (Kiryo et al., 2017), which numpy
minimises over hashed words, and beginnings of words, that occur in a text. Several classifiers learn from halves of the sample; a text's score is the
logistic of their mean.

Only fitting samples: at most `positives` toxic rows and `unlabelled` other rows, bounded parameters. Every text is scored
whole. Defined results: null and empty texts have no words and get the bias's score, as any text without a telling word;
with no positives the score is the prior for every text; repeated rows get equal scores; ids may be of any type that sorts; an id that repeats
with different texts gives the sample the least of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onceflow.llm.common import coded, crc_remainder, lower_words, materialize, text_chunks, word_hashes

BITS = 24
#: Lengths of the beginnings of words that are features beside whole words, in characters.
PREFIXES = (3, 4, 5, 6, 7, 8)
LENGTHS = 20  # features 0 to 19: one for each power of two in the number of words
_EDGE = b"".join(bytes([b]) for b in range(128) if not chr(b).isalnum())


def feature_ids(words: list[bytes]) -> np.ndarray:
    """For each word the ids of its features (itself, and its beginnings), -1 where it has fewer. Shape: words x 7."""
    out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
    bare = [w.strip(_EDGE).decode("utf-8", "replace") for w in words]
    for j, k in enumerate((0, *PREFIXES)):
        at = [i for i, w in enumerate(bare) if w and len(w) > k]
        h = word_hashes([(bare[i][:k] + "\0" if k else bare[i]).encode() for i in at])
        out[at, j] = LENGTHS + (h >> np.uint64(64 - BITS)).astype(np.int64)
    return out


def _length_ids(base: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.diff(base) + 1).astype(np.int64), LENGTHS - 1)


def document_features(texts: pa.Array, chosen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, feature, value) of the texts, in chunks: the value is log2 of one and the distinct words with the feature. chosen: sorted ids,
    and features are places in it."""
    for s, e in text_chunks(texts):
        flat, base = lower_words(texts.slice(s, e - s))
        codes, words = coded(flat)
        ids = feature_ids(words)
        if chosen is not None:
            at = np.minimum(np.searchsorted(chosen, ids), len(chosen) - 1)
            ids = np.where((ids >= 0) & (chosen[at] == ids), at, -1)
        useful = (ids >= 0).any(1) if len(ids) else np.zeros(0, bool)
        hit = np.nonzero(useful[codes])[0] if len(codes) else codes
        of = np.searchsorted(base, hit, side="right") - 1
        seen = np.unique(of << 32 | codes[hit])  # each distinct word of a text once
        many = ids[seen & 0xFFFFFFFF]
        of = np.repeat(seen >> 32, many.shape[1])
        many, of = many.ravel(), of[: many.size]
        pair, times = np.unique(of[many >= 0] << 32 | many[many >= 0], return_counts=True)
        length = np.arange(e - s) << 32 | (_length_ids(base) if chosen is None else np.searchsorted(chosen, _length_ids(base)))
        pair, times = np.concatenate([pair, length]), np.concatenate([np.log2(1 + times), np.ones(e - s)])
        yield s + (pair >> 32), pair & 0xFFFFFFFF, times


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted ids of features, those of the lengths first
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.words):
            for doc, feature, times in document_features(texts, self.words):
                np.add.at(z, doc, self.weights[feature] * times)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _fit_one(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, positive: np.ndarray, k: int, prior: float, steps: int) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the sigmoid loss over a sparse matrix."""
    n, pos = len(positive), positive.astype(bool)
    n_p, n_u = max(1, pos.sum()), max(1, (~pos).sum())
    w, b = np.where(np.arange(k) < LENGTHS, 0, 1.0), np.log(prior / (1 - prior))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        up = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols] * vals, n), -60, 60)))  # the sigmoid loss l(-z); l(z) is 1 - l(-z)
        slope = up * (1 - up)
        negative_risk = up[~pos].sum() / n_u - prior * up[pos].sum() / n_p
        negative = np.where(pos, -prior * slope / n_p, slope / n_u)
        # below zero, take that part back
        g = np.where(pos, -prior * slope / n_p, 0.0) + negative if negative_risk >= 0 else -negative
        grad = np.append(np.bincount(cols, g[rows] * vals, k) + 2e-5 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(chosen: np.ndarray, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, positive: np.ndarray, prior: float, *, steps: int = 400, models: int = 3) -> Model:
    """The mean of several classifiers, each learnt from part of the sample."""
    prior = float(np.clip(prior, 1e-4, 1 - 1e-4))
    positive = np.asarray(positive, bool)
    if not positive.any() or positive.all() or len(chosen) <= LENGTHS:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    rng, ws, bs = np.random.default_rng(7), [], []
    for i in range(models):
        part = rng.random(len(positive)) < 0.7 if i else np.ones(len(positive), bool)
        if not positive[part].any() or positive[part].all():
            continue
        to, inside = np.cumsum(part) - 1, part[rows]
        w, b = _fit_one(to[rows[inside]], cols[inside], vals[inside], positive[part], len(chosen), prior, steps)
        ws.append(w)
        bs.append(b)
    return Model(chosen, np.mean(ws, 0), float(np.mean(bs)))


def train(docs: DataFrame, labels: DataFrame, *, positives: int = 4000, unlabelled: int = 12000, features: int = 2000) -> Model:
    """Fits on the driver. Labels count only where crc32(doc_id) mod 5 is not 0; the samples' bounds are the parameters.

    The sampled texts are written once; the shares of their features are counted by the executors, the most telling
    `features` (in at least 3 and 1% of the positives, by at least 5 deviations) are chosen, and only these come to the driver."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_remainder(F.col("doc_id")) != 0))
    marks = marks.groupBy("doc_id").agg(F.min("toxic").alias("__y"), F.max("toxic").alias("__z")).where("__y = __z").select("doc_id", "__y")
    n, n_toxic = marks.agg(F.count("*"), F.coalesce(F.sum("__y"), F.lit(0))).first()
    prior = float(np.clip(n_toxic / max(1, n), 1e-4, 1 - 1e-4))
    few = lambda df, most: df.select("doc_id").orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").limit(most)
    p = few(marks.where("__y = 1"), positives).withColumn("p", F.lit(1))
    u = few(docs.where(F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id")) != 0)), unlabelled).withColumn("p", F.lit(0))
    ids = [(r[0], r[1]) for r in p.unionByName(u).collect()]
    if not n_toxic or not ids:
        return fit(np.zeros(0), *[np.zeros(0)] * 3, np.zeros(0), prior)
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    chosen = spark.createDataFrame(ids, f"doc_id {kind}, p int")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # an id that repeats counts once, with the least of its texts
    sample = sample.groupBy("doc_id", "p").agg(F.min("text").alias("text")).withColumn("row", F.monotonically_increasing_id())
    sample = materialize(sample, "toxicity-sample")
    n_p, n_u = sample.agg(F.count_if(F.col("p") == 1), F.count_if(F.col("p") == 0)).first()

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = b.column(0).to_numpy() == 1
            for doc, feature, _ in document_features(b.column(1)):
                f, at = np.unique(feature, return_inverse=True)
                a = np.bincount(at, pos[doc], len(f)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(a), pa.array(np.bincount(at, minlength=len(f)) - a)], ["f", "a", "b"])

    counts = sample.select("p", "text").mapInArrow(shares, "f long, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ra, ru = F.col("a") / max(1, n_p), F.col("b") / max(1, n_u)
    clean = F.greatest(F.lit(0.0), (ru - prior * ra) / (1 - prior))
    z = (ra - clean) / F.sqrt((clean + 0.5 / max(1, n_u)) / max(1, n_p) + prior * prior * ra / max(1, n_u))
    best = counts.where((F.col("f") >= LENGTHS) & (F.col("a") >= max(3, n_p // 100)) & (ra > 4 * clean) & (z > 5)).orderBy(z.desc(), "f").limit(features).select("f")
    kept = np.concatenate([np.arange(LENGTHS), np.sort(np.array([r[0] for r in best.collect()], np.int64))])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "p", "f", "v"]
        for b in batches:
            for doc, feature, value in document_features(b.column(3), kept):
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(feature.astype(np.int32)), pa.array(value)], names)

    rows = sample.select("row", "doc_id", "p", "text").mapInArrow(sparse, f"row long, doc_id {kind}, p int, f int, v double").toArrow()
    rows = rows.sort_by([("p", "descending"), ("doc_id", "ascending"), ("f", "ascending")])
    key = rows["row"].to_numpy()
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return fit(kept, np.cumsum(first) - 1, rows["f"].to_numpy(), rows["v"].to_numpy(), rows["p"].to_numpy()[first] == 1, prior)


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.scores(texts), pa.float64())

    return toxicity(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a narrow pass after fitting."""
    model = train(docs, labels, **bounds)
    out = docs.select("doc_id", score_column(model, F.col("text")).alias("score"))
    held = F.coalesce(crc_remainder(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds: int) -> DataFrame:
    """The rows whose score stays below the threshold, with all their columns."""
    return docs.where(score_column(train(docs, labels, **bounds), docs["text"]) < threshold)
