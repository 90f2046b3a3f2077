"""Quality by Bradley-Terry pairwise ranking.

Every pair of a good and a poor document is a preference. A document's worth is linear in features of its shape (binned, so
that an additive curve is learnt for each); minimising the logistic loss on differences of features gives the weights. The
threshold is a quantile of the training scores: the share of poor documents. Scores are shifted so that it falls on `cut`.

Features are of the text alone: letter case, symbols, repeats of words, pairs of words and lines, lengths. All labelled training rows
take part in all that is learnt: the edges of bins, the loss, over all pairs, and the threshold. A pair's loss depends on two scores, so counts
of rows by score and class hold it exactly; each step is two passes over the rows' bins, which executors sum. Defined results: null and empty texts have the features of no words and a
score like any other; without both classes every text scores 0.5; repeated rows get equal scores; ids
may be of any type that sorts; an id that repeats with different texts is learnt from once, with the features that sort first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onceflow.llm.common import coded, crc_remainder, drop_scratch, fmix, lower_words, materialize, owned, text_chunks

_GROUPS = 12
_LUT = np.full(256, 11, np.int64)  # 11: other punctuation and controls
for _i, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32), range(128, 256), b"!", b"|", b"#%&*$@^~", b".,;:", b"<>{}[]=/\\_", b"?-'\"()")):
    _LUT[list(_set)] = _i
NAMES = ["upper", "digit", "bang", "bar", "symbol", "stop", "markup", "quote", "other", "non_ascii", "space", "word_length", "log_words", "distinct", "top", "adjacent", "pairs", "lines_repeated", "line_words"]


def _features(texts: pa.Array) -> np.ndarray:
    n = len(texts)
    texts = owned(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
    doc = np.repeat(np.arange(n), size)
    c = np.bincount(doc * _GROUPS + _LUT[raw], minlength=n * _GROUPS).reshape(n, _GROUPS).astype(float)
    flat, base = lower_words(texts)
    codes, _ = coded(flat)
    words = np.diff(base)
    w1, b1 = np.maximum(words, 1), np.maximum(size, 1)
    of = np.repeat(np.arange(n), words)
    key, times = np.unique((of << 32) | codes, return_counts=True)
    distinct, top = np.bincount(key >> 32, minlength=n), np.zeros(n)
    np.maximum.at(top, key >> 32, times)
    same = of[1:] == of[:-1]
    adjacent = np.bincount(of[1:][same & (codes[1:] == codes[:-1])], minlength=n)
    two = fmix((codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + of[1:].astype(np.uint64))[same] if len(codes) > 1 else np.zeros(0, np.uint64)
    _, first = np.unique(two, return_index=True)
    pairs = np.bincount(of[1:][same][first], minlength=n) if len(codes) > 1 else np.zeros(n)
    lines = pc.split_pattern(texts, "\n")
    per = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    line = lines.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    own = np.unique((np.repeat(np.arange(n), per) << 32) | line) >> 32
    repeated = 1 - np.bincount(own, minlength=n) / np.maximum(per, 1)
    letters = np.maximum(c[:, 0] + c[:, 1], 1)
    return np.column_stack([
        c[:, 0] / letters, c[:, 2] / b1, c[:, 5] / w1, c[:, 6] / w1, c[:, 7] / w1, c[:, 8] / w1, c[:, 9] / w1, c[:, 10] / w1, c[:, 11] / w1, c[:, 4] / b1,
        c[:, 3] / b1, (size - c[:, 3]) / w1, np.log1p(words), distinct / w1, top / w1, adjacent / w1, pairs / np.maximum(words - 1, 1), repeated, words / np.maximum(per, 1),
    ])


def features(texts: pa.Array) -> np.ndarray:
    parts = [_features(texts.slice(s, e - s)) for s, e in text_chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # features x inner edges of bins
    weights: np.ndarray  # features x bins
    threshold: float
    cut: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.size:
            return np.zeros(len(x))
        return sum(self.weights[j][np.searchsorted(self.edges[j], x[:, j], side="right")] for j in range(len(self.edges)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """At the threshold the score is just `cut`."""
        if not self.weights.size:
            return np.full(len(texts), 0.5)
        z = self.worth(features(texts)) - self.threshold + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Weights are whole multiples of this while they are learnt, so scores are too, and equal ones are one cell of a count.
_UNIT = 2.0**-8
#: Slopes of the loss are summed as whole multiples of this: the sums do not depend on how the rows are dealt.
_SLOPE = 2.0**-30
#: Bits of a feature's sortable key that passes over the rows decide, one after another; quantiles are exact to the 32 bits decided.
_RADIX = (16, 8, 8)


def _keys(x: np.ndarray) -> np.ndarray:
    """The upper 32 bits of numbers as keys that sort as they do."""
    raw = (np.asarray(x, float) + 0.0).view(np.uint64)  # + 0.0: no negative zero
    return np.where(raw >> np.uint64(63), ~raw, raw | np.uint64(1 << 63)) >> np.uint64(32)


def _numbers(keys: np.ndarray) -> np.ndarray:
    """The least number of each key."""
    raw = keys.astype(np.uint64) << np.uint64(32)
    return np.where(raw >> np.uint64(63), raw ^ np.uint64(1 << 63), ~raw).view(float)


def _counted(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(cells, return_counts=True)


def _quantiles(total: Callable, good: int, poor: int, features: int, bins: int) -> np.ndarray:
    """features x inner edges of bins: quantiles of all rows, of which each class weighs half. total sums what a function counts over all rows."""
    ask = np.arange(1, bins) / bins * 2.0 * good * poor
    prefix = np.zeros((features, bins - 1), np.int64)
    under, shift = np.zeros((features, bins - 1)), 32  # mass below each prefix
    for bits in _RADIX:
        shift -= bits
        found = [np.unique(p) for p in prefix]
        base = np.concatenate([[0], np.cumsum([len(p) for p in found])])

        def count(x: np.ndarray, y: np.ndarray, found=found, base=base, shift=shift, bits=bits) -> tuple[np.ndarray, np.ndarray]:
            out = []
            for j, p in enumerate(found):
                key = (_keys(x[:, j]) >> np.uint64(shift)).astype(np.int64)
                at = np.minimum(np.searchsorted(p, key >> bits), len(p) - 1)
                on = p[at] == key >> bits
                out.append((((base[j] + at[on]) << bits | key[on] & ((1 << bits) - 1)) << 1) | y[on])
            return _counted(np.concatenate(out))

        cells, n = total(count)
        mass = n * np.where(cells & 1, poor, good).astype(float)
        for j, p in enumerate(found):
            for i in range(bins - 1):
                at = base[j] + np.searchsorted(p, prefix[j, i])
                s, e = np.searchsorted(cells, [at << bits + 1, at + 1 << bits + 1])
                upto = under[j, i] + np.cumsum(mass[s:e])
                k = min(int(np.searchsorted(upto, ask[i], side="right")), e - s - 1)
                under[j, i] = upto[k] - mass[s + k]
                low = cells[s + k] >> 1 & ((1 << bits) - 1)
                if k and cells[s + k] >> 1 == cells[s + k - 1] >> 1:  # both classes of one key
                    under[j, i] -= mass[s + k - 1]
                prefix[j, i] = prefix[j, i] << bits | low
    return _numbers(prefix)


def _binned(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1).astype(np.uint8)


def _convolved(n: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """At each cell the sum over all cells b of n[b] * kernel[b - cell]; kernel: from -(cells - 1) to cells - 1."""
    size = 1 << (len(n) + len(kernel)).bit_length()
    return np.fft.irfft(np.fft.rfft(n, size) * np.fft.rfft(kernel[::-1], size), size)[len(n) - 1 : 2 * len(n) - 1]


class _Pairs:
    """The mean logistic loss over all pairs of a good and a poor row, and its slope, at weights that are multiples of _UNIT."""

    def __init__(self, total: Callable, good: int, poor: int, shape: tuple[int, int], ridge: float = 1e-4):
        self.total, self.good, self.poor, self.shape, self.ridge = total, good, poor, shape, ridge

    def histogram(self, w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The least score, and the good and the poor rows of each score from there on."""
        whole, k = np.rint(w / _UNIT).astype(np.int64), self.shape[1]

        def count(b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return _counted(whole[b + np.arange(b.shape[1]) * k].sum(1) << 1 | y)

        cells, n = self.total(count)
        low, of = int(cells[0] >> 1), (cells >> 1) - (cells[0] >> 1)
        size = int(of[-1]) + 1
        return low, np.bincount(of, n * (cells & 1), size), np.bincount(of, n * (1 - (cells & 1)), size)

    def loss(self, w: np.ndarray, seen: tuple) -> float:
        _, good, poor = seen
        far = np.arange(1 - len(good), len(good)) * _UNIT  # poor score less good score
        return float(good @ _convolved(poor, np.logaddexp(0, far))) / self.good / self.poor + self.ridge / 2 * float(w @ w)

    def slope(self, w: np.ndarray, seen: tuple) -> np.ndarray:
        low, good, poor = seen
        wrong = 1 / (1 + np.exp(-np.arange(1 - len(good), len(good)) * _UNIT))
        up = np.stack([_convolved(good, wrong[::-1]) / self.good, -_convolved(poor, wrong) / self.poor])
        up = np.rint(up / _SLOPE).astype(np.int64)  # by class: what a row's score adds to its class's part of the slope
        whole, (f, k) = np.rint(w / _UNIT).astype(np.int64), self.shape

        def count(b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = b + np.arange(f) * k
            add = up[y, whole[at].sum(1) - low]
            return np.arange(2 * f * k), np.bincount((at + (y * f * k)[:, None]).ravel(), np.repeat(add, f), 2 * f * k).astype(np.int64)

        cells, n = self.total(count)
        both = np.zeros(2 * f * k)
        both[cells] = n * _SLOPE
        return both[: f * k] / self.poor + both[f * k :] / self.good + self.ridge * w


def _descend(pairs: _Pairs, steps: int, memory: int = 12) -> tuple[np.ndarray, tuple]:
    """L-BFGS over multiples of _UNIT, until no step lowers the loss. The weights and their histogram."""
    w = np.zeros(pairs.shape[0] * pairs.shape[1])
    seen = pairs.histogram(w)
    loss, past = pairs.loss(w, seen), []
    g = pairs.slope(w, seen)
    for _ in range(steps):
        d, back = -g, []
        for s, y in reversed(past):
            back.append(s @ d / (s @ y))
            d = d - back[-1] * y
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, np.abs(g).max()))
        for (s, y), a in zip(past, reversed(back), strict=True):
            d = d + (a - y @ d / (s @ y)) * s
        size = min(1.0, 4 / max(1e-12, np.abs(d).max()))
        while True:
            new = np.rint((w + size * d) / _UNIT) * _UNIT
            if (new == w).all():
                return w, seen
            now = pairs.histogram(new)
            if (lower := pairs.loss(new, now)) < loss + 1e-4 * min(0.0, g @ (new - w)):
                break
            size /= 2.5
        done, after = loss - lower < 1e-4 * loss, pairs.slope(new, now)
        if (new - w) @ (after - g) > 1e-12:
            past = [*past, (new - w, after - g)][-memory:]
        w, g, seen, loss = new, after, now, lower
        if done:
            break
    return w, seen


def _fit(total_x: Callable, binned: Callable, good: int, poor: int, poor_share: float, cut: float, features: int, bins: int, steps: int) -> Model:
    """total_x sums a function of features and classes over all rows; binned, given the edges, makes such a function for bins and classes."""
    if not good or not poor:
        return Model(np.zeros((0, 0)), np.zeros((0, 0)), 0.0, cut)
    edges = _quantiles(total_x, good, poor, features, bins)
    w, (low, *seen) = _descend(_Pairs(binned(edges), good, poor, (features, bins)), steps)
    mass = seen[0] * (1 - poor_share) / good + seen[1] * poor_share / poor
    cells = np.flatnonzero(seen[0] + seen[1])
    at = int(np.clip(np.searchsorted(np.cumsum(mass[cells]), poor_share + 1e-9), 1, max(1, len(cells) - 1)))
    threshold = (2 * low + cells[at - 1] + cells[min(at, len(cells) - 1)]) / 2 * _UNIT
    return Model(edges, w.reshape(features, bins), float(threshold), cut)


def fit(x: np.ndarray, y: np.ndarray, poor_share: float, *, cut: float = 0.3, bins: int = 16, steps: int = 60) -> Model:
    """Bradley-Terry weights from all preference pairs (good over poor), and the quantile `poor_share` of the scores. Rows in memory; train's are not."""
    y = np.asarray(y, np.int64)
    return _fit(lambda count: count(x, y), lambda edges: lambda count: count(_binned(edges, x), y), int(y.sum()), int((1 - y).sum()), poor_share, cut, x.shape[1], bins, steps)


def _total(rows: DataFrame, kind: type, width: int) -> Callable:
    """What a function counts over all rows of packed features or bins and classes, in whole numbers. Tasks add up their batches before they send."""

    def total(count: Callable) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, n = [], []
            held = 0

            def merged() -> tuple[np.ndarray, np.ndarray]:
                every, at = np.unique(np.concatenate(cells), return_inverse=True)
                out = np.zeros(len(every), np.int64)
                np.add.at(out, at, np.concatenate(n))
                return every, out

            for b in batches:
                for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True):
                    c, m = count(np.frombuffer(x, kind).reshape(-1, width), np.frombuffer(y, np.uint8).astype(np.int64))
                    cells.append(c)
                    n.append(m)
                    held += len(c)
                    if held > 1 << 20:
                        c, m = merged()
                        cells, n, held = [c], [m], 0
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in merged()], ["cell", "n"])

        sums = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
        return sums["cell"].to_numpy(), sums["n"].to_numpy()

    return total


def train(docs: DataFrame, labels: DataFrame, *, cut: float = 0.3) -> Model:
    """Learns from all labelled rows, none with crc32(doc_id) mod 5 = 0. Executors count and sum; the driver holds counts of cells, not rows."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_remainder(F.col("doc_id")) != 0))
    poor_share = marked.agg(F.avg(1 - F.col("quality"))).first()[0]
    marked = marked.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"), F.max("quality").alias("z")).where("y = z").select("doc_id", "y")
    kind, width = docs.schema["doc_id"].dataType.simpleString(), len(NAMES)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in features(b.column(1))], pa.binary())], ["doc_id", "x"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(b["x"].to_pylist())]), pa.array([b["y"].to_numpy().astype(np.uint8).tobytes()])], ["x", "y"])

    # texts stay where they are: only their features meet the labels
    x = docs.where(F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id")) != 0)).select("doc_id", "text").mapInArrow(shapes, f"doc_id {kind}, x binary")
    x = x.join(marked, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    rows = materialize(x.select("x", "y").mapInArrow(packed, "x binary, y binary"), "quality-features")
    scratch = [rows]
    total = _total(rows, float, width)
    sizes = dict(zip(*(a.tolist() for a in total(lambda _, y: _counted(y))), strict=True))

    def binned(edges: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([_binned(edges, np.frombuffer(v, float).reshape(-1, width)).tobytes() for v in b["x"].to_pylist()], pa.binary()), b["y"]], ["x", "y"])

        scratch.append(materialize(rows.mapInArrow(run, "x binary, y binary"), "quality-bins"))
        return _total(scratch[-1], np.uint8, width)

    model = _fit(total, binned, sizes.get(1, 0), sizes.get(0, 0), float(poor_share or 0), cut, width, 16, 60)
    drop_scratch(*scratch)
    return model


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.scores(texts), pa.float64())

    return quality(text)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a narrow pass after fitting."""
    out = docs.select("doc_id", score_column(train(docs, labels, cut=cut), F.col("text")).alias("score"))
    held = F.coalesce(crc_remainder(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows whose score reaches the cut, with all their columns."""
    return docs.where(score_column(train(docs, labels, cut=cut), docs["text"]) >= cut)
