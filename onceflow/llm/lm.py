"""Language-model scores: a causal self-attention model in numpy over subword ids, beside a smoothed word unigram.

The model reads a text's lower-cased words, one blank before each, as ids of a public byte-level vocabulary, and an end.
A causal attention layer over a window and the id before predict the next id in two steps, a cluster of ids and an id of the
cluster; the clusters come from which ids follow which. The most frequent ids have outputs of their own, the others share two, within
which counts decide. Windows of a text overlap: each id is scored once, all but a text's first with at least
`overlap` ids before it. Windows of many texts are scored in one batch with a mask.

Everything learnt covers all training documents: counts of subwords (which choose the outputs) and of pairs of neighbours, word counts, their total, the number
of distinct words, and the attention weights, which learn from every window of every training document, once. The method is one at every size: there is a task for each
`documents` * `windows` windows, one at least; each learns from its own share in rounds, after which the tasks' weights are averaged.

Words are counted in two levels: a chunk of texts sends one entry a distinct word, whose counts come back to the chunk, so neither a hot word nor a long text is
one task's work. Words are told apart by 64-bit hashes.

Defined results: null and empty texts consist of the end alone; a null id counts as a training row; without training rows every
count is 0 and the base score adds log10(0.5 / 0.5) = 0 a token; repeated rows count and score each; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onceflow.llm.common import coded, drop_scratch, fmix, id_crc, lower_words, materialize, ragged, text_chunks, word_hashes
from onceflow.llm.tokencount import END, VOCABULARY, encoder, shipped

CHUNK = 8 << 20
#: Ids of a window, of which all but a text's first window repeat the first OVERLAP as context.
WINDOW, OVERLAP = 64, 8
WIDTH, HIDDEN, CLUSTERS, MEMBERS = 16, 32, 32, 32
#: Bound of queries, keys and values; a product of WIDTH of them over its root stays below 88.
_BOUND = 4.5
_SCALE = np.float32(WIDTH**-0.5)
#: Windows whose attention weights are worked out at once: few enough to stay in a core's cache.
_PART = 16
#: Places whose outputs' probabilities are worked out at once, likewise.
_ROWS = 2048
#: What stands before a text's first id in stored windows: no id of the vocabulary.
_START = 65535
#: Rounds hold growing shares of the windows, in 64ths: these are their ends. Tasks agree often while weights move fast.
_ROUNDS = np.array([1, 2, 4, 8, 16, 32, 48, 64])
#: Outputs: ids of their own and two shared ones, for the others that begin a word and that do not.
SLOTS = CLUSTERS * MEMBERS


class Subwords:
    """Ids of words, each with the blank before it."""

    def __init__(self, vocabulary: str | bytes):
        self.enc = encoder(vocabulary)
        self.size = np.array([len(self.enc.decode_single_token_bytes(i)) for i in range(END)], np.int64)
        self.begins = np.array([self.enc.decode_single_token_bytes(i)[:1] == b" " for i in range(END)] + [False])

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and where each word's begin."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
        text = (b" " + b" ".join(words)).decode("utf-8", "replace")
        if not re.search(r"[^\S ]", text) and "�" not in text:
            ids = self.enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(self.size[ids])])
            at = np.searchsorted(ends, starts)
            if (ends[at] == starts).all():
                return ids, at
        parts = [self.enc.encode_to_numpy(" " + w.decode("utf-8", "replace"), disallowed_special=()).astype(np.int32) for w in words]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def text_ids(sub: Subwords, words: list[bytes], codes: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts given as codes of words, each text closed by END; and where each text's begin."""
    flat, at = sub(words)
    sizes = np.diff(at)[codes] if len(codes) else codes
    ids = flat[ragged(at[codes], sizes)] if len(codes) else np.zeros(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(sizes)])[base]  # of each text without its END
    out = np.full(len(ids) + len(base) - 1, END, np.int32)
    place = np.arange(len(ids)) + np.repeat(np.arange(len(base) - 1), np.diff(ends))
    out[place] = ids
    return out, ends + np.arange(len(base))


def slots_of(counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The output of each id: END and the most frequent have their own."""
    order = np.argsort(-counts, kind="stable")
    slot = np.where(begins, SLOTS - 2, SLOTS - 1)
    slot[[END, *[i for i in order if i != END][: SLOTS - 3]]] = np.arange(SLOTS - 2)
    return slot.astype(np.int32)


def clustered(pairs: np.ndarray) -> np.ndarray:
    """A renumbering of the outputs so that MEMBERS in a row, a cluster, follow and precede alike: halved by principal components."""
    near = pairs[:SLOTS] + 0.1
    near = np.log(near / near.sum(1, keepdims=True) / (near.sum(0) / near.sum()))
    _, _, axes = np.linalg.svd(np.concatenate([near, near.T], 1) - np.concatenate([near, near.T], 1).mean(0), full_matrices=False)
    points = np.concatenate([near, near.T], 1) @ axes[:16].T
    groups = [np.arange(SLOTS)]
    while len(groups) < CLUSTERS:
        halves = []
        for g in groups:
            x = points[g] - points[g].mean(0)
            by = g[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
            halves += [by[: len(g) // 2], by[len(g) // 2 :]]
        groups = halves
    new = np.empty(SLOTS, np.int64)
    new[np.concatenate(groups)] = np.arange(SLOTS)
    return new


class Space:
    """Arrays that one batch after another is worked out in. New ones for each batch would cost more than the work: the system hands out their memory page by page."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        """An array of that shape, whose numbers are of no meaning, good until the name is asked for again."""
        size, x = math.prod(shape), self.held.get(name)
        if x is None or len(x) < size or x.dtype != kind:
            x = self.held[name] = np.empty(size, kind)
        return x[:size].reshape(shape)


def _qkv(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of queries, keys, and values with what stands beside them."""
    return x[..., :WIDTH], x[..., WIDTH : 2 * WIDTH], x[..., 2 * WIDTH :]


@dataclass
class Model:
    slot: np.ndarray  # output of each id; also its row of the embedding, SLOTS being a text's beginning
    within: np.ndarray  # log10 of an id's share of its output
    top: np.ndarray  # outputs before + 1 x clusters: log of the next cluster's share
    inner: np.ndarray  # clusters x outputs before + 1 x members: log of the next output's share of its cluster
    weights: dict[str, np.ndarray]
    learnt_from: int = 0  # training windows

    @classmethod
    def of_counts(cls, slot: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> Model:
        """counts of ids; pairs of neighbouring outputs, the last row after a text's beginning."""
        new = clustered(pairs)
        moved = np.zeros_like(pairs)
        moved[np.append(new, SLOTS)[:, None], new] = pairs
        slot = new[slot].astype(np.int32)
        size, total = np.bincount(slot, minlength=SLOTS), np.bincount(slot, counts, SLOTS)
        within = np.log10((counts + 0.5) / (total + 0.5 * size)[slot])
        share = moved.sum(0) + 0.5
        p = moved + 20 * share / share.sum()
        p /= p.sum(1, keepdims=True)
        top = p.reshape(SLOTS + 1, CLUSTERS, MEMBERS).sum(2)
        inner = np.ascontiguousarray((p / np.repeat(top, MEMBERS, 1)).reshape(SLOTS + 1, CLUSTERS, MEMBERS).transpose(1, 0, 2))
        rng = np.random.default_rng(5)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        weights = {"embed": draw(SLOTS + 1, WIDTH), "place": draw(WINDOW, WIDTH), "qkv": draw(WIDTH, 3 * WIDTH), "out": draw(WIDTH, WIDTH), "up": draw(WIDTH, HIDDEN), "down": draw(HIDDEN, WIDTH), "top": np.zeros((WIDTH, CLUSTERS), np.float32), "inner": np.zeros((CLUSTERS, WIDTH, MEMBERS), np.float32)}
        return cls(slot, within.astype(np.float32), np.log(top).astype(np.float32), np.log(inner).astype(np.float32), weights)

    def hidden(self, read: np.ndarray, keep: dict | None = None, space: Space | None = None) -> np.ndarray:
        """The attention layer's output at each place of windows of outputs read."""
        w, space = self.weights, space or Space()
        (b, t), kind = read.shape, w["embed"].dtype
        n = b * t
        x = np.take(w["embed"], read.reshape(-1), 0, out=space("x", kind, n, WIDTH), mode="clip")
        x.reshape(b, t, WIDTH)[:] += w["place"][:t]
        # projected by row of the embedding and by place; a column of ones beside the values: one product gives the weighted sums and what to divide them by
        project = np.concatenate([w["qkv"], np.zeros((WIDTH, 1), kind)], 1)
        qkv = np.take(w["embed"] @ project, read.reshape(-1), 0, out=space("qkv", kind, n, 3 * WIDTH + 1), mode="clip")
        qkv.reshape(b, t, -1)[:] += w["place"][:t] @ project
        np.clip(qkv, -_BOUND, _BOUND, out=qkv)  # so that no exp overflows
        qkv[:, :WIDTH] *= _SCALE
        qkv[:, 3 * WIDTH] = 1
        q, k, v = _qkv(qkv.reshape(b, t, -1))
        causal = np.tri(t, dtype=kind)
        a = space("a", kind, b if keep is not None else min(b, _PART), t, t)
        sums = space("sums", kind, b, t, WIDTH + 1)
        for s in range(0, b, _PART):
            few = slice(s, min(b, s + _PART))
            part = a[few] if keep is not None else a[: few.stop - s]
            np.matmul(q[few], k[few].transpose(0, 2, 1), out=part)
            np.exp(part, out=part)
            part *= causal
            np.matmul(part, v[few], out=sums[few])
            if keep is not None:
                part *= 1 / sums[few, :, WIDTH:]
        z = np.divide(sums[..., :WIDTH], sums[..., WIDTH:], out=space("z", kind, b, t, WIDTH)).reshape(n, WIDTH)
        y = np.matmul(z, w["out"], out=space("y", kind, n, WIDTH))
        y += x
        u = np.matmul(y, w["up"], out=space("u", kind, n, HIDDEN))
        np.maximum(u, 0, out=u)
        h = np.matmul(u, w["down"], out=space("h", kind, n, WIDTH))
        h += y
        if keep is not None:
            keep |= {"x": x, "qkv": qkv, "a": a, "z": z, "y": y, "u": u}
        return h

    def logs(self, h: np.ndarray, before: np.ndarray, target: np.ndarray, grads: dict | None = None, weight: np.ndarray | None = None, space: Space | None = None) -> np.ndarray:
        """Log of the target outputs' probabilities. With grads, also the gradients of -weight * log into it, and h's as "h"."""
        w, space, n, kind = self.weights, space or Space(), len(target), h.dtype
        order = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")  # places by the cluster of their target: one product a cluster
        target, before = target.take(order), before.take(order)
        cluster, member = target // MEMBERS, target % MEMBERS
        ends = np.searchsorted(cluster, np.arange(CLUSTERS + 1))
        h = np.take(h, order, 0, out=space("ordered", kind, n, WIDTH), mode="clip")
        first, second = np.matmul(h, w["top"], out=space("first", kind, n, CLUSTERS)), space("second", kind, n, MEMBERS)
        found = [(c, slice(ends[c], ends[c + 1])) for c in range(CLUSTERS) if ends[c] < ends[c + 1]]
        for c, at in found:
            np.matmul(h[at], w["inner"][c], out=second[at])
        value, total = np.zeros(n, kind), space("total", kind, n)
        weight = None if grads is None else weight.take(order)
        for x, known, row, hit in ((first, self.top, before, cluster), (second, self.inner.reshape(-1, MEMBERS), cluster * (SLOTS + 1) + before, member)):
            width = x.shape[1]
            ones, hit = np.ones(width, kind), np.arange(n) * width + hit
            for s in range(0, n, _ROWS):
                few = slice(s, min(n, s + _ROWS))
                part, at = x[few], hit[few]
                part += np.take(known, row[few], 0, out=space("known", known.dtype, len(part), width), mode="clip")
                value[few] += x.take(at)
                np.exp(part, out=part)
                np.matmul(part, ones, out=total[few])
                if grads is not None:
                    part *= (weight[few] / total[few])[:, None]
                    x.reshape(-1)[at] -= weight[few]
            value -= np.log(total)
        if grads is not None:
            grads["top"], grads["inner"] = h.T @ first, np.zeros_like(w["inner"])
            dh, more = np.matmul(first, w["top"].T, out=space("dh ordered", kind, n, WIDTH)), space("dh inner", kind, n, WIDTH)
            for c, at in found:
                np.matmul(h[at].T, second[at], out=grads["inner"][c])
                np.matmul(second[at], w["inner"][c].T, out=more[at])
            dh += more
            grads["h"] = space("dh", kind, n, WIDTH)
            grads["h"][order] = dh
        out = np.empty_like(value)
        out[order] = value
        return out

    def backward(self, read: np.ndarray, dh: np.ndarray, keep: dict, space: Space | None = None) -> dict[str, np.ndarray]:
        """Gradients of the layer's weights from that of its output."""
        w, g, space = self.weights, {}, space or Space()
        (b, t), n, kind = read.shape, read.size, dh.dtype
        x, a, z, y, u = (keep[i] for i in ("x", "a", "z", "y", "u"))
        g["down"] = u.T @ dh
        du = np.matmul(dh, w["down"].T, out=space("du", kind, n, HIDDEN))
        du *= np.greater(u, 0, out=space("on", np.dtype(bool), n, HIDDEN))
        g["up"] = y.T @ du
        dy = np.matmul(du, w["up"].T, out=space("dy", kind, n, WIDTH))
        dy += dh
        g["out"] = z.T @ dy
        dz = space("dz", kind, n, WIDTH + 1)
        np.matmul(dy, w["out"].T, out=dz[:, :WIDTH])
        np.einsum("ij,ij->i", dz[:, :WIDTH], z, out=dz[:, WIDTH])
        dz[:, WIDTH] *= -1  # what the weights' sum of 1 takes back meets the column of ones
        dz = dz.reshape(b, t, WIDTH + 1)
        q, k, v = _qkv(keep["qkv"].reshape(b, t, -1))
        dqkv = space("dqkv", kind, b, t, 3 * WIDTH)
        dq, dk, dv = _qkv(dqkv)
        ds = space("ds", kind, min(b, _PART), t, t)
        for s in range(0, b, _PART):
            few = slice(s, min(b, s + _PART))
            part = np.matmul(dz[few], v[few].transpose(0, 2, 1), out=ds[: few.stop - s])
            part *= a[few]
            np.matmul(part, k[few], out=dq[few])
            np.matmul(part.transpose(0, 2, 1), q[few], out=dk[few])
            np.matmul(a[few].transpose(0, 2, 1), dz[few, :, :WIDTH], out=dv[few])
        dq *= _SCALE
        dqkv = dqkv.reshape(n, 3 * WIDTH)
        g["qkv"] = x.T @ dqkv
        dx = np.matmul(dqkv, w["qkv"].T, out=space("dx", kind, n, WIDTH))
        dx += dy
        g["place"] = np.zeros_like(w["place"])
        g["place"][:t] = dx.reshape(b, t, WIDTH).sum(0)
        g["embed"] = np.stack([np.bincount(read.reshape(-1), dx[:, i], len(w["embed"])) for i in range(WIDTH)], 1).astype(np.float32)
        return g

    def learn(self, windows: list[np.ndarray], *, passes: int = 4, batch: int = 32) -> None:
        """windows: ids with the one before them at the front (-1 at a text's beginning). Adam on the mean cross-entropy."""
        if not windows:
            return
        ids = np.full((len(windows), WINDOW + 1), -2, np.int64)
        for i, x in enumerate(windows):
            ids[i, : len(x)] = x[: WINDOW + 1]
        outputs = np.where(ids >= 0, self.slot[ids], SLOTS)
        adam = Adam(self)
        rng, total = np.random.default_rng(3), passes * -(-len(ids) // batch)
        for _ in range(passes):
            order = rng.permutation(len(ids))
            for s in range(0, len(ids), batch):
                adam.descend(outputs[order[s : s + batch]], 1 - 0.9 * (adam.step + 1) / total)

    def log10s(self, ids: np.ndarray, starts: np.ndarray, batch: int = 256) -> np.ndarray:
        """log10 of each text's probability, END included. ids: texts in a row, of at least one id each."""
        sizes, stride = np.diff(starts), WINDOW - OVERLAP
        if not len(sizes):
            return np.zeros(0)
        number = 1 + np.maximum(0, -(-(sizes - WINDOW) // stride))
        text = np.repeat(np.arange(len(sizes)), number)
        begin = stride * (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number))  # of the window's targets in its text
        order = np.argsort(np.minimum(sizes[text] - begin, WINDOW), kind="stable")  # windows of a length together
        out, step, outputs, within = np.zeros(len(sizes)), np.arange(WINDOW), self.slot[ids], self.within[ids]
        begin, first_of, left_of, space = begin.astype(np.int32), starts[text] + begin, sizes[text] - begin, Space()
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            left, starting = left_of[pick], begin[pick] == 0
            t = int(min(WINDOW, left.max()))
            at = np.minimum(first_of[pick][:, None] + step[:t], len(ids) - 1)
            target = outputs.take(at)
            read = np.empty_like(target)
            read[:, 1:] = target[:, :-1]
            read[:, 0] = np.where(starting, SLOTS, outputs.take(at[:, 0] - 1, mode="clip"))
            scored = np.flatnonzero((step[:t] < left[:, None]) & (starting[:, None] | (step[:t] >= OVERLAP)))  # not context, not beyond the end
            h = self.hidden(read, space=space)
            h = np.take(h, scored, 0, out=space("scored", h.dtype, len(scored), WIDTH), mode="clip")
            value = self.logs(h, read.reshape(-1).take(scored), target.reshape(-1).take(scored), space=space)
            value /= np.float32(np.log(10))
            value += within.take(at.reshape(-1).take(scored))
            out += np.bincount(text[pick].take(scored // t), value, len(sizes))
        return out


class Adam:
    """Steps of a model's weights, and their state as one row of numbers."""

    def __init__(self, model: Model, state: np.ndarray | None = None, step: int = 0):
        self.model, self.step, self.space = model, step, Space()
        self.m = {k: np.zeros_like(v) for k, v in model.weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.weights.items()}
        if state is not None:
            at = 0
            for part in (model.weights, self.m, self.v):
                for k, x in part.items():
                    part[k] = state[at : at + x.size].reshape(x.shape).astype(np.float32)
                    at += x.size

    def state(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for part in (self.model.weights, self.m, self.v) for x in part.values()])

    def descend(self, outputs: np.ndarray, rate: float) -> None:
        """One step. outputs: windows with the output before them at the front; SLOTS is no target."""
        model, space, keep, grads = self.model, self.space, {}, {}
        read, target = np.ascontiguousarray(outputs[:, :-1]), outputs[:, 1:].reshape(-1)
        on = target < SLOTS
        model.logs(model.hidden(read, keep, space), read.reshape(-1), np.where(on, target, 0), grads, (on / max(1, on.sum())).astype(np.float32), space)
        grads |= model.backward(read, grads.pop("h"), keep, space)
        self.step += 1
        rate *= 0.01 * min(1, self.step / 50)
        for k, g in grads.items():
            w, m, v = model.weights[k], self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            g *= g
            g *= 0.01
            v += g
            by = np.sqrt(v)
            by *= (1 - 0.99**self.step) ** -0.5
            by += 1e-8
            np.divide(m, by, out=by)
            by *= rate / (1 - 0.9**self.step)
            w -= by


def _training(ids: pa.Array, remainder: int) -> np.ndarray:
    return np.array([i is None or id_crc(i) % 5 != remainder for i in ids.to_pylist()], bool)


def _windows(names: pa.Array, ids: np.ndarray, starts: np.ndarray, learn: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Rounds, sizes and ids of all windows of those texts that learn marks."""
    crc = np.array([0 if i is None else id_crc(i) for i in names.to_pylist()], np.uint64)
    sizes = np.diff(starts)
    number = -(-sizes // WINDOW) * learn
    text = np.repeat(np.arange(len(sizes)), number)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    begin, size = starts[text] + text + WINDOW * nth, np.minimum(WINDOW, sizes[text] - WINDOW * nth) + 1
    ids = np.insert(ids.astype("<u2"), starts[:-1], _START)
    share = fmix(crc[text] << np.uint64(32) | nth.astype(np.uint64)) % np.uint64(_ROUNDS[-1])
    rounds = np.searchsorted(_ROUNDS, share.astype(np.int64), side="right")
    for r in np.unique(rounds):
        at = np.flatnonzero(rounds == r)
        yield int(r), size[at].astype("u1").tobytes(), ids[ragged(begin[at], size[at])].tobytes()


def training_windows(docs: DataFrame, vocabulary: str, remainder: int) -> DataFrame:
    """(round, sizes, ids): all windows of all training documents, each of up to WINDOW ids with the one before them at the front. A row holds a chunk's
    windows of a round; a window's round depends on its document's id and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(vocabulary)
        for b in batches:
            mine = pa.array(_training(b.column(0), remainder))
            names, texts = b.column(0).filter(mine), b.column(1).filter(mine)
            for s, e in text_chunks(texts, CHUNK):
                flat, base = lower_words(texts.slice(s, e - s))
                codes, words = coded(flat)
                ids, starts = text_ids(sub, words, codes, base)
                for r, sizes, ids in _windows(names.slice(s, e - s), ids, starts, np.ones(e - s, bool)):
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([sizes]), pa.array([ids])], ["round", "sizes", "ids"])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, "round int, sizes binary, ids binary"), "lm-windows")


#: Parts that counts and weights are summed in.
_RANGES = 16


#: Tasks whose sums are added up in one group.
_TOGETHER = 32
#: Training windows whose words make a bucket.
_BUCKET_WINDOWS = 200_000


def _summed(windows: DataFrame, cells: int, count) -> np.ndarray:
    """Sums over all windows, of whole numbers. A task sums its rows and sends its sums in ranges; _TOGETHER tasks' sums of a range are added up in a group, then as many
    groups' sums, until one is left, so a group holds as much whatever the number of tasks."""
    schema = "r int, task long, at binary, n binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(cells, np.int64)
        for b in batches:
            for sizes, ids in zip(b["sizes"].to_pylist(), b["ids"].to_pylist(), strict=True):
                count(total, np.frombuffer(sizes, "u1"), np.frombuffer(ids, "<u2"))
        task = TaskContext.get().partitionId()
        for r in range(_RANGES):
            part = total[r * cells // _RANGES : (r + 1) * cells // _RANGES]
            some = np.flatnonzero(part)
            if len(some):
                blobs = [pa.array([some.astype("<u4").tobytes()]), pa.array([part[some].astype("<i8").tobytes()])]
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([task], pa.int64()), *blobs], ["r", "task", "at", "n"])

    def add(t: pa.Table) -> pa.Table:
        r = t["r"][0].as_py()
        total = np.zeros((r + 1) * cells // _RANGES - r * cells // _RANGES, np.int64)
        for at, n in zip(t["at"].to_pylist(), t["n"].to_pylist(), strict=True):
            total[np.frombuffer(at, "<u4")] += np.frombuffer(n, "<i8")
        some = np.flatnonzero(total)
        blobs = {"at": pa.array([some.astype("<u4").tobytes()], pa.binary()), "n": pa.array([total[some].astype("<i8").tobytes()], pa.binary())}
        return pa.table({"r": t["r"][:1], "task": t["task"][:1]} | blobs)

    tasks = windows.rdd.getNumPartitions()
    sums = windows.select("sizes", "ids").mapInArrow(run, schema)
    while True:
        tasks = -(-tasks // _TOGETHER)
        sums = sums.withColumn("task", F.floor(F.col("task") / _TOGETHER)).groupBy("r", "task").applyInArrow(add, schema)
        if tasks <= 1:
            break
    total = np.zeros(cells, np.int64)
    for r, _, at, n in sums.collect():
        total[r * cells // _RANGES + np.frombuffer(at, "<u4").astype(np.int64)] += np.frombuffer(n, "<i8")
    return total


def id_counts(windows: DataFrame) -> tuple[np.ndarray, int]:
    """Counts of all ids in all training documents, and the number of windows."""

    def count(total: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        front = np.cumsum(sizes, dtype=np.int64) - sizes  # the id before a window is a target of the window before
        total[: END + 1] += np.bincount(ids, minlength=_START + 1)[: END + 1] - np.bincount(ids[front], minlength=_START + 1)[: END + 1]
        total[END + 1] += len(sizes)

    total = _summed(windows, END + 2, count)
    return total[:-1], int(total[-1])


def pair_counts(windows: DataFrame, slot: np.ndarray) -> np.ndarray:
    """Counts of all pairs of neighbouring outputs in all training documents, the last row after a text's beginning."""
    wide = _wide(slot)

    def count(total: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        now = wide[ids].astype(np.int64)
        pair = now[:-1] * SLOTS + now[1:]
        front = np.cumsum(sizes, dtype=np.int64)[:-1]
        total += np.bincount(np.delete(pair, front - 1), minlength=len(total))  # not from one window's end to the next's front

    return _summed(windows, (SLOTS + 1) * SLOTS, count).reshape(SLOTS + 1, SLOTS).astype(np.float64)


def _wide(slot: np.ndarray) -> np.ndarray:
    """The outputs of ids, and SLOTS for a text's beginning."""
    wide = np.full(_START + 1, SLOTS, np.int32)
    wide[: len(slot)] = slot
    return wide


def train(docs: DataFrame, vocabulary: str = VOCABULARY, remainder: int = 1, documents: int = 2500, windows: int = 16) -> Model:
    """A model of all training documents. There is a task for each documents * windows windows, and each learns its share."""
    vocabulary = shipped(vocabulary)
    rows = training_windows(docs, vocabulary, remainder)
    model = _fit(rows, vocabulary, documents * windows)
    drop_scratch(rows)
    return model


def _fit(rows: DataFrame, vocabulary: str, most: int) -> Model:
    counts, n = id_counts(rows)
    slot = slots_of(counts, Subwords(vocabulary).begins)
    model = Model.of_counts(slot, counts, pair_counts(rows, slot))
    model.learnt_from = n
    _learn(model, rows, tasks=max(1, n // most))
    return model


def _learn(model: Model, rows: DataFrame, tasks: int) -> None:
    """Rounds in which each of at most `tasks` tasks learns from all of its windows of the round, beginning with what the tasks had on average after the round before."""
    wide, batch = _wide(model.slot), 128
    state, step = Adam(model).state(), 0
    cells = len(state)

    def of(state: np.ndarray, step: int, rate: float, seed: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            adam, rng, held, seen = Adam(model, state, step), np.random.default_rng(seed), [], 0

            def learn() -> None:
                outputs = np.concatenate(held)
                order = rng.permutation(len(outputs))
                for s in range(0, len(order), batch):
                    adam.descend(outputs[order[s : s + batch]], rate)
                held.clear()

            for b in batches:
                for sizes, ids in zip(b["sizes"].to_pylist(), b["ids"].to_pylist(), strict=True):
                    sizes, ids = np.frombuffer(sizes, "u1"), wide[np.frombuffer(ids, "<u2")]
                    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                    for s in range(0, len(sizes), 1 << 13):
                        few = sizes[s : s + (1 << 13)]
                        outputs = np.full((len(few), WINDOW + 1), SLOTS, np.int64)
                        outputs[np.arange(WINDOW + 1) < few[:, None]] = ids[ends[s] : ends[s + len(few)]]
                        held.append(outputs)
                        seen += len(few)
                        if sum(map(len, held)) >= 1 << 13:
                            learn()
            if held:
                learn()
            if seen:
                now = adam.state()
                for r in range(_RANGES):
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([seen]), pa.array([adam.step]), pa.array([now[r * cells // _RANGES : (r + 1) * cells // _RANGES].tobytes()])], ["r", "n", "step", "x"])

        return run

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "ascending"), ("x", "ascending")])  # sums in one order
        n, total = np.array(t["n"].to_pylist(), np.float64), 0.0
        for k, x in zip(n / n.sum(), t["x"].to_pylist(), strict=True):
            total = total + k * np.frombuffer(x, "<f4").astype(np.float64)
        step = round(float((n * np.array(t["step"].to_pylist())).sum() / n.sum()))
        return pa.table({"r": t["r"][:1], "step": pa.array([step]), "x": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    for r in range(len(_ROUNDS)):
        done = _ROUNDS[r - 1] / _ROUNDS[-1] if r else 0
        mine = rows.where(F.col("round") == r).select("sizes", "ids").coalesce(tasks)
        mine = mine.mapInArrow(of(state, step, 1 - 0.9 * done, 3 + r), "r int, n long, step long, x binary")
        state = state.copy()
        for at, step, x in mine.groupBy("r").applyInArrow(mean, "r int, step long, x binary").collect():
            state[at * cells // _RANGES : (at + 1) * cells // _RANGES] = np.frombuffer(x, np.float32)
    Adam(model, state)


#: Columns of a row of _scan, by kind.
_KINDS = (("chunk", "place", "doc_id", "held_out", "n_tokens", "ids"), ("chunk", "words", "counts", "holders", "places", "times"), ("round", "sizes", "windows"))


def _scan_schema(kind: str) -> str:
    return f"kind int, chunk long, place int, doc_id {kind}, held_out boolean, n_tokens long, ids binary, words binary, counts binary, holders binary, places binary, times binary, round int, sizes binary, windows binary"


def _scan(vocabulary: str, remainder: int):
    """All that is read of the texts, in one pass. Rows of kind 0: a document (chunk, place, doc_id, held_out, n_tokens, ids); of kind 1: a chunk's words in order of
    their hashes (hashes, training counts, and which texts hold each how often); of kind 2: a chunk's training windows of a round."""
    types = {"kind": pa.int32(), "chunk": pa.int64(), "place": pa.int32(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "round": pa.int32()}
    names = ["kind", *dict.fromkeys(c for k in _KINDS for c in k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(vocabulary)
        for b in batches:
            for s0, e0 in text_chunks(b.column(1), CHUNK):
                for s in range(s0, e0, 60_000):
                    n = min(e0, s + 60_000) - s
                    for kind, columns in chunk(sub, b.column(0).slice(s, n), b.column(1).slice(s, n)):
                        m = len(columns[0])
                        given = {"kind": pa.array(np.full(m, kind, np.int32))} | dict(zip(_KINDS[kind], columns, strict=True))
                        types["doc_id"] = b.column(0).type
                        yield pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(m, types.get(c, pa.binary())) for c in names], names)

    def chunk(sub: Subwords, names: pa.Array, texts: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        number, n = uuid.uuid4().int >> 65, len(texts)
        learn = _training(names, remainder)
        flat, base = lower_words(texts)
        codes, words = coded(flat)
        sizes = np.diff(base)
        ids, starts = text_ids(sub, words, codes, base)
        blobs = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(2 * starts), pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary())
        yield 0, [pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), names, pa.array(~learn), pa.array(sizes + 1), blobs]
        for r, few, of in _windows(names, ids, starts, learn):
            yield 2, [pa.array([r], pa.int32()), pa.array([few]), pa.array([of])]
        if not words:
            return
        text = np.repeat(np.arange(n), sizes)
        counts = np.bincount(codes[learn[text]], minlength=len(words))
        hashes = word_hashes(words)
        by = np.argsort(hashes)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        pair, times = np.unique(rank[codes] << 20 | text, return_counts=True)
        while (times > 65535).any():  # counts are 16-bit: what exceeds them is a further entry
            more = times > 65535
            pair, times = np.concatenate([pair, pair[more]]), np.concatenate([np.minimum(times, 65535), times[more] - 65535])
        order = np.argsort(pair, kind="stable")
        pair, times = pair[order], times[order]
        holders = np.bincount(pair >> 20, minlength=len(by))
        yield 1, [pa.array([number]), *(pa.array([v.astype(kind).tobytes()]) for v, kind in ((hashes[by], "<u8"), (counts[by], "<u4"), (holders, "<u4"), (pair & 0xFFFFF, "<u2"), (times, "<u2")))]

    return run


def _in_buckets(buckets: int, columns: list[str]):
    """A chunk's words, cut in equal ranges of their hashes."""
    edges = np.array([-(-(i << 64) // buckets) for i in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                hashes, holders = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["holders"], "<u4")
                ends = np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])
                posts = np.concatenate([[0], np.cumsum(holders, dtype=np.int64)])[ends]
                found = np.flatnonzero(np.diff(ends))
                of = {"words": (ends, 8), "counts": (ends, 4), "holders": (ends, 4), "places": (posts, 2), "times": (posts, 2)}
                cut = lambda c: pa.array([row[c][of[c][0][i] * of[c][1] : of[c][0][i + 1] * of[c][1]] for i in found], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row["chunk"])), pa.array(found.astype(np.int32)), *map(cut, columns)], ["chunk", "bucket", *columns])

    return run


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with their scores instead of their ids."""
        for b in batches:
            for s, e in text_chunks(b["ids"], CHUNK // 2):
                few = b.slice(s, e - s)
                ids = few["ids"].to_pylist()
                starts = np.concatenate([[0], np.cumsum([len(x) // 2 for x in ids])])
                scores = model.log10s(np.frombuffer(b"".join(ids), "<u2"), starts)
                yield pa.RecordBatch.from_arrays([*few.columns[:-1], pa.array(scores)], [*few.schema.names[:-1], "score"])

    return run


def _totals(t: pa.Table) -> pa.Table:
    """For each chunk's words of one bucket their counts over all chunks; the bucket's sum and number of counted words on its first row."""
    parts = [np.frombuffer(x, "<u8") for x in t["words"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in t["counts"].to_pylist()])
    words, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(at, counts, len(words)).astype(np.int64)
    kind = "<u4" if total.max() < 1 << 32 else "<u8"
    ends = np.cumsum([len(p) for p in parts])
    blobs = [total[at[e - len(p) : e]].astype(kind).tobytes() for p, e in zip(parts, ends, strict=True)]
    head = np.arange(len(parts)) == 0
    return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "totals": pa.array(blobs, pa.binary()), "n": pa.array(head * total.sum()), "v": pa.array(head * int((total > 0).sum()))})


def _parts(n_all: int, v_all: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's sum of log10 and of known words, over the words of one bucket."""
        for b in batches:
            for chunk, holders, places, times, totals in zip(*(c.to_pylist() for c in b.columns), strict=True):
                holders, places, times = np.frombuffer(holders, "<u4"), np.frombuffer(places, "<u2"), np.frombuffer(times, "<u2").astype(np.float64)
                c = np.frombuffer(totals, "<u4" if len(totals) == 4 * len(holders) else "<u8").astype(np.float64)
                value, known = np.repeat(np.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1))), holders), np.repeat(c > 0, holders)
                some = np.flatnonzero(np.bincount(places))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([some.astype("<u2").tobytes()]), pa.array([np.bincount(places, value * times)[some].tobytes()]), pa.array([np.bincount(places, known * times)[some].astype("<i8").tobytes()])], ["chunk", "places", "base", "known"])

    return run


def _sum_parts(t: pa.Table) -> pa.Table:
    place = np.concatenate([np.frombuffer(x, "<u2") for x in t["places"].to_pylist()])
    base, known = (np.concatenate([np.frombuffer(x, kind) for x in t[c].to_pylist()]) for c, kind in (("base", "<f8"), ("known", "<i8")))
    some = np.flatnonzero(np.bincount(place))
    return pa.table({"chunk": pa.array(np.full(len(some), t["chunk"][0].as_py())), "place": pa.array(some.astype(np.int32)), "base": pa.array(np.bincount(place, base)[some]), "known": pa.array(np.bincount(place, known)[some].astype(np.int64))})


def lm_scores(docs: DataFrame, vocabulary: str = VOCABULARY, remainder: int = 1, documents: int = 2500, windows: int = 16) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row. Rows with crc32(doc_id) mod 5 = remainder are held out."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    vocabulary = shipped(vocabulary)
    scan = materialize(docs.select("doc_id", "text").mapInArrow(_scan(vocabulary, remainder), _scan_schema(kind)), "lm-scan")
    model = _fit(scan.where("kind = 2").select("round", "sizes", F.col("windows").alias("ids")), vocabulary, documents * windows)
    buckets = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, model.learnt_from // _BUCKET_WINDOWS)
    rows = scan.where("kind = 0").select("chunk", "place", "doc_id", "held_out", "n_tokens", "ids")
    rows = materialize(rows.mapInArrow(_score(model), f"chunk long, place int, doc_id {kind}, held_out boolean, n_tokens long, score double"), "lm-scores")

    def posts(*columns: str) -> DataFrame:
        words = scan.where("kind = 1").select("chunk", *dict.fromkeys(["words", "holders", *columns]))
        return words.mapInArrow(_in_buckets(buckets, list(columns)), f"chunk long, bucket int, {', '.join(f'{c} binary' for c in columns)}")

    totals = materialize(posts("words", "counts").groupBy("bucket").applyInArrow(_totals, "chunk long, bucket int, totals binary, n long, v long"), "lm-totals")
    n, v = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = rows.where("not held_out").count()  # the end's count
    n, v = n + ends, v + (ends > 0)
    parts = posts("holders", "places", "times").join(totals.select("chunk", "bucket", "totals"), ["chunk", "bucket"]).select("chunk", "holders", "places", "times", "totals")
    parts = parts.mapInArrow(_parts(n, v), "chunk long, places binary, base binary, known binary").groupBy("chunk").applyInArrow(_sum_parts, "chunk long, place int, base double, known long")
    out = rows.select("chunk", "place", "doc_id", "held_out", "n_tokens", "score").join(parts, ["chunk", "place"], "left")
    end = float(np.log10((ends + 0.5) / (n + 0.5 * (v + 1))))
    return out.select("doc_id", "held_out", "n_tokens", (F.coalesce("known", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.coalesce("base", F.lit(0.0)) + end).alias("base_score"), "score")
