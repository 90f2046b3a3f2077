"""The learnt operators against plain Python that shares no code with them: features and scores of the classifiers, the forward pass and the gradients of the language model."""

import bisect
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from onceflow.llm import lm, quality, toxicity

from .test_text import ODD, docs, prose

rng = random.Random(21)
TEXTS = [*ODD, "A!! B|b 12 é\nA!! B|b 12 é\n\n#x <y> 'z'", "THE the The\tthe", *[prose(rng, rng.randrange(1, 90)) for _ in range(150)]]
TEXTS += [t.upper().replace(" ", rng.choice([" ", "\n", "! ", ", ", "?\n"])) for t in TEXTS[-40:]]


# -- toxicity


def plain_toxicity(model, text):
    raw = (text or "").encode().lower()
    edge = bytes(b for b in range(128) if not chr(b).isalnum())
    seen = Counter()
    for w in set(raw.split()):
        bare = w.strip(edge).decode("utf-8", "replace")
        names = ([bare] if bare else []) + [bare[:k] + "\0" for k in (3, 4, 5, 6, 7, 8) if len(bare) > k]
        seen.update({20 + (xxhash.xxh3_64_intdigest(n.encode()) >> 40) for n in names})
    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    z = model.bias + weights[min(int(math.log2(len(raw.split()) + 1)), 19)]
    z += sum(weights[i] * math.log2(1 + n) for i, n in seen.items() if i in weights)
    return 1 / (1 + math.exp(-max(-500, min(500, z))))


def test_toxicity_scores_by_hand():
    ids = toxicity.feature_ids([w.encode() for t in TEXTS[-60:] for w in t.lower().split()[:5]])
    chosen = np.unique(np.concatenate([np.arange(20), ids[ids >= 0]]))
    model = toxicity.Model(chosen, np.random.default_rng(1).normal(size=len(chosen)) * 0.3, -0.4)
    got = model.scores(pa.array(TEXTS, pa.string()))
    assert np.allclose(got, [plain_toxicity(model, t) for t in TEXTS], rtol=1e-9)


def plain_risk(w, b, rows, positive, prior):
    """The non-negative risk with the sigmoid loss, and a little decay."""
    loss = lambda z: 1 / (1 + math.exp(z))
    z = [b + sum(w[j] * v for j, v in r.items()) for r in rows]
    pos, unl = [x for x, p in zip(z, positive, strict=True) if p], [x for x, p in zip(z, positive, strict=True) if not p]
    mean = lambda xs: sum(xs) / len(xs)
    rest = mean([loss(-x) for x in unl]) - prior * mean([loss(-x) for x in pos])
    return prior * mean([loss(x) for x in pos]) + max(0.0, rest)


@pytest.mark.parametrize("prior", [0.1, 0.5, 0.8])
def test_toxicity_lowers_its_risk(prior):
    """For class priors on either side of a half: the risk that is minimised is the one with this prior."""
    r = random.Random(int(prior * 10))
    rows, positive = [], []
    for i in range(240):
        toxic = i < 60 or r.random() < prior
        rows.append({0: 1.0} | ({20: r.choice([1.0, 2.0])} if toxic and r.random() < 0.9 else {21: 1.0}))
        positive.append(i < 60)
    flat = [(i, j, v) for i, x in enumerate(rows) for j, v in x.items()]
    at, cols, vals = (np.array(c) for c in zip(*flat, strict=True))
    model = toxicity.fit(np.arange(22), at, cols, vals.astype(float), np.array(positive), prior, steps=200, models=1)
    start = np.where(np.arange(22) < 20, 0, 1.0)
    before = plain_risk(start, math.log(prior / (1 - prior)), rows, positive, prior)
    after = plain_risk(model.weights, model.bias, rows, positive, prior)
    assert after < before and model.weights[20] > model.weights[21]
    other = toxicity.fit(np.arange(22), at, cols, vals.astype(float), np.array(positive), 0.3, steps=200, models=1)
    assert after <= plain_risk(other.weights, other.bias, rows, positive, prior) + 0.02


def test_toxicity_takes_ids_of_any_type(spark):
    texts = [("grub " if i % 4 == 0 else "") + prose(rng, 12) for i in range(200)]
    rows = [f"d{i}" for i in range(200)]
    d = docs(spark, texts + ["other text with this id"], [*rows, "d0"], "string")
    labels = spark.createDataFrame([(r, 1, int(i % 4 == 0)) for i, r in enumerate(rows)], "doc_id string, quality int, toxic int")
    got = {(r.doc_id, r.score) for r in toxicity.toxicity_scores(d, labels).collect()}
    assert len(got) >= 200 and got == {(r.doc_id, r.score) for r in toxicity.toxicity_scores(d.repartition(3), labels).collect()}
    assert {r.predicted for r in toxicity.toxicity_scores(d, labels).where("doc_id in ('d4', 'd8', 'd12')").collect()} == {1}


# -- quality


def plain_features(text):
    text = text or ""
    raw, words = text.encode(), (text.encode()).lower().split()
    sets = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "high": range(128, 256), "!": b"!", "|": b"|", "sym": b"#%&*$@^~", "stop": b".,;:", "mark": b"<>{}[]=/\\_", "quote": b"?-'\"()"}
    c = {k: sum(b in set(s) for b in raw) for k, s in sets.items()}
    other = len(raw) - sum(c.values())
    w, size, letters = max(len(words), 1), max(len(raw), 1), max(c["upper"] + c["lower"], 1)
    lines = text.split("\n")
    return [
        c["upper"] / letters, c["digit"] / size, c["!"] / w, c["|"] / w, c["sym"] / w, c["stop"] / w, c["mark"] / w, c["quote"] / w, other / w, c["high"] / size, c["space"] / size,
        (len(raw) - c["space"]) / w, math.log1p(len(words)), len(set(words)) / w, max(Counter(words).values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        len(set(zip(words, words[1:], strict=False))) / max(len(words) - 1, 1), 1 - len(set(lines)) / len(lines), len(words) / len(lines),
    ]


def test_quality_features_and_scores_by_hand():
    want = [plain_features(t) for t in TEXTS]
    assert np.allclose(quality.features(pa.array(TEXTS, pa.string())), want, rtol=1e-12, atol=1e-12)
    x, y = np.array(want), np.arange(len(TEXTS)) % 2
    model = quality.fit(x, y, 0.4, steps=20)
    for t, row, got in zip(TEXTS, want, model.scores(pa.array(TEXTS, pa.string())), strict=True):
        z = sum(model.weights[j][bisect.bisect_right(model.edges[j].tolist(), v)] for j, v in enumerate(row)) - model.threshold + math.log(0.3 / 0.7)
        assert math.isclose(got, 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9), t


def test_quality_learns_preferences():
    """Of all pairs of a good and a poor document the first is worth more in nearly all, as the model of preferences asks."""
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 19))
    y = (x[:, 3] + 0.5 * x[:, 7] > 0.2).astype(int)
    model = quality.fit(x, y, float(np.mean(y == 0)))
    worth = model.worth(x)
    assert np.mean(worth[y == 1][:, None] > worth[y == 0][None, :]) > 0.97
    assert abs(np.mean(worth < model.threshold) - np.mean(y == 0)) < 0.03


def test_quality_takes_every_pair():
    """Loss and slope are those of all pairs, bins those of all rows, and rows given twice change nothing."""
    r = np.random.default_rng(6)
    x = np.round(r.normal(size=(90, 3)), 1)
    y = (x[:, 0] + r.normal(size=90) > 0.8).astype(int)
    total = lambda count: count(x, y)
    good, poor = int(y.sum()), int((1 - y).sum())
    edges = quality._quantiles(total, good, poor, 3, 8)
    for j in range(3):
        rows = sorted((v, poor if c else good) for v, c in zip(x[:, j], y, strict=True))
        upto = np.cumsum([m for _, m in rows])
        assert np.allclose(edges[j], [rows[np.searchsorted(upto, i / 8 * upto[-1], side="right")][0] for i in range(1, 8)], rtol=1e-5, atol=1e-9)
    b = quality._binned(edges, x)
    pairs = quality._Pairs(lambda count: count(b, y), good, poor, (3, 8))
    w = r.integers(-300, 300, 24) * quality._UNIT
    hot = np.zeros((90, 24))
    hot[np.arange(90)[:, None], b + np.arange(3) * 8] = 1
    far = (hot[y == 0, None] - hot[None, y == 1]).reshape(-1, 24)
    seen = pairs.histogram(w)
    assert math.isclose(pairs.loss(w, seen), np.logaddexp(0, far @ w).mean() + 5e-5 * w @ w, rel_tol=1e-9)
    assert np.allclose(pairs.slope(w, seen), (far / (1 + np.exp(-far @ w))[:, None]).mean(0) + 1e-4 * w, atol=1e-7)
    one, two = quality.fit(x, y, 0.3), quality.fit(np.repeat(x, 2, 0), np.repeat(y, 2), 0.3)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.edges, two.edges) and one.threshold == two.threshold


def test_quality_learns_from_every_labelled_row(spark):
    """More rows of each class than a sample once held: executors' sums give what all rows in memory give, however they are dealt."""
    r = np.random.default_rng(8)
    texts, marks = [], []
    for i in range(16_000):
        words = r.integers(0, 50, 6)
        poor = i % 2 == int(r.random() < 0.1)
        texts.append(" ".join(f"W{w}!" if poor or w < 3 else f"w{w}" for w in words))
        marks.append(0 if i % 2 == 0 else 1)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int")
    on = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(len(texts))])
    y = np.array(marks)[on]
    assert min(y.sum(), (1 - y).sum()) > 6000
    want = quality.fit(quality.features(pa.array(np.array(texts)[on].tolist())), y, float(np.mean(y == 0)))
    got = quality.train(d, labels)
    assert np.array_equal(got.edges, want.edges) and np.array_equal(got.weights, want.weights) and got.threshold == want.threshold


# -- language model


def small_model():
    r = np.random.default_rng(7)
    counts = r.integers(0, 50, lm.END + 1)
    slot = lm.slots_of(counts, np.arange(lm.END + 1) % 2 == 0)
    model = lm.Model.of_counts(slot, counts, r.integers(0, 5, (lm.SLOTS + 1, lm.SLOTS)).astype(float))
    model.weights = {k: v.astype(np.float64) + r.normal(size=v.shape) * 0.2 for k, v in model.weights.items()}
    model.top, model.inner = model.top.astype(np.float64), model.inner.astype(np.float64)
    return model, r


def plain_forward(model, read, targets):
    """Natural logs of the targets' outputs, one place and one number at a time."""
    w = {k: v.tolist() for k, v in model.weights.items()}
    times = lambda x, m: [sum(x[i] * m[i][j] for i in range(len(x))) for j in range(len(m[0]))]
    d = lm.WIDTH
    xs = [[a + b for a, b in zip(w["embed"][s], w["place"][i], strict=True)] for i, s in enumerate(read)]
    qkv = [[max(-4.5, min(4.5, v)) for v in times(x, w["qkv"])] for x in xs]
    out = []
    for i, x in enumerate(xs):
        e = [math.exp(sum(qkv[i][c] * qkv[j][d + c] for c in range(d)) / math.sqrt(d)) for j in range(i + 1)]
        z = [sum(e[j] * qkv[j][2 * d + c] for j in range(i + 1)) / sum(e) for c in range(d)]
        y = [a + b for a, b in zip(x, times(z, w["out"]), strict=True)]
        h = [a + b for a, b in zip(y, times([max(0.0, v) for v in times(y, w["up"])], w["down"]), strict=True)]
        cluster, member = divmod(targets[i], lm.MEMBERS)
        first = [a + b for a, b in zip(times(h, w["top"]), model.top[read[i]].tolist(), strict=True)]
        second = [a + b for a, b in zip(times(h, w["inner"][cluster]), model.inner[cluster][read[i]].tolist(), strict=True)]
        out.append(first[cluster] - math.log(sum(map(math.exp, first))) + second[member] - math.log(sum(map(math.exp, second))))
    return out


def test_forward_pass_by_hand():
    model, r = small_model()
    read, target = r.integers(0, lm.SLOTS + 1, (3, 20)), r.integers(0, lm.SLOTS, (3, 20))
    got = model.logs(model.hidden(read).reshape(60, -1), read.reshape(-1), target.reshape(-1)).reshape(3, 20)
    for b in range(3):
        assert np.allclose(got[b], plain_forward(model, read[b].tolist(), target[b].tolist()), rtol=1e-9)


def test_scores_of_texts_by_hand():
    """Whole texts, over several windows, from the definition of the windows."""
    model, r = small_model()
    texts = [r.integers(0, lm.END, n - 1).tolist() + [lm.END] for n in (1, 5, 64, 65, 150)]
    got = model.log10s(np.concatenate(texts).astype(np.int32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for t, value in zip(texts, got, strict=True):
        total, begin = 0.0, 0
        while True:
            window = t[begin : begin + lm.WINDOW]
            before = [lm.SLOTS if begin == 0 else int(model.slot[t[begin - 1]]), *[int(model.slot[i]) for i in window[:-1]]]
            logs = plain_forward(model, before, [int(model.slot[i]) for i in window])
            new = slice(0 if begin == 0 else lm.OVERLAP, None)
            total += sum(logs[new]) / math.log(10) + sum(float(model.within[i]) for i in window[new])
            if begin + lm.WINDOW >= len(t):
                break
            begin += lm.WINDOW - lm.OVERLAP
        assert math.isclose(value, total, rel_tol=1e-5)


def test_gradients_by_finite_differences():
    model, r = small_model()
    outputs = r.integers(0, lm.SLOTS, (4, 13))
    outputs[0, 0] = lm.SLOTS
    outputs[1, 9:] = lm.SLOTS  # a window that ends early
    read, target = outputs[:, :-1], outputs[:, 1:].reshape(-1)
    on = target < lm.SLOTS
    weight = on / on.sum()

    def loss():
        return -float((model.logs(model.hidden(read).reshape(target.size, -1), read.reshape(-1), np.where(on, target, 0)) * weight).sum())

    keep, grads = {}, {}
    model.logs(model.hidden(read, keep), read.reshape(-1), np.where(on, target, 0), grads, weight)
    grads |= model.backward(read, grads.pop("h"), keep)
    assert set(grads) == set(model.weights)
    for name, w in model.weights.items():
        flat, g = w.reshape(-1), grads[name].reshape(-1)
        for i in [*np.argsort(-np.abs(g))[:4], *r.integers(0, flat.size, 3)]:
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            slope = (up - loss()) / (2 * step)
            flat[i] = old
            assert math.isclose(slope, g[i], rel_tol=2e-3, abs_tol=2e-7), (name, i)


