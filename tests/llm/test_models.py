"""Classifiers, language model, mixing, WARC, token counts, top-k, pipeline: held-out accuracy, brute force, round trips."""

import gzip
import math
import random
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from onceflow.llm import common, decontam, jaccard, lm, mixing, quality, tokencount, topk, toxicity, warc

from .test_text import ODD, components, docs, prose, shingles

TOXIC = ["grubwort", "slimegob", "muckface", "dolthead"]


def corpus(rng, n=400, toxic=0.2, poor=0.25):
    """Texts with labels: toxic ones hold words of a lexicon, poor ones repeat themselves or shout."""
    texts, q, t = [], [], []
    for _ in range(n):
        words = prose(rng, rng.randrange(20, 120)).split()
        bad, low = rng.random() < toxic, rng.random() < poor
        if bad:
            for w in rng.sample(TOXIC, 2):
                words.insert(rng.randrange(len(words)), w)
        text = " ".join(words)
        if low:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join([words[0]] * 60) + " " + " ".join(TOXIC[:2] if bad else []), " | ".join(words)])
        texts.append(text)
        q.append(0 if low else 1)
        t.append(int(bad))
    return texts, q, t


@pytest.fixture(scope="module")
def labelled(spark):
    texts, q, t = corpus(random.Random(9))
    d = docs(spark, [*texts, *ODD])
    labels = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(q, t, strict=True))] + [(None, 1, 1), (0, None, None), (10_000, 1, 1)], "doc_id long, quality int, toxic int")
    return texts, q, t, d, labels


@pytest.mark.parametrize(("score", "cut", "which"), [(quality.quality_scores, 0.3, 0), (toxicity.toxicity_scores, 0.5, 1)])
def test_classifiers_hold_out(spark, labelled, score, cut, which):
    texts, q, t, d, labels = labelled
    want = (q, t)[which]
    rows = {r.doc_id: r for r in score(d, labels).collect()}
    assert len(rows) == len(texts) + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [i for i in range(len(texts)) if rows[i].held_out]
    assert np.mean([rows[i].predicted == want[i] for i in held]) > 0.93
    again = {r.doc_id: r.score for r in score(d.repartition(3), labels).collect()}
    assert all(math.isclose(again[i], r.score, rel_tol=1e-9) for i, r in rows.items())


def test_held_out_labels_are_not_read(spark, labelled):
    texts, q, t, d, labels = labelled
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(d, x).collect()} for x in (labels, other))
    assert a == b


def test_classifiers_without_labels(spark, labelled):
    _, _, _, d, labels = labelled
    for score in (quality.quality_scores, toxicity.toxicity_scores):
        rows = score(d, labels.limit(0)).collect()
        assert len(rows) == d.count() and len({r.score for r in rows}) == 1
        assert score(d.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(d, labels).columns == d.columns == quality.drop_poor(d, labels).columns


# -- language model


def test_base_scores_and_models(spark):
    rng = random.Random(3)
    texts = [*ODD[:5], *[prose(rng, rng.randrange(1, 200)) for _ in range(120)], "same words", "same words", "x y " * 50_000]
    ids = [*range(len(texts) - 1), None]
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    train = [t for i, t in zip(ids, texts, strict=True) if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    rows = {r.doc_id: r for r in lm.lm_scores(docs(spark, texts, ids), documents=100).collect()}
    for i, t in zip(ids, texts, strict=True):
        r, w = rows[i], tokens(t)
        want = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.score < 0
    held = [r for r in rows.values() if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # subwords know words that no training text has
    empty = lm.lm_scores(docs(spark, []))
    assert empty.count() == 0


def test_windows_score_each_id_once():
    """Batched windows give what one text at a time gives, and a model's next ids have probability 1 together."""
    rng = np.random.default_rng(0)
    sub = lm.Subwords(lm.VOCABULARY)
    flat, at = sub([b"hello", b"worlds!", "é x".encode(), b"\x1c"])
    assert sub.enc.decode(flat.tolist()) == " hello worlds! é x \x1c" and len(at) == 5
    counts = rng.integers(0, 50, lm.END + 1)
    slot = lm.slots_of(counts, sub.begins)
    model = lm.Model.of_counts(slot, counts, rng.integers(0, 5, (lm.SLOTS + 1, lm.SLOTS)).astype(float))
    sizes = [1, 2, 63, 64, 65, 120, 121, 300]
    texts = [rng.integers(0, lm.END, s - 1).tolist() + [lm.END] for s in sizes]
    model.learn([np.array([-1, *t[:64]], np.int32) for t in texts], passes=3)
    flat, starts = np.concatenate([np.array(t, np.int32) for t in texts]), np.concatenate([[0], np.cumsum(sizes)])
    together = model.log10s(flat, starts)
    for i, t in enumerate(texts):
        assert math.isclose(together[i], model.log10s(np.array(t, np.int32), np.array([0, len(t)]))[0], rel_tol=1e-4)
    h = model.hidden(np.array([[lm.SLOTS, 3, 5]]))
    every = np.arange(lm.SLOTS)
    p = np.exp(model.logs(np.repeat(h[-1:], lm.SLOTS, 0), np.full(lm.SLOTS, 5), every).astype(float))
    assert math.isclose(p.sum(), 1, rel_tol=1e-4) and math.isclose((10 ** model.within.astype(float)).sum(), lm.SLOTS, rel_tol=1e-3)


def test_attention_learns_from_every_window(spark):
    """Every id that a training text holds anywhere moves its row of the embedding, whatever the bound on what one task learns."""
    sub = lm.Subwords(lm.VOCABULARY)
    words = [w for w in (sub.enc.decode([i]).strip() for i in range(1000, 1900)) if w.isascii() and w.isalpha() and w.islower()]
    texts = [" ".join(words[i::7] * 3) for i in range(7)] + ["one long text", " ".join(words * 8)]
    d = docs(spark, texts).repartition(3)
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    model = lm.train(d, documents=2, windows=4)
    ids = {x for t in train for x in sub([w.encode() for w in t.split()])[0].tolist()[:-1]}
    before = (np.random.default_rng(5).standard_normal((lm.SLOTS + 1, lm.WIDTH)) * 0.1).astype(np.float32)
    assert len(train) >= 5 and len(ids) > 200
    assert all((model.weights["embed"][model.slot[i]] != before[model.slot[i]]).any() for i in ids)
    again = lm.train(d, documents=2, windows=4)
    assert all(np.allclose(model.weights[k], again.weights[k], atol=1e-3) for k in model.weights)


def test_learning_has_no_switch_by_size(spark):
    """One window more or less than the bound on a task's share, which still leaves one task, changes nothing."""
    rng = random.Random(21)
    d = docs(spark, [prose(rng, rng.randrange(1, 200)) for _ in range(40)]).coalesce(1)
    n = lm.id_counts(lm.training_windows(d, lm.VOCABULARY, 1))[1]
    few, same, many = (lm.train(d, documents=1, windows=n + k) for k in (-1, 0, 1))
    assert n > 40 and few.learnt_from == n
    for k, x in same.weights.items():
        assert np.array_equal(x, few.weights[k]) and np.array_equal(x, many.weights[k]), k


def test_windows_and_counts_cover_all_training_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "_TOGETHER", 2)  # sums of several tasks, in several levels
    rng = random.Random(8)
    texts = [*ODD[:4], "", None, *[prose(rng, rng.randrange(1, 300)) for _ in range(30)], "x y " * 5_000]
    sub = lm.Subwords(lm.VOCABULARY)
    want, counts, pairs = Counter(), Counter(), Counter()
    slot = lm.slots_of(np.arange(lm.END + 1), sub.begins)
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            ids = [lm._START, *sub((t or "").encode().lower().split())[0].tolist(), lm.END]
            want.update(tuple(ids[k : k + lm.WINDOW + 1]) for k in range(0, len(ids) - 1, lm.WINDOW))
            counts.update(ids[1:])
            pairs.update((lm.SLOTS if a == lm._START else int(slot[a]), int(slot[b])) for a, b in zip(ids, ids[1:], strict=False))
    rows = lm.training_windows(docs(spark, texts).repartition(7), lm.VOCABULARY, 1)
    rows = rows.repartition(7)
    got = Counter()
    for r in rows.collect():
        got.update(tuple(x.tolist()) for x in np.split(np.frombuffer(r.ids, "<u2"), np.cumsum(np.frombuffer(r.sizes, "u1"), dtype=int)[:-1]))
    assert got == want
    total, n = lm.id_counts(rows)
    assert n == sum(want.values()) and Counter(dict(enumerate(total.tolist()))) == counts
    table = lm.pair_counts(rows, slot)
    assert table.sum() == sum(pairs.values()) and all(table[k] == x for k, x in pairs.items())


def test_outputs_go_to_ids_frequent_in_the_corpus(spark):
    """An id that is frequent only beyond the first windows of a long text has an output of its own."""
    sub = lm.Subwords(lm.VOCABULARY)
    words = [w for w in (sub.enc.decode([i]).strip() for i in range(20_000, 24_000)) if w.isascii() and w.isalpha() and w.islower()]
    often = words[-20:]
    late = [" ".join([*words[:1500], *(often * 40)])] * 4
    model = lm.train(docs(spark, late, [2, 3, 4, 5]), documents=1, windows=2)
    ids = [x for w in often for x in sub([w.encode()])[0].tolist()]
    shared = np.bincount(model.slot, minlength=lm.SLOTS)
    assert any(zlib.crc32(str(i).encode()) % 5 != 1 for i in (2, 3, 4, 5)) and all(shared[model.slot[i]] == 1 for i in ids)


def test_batches_are_worked_out_in_the_same_memory():
    """A batch after the first asks for little new memory."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, lm.END + 1)
    slot = lm.slots_of(counts, np.arange(lm.END + 1) % 2 == 0)
    adam = lm.Adam(lm.Model.of_counts(slot, counts, rng.integers(0, 5, (lm.SLOTS + 1, lm.SLOTS)).astype(float)))
    batch = rng.integers(0, lm.SLOTS, (128, lm.WINDOW + 1))
    adam.descend(batch, 1)
    tracemalloc.start()
    try:
        adam.descend(batch, 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 << 20, peak


def test_scores_are_those_of_a_model_of_the_same_texts(spark):
    """One pass over the texts gives the ids that are learnt from and those that are scored."""
    rng = random.Random(12)
    texts = [*ODD[:5], "", None, *[prose(rng, rng.randrange(1, 200)) for _ in range(30)], "x y " * 3_000]
    d = docs(spark, texts).coalesce(1)
    model = lm.train(d)
    sub = lm.Subwords(lm.VOCABULARY)
    got = {r.doc_id: r.score for r in lm.lm_scores(d).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        ids, starts = lm.text_ids(sub, words, np.arange(len(words)), np.array([0, len(words)]))
        assert math.isclose(got[i], model.log10s(ids, starts)[0], rel_tol=1e-3), i


# -- mixing


def mixed(sizes, sources, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by dealing the excess again until no source is above its cap."""
    order = sorted({s for s in sources if s is not None}) + [None] * (None in sources)
    size = {s: sum(n for n, x in zip(sizes, sources, strict=True) if x == s) for s in order}
    w, target, free, budget = {s: weights[i % 3] for i, s in enumerate(order)}, {}, set(order), share * sum(sizes)
    while True:
        give = {s: budget * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if give[s] > most * size[s]}
        if not over:
            return size, target | give
        for s in over:
            target[s] = most * size[s]
            budget -= target[s]
        free -= over
        if not free:
            return size, target


@pytest.mark.parametrize("seed", range(3))
def test_mix_comes_near_targets(spark, seed):
    rng = random.Random(seed)
    texts = [*ODD[:5], *[prose(rng, rng.randrange(1, 60)) for _ in range(150)]]
    sources = [rng.choice(["b", "a", "é", "Z", None, "hot", "hot", "hot"][: 3 + 2 * seed]) for _ in texts]
    sources[-1], texts[-1] = "nothing", None
    ids = [*range(len(texts) - 2), 0, None]
    d = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in zip(ids, texts, sources, strict=True)], "doc_id long, text string, source string, size int, epoch int")
    sizes = [len((t or "").encode().split()) for t in texts]
    size, target = mixed(sizes, sources)
    got = mixing.mix(d, [3, 1, 2], 1.5, 2).collect()
    assert sorted(r.size for r in got) == sorted(sizes) and all(0 <= r.taken <= 2 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s in size:
        key = (size[s], round(target[s], 6))
        alike = [x for x in size if (size[x], round(target[x], 6)) == key]
        assert key in taken and abs(taken[key] - len(alike) * target[s]) <= len(alike) + 1
    assert sorted(map(tuple, mixing.mix(d.repartition(5), [3, 1, 2], 1.5, 2).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_schedule_is_in_order_and_cut_at_the_budget(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(i, prose(rng, rng.randrange(1, 40)), rng.choice("abc")) for i in range(200)], "doc_id long, text string, source string")
    plan = mixing.planned(d, [3, 1, 2], 1.5, 2)
    rows = mixing.schedule(plan, 1.5, 2).collect()  # as the partitions stand
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    offset = 0
    for r in rows:
        assert r.mix_offset == offset
        offset += r.words
    assert abs(offset - 1.5 * sum(r["size"] for r in plan.collect())) <= 3
    assert mixing.mix(d.limit(0), [3, 1, 2], 1.5, 2).count() == 0


# -- WARC


def test_warc_round_trip(spark, tmp_path):
    big, small = "x\r\n\r\nWARC/1.1\r\n" * 200, "é" * 499
    html = [big, big, "a" * 999, "a" * 999, None, "", small + "é", small + "é", big + "1", "\x00\x85" * 600, big]
    ids = [5, 9, 1, 2, 3, 4, 7, 8, 6, 10, None]
    urls = ["http://b.com/x", "http://a.com/ y\r\nX: z", None, "", "HTTP://www.A.com", "not a url", "http://b.com/x", "http://[bad", "http://b.com/x?q", "ftp://c", "http://b.com/x"]
    p = spark.createDataFrame([(i, u, h, "x") for i, u, h in zip(ids, urls, html, strict=True)], "page_id long, url string, html string, digest string")
    rows = warc.capture_index(p).collect()
    assert len(rows) == len(ids)
    top = {}
    for i, h in zip(ids, html, strict=True):
        if len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, -1), -1 if i is None else i)
    import hashlib

    for i, h in zip(ids, html, strict=True):
        raw = (h or "").encode()
        r = next(x for x in rows if x.page_id == i)
        again = h in top and top[h] != i
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[h] if again else None)
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in rows]
    assert order == sorted(order, key=lambda x: (x[0].encode(), *x[1:]))
    assert warc.capture_index(p.limit(0)).count() == 0
    warc.write_warc(p.coalesce(1), str(tmp_path / "w"), file_bytes=1)
    files = list((tmp_path / "w").glob("file=*/part-*"))
    assert len(files) >= 5 and not list((tmp_path / "w").glob("file=*/part-*c001*"))
    found = warc.read_index(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(str(tmp_path / "w"))).collect()
    for r in found:  # a reader may begin at any record
        raw = (tmp_path / "w" / r.archive).read_bytes()[r.offset :]
        assert f"<urn:page:{'none' if r.page_id is None else r.page_id}>".encode() in gzip.decompress(raw).split(b"\r\n\r\n")[0]
    assert [(r.url_key, r.page_id) for r in found] == [(r.url_key, r.page_id) for r in rows]


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


# -- token counts


def test_token_counts_equal_the_tokenizer(spark):
    enc = tokencount.encoder(tokencount.VOCABULARY)
    texts = [*ODD, "<|endoftext|>", "a", "a"]
    got = sorted((r.doc_id, r.n_tokens) for r in tokencount.token_counts(docs(spark, texts), file_bytes=4, block=7).collect())
    assert got == [(i, len(enc.encode_ordinary(t or ""))) for i, t in enumerate(texts)]
    assert tokencount.token_counts(docs(spark, [])).count() == 0
    names = ["Pā", "", None, "x"]
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs(spark, ["a", "b b", "", "c"], names, "string")).collect()}
    assert got == {"Pā": 1, "": 2, None: 0, "x": 1}


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_scan_stitches_blocks_and_files(spark, block):
    e = tokencount.END
    streams = {0: [[1, 2, e, e, 3], [4], [], [5, e, 6, 7]], 1: [[e], [e, e]], 2: [[1, 2], [3]], 3: [[]]}
    rows = [(s, i, np.array(f, "<u2").tobytes()) for s, files in streams.items() for i, f in enumerate(files)]
    got = tokencount.separator_scan(spark.createDataFrame(rows, "stream int, part int, content binary"), block)
    want = []
    for s, files in streams.items():
        n, place = 0, 0
        for t in [t for f in files for t in f]:
            if t == e:
                want.append((s, place, n))
                n, place = 0, place + 1
            else:
                n += 1
        want += [(s, place, n)] * bool(n)
    assert sorted((r.stream, r.place, r.n_tokens) for r in got.collect()) == want


# -- top-k


def top(rows, k=20, scale=64):
    """Brute force in Python's integers."""
    usable = lambda v: v and all(c is not None and math.isfinite(c) for c in v)
    good = [(i, [math.floor(Fraction(c) * scale) for c in v]) for i, v, _ in rows if i is not None and usable(v)]
    out = []
    for a, (q, v) in enumerate(good):
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for b, (i, w) in enumerate(good) if b != a and len(w) == len(v))[:k]
            out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores)]
    return sorted(out)


ODD_VECTORS = [(1000, None, 0), (1040, [float("nan")] * 12, 0), (1060, [float("inf")] + [0.0] * 11, 0), (1080, [], 0), (2000, [0.5, 0.5], 0), (2001, [0.25, 1.0], 0)]


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_BYTES", 64 * 8 * 12)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 10 * 8 * 12)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)) * 0.2
    x[50:90] = x[50]  # one very common vector
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + ODD_VECTORS
    rows += [(None, x[0].tolist(), 0), (1020, [1.0, None] * 6, 0), (20, x[7].tolist(), 0), (20, x[7].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect())) == top(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0 and topk.top_k(df, F.lit(False)).count() == 0


def test_top_k_takes_every_finite_vector(spark):
    """Components of any size, of either sign: exact scores, and the nearest long for those beyond one."""
    rng = np.random.default_rng(2)
    sizes = [1.0, 1e5, 1e9, 1e12, 1e15, 1e17, 1e150, 1.7e308, 3e-300]
    rows = [(i, (rng.uniform(-1, 1, 3) * sizes[i % len(sizes)]).tolist(), 0) for i in range(80)]
    rows += [(100, [1.0, 2.0, 0.0], 0), (101, [1e9, 1.0, 0.0], 0), (120, [2.0**53 / 64] * 3, 0), (121, [(2.0**53 - 1) / 64] * 3, 0), (140, [-1e300, 0.0, 1e300], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == top(rows)
    assert (100, 1, 101) in {r[:3] for r in topk.top_k(df.where("vec_id in (100, 101)"), F.col("vec_id") == 100).collect()}


@pytest.mark.parametrize("kind", [np.float64, np.int64, object])
def test_max_score_skips_postings(kind):
    """The same as brute force, in every kind of numbers, while few postings of the non-essential terms are touched."""
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (600, 24)) * (rng.random((600, 24)) < 0.5)
    x[:, :4] *= 20  # some terms decide
    x = x.astype(kind) if kind is not object else np.array([[int(c) for c in r] for r in x], object)
    shard, scanned = topk.Shard(x), 0
    for q in range(0, 600, 40):
        floor = None
        want = sorted((-int(s), i) for i, s in enumerate((x @ x[q]).tolist()) if i != q)[:5]
        for _ in range(2):  # without a threshold, and with the k-th best score as one
            places, scores = shard.search(x[q], 5, floor, q)
            assert [(-int(s), int(i)) for s, i in zip(scores, places, strict=True)] == want
            floor = -want[-1][0]
            scanned += shard.total
    assert 0 < shard.touched < 0.8 * scanned


# -- the pipeline


def test_pipeline_stages(spark, tmp_path):
    """Each stage against its rule applied to every row that the stage before kept."""
    rng = random.Random(5)
    texts, q, t = corpus(rng, 300)
    item = prose(rng, 40)
    texts += [texts[3] + " more", texts[3], item, prose(rng, 30) + " " + item, *ODD]
    d = docs(spark, texts)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(q, t, strict=True))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, now = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    labels, kept = common.table(spark, sf, "labels"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, now, sf), "test")
        assert out.columns == d.columns
        kept.append((now, out, {r.doc_id: r.text for r in now.collect()}, {r.doc_id: r.text for r in out.collect()}))
        now = out
    ids = lambda df, rule: {r.doc_id for r in df.collect() if rule(r)}
    assert set(kept[0][3]) == ids(toxicity.toxicity_scores(kept[0][0], labels), lambda r: r.score < 0.5)
    assert set(kept[1][3]) == ids(quality.quality_scores(kept[1][0], labels), lambda r: r.score >= 0.3)
    before = sorted(kept[2][2])
    groups = components([kept[2][2][i] for i in before], 5, 80, 100)
    assert set(kept[2][3]) == {i for n, i in enumerate(before) if groups[n][1] == n}
    matcher = decontam.Matcher([(0, item)], 0.08)
    assert set(kept[3][3]) == {i for i, x in kept[3][2].items() if not matcher.matches(x)} and not any(item in (x or "") for x in kept[3][3].values())
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(final) == set(kept[3][3])
    size, target = mixed([len((x or "").encode().split()) for x in kept[3][3].values()], ["s"] * len(kept[3][3]))
    assert abs(sum(r.taken for r in final.values()) - target["s"]) <= 1


def test_pipeline_learns_quality_from_every_labelled_row(spark, tmp_path, monkeypatch):
    """More labelled rows of each class than a sample once held: the stage scores by the model of all rows in memory."""
    r, texts = np.random.default_rng(12), []
    for i in range(16_000):
        poor = (i % 2 == 0) != (r.random() < 0.1)
        texts.append(" ".join(f"W{w}!" if poor or w < 3 else f"w{w}" for w in r.integers(0, 50, 6)))
    marks = [i % 2 for i in range(len(texts))]
    spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = docs(spark, texts)
    on = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(len(texts))])
    y, all_texts = np.array(marks)[on], pa.array(texts)
    model = quality.fit(quality.features(all_texts.filter(pa.array(on))), y, float(np.mean(y == 0)))
    used, column = [], quality.score_column
    monkeypatch.setattr(quality, "score_column", lambda m, text: used.append(m) or column(m, text))
    corpus_pipeline.quality(spark, d, str(tmp_path))
    assert min(y.sum(), (1 - y).sum()) > 6000 and np.array_equal(used[0].weights, model.weights) and used[0].threshold == model.threshold


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Ids that are null or repeat, columns named like those that stages make, labels that say nothing, and a table without rows: each text stays once."""
    rng = random.Random(11)
    a, b, c = (prose(rng, 40) for _ in range(3))
    item = prose(rng, 30)
    rows = [(1, a, "s"), (1, b, "s"), (None, a, "s"), (None, c, None), (None, c, "s"), (3, "", "s"), (3, None, "s"), (4, f"x {item} y", "s"), (4, f"x {item} y", "s")]
    columns = "doc_id long, text string, source string, score int, row int, __row0 int, label int, p int, node int, size int, target int"
    d = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8) for r in rows], columns)
    marks = [(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, None, None)]
    for name, rows_ in (("some", d), ("none", d.limit(0))):
        sf = tmp_path / name
        rows_.write.parquet(str(sf / "documents.parquet"))
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
        spark.createDataFrame([(None, item), (7, None)], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    got = sorted((r.doc_id or -1, r["size"]) for r in corpus_pipeline.run(spark, str(tmp_path / "some")).collect())
    assert got == [(-1, 40), (1, 40), (1, 40), (3, 0), (3, 0)]
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_shingle_sets_keep_whole_texts():
    sets = jaccard.shingle_sets(pa.array(ODD), 4)
    assert [len(s) for s in sets] == [len(shingles(t, 4)) for t in ODD]


def test_file_names_tell_stream_and_part(spark, tmp_path):
    """The job's id in a file's name may end in a c and digits."""
    (tmp_path / "part-00007-4fe55bb1-5b2a-4d1c-8e7f-0000000000c1.c003.txt").write_bytes(b"\x50\xc4")
    assert [(r.stream, r.part) for r in tokencount._files(spark, str(tmp_path)).collect()] == [(7, 3)]
