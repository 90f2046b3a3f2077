"""License scan, decontamination, n-gram join: against brute force on small tables with odd rows."""

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from onceflow.llm import common, decontam, jaccard, license
from onceflow.llm.components import connected_components

ODD = [None, "", "   \t\n", "one", "two words", "x" * 200_000, "a b c d " * 20_000, "é à ü " * 30, "\x00\x1c \x85 z"]


def docs(spark, texts, ids=None, kind="long"):
    """With columns whose names clash with those that the operators make."""
    rows = [(i if ids is None else ids[i], t, "s", i, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, source string, n long, score double, key string")


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()):
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x0c\r\x1c\x85Éé.")), max_size=8), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_bytes_split(texts, skip):
    flat, base = common.lower_words(pa.array(texts, pa.string()).slice(min(skip, len(texts))))
    got = flat.cast(pa.large_binary()).to_pylist()
    assert [got[a:b] for a, b in zip(base[:-1], base[1:], strict=True)] == [(t or "").encode().lower().split() for t in texts[skip:]]


# -- license scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    places = [(label, i) for label, p in license.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for _, i in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for label, _ in places}))


def test_license_scan(spark):
    lines = [
        "Released under the MIT License.", "UNDER--THE MIT\nLICENSE under the mit license", "under the mit licenses", "under the mit xlicense", "Licensed under the Apache License, Version 2.0 (the License)", "apache license version 20", "CC BY-NC 4.0", "cc byénc", "éunder the mit license", "This software is licensed under the GNU General Public License, version 3.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use in source forms",
    ]
    texts = [*ODD, *lines, lines[0], "z " * 50_000 + lines[0] + " z" * 50_000 + " " + lines[6]]
    rows = license.license_scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(t), t and t[:50]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    by = {t: r for r, t in zip(rows, texts, strict=True)}
    assert by[lines[9]].labels == "gpl-3" and by[lines[10]].labels == "bsd" and by[lines[11]].labels == "" and by[lines[0]].score == 1.0 and by[None].score == 0.0
    assert license.license_scan(docs(spark, [])).count() == 0


def test_license_scan_equals_its_sql(spark):
    """Texts made of templates with regions left out, filled, or broken, against regular expressions in DuckDB."""
    import duckdb

    rng, texts = random.Random(3), [None, "", "|under|the|mit|license|", "Under the MIT license, under the mit license: mit"]
    for _ in range(300):
        words = []
        for _ in range(rng.randrange(1, 4)):
            wording = rng.choice([w for all_of in license.TEMPLATES.values() for w in all_of])
            for part in re.split(r"(<<beginOptional>>.*?<<endOptional>>)", wording):
                if not part.startswith("<<beginOptional") or rng.random() < 0.6:
                    free = " ".join(rng.choice(["x", "é", "the", "0", "is", "this"]) for _ in range(rng.randrange(1, 5)))
                    words += re.sub(r"<<(begin|end)Optional>>", "", re.sub(r"<<var;match=\d>>", free, part)).split()
            words += [rng.choice(["z", "license", "2", "0", "a"])] * rng.randrange(3)
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "q"
        texts.append(rng.choice([" ", "  \n", " -- "]).join(rng.choice([w, w.upper()]) for w in words))
    d = docs(spark, texts)
    con = duckdb.connect()
    documents = pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    con.register("documents", documents)
    want = con.sql(license.oracle()).order("doc_id")
    got = [tuple(r[c] for c in want.columns) for r in license.license_scan(d).orderBy("doc_id").collect()]
    assert got == want.fetchall() and len({r[6] for r in got}) > 6


def test_template_markup():
    t = license.compile_template("x", "a <<beginOptional>>b <<var;match=2>> c<<endOptional>> d")
    run = lambda s: license.accepts(t, s.split(), 0)
    assert run("a d") == (2, 1.0) and run("a b z c d") == (5, 0.8) and run("a b z y c d")[0] == 6
    assert run("a b c d") is None and run("a b z y x c d") is None and run("a z d") is None
    for bad in ("<<beginOptional>>a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            license.compile_template("x", bad)


# -- decontamination


def least(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


@given(st.text(alphabet="ab ", min_size=1, max_size=70), st.text(alphabet="ab ", min_size=1, max_size=90))
@settings(max_examples=80, deadline=None)
def test_myers_is_edit_distance(p, t):
    want = least(p, t)
    got = decontam.myers(p, t, len(p))[0]
    assert got == want or want == len(p)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [prose(rng, n) for n in (12, 30, 40)] + ["", None, "short item", "!!!", "of twenty-two bytes xy", "just fourteen!"]
    edit = lambda s, k: "".join(c if i not in at else rng.choice(["", "q", c + "q"]) for i, c in enumerate(s)) if (at := set(rng.sample(range(len(s)), k))) else s
    k = [int(len(decontam.fold(i)) * 0.08) for i in items[:3]]
    texts = [*ODD, items[0], "pre, " + items[1].upper().replace(" ", "\n--") + " post", *[prose(rng, 20) + " " + edit(items[j], e) + " " + prose(rng, 20) for j in range(3) for e in (1, k[j], k[j] + 1, k[j] + 9)], items[2][: len(items[2]) // 2], "a SHORT item here", "a short items", "one of twenty-twQ bytes xy", "of twenty-tw bytes xyz", "so of tenty-two bytes zy", "a just fortin b", "just fourten", prose(rng, 400), items[0]]
    d, b = docs(spark, texts), spark.createDataFrame([(i, t, i) for i, t in enumerate(items)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.edit_matches(d, b).collect()}
    want = {}
    for i, t in enumerate(texts):
        if t is None or len(t) > 10_000:
            continue
        for j, item in enumerate(items):
            p = decontam.fold(item)
            if len(p) * 0.08 < 1:
                if p and f" {p} " in f" {decontam.fold(t)} ":
                    want[i, j] = 0
            elif (e := least(p, decontam.fold(t))) <= int(len(p) * 0.08):
                want[i, j] = e
    assert got == want and len(want) >= 10
    for blocks in ({}, {"block_items": 1}):
        kept = decontam.drop_contaminated(d, b, **blocks)
        assert kept.columns == d.columns and {r.doc_id for r in kept.select("doc_id").collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontam.edit_matches(d, b.limit(0)).count() == 0 and decontam.drop_contaminated(d, b.limit(0)).count() == len(texts) and decontam.edit_matches(d.limit(0), b).count() == 0


def test_equally_close_passages():
    """The first of them is told, whatever follows."""
    item = "alpha beta gamma delta epsilon zeta"
    near = item.replace("gamma", "gamna")
    matcher = decontam.Matcher([(1, item)], 0.08)
    assert matcher.matches(f"{item} x {item}") == [(1, 0, 0, len(item))]
    [(_, distance, start, end)] = matcher.matches(f"zzz {near} yyy yyy {near}")
    assert (distance, start, end) == (1, 4, 4 + len(near))


# -- n-gram join


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts, k, num, den):
    sets, of = [shingles(t, k) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    return [(len(s), min(j for j in range(len(texts)) if of[j] == of[i])) for i, s in enumerate(sets)]


def near_copies(rng, n):
    out = []
    for _ in range(n):
        base = prose(rng, rng.choice([3, 5, 12, 60, 150])).split()
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(["q", "r", w[0]])
            out.append(" ".join(w) if rng.random() < 0.7 else " \n".join(w).upper())
    return out


@pytest.mark.parametrize(("k", "num", "block"), [(4, 85, 1_000_000), (5, 80, 1_000_000), (4, 85, 400)])
def test_join_equals_brute_force(spark, monkeypatch, k, num, block):
    rng = random.Random(num + block)
    passage = prose(rng, 55)
    texts = [*ODD, *ODD, *near_copies(rng, 60), *[passage + " " + prose(rng, n) for n in (0, 3, 8, 8, 20, 200)]]
    group = prose(rng, 100).split()  # one large group of near copies
    for i in range(60):
        w = list(group)
        w[i] = f"v{i}"
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, texts), k, num, 100).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts, k, num, 100)


def test_join_odd_tables(spark):
    text = "a b c d e f g h"
    d = docs(spark, [text, text, text + " ", "", None, text], ids=[3, None, 3, 4, None, 9])
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(d).collect() if r.n_shingles)
    assert got == [(-1, 5, 3), (3, 5, 3), (3, 5, 3), (9, 5, 3)]
    kept = jaccard.drop_near_duplicates(d)
    assert kept.columns == d.columns and sorted((r.doc_id or -1, (r.text or "").strip()) for r in kept.collect()) == [(-1, ""), (3, text), (4, "")]
    nameless = jaccard.drop_near_duplicates(docs(spark, [text, text, None, "z"], ids=[None] * 4)).collect()
    assert sorted(r.text or "" for r in nameless) == ["", text, "z"]
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0 and jaccard.drop_near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("window", [8, 1 << 13])
def test_index_finds_all_that_reach_the_overlap(monkeypatch, window):
    import numpy as np

    monkeypatch.setattr(jaccard, "_WINDOW", window)
    rng = np.random.default_rng(window)
    for size in [25] * 12 + [300]:
        base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
        other = lambda: rng.integers(0, 1 << 60, 80).astype(np.uint64)  # noqa: B023, E731
        sets = [np.unique(np.where(rng.random(80) < rng.choice([0, 0.05, 0.1, 0.3]), other(), base)[: rng.integers(5, 80)]) for _ in range(size)]
        index = jaccard.Index(sets, 85, 100)
        for q in range(0, size, max(1, size // 25)):
            want = [j for j in range(size) if j != q and 100 * len(np.intersect1d(sets[q], sets[j])) >= 85 * len(np.union1d(sets[q], sets[j]))]
            assert sorted(index.search(q, np.ones(size, bool)).tolist()) == want


def test_null_ids_cost_what_own_ids_cost(spark, monkeypatch, tmp_path):
    """Near copies without ids, or with one id, send each text into the pair step once, as with own ids."""
    rng = random.Random(6)
    base = prose(rng, 80).split()
    texts = []
    for i in range(40):
        w = list(base)
        w[i] = f"v{i}"
        texts.append(" ".join(w))
    seen = []
    real = jaccard._links

    def counted(*args):
        run, log = real(*args), str(tmp_path / f"log{len(seen)}")
        seen.append(log)

        def links(t):
            with open(log, "a") as f:
                f.write(f"{t.num_rows}\n")
            return run(t)

        return links

    monkeypatch.setattr(jaccard, "_links", counted)
    for ids in (list(range(40)), [None] * 40, [7] * 40):
        found = jaccard.near_duplicates(docs(spark, texts, ids)).collect()
        assert len(found) == 40 and {r.component_id for r in found} == {ids[0]}
    assert {sum(map(int, open(log))) for log in seen} == {40}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1300)} == {1000} and got[5001] == 5000 and len(got) == 503
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_columns_do_not_matter(spark):
    assert jaccard.near_duplicates(docs(spark, ["a b c d e"])).columns == ["doc_id", "n_shingles", "component_id"]


def test_ids_that_repeat_with_different_texts(spark):
    """A row goes for its own text's sake, not for that of another row with its id."""
    rng = random.Random(12)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    kept = jaccard.drop_near_duplicates(docs(spark, [a, a, b, c, d, d, a, e], [1, 2, 2, 3, 3, 3, None, None]))
    assert sorted((r.doc_id or 9, r.text) for r in kept.collect()) == sorted([(1, a), (2, b), (3, c), (3, d), (9, e)])
