"""License scan by template markup.

A template is wording with `<<beginOptional>>...<<endOptional>>` regions, which a text may leave out, and
`<<var;match=N>>` regions, which it may replace by one to N words of its own. Each template compiles to an automaton over
words; a text is accepted where the mandatory wording occurs exactly. Words are runs of ASCII letters and digits and of
non-ASCII characters, A-Z lowered, so case, punctuation and layout never matter.

Defined results: a null or empty text has no words and no labels; a very long text is scanned whole; repeated rows get
equal results; only the id and the text column are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases of the base labels, as words.
BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Wording of notices and licenses, with markup.
TEMPLATES = {
    "mit": [
        "<<beginOptional>>this <<var;match=3>> is<<endOptional>> <<beginOptional>>released<<endOptional>> under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 <<beginOptional>>the license<<endOptional>>",
        "apache license version 2 <<beginOptional>>0<<endOptional>>",
    ],
    "cc-by-nc": [
        "<<beginOptional>>licensed under<<endOptional>> <<beginOptional>>a<<endOptional>> cc by nc "
        "<<beginOptional>><<var;match=1>> 0<<endOptional>>",
        "creative commons attribution noncommercial <<var;match=2>> <<beginOptional>>international<<endOptional>> license",
    ],
    "gpl-3": [
        "<<beginOptional>>this <<var;match=3>> is<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the "
        "<<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free "
        "software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "under the <<beginOptional>><<var;match=1>> clause<<endOptional>> bsd license",
    ],
    "mpl-2": ["subject to the terms of the mozilla public license <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2 0"],
}

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes for matching: A-Z lowered, everything between words a blank.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _WORD[b] else 0x20 for b in range(256))


@dataclass(frozen=True)
class Template:
    """An automaton over words: edges[state] lists (word or None for any word, next state); None on the last is a free move."""

    label: str
    edges: tuple[tuple[tuple[str | None, int, bool], ...], ...]  # word, next state, optional or replaceable region
    final: int
    mandatory: int
    first: frozenset[str]


def compile_template(label: str, wording: str) -> Template:
    parts = re.findall(r"<<[^>]*>>|[^\s<]+", wording.lower())
    edges: list[list[tuple[str | None, int, bool]]] = [[]]
    free: list[list[int]] = [[]]
    opened: list[int] = []

    def state() -> int:
        edges.append([])
        free.append([])
        return len(edges) - 1

    at = mandatory = 0
    for part in parts:
        if part == "<<beginoptional>>":
            opened.append(at)
        elif part == "<<endoptional>>":
            free[opened.pop()].append(at)
        elif part.startswith("<<var"):
            first, most = at, int(re.search(r"match=(\d+)", part)[1])
            ends = []
            for _ in range(most):
                to = state()
                edges[at].append((None, to, True))
                ends.append(at := to)
            last = state()
            for e in ends:
                free[e].append(last)
            at = last
            assert first != at
        else:
            to = state()
            edges[at].append((part, to, bool(opened)))
            mandatory += not opened
            at = to
    if opened:
        raise ValueError(f"an optional region of {label} has no end")
    if not mandatory:
        raise ValueError(f"a template of {label} has no mandatory wording")

    def reach(s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    closed = tuple(tuple(dict.fromkeys(e for t in sorted(reach(s)) for e in edges[t])) for s in range(len(edges)))
    final = at
    ends = {s for s in range(len(edges)) if final in reach(s)}
    closed = tuple((*c, ("\0end", final, True)) if s in ends else c for s, c in enumerate(closed))
    return Template(label, closed, final, mandatory, frozenset(w for w, _, _ in closed[0] if w and w != "\0end"))


def accepts(t: Template, words: list[str], start: int) -> tuple[int, float] | None:
    """The end of the longest accepted run of words from start, and the share of its words that is fixed wording."""
    live: dict[int, int] = {0: 0}  # state: fixed words so far
    best, i = None, start
    while live:
        done = [n for s, n in live.items() if t.edges[s] and t.edges[s][-1][0] == "\0end"]
        if done and i > start:
            best = (i, max(done) / (i - start))
        if i >= len(words):
            break
        step: dict[int, int] = {}
        for s, n in live.items():
            for w, to, _ in t.edges[s]:
                if w is None or w == words[i]:
                    step[to] = max(step.get(to, -1), n + (w is not None))
        live, i = step, i + 1
    return best


class Scanner:
    """Finds base phrases and template matches in folded text."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES):
        self.templates = [compile_template(label, w) for label, all_of in templates.items() for w in all_of]
        self.phrases = [(label, re.compile(rb"(?<![^ ])" + rb" +".join(map(re.escape, p.encode().split())) + rb"(?![^ ])")) for label, p in phrases.items()]
        # a word that every accepted text holds: the longest mandatory one
        self.anchors = []
        for t in self.templates:
            must = [w for s, e in enumerate(t.edges) for w, _, optional in e if w and w != "\0end" and not optional]
            self.anchors.append(max(must, key=len).encode())

    def scan(self, folded: bytes) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Base places (label, byte offset) and template matches (label, first word, end word, share of fixed wording)."""
        places = [(label, m.start()) for label, p in self.phrases for m in p.finditer(folded)]
        matches, words, at = [], None, {}
        for t, anchor in zip(self.templates, self.anchors, strict=True):
            if anchor not in folded:
                continue
            if words is None:
                words = folded.decode("utf-8", "replace").split(" ")
                words = [w for w in words if w]
                for i, w in enumerate(words):
                    at.setdefault(w, []).append(i)
            starts = range(len(words)) if any(w is None for w, _, _ in t.edges[0]) else sorted(i for w in t.first for i in at.get(w, ()))
            end = 0
            for i in starts:
                if i >= end and (m := accepts(t, words, i)):
                    end = m[0]
                    matches.append((t.label, i, *m))
        return places, matches


def scan_batch(scanner: Scanner, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    rows = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
    for text in texts:
        raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
        is_word = _WORD[np.frombuffer(raw, np.uint8)]
        starts = is_word & ~np.concatenate([[False], is_word[:-1]]) if len(raw) else is_word
        places, matches = scanner.scan(raw.translate(_FOLD))
        at = (np.cumsum(starts)[[o for _, o in places]] - 1).tolist() if places else []
        base = {label for label, _ in places}
        every = base | {m[0] for m in matches}
        rows["n_words"].append(int(np.count_nonzero(starts)))
        rows["n_base"].append(len(places))
        rows["first_word"].append(min(at) if at else None)
        rows["last_word"].append(max(at) if at else None)
        rows["base_labels"].append(",".join(sorted(base)))
        rows["labels"].append(",".join(sorted(every)))
        rows["score"].append(max([0.5 * bool(base), *(m[3] for m in matches)]))
    types = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
    return pa.RecordBatch.from_arrays([ids, *(pa.array(v, types.get(k, pa.int64())) for k, v in rows.items())], ["doc_id", *rows])


def license_scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Per document: n_words, the base phrases' places and labels, the templates' labels, and a score: the largest share of
    fixed wording in an accepted run, half where only a base phrase stands, else 0. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            yield scan_batch(scanner, b.column(0), b.column(1))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def _sql_words(text: str) -> str:
    """The words of a text, A-Z lowered, in DuckDB."""
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"coalesce(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


def template_pattern(wording: str) -> str:
    """A template as a regular expression over words that stand between bars; a replaceable region is its group 1."""
    out = []
    for part in re.findall(r"<<[^>]*>>|[^\s<]+", wording.lower()):
        if part == "<<beginoptional>>":
            out.append("(?:")
        elif part == "<<endoptional>>":
            out.append(")?")
        elif part.startswith("<<var"):
            out.append(rf"((?:\|[^|]+\|){{1,{re.search(r'match=([0-9]+)', part)[1]}}}?)")  # as few free words as will do: the others are fixed wording
        else:
            out.append(rf"\|{part}\|")
    return "".join(out)


def oracle(templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES) -> str:
    """The same rows in DuckDB SQL: base places by comparing words, templates as regular expressions."""
    count = lambda x: f"(len({x}) - len(replace({x}, '|', ''))) // 2"
    at = {
        label: "[i FOR i IN range(len(w)) IF " + " AND ".join(f"w[i + {n + 1}] = '{word}'" for n, word in enumerate(p.split())) + "]" for label, p in phrases.items()
    }
    found = [(label, template_pattern(t)) for label, all_of in templates.items() for t in all_of]
    groups = lambda p: f"{count(f'regexp_extract(m, {chr(39)}{p}{chr(39)}, 1)')}" if "((?:" in p else "0"
    shares = ", ".join(f"list_max([CAST({count('m')} - {groups(p)} AS DOUBLE) / ({count('m')}) FOR m IN regexp_extract_all(s, '{p}')])" for _, p in found)
    # the length of a pattern's matches counts fixed and free words; group 1 holds the free ones
    base = " || ".join(f"CASE WHEN len(at_{i}) > 0 THEN ['{label}'] ELSE [] END" for i, label in enumerate(at))
    more = " || ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN ['{label}'] ELSE [] END" for label, p in found)
    places = " || ".join(f"at_{i}" for i in range(len(at)))
    return f"""
WITH w AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents),
     s AS (SELECT *, array_to_string([concat('|', x, '|') FOR x IN w], '') AS s, {', '.join(f'{x} AS at_{i}' for i, x in enumerate(at.values()))} FROM w),
     l AS (SELECT *, {places} AS places, {base} AS base, {base} || {more} AS every, [{shares}] AS shares FROM s)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(every)), ',') AS labels,
       greatest(CASE WHEN len(base) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, coalesce(list_max(shares), 0.0::DOUBLE)) AS score
FROM l"""
