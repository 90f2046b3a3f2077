"""Benchmark decontamination by pigeonhole edit matching.

A test item of n bytes (after folding) tolerates k = rate * n edits and is split into k + 1 pieces: a passage within k edits of
it holds one of them exactly. One Aho-Corasick automaton finds all pieces of a block of items in one pass over a whole text;
around each hit, Myers' bit-parallel algorithm gives the least edit distance of the item to any passage there.

Folding lowers A-Z and puts one blank for every run of other ASCII characters than letters and digits. Items go to the
executors in blocks of at most `block_items` items and `block_bytes` bytes, a pass over the documents each. A block is dropped when its pass has been
written, so that neither the driver nor a task ever holds more than one.

Defined results: null or empty texts and items match nothing; an item too short for an edit (k = 0) must stand exactly, as whole words; of
passages equally close the one found first counts; an item whose id is null is matched with a null id; repeated rows give repeated matches; an empty benchmark matches nothing;
only the id and the text columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from onceflow.llm.common import drop_scratch, materialize, scratch_path

_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: str | None) -> str:
    """Folded bytes, as a string of one character a byte."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()).decode("latin-1")


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """The least edit distance of the pattern to a part of the text, and the first end of such a part; (most + 1, -1) beyond most."""
    m = len(pattern)
    ones, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best, end = ones, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (ones & ~(xh | pv)), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & ones, mh << 1 & ones
        pv, mv = mh | (ones & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items = []  # id, folded text, edits allowed
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            t = fold(text)
            if not t:
                continue
            k = int(len(t) * rate)
            n = len(self.items)
            self.items.append((item_id, t, k))
            if not k:
                at[f" {t} "].append((n, -1))
            else:
                for j in range(k + 1):
                    s, e = j * len(t) // (k + 1), (j + 1) * len(t) // (k + 1)
                    at[t[s:e]].append((n, s))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in at.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if at:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, start, end) of each item found, at its closest; places are bytes of the folded text."""
        t = fold(text)
        if not t or not len(self.automaton):
            return []
        t = f" {t} "
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (size, uses) in self.automaton.iter(t):
            for n, offset in uses:
                _, item, k = self.items[n]
                begin = last + 1 - size - max(offset, -1)
                windows[n].append((max(0, begin - k), begin + len(item) + k))
        out = []
        for n, spans in sorted(windows.items()):
            item_id, item, k = self.items[n]
            spans.sort()
            best, place = k + 1, (0, 0)
            lo, hi = spans[0]
            for s, e in [*spans[1:], (len(t) + k + 1, 0)]:  # overlapping windows count as one
                if s <= hi and e:
                    hi = max(hi, e)
                    continue
                d, end = myers(item, t[lo:hi], best - 1)
                if d < best:
                    back = t[lo : lo + end][::-1]
                    best, place = d, (lo + end - myers(item[::-1], back[: len(item) + k], d)[1], lo + end)
                    if not best:
                        break
                lo, hi = s, e
            if best <= k:
                out.append((item_id, best, place[0] - 1, place[1] - 1))
        return out


def item_blocks(benchmark: DataFrame, block_items: int, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items with text, in blocks of bounded size."""
    block, size = [], 0
    for item_id, text in benchmark.where(F.length("text") > 0).select("item_id", "text").toLocalIterator():
        if block and (len(block) >= block_items or size + len(text) > block_bytes):
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def edit_matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_items: int = 20_000, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, distance, start, end): a row for each document row and item found in it within rate * length edits."""
    spark, id_kind, item_kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {id_kind}, item_id {item_kind.simpleString()}, distance int, start long, end long"
    path = scratch_path(spark, "edit-matches")
    spark.createDataFrame([], schema).write.parquet(path)
    for items in item_blocks(benchmark, block_items, block_bytes):
        docs.select("doc_id", "text").mapInArrow(_found(items, rate, to_arrow_type(item_kind)), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _found(items: list[tuple[int | None, str]], rate: float, item_kind: pa.DataType):
    names = ["doc_id", "item_id", "distance", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for b in batches:
            rows = [(i, *m) for i, text in enumerate(b.column(1)) for m in matcher.matches(text.as_py())]
            of, item, distance, start, end = zip(*rows, strict=True) if rows else ((),) * 5
            ids = b.column(0).take(pa.array(of, pa.int64()))
            places = [pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(item, item_kind), pa.array(distance, pa.int32()), *places], names)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_items: int = 20_000, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows that hold no item, with all their columns. What a block leaves is written before the next one comes."""
    last, written = None, None
    for items in item_blocks(benchmark, block_items, block_bytes):
        if last is not None:
            before, docs = written, materialize(docs.where(_clean(last, rate)(docs["text"])), "clean-so-far")
            written = docs
            if before is not None:
                drop_scratch(before)
        last = items
    return docs if last is None else docs.where(_clean(last, rate)(docs["text"]))


def _clean(items: list[tuple[int | None, str]], rate: float):
    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(items, rate)
        for texts in batches:
            yield pa.array([not matcher.matches(t.as_py()) for t in texts], pa.bool_())

    return clean
