"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every source's documents stand in a shuffled order (a hash of the id) and repeat in epochs. A copy's virtual finish time is the
source's cumulative words up to its end, divided by the source's target weight in words. All copies are range-sorted by it, and the mix is cut at the total budget; the
document that a source is serving at the cut gives only the words served by then, so each source comes within a word of its
target.

The sums behind it run in two levels, so that no source, however hot, is one task's work: within slices of the shuffled
order (or of virtual time), and over the slices' totals. Slices number about the square root of the rows.

Defined results: a null text has size 0; sizes of 0 are never taken; a null source is a source of its own, last in order; a
null id shuffles like the empty text; equal rows are separate documents; a source or a table without words has target 0 and
gives nothing; only doc_id, source and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onceflow.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words between ASCII white space: the parts between runs of it, less empty ones at the ends."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target): share of all words dealt by weight, capped at most * source_size, the excess dealt again.

    With the sources ordered by cap / weight, those capped come first: the level of the others is the budget left over the
    weights left, and the first source whose cap reaches that level ends the capped ones. A row a source: the windows without
    a key are over the sources only."""
    by = Window.orderBy(F.col("source").isNull(), "source")
    of = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", of.cast("double"))
    t = t.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(order), F.lit(0.0))))
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return t.select("source", "source_size", target.alias("target"))


def planned(docs: DataFrame, weights: list[int], share: float, most: int, seed: str = "mix") -> DataFrame:
    """A row a document: row (a number of its own), doc_id, source, size, source_size, target, start (words of its source before
    it in the shuffled order). Written once."""
    shuffled = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    sizes = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), shuffled.alias("place"))
    sizes = materialize(sizes, "mix-sizes")
    slices = _slices(sizes)
    plan = targets(sizes, weights, share, most).withColumnRenamed("source", "s")
    rows = sizes.withColumn("slice", F.floor(F.col("place") / F.lit(float(1 << 60)) * slices))
    # over the slices before, and within the slice
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")).withColumn("slice_start", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    totals = totals.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("slice").alias("k"), "slice_start", "source_size", "target")
    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")))
    return materialize(rows.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("slice_start") + F.col("inside")).alias("start")), "mix-plan")


def _slices(rows: DataFrame) -> int:
    return max(1, int(rows.count() ** 0.5))


def schedule(plan: DataFrame, share: float, most: int) -> DataFrame:
    """The mix in its order: a row a copy that is used, with epoch, finish (virtual time), mix_offset (words of the mix before it)
    and words (what it gives), range-sorted by virtual finish time and cut at the total budget."""
    slices = _slices(plan)
    copies = plan.withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("long") for e in range(most)])))
    begin = F.col("epoch") * F.col("source_size") + F.col("start")
    # the targets add up to the budget, so the cut is at virtual time 1; a document in service then gives what is served by it
    served = F.floor(F.least(F.col("size").cast("double"), F.col("target") - begin) + 0.5)
    copies = copies.where((F.col("size") > 0) & (served > 0)).withColumn("served", served.cast("long"))
    copies = copies.withColumn("finish", (begin + F.col("size")) / F.col("target"))
    copies = copies.withColumn("tick", F.floor(F.least(F.col("finish"), F.lit(1.0)) * slices))
    ticks = copies.groupBy("tick").agg(F.sum("served").alias("tick_size"))
    ticks = ticks.withColumn("tick_start", F.coalesce(F.sum("tick_size").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    budget = plan.agg((F.lit(share) * F.sum("size")).alias("budget"))
    ticks = ticks.join(F.broadcast(budget)).select(F.col("tick").alias("t"), "tick_start", "budget")  # one row of budget
    inside = Window.partitionBy("tick").orderBy("finish", "source", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # ranges of ticks, sorted within by the window: the global order
    sorted_ = copies.repartitionByRange("tick").withColumn("inside", F.coalesce(F.sum("served").over(inside), F.lit(0)))
    sorted_ = sorted_.join(ticks, F.col("tick") == F.col("t")).withColumn("mix_offset", F.col("tick_start") + F.col("inside"))
    words = F.least(F.col("served"), F.ceil(F.col("budget") - F.col("mix_offset"))).cast("long")
    return sorted_.withColumn("words", words).where("words > 0").drop("inside", "tick", "t", "tick_start", "budget", "served", "start")


def mix(docs: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, taken (words that the mix takes of it, repeats counted)."""
    plan = planned(docs, weights, share, most)
    used = schedule(plan, share, most).select("row", "doc_id", "size", "source_size", "target", "words")
    every = plan.select("row", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("words"))
    taken = every.unionByName(used).groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


#: The same rows by plain windows.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
                  substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS place, row_number() OVER () AS r FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
     l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM w
           WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     p AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= cap / w) * w, cap)) AS target FROM l),
     q AS (SELECT d.*, p.source_size, p.target, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
           FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
     c AS (SELECT q.*, e.e * source_size + start AS begin, (e.e * source_size + start + size)::DOUBLE / target AS finish,
                  CAST(floor(least(size::DOUBLE, target - (e.e * source_size + start)) + 0.5) AS BIGINT) AS served FROM q, (VALUES (0), (1)) e(e) WHERE size > 0),
     m AS (SELECT r, served, coalesce(sum(served) OVER (ORDER BY finish, source NULLS FIRST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c WHERE served > 0),
     g AS (SELECT r, sum(greatest(0, least(served, ceil((SELECT 1.5::DOUBLE * sum(size) FROM d) - off)))) AS taken FROM m GROUP BY r)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN g ON q.r = g.r"""
