"""Connected components over edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onceflow.llm.common import drop_scratch, materialize


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of the edges (a, b).

    Each round every node of the graph points to its least neighbour, if that is smaller, and pointers double until they reach a root (pointer
    jumping); the nodes of a tree become one, and only edges between different ones stay, so the rounds join ever fewer edges. The
    smallest node of a component never changes its name. Only sums, and whether edges are left, come to the driver; tables are written to scratch."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    total = lambda t: t.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
    left = materialize(both(edges.where("a <> b").select("a", "b")), "edges")
    labels = None
    for _ in range(most):
        joined = materialize(left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "pointers")
        before = total(joined)
        while True:
            up = joined.select(F.col("node").alias("n"), F.col("comp").alias("c"))
            jumped = materialize(joined.join(up, joined["comp"] == up["n"]).select("node", F.col("c").alias("comp")), "pointers")
            drop_scratch(joined)
            joined, now = jumped, total(jumped)
            if now == before:
                break
            before = now
        to = joined.select(F.col("node").alias("n"), F.col("comp").alias("c"))
        if labels is None:
            new = joined
        else:
            new = materialize(labels.join(to, labels["comp"] == to["n"], "left").select("node", F.coalesce("c", "comp").alias("comp")), "labels")
            drop_scratch(labels)
        one = left.join(to, left["a"] == to["n"]).select(F.col("c").alias("a"), "b")
        rest = one.join(to, one["b"] == to["n"]).select("a", F.col("c").alias("b")).where("a <> b").distinct()
        old, left, labels = left, materialize(rest, "edges"), new
        drop_scratch(old, *([] if joined is labels else [joined]))
        if not left.take(1):
            return labels
    raise RuntimeError(f"no end after {most} rounds")
