"""Counts of events and states, and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onceflow.schema import EVENTS, STATES

#: Bits of a value that a level of the selection decides.
_LEVEL = 16


def event_counts(events: DataFrame) -> DataFrame:
    """(event, n) for all four events; 0 for those not seen. A row may settle more than once over its life: these count events, not rows."""
    seen = events.groupBy("event").agg(F.count("*").alias("n"))
    names = events.sparkSession.createDataFrame([(e,) for e in EVENTS], "event string")
    return F.broadcast(names).join(seen, "event", "left").select("event", F.coalesce("n", F.lit(0)).alias("n"))


def state_counts(ledger: DataFrame) -> DataFrame:
    """(state, n) for all states."""
    seen = ledger.groupBy("state").agg(F.count("*").alias("n"))
    names = ledger.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return F.broadcast(names).join(seen, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def total_settled(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("event") == "settled").alias("n"))


def flag_density(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, files, findings, per_file) with a total row (repo null). findings and files: repo, path."""
    n = files.groupBy("repo").agg(F.count("*").alias("files")).join(findings.groupBy("repo").agg(F.count("*").alias("findings")), "repo", "left")
    both = n.rollup("repo").agg(F.sum("files").alias("files"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))
    return both.withColumn("per_file", F.col("findings") / F.col("files"))


def _as_bits(value: Column, whole: bool) -> Column:
    """A long in the order of the values."""
    bits = value.cast("long") if whole else F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return bits if whole else F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def _from_bits(bits: Column, whole: bool) -> Column:
    raw = F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)
    return bits if whole else F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def percentiles(df: DataFrame, column: str, ps: tuple[float, ...] = (50, 95, 99)) -> DataFrame:
    """(p, value): the value at round(p / 100 * (n - 1)), halves to even; p 100 is the maximum. Nulls take no part; no values, no rows.

    One plan for all ranks, exact for doubles and whole numbers: equal values become one row with a count, and a radix selection then decides _LEVEL bits a
    level. What a window sorts is a level's counts, 2**_LEVEL a rank at most, whatever the data."""
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    value = F.col(column).cast("long" if whole else "double")
    counts = df.where(F.col(column).isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    counts = counts.select(_as_bits(F.col("v"), whole).alias("bits"), "n")
    asked = F.explode(F.array(*[F.lit(float(p)) for p in (*ps, 100)])).alias("p")
    rank = F.rint(F.col("p") / 100 * (F.col("all") - 1)).cast("long")
    # a row a rank: what is decided of its value (the bits from `shift` on), and its rank among the values that share that
    found = counts.agg(F.sum("n").alias("all")).where("all > 0").select("all", asked).select("p", F.lit(0).cast("long").alias("head"), rank.alias("rank"))
    for shift in range(64 - _LEVEL, -1, -_LEVEL):
        head = F.shiftright("bits", shift)
        above = F.lit(0).cast("long") if shift == 64 - _LEVEL else F.shiftright("bits", shift + _LEVEL)
        here = counts.select(above.alias("head"), head.alias("next"), "n").groupBy("head", "next").agg(F.sum("n").alias("n"))
        here = here.join(F.broadcast(found), "head")  # a row a rank
        until = F.sum("n").over(Window.partitionBy("p").orderBy("next"))
        here = here.withColumn("until", until).where((F.col("rank") < F.col("until")) & (F.col("rank") >= F.col("until") - F.col("n")))
        found = here.select("p", F.col("next").alias("head"), (F.col("rank") - F.col("until") + F.col("n")).alias("rank"))
    return found.select("p", _from_bits(F.col("head"), whole).alias("value"))
