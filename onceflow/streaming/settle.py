"""Streams of requests.

`settle_stream` runs the engine on micro-batches: a restarted query replays its last batch, whose requests then meet what they committed. `decide_stream` keeps the
first claim of each key in operator state instead, for streams that only need decisions. Neither drops late rows: no watermark is safe for effects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from onceflow.operators import transitions
from onceflow.plans.engine import Engine
from onceflow.sources.store import Ledger

DECISIONS = "key string, arrival long, outcome string"


def settle_stream(requests: DataFrame, engine: Engine, dispatch: Callable[[pd.DataFrame], pd.DataFrame], sink: str, checkpoint: str) -> DataStreamWriter:
    """A writer that settles each micro-batch and puts its outcomes below sink/batch=<id>, overwriting on replay."""

    def batch(df: DataFrame, batch_id: int) -> None:
        engine.settle(df, dispatch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def late_evidence_stream(evidence: DataFrame, ledger: Ledger, checkpoint: str) -> DataStreamWriter:
    """A writer that applies late evidence (key, failed, result, result_ref, error) whenever it comes."""

    def batch(df: DataFrame, batch_id: int) -> None:
        one = df.groupBy("key").agg(F.min_by(F.struct("failed", "result", "result_ref", "error"), "failed").alias("e")).select("key", "e.*")  # success outranks failure
        ledger.update(lambda state: (transitions.late_evidence(state.join(one.select("key"), "key", "left_semi"), one, F.current_timestamp())[0], None), f"late evidence {batch_id}")

    return evidence.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


class FirstClaim(StatefulProcessor):
    """The first fingerprint of a key, and the outcome of each later request against it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "fingerprint string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        batch = pd.concat(parts).sort_values("arrival", kind="stable")
        out, known = [], self.first.get()[0] if self.first.exists() else None
        for arrival, fp in zip(batch["arrival"], batch["fingerprint"], strict=True):
            out.append((key[0], arrival, "PROCEED" if known is None else "REPLAY" if fp == known else "DIVERGENT"))
            known = fp if known is None else known
        self.first.update((known,))
        yield pd.DataFrame(out, columns=["key", "arrival", "outcome"])

    def close(self) -> None:
        pass


def decide_stream(requests: DataFrame) -> DataFrame:
    """(key, arrival, outcome) of a stream (key, fingerprint, arrival). Needs the RocksDB state store provider."""
    return requests.select("key", "fingerprint", "arrival").groupBy("key").transformWithStateInPandas(FirstClaim(), outputStructType=DECISIONS, outputMode="Append", timeMode="None")


def bounded_dedup(requests: DataFrame, horizon: str) -> DataFrame:
    """A weaker form for streams that may forget: a key's repeats within a horizon of event time ts are dropped."""
    return requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["key"])
