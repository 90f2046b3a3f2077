"""What time alone changes, as a stream: an effect whose provider has forgotten its key, a lease that nobody renewed.

An effect that is out has a horizon: the end of its provider's memory, or of its lease. A timer on each key fires when the stream's time passes it without news, and
says what is to be done about the key. News that comes first moves the horizon, or ends it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from onceflow import schema as S

#: What is told when a horizon passes: the key, what was waited for, and when it ended.
PASSED = "key string, reason string, horizon timestamp"


class Horizon(StatefulProcessor):
    """The horizon that a key waits for. Rows: (key, ts, horizon, reason); a null horizon ends the wait. Of a batch's rows for a key the latest counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "horizon long, reason string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        batch = pd.concat(parts).sort_values(["at", "horizon"], kind="stable", na_position="last")
        last = batch.iloc[-1]
        if self.open.exists():
            horizon, _, at = self.open.get()
            if at > int(last["at"]):  # older news than what is known
                return
            self.handle.deleteTimer(horizon)
            self.open.clear()
        if pd.notna(last["horizon"]):
            horizon = int(last["horizon"])
            self.open.update((horizon, last["reason"], int(last["at"])))
            self.handle.registerTimer(horizon)
        return
        yield  # a generator without rows

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            horizon, reason, _ = self.open.get()
            if horizon <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield pd.DataFrame({"key": [key[0]], "reason": [reason], "horizon": [pd.Timestamp(horizon, unit="ms")]})

    def close(self) -> None:
        pass


def passed_horizons(news: DataFrame, delay: str = "0 seconds", time_mode: str = "EventTime") -> DataFrame:
    """(key, reason, horizon) of the keys whose horizon passes. news: key, ts, horizon (a timestamp or null), reason. By event time the horizon passes with the watermark, which
    follows ts by `delay`; by processing time with the clock. Needs the RocksDB state store provider."""
    rows = news.select("key", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.unix_millis(F.col("horizon").cast("timestamp")).alias("horizon"), "reason")
    rows = rows.withWatermark("ts", delay) if time_mode == "EventTime" else rows
    return rows.groupBy("key").transformWithStateInPandas(Horizon(), outputStructType=PASSED, outputMode="Append", timeMode=time_mode)


def provider_news(changes: DataFrame) -> DataFrame:
    """News of the providers' memories from a stream of ledger rows (key, state, provider_dedup, provider_ttl_s, created_at, ts): an effect that is out waits for the end of its
    provider's memory; when that passes, sending it again is no longer safe, and it must become AMBIGUOUS."""
    waits = (F.col("state") == S.EXECUTING) & F.col("provider_dedup") & F.col("provider_ttl_s").isNotNull()
    # the limit itself is still inside
    end = F.timestamp_micros((F.unix_micros("created_at") + F.col("provider_ttl_s") * 1_000_000 + 1_000).cast("long"))
    return changes.select("key", "ts", F.when(waits, end).alias("horizon"), F.lit("PROVIDER_FORGOT").alias("reason"))


def lease_news(changes: DataFrame) -> DataFrame:
    """News of leases from a stream of ledger rows (key, state, lease_owner, lease_expires, ts): an effect under a lease waits for its end; a renewal moves it."""
    waits = F.col("state").isin(S.CLAIMED, S.EXECUTING) & F.col("lease_expires").isNotNull()
    return changes.select("key", "ts", F.when(waits, F.timestamp_micros((F.col("lease_expires") * 1_000_000).cast("long"))).alias("horizon"), F.lit("LEASE_ENDED").alias("reason"))
