"""Requests to effects where several writers share a ledger.

Each writer holds the effects that it runs under a lease and a fencing token. A batch is claimed in one commit, marked EXECUTING under its tokens in a second, sent,
and recorded under its tokens in a third; whatever another writer has taken over in between is refused by its token and healed with what is known. A heartbeat
renews the leases while the batch is out. What another writer holds is looked at again until it is settled, its lease ends, or the patience does.
"""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onceflow import schema as S
from onceflow.functions.canonical import json_round_trip
from onceflow.operators import claims, leases, recovery
from onceflow.operators import transitions as tr
from onceflow.plans.engine import Engine
from onceflow.plans.notices import event
from onceflow.plans.seams import seam

log = logging.getLogger(__name__)

#: What becomes of a request that was sent, by what its record met. HEAL: the evidence is in, if late.
_SENT = {"APPLIED": "PROCEED", "HEAL": "PROCEED", "ADOPT": "REPLAY", "DIVERGENT": "DIVERGENT", "SURFACE": "AMBIGUOUS"}


class Heartbeat:
    """Renews the leases of a batch while it is out. A beat that fails is logged and tried again: a heartbeat that dies in silence would let a live writer be taken for dead."""

    def __init__(self, beat: Callable[[], int], expected: int, period: float):
        self.beat, self.expected, self.period = beat, expected, period
        self.beats = 0
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, name="onceflow-heartbeat", daemon=True)

    def _run(self) -> None:
        while not self._stop.wait(self.period):
            began = time.monotonic()
            try:
                renewed = self.beat()
                self.beats += 1
                if renewed < self.expected:
                    log.warning("%d of %d leases were not renewed; another writer may have taken them", self.expected - renewed, self.expected)
                if time.monotonic() - began > self.period:
                    log.warning("a heartbeat took %.1f s, longer than its period of %.1f s; leases may end before the next", time.monotonic() - began, self.period)
            except Exception:  # noqa: BLE001
                log.exception("a heartbeat failed; it will be tried again")

    def __enter__(self) -> Heartbeat:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        """Returns when no beat is under way, so that none commits between the effects and their record."""
        self._stop.set()
        self._thread.join()


class LeasedEngine(Engine):
    """Settles batches of requests against a ledger with several writers. clock: seconds since 1970."""

    _many = True

    def __init__(self, *args: Any, owner: str | None = None, lease_seconds: float = 30.0, heartbeat_interval: float | None = None, clock: Callable[[], float] = time.time, **kwargs: Any):
        super().__init__(*args, **kwargs)
        self.owner, self.lease_seconds, self.clock = owner or uuid.uuid4().hex, lease_seconds, clock
        self.heartbeat_interval = max(lease_seconds / 3, 0.001) if heartbeat_interval is None else heartbeat_interval

    def _instant(self):
        return F.timestamp_micros(F.lit(int(self.clock() * 1e6)))

    def settle(self, requests: DataFrame, dispatch: Callable[[pd.DataFrame], pd.DataFrame], *, wait_timeout: float = 30.0, poll: float = 0.05) -> DataFrame:
        """One row a request: its columns, outcome, result, result_ref. Outcomes are those of Engine.settle, AMBIGUOUS where an effect was taken over that nobody can
        ask about, and BUSY where another writer still holds the effect when the patience of wait_timeout seconds ends."""
        base, todo, refused = self._begin(requests.withColumn("owner", F.lit(self.owner)))
        deadline, done, n = self.clock() + wait_timeout, [refused], 0
        while True:
            here = f"{base}/{n:03d}"
            decided = self._claim(todo, here)
            seam("after_claim")
            after = self._stored(self._run(decided, dispatch, here), f"{here}/after")
            told = F.when((F.col("outcome") == "AMBIGUOUS") & F.col("new_token").isNotNull(), "SURFACED").otherwise(F.col("outcome"))  # ambiguous as of now
            self._tell(after.select("key", event(told).alias("event")).where("event is not null"))
            columns = [*requests.columns, "owner", "outcome", "result", "result_ref"]
            done.append(after.where("outcome <> 'BUSY'").select(*columns))
            again, n = after.where("outcome = 'BUSY'").select(*requests.columns, "owner"), n + 1
            if not again.take(1):
                break
            # what waits only for another request of this batch need not wait for the clock
            if self.clock() >= deadline and not after.where("outcome <> 'BUSY'").take(1):
                done.append(self._without_result(again, "BUSY"))
                break
            if not after.where("outcome <> 'BUSY'").take(1):
                time.sleep(poll)
            todo = again
        return reduce(DataFrame.unionByName, done).drop("fingerprints", "owner")

    def _claim(self, todo: DataFrame, here: str) -> DataFrame:
        def change(ledger: DataFrame) -> tuple[DataFrame | None, DataFrame]:
            mine, now = self._stored(ledger, f"{here}/held"), self.clock()
            decided = self._stored(claims.decide_leased(todo, mine, now, self.lease_seconds, self._matches(todo)).drop("stored_fingerprint"), f"{here}/decided")
            acting = decided.where(F.col("new_token").isNotNull()).take(1)
            return leases.take(mine, decided, self._instant()) if acting else None, decided

        return self.ledger.update(change, "claim", keys=todo)

    def _fence(self, writes: DataFrame, path: str, note: str) -> DataFrame:
        """(key, applied) of fenced writes."""

        def change(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
            after, hits = tr.fence(self._stored(ledger, f"{path}-on"), writes, self._instant())
            hits = self._stored(hits, path)
            return after.join(hits.where("applied"), "key", "left_semi"), hits

        return self.ledger.update(change, note, keys=writes)

    def _ask(self, taken: DataFrame) -> DataFrame:
        """(key, verdict, result) from the providers of effects taken over (key, tool)."""
        known = {d.tool: d.reconcile for d in self.registry if d.reconcile is not None}

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for key, tool in zip(f["key"], f["tool"], strict=True):
                    try:
                        verdict, result = known[tool](key)
                        rows.append((key, verdict, json_round_trip(result)[0]))
                    except Exception:  # noqa: BLE001  a failed read concludes nothing
                        rows.append((key, "UNKNOWN", None))
                yield pd.DataFrame(rows, columns=["key", "verdict", "result"])

        return taken.select("key", "tool").mapInPandas(ask, S.PROVIDER_READS)

    def _run(self, decided: DataFrame, dispatch: Callable[[pd.DataFrame], pd.DataFrame], here: str) -> DataFrame:
        """What the claims came to: decided with its outcome, result and result_ref."""
        none = F.lit(None).cast("string")
        mine = decided.where(F.col("new_token").isNotNull() & F.col("outcome").isin("PROCEED", "RECONCILE"))
        if not mine.take(1):
            return decided
        taken = mine.where("outcome = 'RECONCILE'")
        reads = self._stored(self._ask(taken), f"{here}/reads")
        seam("during_reconcile_takeover")
        rules = F.broadcast(self.registry.frame(self.spark).select("tool", "on_absent"))  # a row a tool
        actions = recovery.reconcile_on_takeover(taken.join(rules, "tool", "left").select("key", "on_absent"), reads)
        ways = mine.join(actions, "key", "left").join(reads.select("key", F.col("result").alias("found")), "key", "left")
        to = F.when(F.col("action") == "ADOPT", S.SUCCEEDED).when(F.col("action") == "AMBIGUATE", S.AMBIGUOUS).otherwise(S.EXECUTING)
        writes = ways.select("key", F.col("new_token").alias("token"), to.alias("state"), F.when(F.col("action") == "ADOPT", F.col("found")).alias("result"), none.alias("result_ref"), none.alias("error"))
        writes = self._stored(writes, f"{here}/marks")
        marked = self._fence(writes, f"{here}/marked", "mark").join(writes.select("key", "state", F.col("result").alias("found")), "key")
        sent = decided.join(marked.where(F.col("applied") & (F.col("state") == S.EXECUTING)).select("key"), "key", "left_semi").where("new_token is not null")
        sent = self._stored(sent, f"{here}/sent")
        seam("after_mark_executing")
        with Heartbeat(lambda: self._beat(sent), sent.count(), self.heartbeat_interval):
            outcomes = self._send(sent.drop("owner", "new_state", "new_token", "new_lease_expires"), dispatch, here)
        seam("after_dispatch")
        met = self._record(sent, outcomes, here)
        seam("after_record")
        # the acting requests' outcomes; those whose mark was refused lost their lease before anything was sent, and are looked at again
        ends = outcomes.select("key", F.col("outcome").alias("actual"), F.col("result").alias("r"), F.col("result_ref").alias("rr")).join(met, "key", "left")
        came = F.create_map(*[F.lit(x) for pair in _SENT.items() for x in pair])[F.col("action")]
        actual = F.when(F.col("actual") == "unknown", "UNKNOWN").when(F.col("actual") == "clean_failure", "FAILED").otherwise(came)
        adopted = F.col("action") == "ADOPT"
        ends = ends.select("key", actual.alias("came"), F.when(adopted, F.col("stored")).otherwise(F.col("r")).alias("r"), F.when(adopted, F.col("stored_ref")).otherwise(F.col("rr")).alias("rr"))
        other = marked.where(~F.col("applied") | (F.col("state") != S.EXECUTING)).select("key", F.when(~F.col("applied"), "BUSY").when(F.col("state") == S.SUCCEEDED, "REPLAY").otherwise("AMBIGUOUS").alias("came"), F.when(F.col("applied"), F.col("found")).alias("r"), none.alias("rr"))
        d = decided.join(ends.unionByName(other), "key", "left")
        acts = F.col("new_token").isNotNull() & F.col("came").isNotNull()
        pick = lambda new, old: F.when(acts, F.col(new)).otherwise(F.col(old))
        shown = F.when(acts & ~F.col("came").isin("PROCEED", "REPLAY"), none)
        return d.withColumns({"outcome": pick("came", "outcome"), "result": F.coalesce(shown, pick("r", "result")), "result_ref": F.coalesce(shown, pick("rr", "result_ref"))}).drop("came", "r", "rr")

    def _beat(self, sent: DataFrame) -> int:
        beats = sent.select("key", "owner", F.lit(self.lease_seconds).alias("lease_seconds"))

        def change(ledger: DataFrame) -> tuple[DataFrame, int]:
            after, hits = tr.heartbeat(ledger, beats, self.clock())
            return after.join(hits.where("applied"), "key", "left_semi"), hits.where("applied").count()

        return self.ledger.update(change, "heartbeat", keys=beats)

    def _record(self, sent: DataFrame, outcomes: DataFrame, here: str) -> DataFrame:
        """(key, action, stored, stored_ref): what the records of a batch met. A record that its token no longer allows is healed with what is known."""
        state = F.when(F.col("outcome") == "ok", S.SUCCEEDED).otherwise(S.FAILED)
        known = outcomes.where("outcome <> 'unknown'").withColumn("state", state)
        tokens = sent.select("key", F.col("new_token").alias("token"), "fingerprint")
        writes = known.join(tokens, "key").select("key", "token", "state", "result", "result_ref", "error", "fingerprint")
        writes = self._stored(writes, f"{here}/records")

        def change(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
            mine = self._stored(ledger, f"{here}/recorded-on")
            after, hits = tr.fence(mine, writes.drop("fingerprint"), self._instant())
            late = writes.join(hits.where("not applied").select("key"), "key", "left_semi").withColumn("succeeded", F.col("state") == S.SUCCEEDED)
            acts = tr.heal(late.select("key", "fingerprint", "succeeded"), mine).select("key", "action")
            acts = hits.where("applied").select("key", F.lit("APPLIED").alias("action")).unionByName(acts)
            stored = mine.select("key", F.col("result").alias("stored"), F.col("result_ref").alias("stored_ref"))
            acts = self._stored(acts.join(stored, "key", "left"), f"{here}/met")
            healed = writes.join(acts.where("action = 'HEAL'").select("key"), "key", "left_semi")
            evidence = healed.select("key", (F.col("state") == S.FAILED).alias("failed"), "result", "result_ref", "error")
            after, _ = tr.late_evidence(after, evidence, self._instant())
            return after.join(acts.where("action in ('APPLIED', 'HEAL')").select("key"), "key", "left_semi"), acts

        met = self.ledger.update(change, "record", keys=writes)
        if late := met.where("action <> 'APPLIED'").count():
            log.warning("%d records came after another writer had taken over", late)
        return met
