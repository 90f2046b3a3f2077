"""What to do after a crash with the effects it left behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onceflow import schema as S
from onceflow.operators.claims import within_ttl


def recover_scan(ledger: DataFrame, now) -> DataFrame:
    """(key, tool, state, next): next is the state that needs no provider to tell, RECONCILE where one must, or the state unchanged. now: a timestamp Column."""
    running = F.col("state") == S.EXECUTING
    fresh = F.col("provider_dedup") & within_ttl(F.col("created_at"), F.col("provider_ttl_s"), now)
    nxt = F.when(F.col("state") == S.CLAIMED, S.INTENDED).when(running & F.col("reconcilable"), "RECONCILE").when(running & fresh, S.INTENDED).when(running, S.AMBIGUOUS).otherwise(F.col("state"))
    return ledger.select("key", "tool", "state", nxt.alias("next"))


def pending_reconcile(ledger: DataFrame) -> DataFrame:
    """The (key, tool) whose provider must be asked."""
    return ledger.where((F.col("state") == S.EXECUTING) & F.col("reconcilable")).select("key", "tool")


def recover(ledger: DataFrame, declarations: DataFrame, reads: DataFrame, now) -> DataFrame:
    """(key, from_state, to_state, result): recovery with the providers' answers.

    declarations: tool, on_absent, has_reconcile; one row a tool, registered in full before recovery. reads: key, verdict (SETTLED, ABSENT, UNKNOWN, or RAISED: the
    query failed, nothing is concluded), result. A pending key without a declaration or a way to ask is ambiguous; one
    whose read is missing counts as raised."""
    scan = recover_scan(ledger, now)
    d = scan.join(declarations.select("tool", "on_absent", "has_reconcile"), "tool", "left").join(reads.select("key", "verdict", F.col("result").alias("read_result")), "key", "left")
    verdict = F.coalesce("verdict", F.lit("RAISED"))
    asked = (
        F.when(~F.coalesce("has_reconcile", F.lit(False)), S.AMBIGUOUS)
        .when(verdict == "RAISED", S.EXECUTING)
        .when(verdict == "SETTLED", S.SUCCEEDED)
        .when((verdict == "ABSENT") & (F.col("on_absent") == "retry"), S.INTENDED)
        .otherwise(S.AMBIGUOUS)
    )
    to = F.when(F.col("next") == "RECONCILE", asked).otherwise(F.col("next"))
    return d.select("key", F.col("state").alias("from_state"), to.alias("to_state"), F.when(to == S.SUCCEEDED, F.col("read_result")).alias("result"))


def reconcile_on_takeover(taken: DataFrame, reads: DataFrame) -> DataFrame:
    """(key, action): what a worker does with effects it took over (key, on_absent): ADOPT the provider's record, DISPATCH again, or AMBIGUATE. A missing read is unknown."""
    d = taken.join(reads.select("key", "verdict"), "key", "left")
    action = F.when(F.col("verdict") == "SETTLED", "ADOPT").when((F.col("verdict") == "ABSENT") & (F.col("on_absent") == "retry"), "DISPATCH").otherwise("AMBIGUATE")
    return d.select("key", action.alias("action"))
