"""Conditional writes, as transforms from a ledger and a batch of writes to a new ledger and which writes applied.

Each key has one write a batch: equal writes of a key count once, and where they differ none applies. The writes meet the ledger in one
equi-join; rows without one pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onceflow import schema as S


def _apply(ledger: DataFrame, writes: DataFrame, allowed: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(ledger after, (key, applied)). Columns of writes are seen as w_<name>."""
    asked = [c for c in writes.columns if c != "key"]
    write = F.struct(*asked, F.lit(True).alias("there"))
    w = writes.groupBy("key").agg(F.min(write).alias("w"), F.max(write).alias("other")).where(F.col("w").eqNullSafe(F.col("other")))
    w = w.select("key", *[F.col("w")[c].alias(f"w_{c}") for c in (*asked, "there")])
    d = ledger.join(w, "key", "left").withColumn("applied", F.coalesce(F.col("w_there") & allowed, F.lit(False)))
    after = d.select(*[F.when(F.col("applied"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in ledger.columns])
    hit = d.where("applied").select("key", F.lit(True).alias("applied"))
    return after, writes.select("key").join(hit, "key", "left").select("key", F.coalesce("applied", F.lit(False)).alias("applied"))


def _now(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def fence(ledger: DataFrame, writes: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """writes: key, token, state, result, result_ref, error. Applies where the token is the row's and the row is not terminal. The row then says what
    the new state says and nothing of an earlier attempt: a result only for SUCCEEDED, an error only for FAILED, a time only for a terminal state, which
    also gives up the lease."""
    terminal, done, failed = F.col("w_state").isin(*S.TERMINAL), F.col("w_state") == S.SUCCEEDED, F.col("w_state") == S.FAILED
    return _apply(ledger, writes, (F.col("fencing_token") == F.col("w_token")) & ~F.col("state").isin(*S.TERMINAL), {
        "state": F.col("w_state"), "result": F.when(done, F.col("w_result")), "result_ref": F.when(done, F.col("w_result_ref")), "error": F.when(failed, F.col("w_error")),
        "settled_at": F.when(terminal, _now(now)), "lease_owner": F.when(~terminal, F.col("lease_owner")), "lease_expires": F.when(~terminal, F.col("lease_expires")),
    })


def heartbeat(ledger: DataFrame, beats: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """beats: key, owner, lease_seconds. Extends the owner's leases; neither token nor state matters."""
    return _apply(ledger, beats, F.col("lease_owner") == F.col("w_owner"), {"lease_expires": F.lit(now) + F.col("w_lease_seconds")})


def late_evidence(ledger: DataFrame, evidence: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """evidence: key, failed, result, result_ref, error, from one who ran the effect, or proves that it did not run. Success resolves an ambiguous or failed row;
    a clean failure frees an ambiguous one. Nothing overwrites a success."""
    failed = F.col("w_failed")
    allowed = F.when(failed, F.col("state") == S.AMBIGUOUS).otherwise(F.col("state").isin(S.AMBIGUOUS, S.FAILED))
    return _apply(ledger, evidence, allowed, {
        "state": F.when(failed, S.FAILED).otherwise(S.SUCCEEDED), "result": F.when(failed, F.col("result")).otherwise(F.col("w_result")), "result_ref": F.when(failed, F.col("result_ref")).otherwise(F.col("w_result_ref")),
        "error": F.when(failed, F.col("w_error")), "resolved_by": F.lit("late_evidence"), "settled_at": _now(now),
    })


def move(ledger: DataFrame, writes: DataFrame, to: str, sources: tuple[str, ...], now=None) -> tuple[DataFrame, DataFrame]:
    """writes: key, and result, result_ref, error where the state has them. From one of the source states to another; terminal rows are written once."""
    changes = {"state": F.lit(to)}
    if to in S.TERMINAL:
        changes["settled_at"] = _now(now)
    for c in ("result", "result_ref", "error"):
        if c in writes.columns:
            changes[c] = F.col(f"w_{c}")
        elif to == S.SUCCEEDED and c == "error":
            changes[c] = _null()
    return _apply(ledger, writes, F.col("state").isin(*sources), changes)


def mark_executing(ledger: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    return move(ledger, keys.select("key"), S.EXECUTING, (S.CLAIMED,))


def record_success(ledger: DataFrame, results: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    return move(ledger, results.select("key", "result", "result_ref"), S.SUCCEEDED, (S.EXECUTING, S.CLAIMED), now)


def record_failure(ledger: DataFrame, failures: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    return move(ledger, failures.select("key", "error"), S.FAILED, (S.EXECUTING, S.CLAIMED), now)


def settle_reconciled(ledger: DataFrame, results: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    return move(ledger, results.select("key", "result"), S.SUCCEEDED, (S.EXECUTING,), now)


def reclaim(ledger: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    return move(ledger, keys.select("key"), S.INTENDED, (S.EXECUTING, S.CLAIMED))


def ambiguate(ledger: DataFrame, keys: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    return move(ledger, keys.select("key"), S.AMBIGUOUS, (S.EXECUTING,), now)


def heal(attempts: DataFrame, ledger: DataFrame) -> DataFrame:
    """What a worker does whose fenced write was refused. attempts: key, fingerprint, succeeded. Adds action: HEAL (late evidence), ADOPT (a peer's
    result), DIVERGENT (a peer settled another action), SURFACE (nobody knows), or for a clean failure HEAL or LEAVE."""
    d = attempts.join(ledger.select("key", F.col("state").alias("now_state"), F.col("fingerprint").alias("now_fp")), "key", "left")
    won = F.when(F.col("now_state").isin(S.AMBIGUOUS, S.FAILED), "HEAL").when(F.col("now_state") == S.SUCCEEDED, F.when(F.coalesce(F.col("fingerprint") == F.col("now_fp"), F.lit(True)), "ADOPT").otherwise("DIVERGENT")).otherwise("SURFACE")
    lost = F.when(F.col("now_state") == S.AMBIGUOUS, "HEAL").otherwise("LEAVE")
    return d.withColumn("action", F.when(F.col("succeeded"), won).otherwise(lost)).drop("now_state", "now_fp")


def reduce_transitions(log: DataFrame) -> DataFrame:
    """(key, state, seq): the log (key, seq, to_state, resolved_by) folded in order. A terminal state stays, but for late evidence
    and for a failed effect that is claimed again; other edges out of it are ignored."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "to_state", "resolved_by")))
    late = lambda a, x: (x["resolved_by"] == "late_evidence") & (a["state"] != S.SUCCEEDED)
    legal = lambda a, x: a["state"].isNull() | ~a["state"].isin(*S.TERMINAL) | F.coalesce(late(a, x), F.lit(False)) | ((a["state"] == S.FAILED) & (x["to_state"] == S.CLAIMED))
    fold = F.aggregate("steps", F.struct(F.lit(None).cast("string").alias("state"), F.lit(None).cast("long").alias("seq")), lambda a, x: F.when(legal(a, x), F.struct(x["to_state"].alias("state"), x["seq"].cast("long").alias("seq"))).otherwise(a))
    return log.groupBy("key").agg(steps.alias("steps")).select("key", fold.alias("s")).select("key", "s.state", "s.seq")
