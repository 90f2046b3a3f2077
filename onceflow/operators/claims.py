"""Claim decisions over whole batches of requests: which may proceed, which replay, which diverge, which must wait or be surfaced.

Errors are data: every request gets one outcome of PROCEED, REPLAY, DIVERGENT, AMBIGUOUS, IN_FLIGHT, BUSY, RECONCILE, SCHEME_MISMATCH.
Requests meet the ledger by one equi-join on the key. The first claimant of a key in a batch is found by an aggregate that combines before the
shuffle and is joined back, so a key with a third of all requests is no single task's window; adaptive execution splits the join's skewed side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onceflow import schema as S

#: Columns of the ledger that decisions read; a scan reads no others.
_ROW = ("state", "fingerprint", "secret_id", "result", "result_ref", "key_version", "fingerprint_version", "fencing_token", "lease_owner", "lease_expires", "provider_ttl_s", "created_at")


def _met(requests: DataFrame, ledger: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    have = [c for c in columns if c in ledger.columns]
    rows = ledger.select("key", *[F.col(c).alias(f"row_{c}") for c in have])
    out = requests.join(rows, "key", "left")
    missing = [c for c in columns if c not in have]
    return out.withColumns({f"row_{c}": F.lit(None).cast(S.EFFECTS[c].dataType) for c in missing}) if missing else out


def foreign_scheme() -> Column:
    """Whether the row's evidence is of another scheme; unknown provenance is not."""
    other = lambda c, v: F.coalesce(F.col(c) != v, F.lit(False))
    return other("row_key_version", S.KEY_VERSION) | other("row_fingerprint_version", S.FINGERPRINT_VERSION)


def within_ttl(created: Column, ttl: Column, now: Column) -> Column:
    """Whether the provider still remembers a key: no limit, or an age up to and at it."""
    return ttl.isNull() | ((F.unix_micros(now) - F.unix_micros(created)) / 1e6 <= ttl)


def first_claimants(candidates: DataFrame) -> DataFrame:
    """(key, lead_arrival, lead_fingerprint): the earliest candidate of each key."""
    lead = F.min(F.struct("arrival", "fingerprint")).alias("lead")
    return candidates.groupBy("key").agg(lead).select("key", F.col("lead.arrival").alias("lead_arrival"), F.col("lead.fingerprint").alias("lead_fingerprint"))


def decide_claim(requests: DataFrame, ledger: DataFrame, matches: Column | None = None) -> DataFrame:
    """Single-writer claims. requests: key, fingerprint, arrival (unique), and any other columns.

    Adds outcome, follows (the arrival of the request of this batch that it waits for, else null), result, result_ref, stored_fingerprint. A follower's
    outcome holds if its leader's effect succeeds; `follow_up` gives it otherwise.
    matches: how evidence compares; by default byte for byte. Use identity.signed_by for rotated secrets."""
    d = _met(requests, ledger, _ROW)
    same = F.coalesce(F.col("fingerprint") == F.col("row_fingerprint") if matches is None else matches, F.lit(False))
    state = F.col("row_state")
    seen = (
        F.when(state.isNull(), "PROCEED")
        .when(foreign_scheme(), "SCHEME_MISMATCH")
        .when(state == S.SUCCEEDED, F.when(same, "REPLAY").otherwise("DIVERGENT"))
        .when(state == S.AMBIGUOUS, F.when(same, "AMBIGUOUS").otherwise("DIVERGENT"))
        .when(state.isin(S.EXECUTING, S.CLAIMED), "IN_FLIGHT")
        .otherwise(F.when(same, "PROCEED").otherwise("DIVERGENT"))
    )
    d = d.withColumn("seen", seen)
    leads = first_claimants(d.where("seen = 'PROCEED'").select("key", "arrival", "fingerprint"))
    d = d.join(leads, "key", "left")
    follows = (F.col("seen") == "PROCEED") & (F.col("arrival") != F.col("lead_arrival"))
    outcome = F.when(follows, F.when(F.col("fingerprint") == F.col("lead_fingerprint"), "REPLAY").otherwise("DIVERGENT")).otherwise(F.col("seen"))
    replay = F.col("outcome") == "REPLAY"
    return d.withColumn("outcome", outcome).select(
        *requests.columns, "outcome", F.when(follows, F.col("lead_arrival")).alias("follows"), F.when(replay, F.col("row_result")).alias("result"),
        F.when(replay, F.col("row_result_ref")).alias("result_ref"), F.col("row_fingerprint").alias("stored_fingerprint"),
    )


def follow_up(decided: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Followers once their leaders' actual outcomes (key, outcome: ok, clean_failure or unknown) are known: unknown leaves them IN_FLIGHT,
    a clean failure makes them claimants again (outcome null: decide anew), ok keeps what was decided."""
    o = outcomes.select("key", F.col("outcome").alias("actual"))
    d = decided.join(o, "key", "left")
    new = F.when(F.col("follows").isNull() | (F.col("actual") == "ok"), F.col("outcome")).when(F.col("actual") == "clean_failure", F.lit(None).cast("string")).otherwise("IN_FLIGHT")
    return d.withColumn("outcome", new).drop("actual")


def decide_leased(requests: DataFrame, ledger: DataFrame, now: float, lease_seconds: float, matches: Column | None = None) -> DataFrame:
    """Multi-writer claims with leases. requests: as for decide_claim, with owner and the caller's provider_dedup and reconcilable.

    The caller's flags and the row's TTL decide about an abandoned effect; a flag that is null promises nothing. A lease that ends just now is over;
    an owner's own lease does not stop it; a live lease whose owner is unknown is another's. One request a key decides in a batch, the earliest; the others of the batch are BUSY until the next. Adds outcome, new_state (null:
    unchanged), new_token, new_lease_expires, result, result_ref, stored_fingerprint."""
    d = _met(requests, ledger, _ROW)
    same = F.coalesce(F.col("fingerprint") == F.col("row_fingerprint") if matches is None else matches, F.lit(False))
    state, never = F.col("row_state"), F.lit(False)
    dedup, asks = F.coalesce("provider_dedup", never), F.coalesce("reconcilable", never)
    held = F.coalesce(F.col("row_lease_expires") > now, never) & ~F.coalesce(F.col("row_lease_owner") == F.col("owner"), never)
    fresh = within_ttl(F.col("row_created_at"), F.col("row_provider_ttl_s"), F.timestamp_micros(F.lit(int(now * 1e6))))
    running = state == S.EXECUTING
    outcome = (
        F.when(state.isNull(), "PROCEED")
        .when(foreign_scheme(), "SCHEME_MISMATCH")
        .when(state == S.SUCCEEDED, F.when(same, "REPLAY").otherwise("DIVERGENT"))
        .when(state == S.AMBIGUOUS, F.when(same, "AMBIGUOUS").otherwise("DIVERGENT"))
        .when(held, "BUSY")
        .when(~same, "DIVERGENT")
        .when(running & ~dedup & ~asks, "AMBIGUOUS")
        .when(running & dedup & ~asks & ~fresh, "AMBIGUOUS")
        .when(running & asks, "RECONCILE")
        .otherwise("PROCEED")
    )
    d = d.withColumn("seen", outcome)
    acts = F.col("seen").isin("PROCEED", "RECONCILE") | ((F.col("seen") == "AMBIGUOUS") & running)
    leads = first_claimants(d.where(acts).select("key", "arrival", "fingerprint")).drop("lead_fingerprint")
    d = d.join(leads, "key", "left").withColumn("acts", F.coalesce(acts, F.lit(False)))
    d = d.withColumn("outcome", F.when(F.col("acts") & (F.col("arrival") != F.col("lead_arrival")), "BUSY").otherwise(F.col("seen")))
    does = F.col("acts") & (F.col("outcome") != "BUSY")
    leased = does & F.col("outcome").isin("PROCEED", "RECONCILE")
    new = F.when(does & (F.col("outcome") == "AMBIGUOUS"), S.AMBIGUOUS).when(does & (F.col("outcome") == "PROCEED") & ~F.coalesce(running, F.lit(False)), S.CLAIMED)
    return d.select(
        *requests.columns, "outcome", new.alias("new_state"), F.when(does, F.coalesce(F.col("row_fencing_token"), F.lit(0)) + 1).alias("new_token"), F.when(leased, F.lit(now + lease_seconds)).alias("new_lease_expires"),
        F.when(F.col("outcome") == "REPLAY", F.col("row_result")).alias("result"), F.when(F.col("outcome") == "REPLAY", F.col("row_result_ref")).alias("result_ref"),
        F.when(F.col("outcome").isin("REPLAY", "DIVERGENT") | ((F.col("outcome") == "AMBIGUOUS") & (state == S.AMBIGUOUS)), F.col("row_fingerprint")).alias("stored_fingerprint"),
    )


def unseen(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requests whose key the ledger has never seen."""
    return requests.join(ledger.select("key"), "key", "left_anti")


def settled(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requests whose effect has already succeeded."""
    return requests.join(ledger.where(F.col("state") == S.SUCCEEDED).select("key"), "key", "left_semi")
