"""What a batch of leased claims writes to the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onceflow import schema as S


def take(ledger: DataFrame, decided: DataFrame, now: Column) -> DataFrame:
    """The rows that the decisions of `claims.decide_leased` change. decided: with scope, tool, provider_ttl_s, secret_id and owner of the requests.

    A new effect, or one of which nothing ran, becomes CLAIMED with the claimant's evidence. One that may have run keeps its state and its evidence: only token and
    lease pass on. One that may have run and can't be asked about becomes AMBIGUOUS, under a token that its old owner does not have."""
    none = lambda kind: F.lit(None).cast(kind)
    acting = decided.where(F.col("new_token").isNotNull())
    new = acting.join(ledger.select("key"), "key", "left_anti").select(
        "key", "scope", "tool", "fingerprint", F.lit(S.CLAIMED).alias("state"), F.coalesce("provider_dedup", F.lit(False)).alias("provider_dedup"), "provider_ttl_s",
        F.coalesce("reconcilable", F.lit(False)).alias("reconcilable"), none("string").alias("result"), none("string").alias("result_ref"), none("string").alias("error"), now.alias("created_at"),
        none("timestamp").alias("settled_at"), F.col("new_token").cast("long").alias("fencing_token"), F.col("owner").alias("lease_owner"), F.col("new_lease_expires").alias("lease_expires"),
        none("string").alias("resolved_by"), F.lit(S.KEY_VERSION).alias("key_version"), F.lit(S.FINGERPRINT_VERSION).alias("fingerprint_version"), "secret_id",
    )
    w = acting.select("key", *[F.col(c).alias(f"w_{c}") for c in ("fingerprint", "secret_id", "owner", "new_state", "new_token", "new_lease_expires")])
    ends, mine = F.coalesce(F.col("w_new_state") == S.AMBIGUOUS, F.lit(False)), F.coalesce(F.col("w_new_state") == S.CLAIMED, F.lit(False))
    own = lambda then, c: F.when(mine, then).otherwise(F.col(c))
    old = ledger.join(w, "key").withColumns({
        "state": F.coalesce("w_new_state", "state"), "fingerprint": own(F.col("w_fingerprint"), "fingerprint"), "secret_id": own(F.col("w_secret_id"), "secret_id"),
        "key_version": own(F.lit(S.KEY_VERSION), "key_version"), "fingerprint_version": own(F.lit(S.FINGERPRINT_VERSION), "fingerprint_version"), "fencing_token": F.col("w_new_token").cast("long"),
        "lease_owner": F.when(ends, F.col("lease_owner")).otherwise(F.col("w_owner")), "lease_expires": F.when(ends, F.col("lease_expires")).otherwise(F.col("w_new_lease_expires")),
        "settled_at": F.when(ends, now).otherwise(F.col("settled_at")),
    }).select(*S.EFFECTS.names)
    return old.unionByName(new.select(*S.EFFECTS.names))
