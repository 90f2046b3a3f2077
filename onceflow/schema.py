"""Tables and enumerations of the ledger."""

from __future__ import annotations

from pyspark.sql import types as T

KEY_VERSION = "v1"
FINGERPRINT_VERSION = "hmac-sha256-canon-v1"
SCHEMA_VERSION = 1

INTENDED, CLAIMED, EXECUTING, SUCCEEDED, FAILED, AMBIGUOUS = STATES = ("INTENDED", "CLAIMED", "EXECUTING", "SUCCEEDED", "FAILED", "AMBIGUOUS")
TERMINAL = (SUCCEEDED, FAILED, AMBIGUOUS)
EVENTS = ("settled", "replayed", "ambiguous", "failed")
LEVELS = ("L0", "L1", "L2", "L2R")

_S, _L, _B, _D, _T = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


EFFECTS = _struct(
    ("key", _S, False), ("scope", _S, False), ("tool", _S, False), ("fingerprint", _S, False), ("state", _S, False),
    ("provider_dedup", _B, False), ("provider_ttl_s", _D, True), ("reconcilable", _B, False), ("result", _S, True), ("result_ref", _S, True),
    ("error", _S, True), ("created_at", _T, False), ("settled_at", _T, True), ("fencing_token", _L, False), ("lease_owner", _S, True),
    ("lease_expires", _D, True), ("resolved_by", _S, True), ("key_version", _S, True), ("fingerprint_version", _S, True), ("secret_id", _S, True),
)

#: The audit projection; result_ref is ours, so that an unserializable result is not mistaken for none.
AUDIT = (
    "key", "scope", "tool", "state", "fingerprint", "result", "error", "created_at", "settled_at", "resolved_by",
    "provider_dedup", "reconcilable", "key_version", "fingerprint_version", "secret_id", "result_ref",
)

#: A request, after identity: one call that wants an effect.
REQUESTS = _struct(
    ("key", _S, False), ("scope", _S, False), ("tool", _S, False), ("fingerprint", _S, False), ("arrival", _L, False),
    ("provider_dedup", _B, False), ("provider_ttl_s", _D, True), ("reconcilable", _B, False), ("secret_id", _S, True),
)

PROVIDER_READS = _struct(("key", _S, False), ("verdict", _S, True), ("result", _S, True))
FINDINGS = _struct(("path", _S, False), ("line", T.IntegerType(), False), ("col", T.IntegerType(), False), ("code", _S, False), ("message", _S, False))


def evolve(df):
    """A ledger written before a nullable column existed reads with nulls there."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EFFECTS.fields])
