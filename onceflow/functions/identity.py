"""Who a request is: coordinate, key, fingerprint.

The key hashes where an effect stands (scope, call site, tool, occurrence, plan epoch), never its arguments. The fingerprint is an HMAC over the
canonical identity arguments: evidence that a retry means the same action.

Key derivation and matching run in the JVM. `fingerprint` computes the HMAC in an Arrow UDF by default, since pads made from a secret would
show in plans and event logs; `fingerprint_native` is for tests and for secrets that may be seen.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from onceflow.functions.canonical import binary, encode, framed

KEY_SCHEME = b"onceflow-key-v1"
SECRET_TAG = b"onceflow-secret-id-v1\x00"
GLOBAL_SCOPE = "global"
#: One byte before a call site tells which rung of the ladder named it.
RUNG_KEY, RUNG_RUNTIME, RUNG_STEP = b"\x01", b"\x02", b"\x03"

_SPACE = r"[\p{Z}\s\x1c-\x1f\x85]+"


def strip(s: Column) -> Column:
    """Without white space at the ends, as Unicode has it."""
    return F.regexp_replace(s, f"^{_SPACE}|{_SPACE}$", "")


def positional_key(scope: Column, call_site: Column, tool: Column, occurrence: Column | int = 1, plan_epoch: Column | int = 0) -> Column:
    """SHA-256 over the framed parts, as hex."""
    number = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("string").cast("binary")
    parts = [binary(KEY_SCHEME), scope.cast("binary"), call_site, tool.cast("binary"), number(occurrence), number(plan_epoch)]
    return F.sha2(F.concat(*map(framed, parts)), 256)


def python_key(scope: str, call_site: bytes, tool: str, occurrence: int = 1, plan_epoch: int = 0) -> str:
    parts = (KEY_SCHEME, scope.encode(), call_site, tool.encode(), str(occurrence).encode(), str(plan_epoch).encode())
    return hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p for p in parts)).hexdigest()


def coordinate(*, key: Column | None = None, step: Column | None = None, scope: Column | None = None, runtime_scope: Column | None = None, runtime_site: Column | None = None, occurrence: Column | int = 1) -> Column:
    """struct<scope, call_site, occurrence, refused>: the first rung that names the effect.

    A business key, then the runtime's coordinate, then a step within a scope. refused says why there is none: a blank name, a key beside a
    step, a step without a scope, or nothing at all. An explicit occurrence counts on every rung."""
    none = F.lit(None).cast("string")
    k, s, sc = (none if c is None else strip(c) for c in (key, step, scope))
    r_scope, r_site = none if runtime_scope is None else runtime_scope, F.lit(None).cast("binary") if runtime_site is None else runtime_site
    refused = (
        F.when((k == "") | (s == "") | (sc == ""), "BLANK")
        .when(k.isNotNull() & s.isNotNull(), "KEY_AND_STEP")
        .when(k.isNull() & r_site.isNull() & s.isNotNull() & sc.isNull(), "STEP_WITHOUT_SCOPE")
        .when(k.isNull() & r_site.isNull() & s.isNull(), "NO_COORDINATE")
    )
    at = F.when(k.isNotNull(), F.struct(F.coalesce(sc, F.lit(GLOBAL_SCOPE)).alias("scope"), F.concat(binary(RUNG_KEY), k.cast("binary")).alias("call_site")))
    at = at.when(r_site.isNotNull(), F.struct(r_scope.alias("scope"), F.concat(binary(RUNG_RUNTIME), r_site).alias("call_site")))
    at = at.otherwise(F.struct(sc.alias("scope"), F.concat(binary(RUNG_STEP), s.cast("binary")).alias("call_site")))
    ok = refused.isNull()
    return F.struct(F.when(ok, at["scope"]).alias("scope"), F.when(ok, at["call_site"]).alias("call_site"), (F.lit(occurrence) if isinstance(occurrence, int) else occurrence).cast("int").alias("occurrence"), refused.alias("refused"))


def secret_id(secret: bytes) -> str:
    """16 hex digits that tell secrets apart without giving them away."""
    return hashlib.sha256(SECRET_TAG + secret).hexdigest()[:16]


def fingerprint(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of canonical bytes, as hex; the secret stays out of the plan."""

    @F.arrow_udf("string")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if m is None else hmac.new(secret, m, hashlib.sha256).hexdigest() for m in b.to_pylist()], pa.string())

    return sign(message)


def fingerprint_native(message: Column, secret: bytes) -> Column:
    """The same in the JVM. The pads, and so the secret, are literals of the plan."""
    block = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: binary(bytes(b ^ x for b in block))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


def python_fingerprint(identity: Mapping[str, object], secret: bytes) -> str:
    return hmac.new(secret, encode(dict(identity)), hashlib.sha256).hexdigest()


def signed_by(by_secret: Mapping[str, Column], stored_secret: Column, primary: str) -> Column:
    """The incoming fingerprint under the secret that signed the stored one: by_secret has one column a secret of the
    keyring, by id; a null id means the primary. Null where the secret has left the keyring."""
    pairs = [x for name, value in by_secret.items() for x in (F.lit(name), value)]
    return F.create_map(*pairs)[F.coalesce(stored_secret, F.lit(primary))]
