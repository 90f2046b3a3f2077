"""Canonical bytes of values: equal logical values have equal bytes, and different scalars never share them.

A tag byte, then for scalars and containers an 8-byte big-endian length or count, then the content. Sequences of any type
are one kind, and so are sets and mappings. Unknown types are refused.

`canonical` builds a Column from a type, in the JVM. It covers null, boolean, integers, strings, binaries, timestamps, arrays, maps and structs (as mappings);
floating and decimal numbers, and strings that may not be in normal form C, take `canonical_udf`, which runs `encode` over Arrow batches.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Iterator, Mapping, Sequence, Set
from datetime import datetime, timezone
from decimal import Decimal
from functools import reduce, singledispatch

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onceflow.errors import CanonicalizationError


def _sized(tag: bytes, content: bytes, n: int | None = None) -> bytes:
    return tag + (len(content) if n is None else n).to_bytes(8, "big") + content


@singledispatch
def encode(value: object) -> bytes:
    """The canonical bytes of a Python value."""
    for kind, rule in ((Mapping, _mapping), (Set, _set), (Sequence, _sequence)):
        if isinstance(value, kind):
            return rule(value)
    raise CanonicalizationError(f"no canonical form for {type(value).__name__}")


def _mapping(value: Mapping) -> bytes:
    pairs = sorted(((encode(k), v) for k, v in value.items()), key=lambda p: p[0])
    return _sized(b"M", b"".join(k + encode(v) for k, v in pairs), len(pairs))


def _set(value: Set) -> bytes:
    parts = sorted(map(encode, value))
    return _sized(b"S", b"".join(len(p).to_bytes(8, "big") + p for p in parts), len(parts))


def _sequence(value: Sequence) -> bytes:
    return _sized(b"L", b"".join(map(encode, value)), len(value))


@encode.register
def _(value: None) -> bytes:
    return b"N"


@encode.register
def _(value: bool) -> bytes:
    return b"T" if value else b"F"


@encode.register
def _(value: int) -> bytes:
    return _sized(b"i", b"%d" % value)


@encode.register
def _(value: float) -> bytes:
    if math.isfinite(value):
        return _sized(b"f", repr(value or 0.0).encode())
    return _sized(b"f", b"NaN" if math.isnan(value) else b"Infinity" if value > 0 else b"-Infinity")


@encode.register
def _(value: Decimal) -> bytes:
    if value.is_finite():
        return _sized(b"d", str(value.normalize()).encode())
    return _sized(b"d", b"NaN" if value.is_nan() else b"Infinity" if value > 0 else b"-Infinity")


@encode.register
def _(value: str) -> bytes:
    return _sized(b"s", unicodedata.normalize("NFC", value).encode())


@encode.register(bytes)
@encode.register(bytearray)
def _(value: bytes) -> bytes:
    return _sized(b"x", bytes(value))


@encode.register
def _(value: datetime) -> bytes:
    if value.tzinfo is None:
        raise CanonicalizationError("a time without a zone is ambiguous")
    return _sized(b"t", value.astimezone(timezone.utc).isoformat().encode())


# -- as Columns


def binary(text: str | bytes) -> Column:
    raw = text.encode() if isinstance(text, str) else text
    return F.unhex(F.lit(raw.hex()))


def count(n: Column) -> Column:
    """8 bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def framed(content: Column) -> Column:
    return F.concat(count(F.octet_length(content)), content)


def _scalar(tag: str, text: Column) -> Column:
    return F.concat(binary(tag), framed(text.cast("binary")))


def _utc(ts: Column) -> Column:
    """ISO form of an instant in UTC; like Python's, without a fraction where microseconds are 0."""
    wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    pattern = "yyyy-MM-dd'T'HH:mm:ss"
    whole = F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0
    return F.concat(F.when(whole, F.date_format(wall, pattern)).otherwise(F.date_format(wall, pattern + ".SSSSSS")), F.lit("+00:00"))


def native(kind: T.DataType) -> bool:
    """Whether `canonical` covers a type."""
    if isinstance(kind, T.ArrayType):
        return native(kind.elementType)
    if isinstance(kind, T.MapType):
        return native(kind.keyType) and native(kind.valueType)
    if isinstance(kind, T.StructType):
        return all(native(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.NullType, T.BooleanType, T.IntegralType, T.StringType, T.BinaryType, T.TimestampType))


def canonical(value: Column, kind: T.DataType, *, as_set: bool = False) -> Column:
    """Canonical bytes in the JVM. Strings must be in normal form C. as_set: arrays are sets."""
    if isinstance(kind, T.TimestampNTZType):
        raise CanonicalizationError("a time without a zone is ambiguous")
    if not native(kind):
        raise CanonicalizationError(f"{kind.simpleString()} needs canonical_udf")
    if isinstance(kind, T.NullType):
        return binary("N")
    if isinstance(kind, T.BooleanType):
        out = F.when(value, binary("T")).otherwise(binary("F"))
    elif isinstance(kind, T.IntegralType):
        out = _scalar("i", value.cast("string"))
    elif isinstance(kind, T.StringType):
        out = _scalar("s", value)
    elif isinstance(kind, T.BinaryType):
        out = _scalar("x", value)
    elif isinstance(kind, T.TimestampType):
        out = _scalar("t", _utc(value))
    elif isinstance(kind, T.ArrayType):
        parts = F.transform(value, lambda x: canonical(x, kind.elementType))
        if as_set:
            parts = F.transform(F.array_sort(F.array_distinct(parts)), framed)
        out = F.concat(binary("S" if as_set else "L"), count(F.size(parts)), _joined(parts))
    elif isinstance(kind, T.MapType):
        pairs = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(canonical(e["key"], kind.keyType).alias("k"), canonical(e["value"], kind.valueType).alias("v"))))
        out = F.concat(binary("M"), count(F.size(pairs)), _joined(F.transform(pairs, lambda p: F.concat(p["k"], p["v"]))))
    else:
        out = mapping([(f.name, canonical(value.getField(f.name), f.dataType)) for f in kind.fields])
    return F.when(value.isNull(), binary("N")).otherwise(out)


def _joined(parts: Column) -> Column:
    return F.aggregate(parts, binary(""), lambda a, b: F.concat(a, b))


def mapping(fields: list[tuple[str, Column]]) -> Column:
    """A mapping from fixed names to encoded values; the names' order is settled here, not per row."""
    ordered = sorted(fields, key=lambda f: encode(f[0]))
    parts = [F.concat(binary(encode(name)), value) for name, value in ordered]
    return reduce(F.concat, parts, F.concat(binary("M"), count(F.lit(len(parts)))))


def canonical_udf(value: Column) -> Column:
    """Canonical bytes by `encode`, over Arrow batches: any type that Arrow carries."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([encode(v) for v in b.to_pylist()], pa.binary())

    return run(value)


def lossless(value: Column) -> Column:
    """Whether JSON text survives a parse and a print."""
    return F.to_json(F.parse_json(value)).eqNullSafe(value)


def json_round_trip(value: object) -> tuple[str | None, str | None]:
    """(result, result_ref): JSON text, or a marker where the value has none."""
    try:
        return json.dumps(value), None
    except (TypeError, ValueError):
        return None, f"unserializable:{type(value).__name__}"
