import hashlib
import hmac
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onceflow.errors import CanonicalizationError, NormalizerError
from onceflow.functions import canonical as C
from onceflow.functions import identity as I
from onceflow.functions import normalizers as N

CASES = {
    "trim": [("  hello  ", "hello"), ("\t\n  hi \n", "hi"), ("", ""), ("a b", "a b"), ("   ", ""), (" x ", "x"), ("\x1cx\x85", "x")],
    "nfc-trim": [("  café  ", "café"), ("café", "café")],
    "email": [(" Alice@Example.COM ", "alice@example.com"), ("ÉA@x.org", "éa@x.org")],
    "phone-e164": [("+1 (415) 555-0100", "+14155550100"), ("415-555-0100", "4155550100"), (" +44 20 7946 0958 ", "+442079460958"), ("1+2", "12")],
    "url-canonical": [
        ("HTTP://Example.COM:80/Path?q=1#frag", "http://example.com/Path?q=1"), ("https://Host.com:443/", "https://host.com/"), ("https://host.com:8443/x", "https://host.com:8443/x"),
        ("http://Example.com", "http://example.com"), ("http://User:Pw@H.com:0080/", "http://User:Pw@h.com/"), ("http://[2001:DB8::1]:443/a", "http://[2001:db8::1]:443/a"), ("mailto:A@b.c", "mailto:A@b.c"), ("/a/b?x#y", "/a/b?x"),
    ],
    "money": [("1.5", "1.5"), ("1.50", "1.5"), ("$1,500.00", "1500"), ("100", "100"), ("-42.10", "-42.1"), ("0.00", "0"), ("-0.00", "0"), ("007", "7"), (".5", "0.5"), ("5.", "5")],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_normalizers_agree_and_are_idempotent(spark, name):
    cases = CASES[name]
    assert [N.normalize(name, a) for a, _ in cases] == [b for _, b in cases]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, s string")
    once = N.COLUMNS[name](F.col("s"))
    got = df.select("i", once.alias("a"), N.COLUMNS[name](once).alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [b for _, b in cases]
    assert [r.b for r in got] == [b for _, b in cases]


def test_normalizers_refuse(spark):
    for bad in ("", "-", ".", "-.", "1-2", "1.2.3"):
        with pytest.raises(NormalizerError):
            N.normalize("money", bad)
    with pytest.raises(NormalizerError):
        N.normalize("url-canonical", "http://h:x/")
    with pytest.raises(NormalizerError):
        N.normalize("upper", "x")
    df = spark.createDataFrame([("1-2", "http://h:70000/")], "m string, u string")
    assert tuple(df.select(N.money(F.col("m")), N.url_canonical(F.col("u"))).first()) == (None, None)


def test_encode_tells_values_apart_and_containers_alike():
    values = [None, True, False, 0, 1, "1", b"1", 1.0, Decimal(1), [], {}, frozenset(), datetime(2024, 1, 1, tzinfo=timezone.utc), float("nan"), float("inf"), "a", ["a"], {"a": 1}, {"a": None}]
    assert len({C.encode(v) for v in values}) == len(values)
    assert C.encode((1, 2)) == C.encode([1, 2])
    assert C.encode({1, 2}) == C.encode(frozenset([2, 1]))
    assert C.encode({"a": 1, "b": 2}) == C.encode({"b": 2, "a": 1})
    assert C.encode(-0.0) == C.encode(0.0) and C.encode("é") == C.encode("é")
    assert C.encode(Decimal("1.00")) == C.encode(Decimal("1")) and C.encode(Decimal(100))[9:] == b"1E+2"
    east = timezone(timedelta(hours=5))
    assert C.encode(datetime(2024, 1, 1, 5, tzinfo=east)) == C.encode(datetime(2024, 1, 1, tzinfo=timezone.utc))
    for bad in (datetime(2024, 1, 1), object()):
        with pytest.raises(CanonicalizationError):
            C.encode(bad)


def test_native_canonical_equals_python(spark):
    schema = T.StructType().add("b", T.BooleanType()).add("i", T.LongType()).add("s", T.StringType()).add("x", T.BinaryType()).add("t", T.TimestampType()).add("a", T.ArrayType(T.StringType())).add("m", T.MapType(T.StringType(), T.IntegerType())).add("r", T.StructType().add("z", T.IntegerType()).add("a", T.StringType()))
    t = datetime(2024, 3, 1, 12, 0, 0, tzinfo=timezone.utc)
    rows = [(True, -5, "café", b"\x00\xff", t, ["b", None, "a"], {"b": 1, "a": None}, (1, "q")), (None,) * 8, (False, 0, "", b"", t + timedelta(microseconds=7), [], {}, (None, None))]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], T.StructType([T.StructField("n", T.IntegerType()), *schema.fields]))
    got = df.orderBy("n").select(*[C.canonical(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields]).collect()
    for row, out in zip(rows, got, strict=True):
        for value, f, raw in zip(row, schema.fields, out, strict=True):
            value = dict(zip(("z", "a"), value, strict=True)) if f.name == "r" and value is not None else value
            assert bytes(raw) == C.encode(value), f.name
    sets = spark.createDataFrame([(["b", "a", "b"],)], "a array<string>").select(C.canonical(F.col("a"), T.ArrayType(T.StringType()), as_set=True)).first()[0]
    assert bytes(sets) == C.encode({"a", "b"})
    floats = spark.createDataFrame([(1e16,), (1e-5,), (-0.0,), (float("nan"),), (None,)], "d double").select("d", C.canonical_udf(F.col("d")).alias("c")).collect()
    assert all(bytes(r.c) == C.encode(r.d) for r in floats)
    with pytest.raises(CanonicalizationError):
        C.canonical(F.col("t"), T.TimestampNTZType())


def test_keys_and_fingerprints_equal_python(spark):
    df = spark.createDataFrame([("global", "k1", "t"), ("", "é", "tool")], "scope string, k string, tool string")
    site = F.concat(C.binary(I.RUNG_KEY), F.col("k").cast("binary"))
    for r in df.select("*", I.positional_key(F.col("scope"), site, F.col("tool"), 2).alias("key")).collect():
        assert r.key == I.python_key(r.scope, I.RUNG_KEY + r.k.encode(), r.tool, 2)
    message = C.mapping([("to", C.canonical(F.col("k"), T.StringType()))])
    for secret in (b"s", b"x" * 100):
        for r in df.select("k", I.fingerprint(message, secret).alias("a"), I.fingerprint_native(message, secret).alias("b")).collect():
            assert r.a == r.b == I.python_fingerprint({"to": r.k}, secret) == hmac.new(secret, C.encode({"to": r.k}), hashlib.sha256).hexdigest()
    assert I.secret_id(b"a") != I.secret_id(b"b") and len(I.secret_id(b"a")) == 16


def test_ladder(spark):
    rows = [(" k ", None, None, None, None), (None, "s", "run", None, None), (None, "s", None, None, None), ("k", "s", "run", None, None), (None, None, None, None, None), ("  ", None, None, None, None), (None, "s", "run", "rs", b"\x09"), ("k", None, "run", "rs", b"\x09")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, s string, sc string, rs string, site binary")
    got = df.select("i", I.coordinate(key=F.col("k"), step=F.col("s"), scope=F.col("sc"), runtime_scope=F.col("rs"), runtime_site=F.col("site")).alias("c")).orderBy("i").collect()
    assert [(r.c.scope, r.c.call_site and bytes(r.c.call_site), r.c.refused) for r in got] == [
        ("global", b"\x01k", None), ("run", b"\x03s", None), (None, None, "STEP_WITHOUT_SCOPE"), (None, None, "KEY_AND_STEP"), (None, None, "NO_COORDINATE"), (None, None, "BLANK"), ("rs", b"\x02\x09", None), ("run", b"\x01k", None)
    ]


def test_rotation_picks_the_signing_secret(spark):
    df = spark.createDataFrame([("a", "x", "y"), (None, "x", "y"), ("gone", "x", "y")], "sid string, f1 string, f2 string")
    got = df.select(I.signed_by({"a": F.col("f1"), "b": F.col("f2")}, F.col("sid"), "b").alias("v")).collect()
    assert [r.v for r in got] == ["x", "y", None]
