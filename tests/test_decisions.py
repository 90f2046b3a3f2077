"""One row per line of the decision tables."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from onceflow import schema as S
from onceflow.operators import claims, recovery
from onceflow.operators import transitions as tr

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def effects(spark, rows):
    base = {"scope": "s", "tool": "t", "fingerprint": "f", "state": S.INTENDED, "provider_dedup": False, "reconcilable": False, "created_at": T0, "fencing_token": 1, "key_version": "v1", "fingerprint_version": S.FINGERPRINT_VERSION}
    full = [base | r for r in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in S.EFFECTS.fields) for r in full], S.EFFECTS)


def asks(spark, rows):
    return spark.createDataFrame([(r["key"], r.get("fp", "f"), r.get("at", i), r.get("dedup", False), r.get("asks", False), r.get("owner", "me")) for i, r in enumerate(rows)], "key string, fingerprint string, arrival long, provider_dedup boolean, reconcilable boolean, owner string")


@pytest.mark.parametrize(
    ("row", "fp", "want"),
    [
        (None, "f", "PROCEED"), ({"state": S.SUCCEEDED, "key_version": "v0"}, "f", "SCHEME_MISMATCH"), ({"state": S.SUCCEEDED, "key_version": None}, "f", "REPLAY"), ({"state": S.SUCCEEDED, "result": "1"}, "f", "REPLAY"),
        ({"state": S.SUCCEEDED}, "g", "DIVERGENT"), ({"state": S.AMBIGUOUS}, "f", "AMBIGUOUS"), ({"state": S.AMBIGUOUS}, "g", "DIVERGENT"), ({"state": S.EXECUTING}, "f", "IN_FLIGHT"), ({"state": S.CLAIMED}, "g", "IN_FLIGHT"),
        ({"state": S.INTENDED}, "g", "DIVERGENT"), ({"state": S.FAILED}, "g", "DIVERGENT"), ({"state": S.INTENDED}, "f", "PROCEED"), ({"state": S.FAILED}, "f", "PROCEED"),
    ],
)
def test_claim_table(spark, row, fp, want):
    ledger = effects(spark, [{"key": "k"} | row] if row is not None else [])
    got = claims.decide_claim(asks(spark, [{"key": "k", "fp": fp}]), ledger).first()
    assert got.outcome == want
    assert got.result == (row or {}).get("result")


def test_claims_of_one_batch(spark):
    d = claims.decide_claim(asks(spark, [{"key": "k"}, {"key": "k"}, {"key": "k", "fp": "g"}, {"key": "x", "fp": "g"}, {"key": "x"}, {"key": "x"}]), effects(spark, [{"key": "x", "state": S.FAILED}]))
    assert [(r.outcome, r.follows) for r in d.orderBy("arrival").collect()] == [("PROCEED", None), ("REPLAY", 0), ("DIVERGENT", 0), ("DIVERGENT", None), ("PROCEED", None), ("REPLAY", 4)]
    out = spark.createDataFrame([("k", "clean_failure"), ("x", "unknown")], "key string, outcome string")
    assert [r.outcome for r in claims.follow_up(d, out).orderBy("arrival").collect()] == ["PROCEED", None, None, "DIVERGENT", "PROCEED", "IN_FLIGHT"]


LEASED = [
    (None, {}, ("PROCEED", S.CLAIMED, 1)),
    ({"state": S.CLAIMED, "key_version": "v0"}, {}, ("SCHEME_MISMATCH", None, None)),
    ({"state": S.SUCCEEDED}, {}, ("REPLAY", None, None)),
    ({"state": S.SUCCEEDED}, {"fp": "g"}, ("DIVERGENT", None, None)),
    ({"state": S.AMBIGUOUS}, {}, ("AMBIGUOUS", None, None)),
    ({"state": S.EXECUTING, "lease_owner": "a", "lease_expires": 101.0}, {}, ("BUSY", None, None)),
    ({"state": S.CLAIMED, "lease_owner": "a", "lease_expires": 100.0}, {}, ("PROCEED", S.CLAIMED, 2)),  # a lease that ends now is over
    ({"state": S.CLAIMED, "lease_owner": "me", "lease_expires": 101.0}, {}, ("PROCEED", S.CLAIMED, 2)),  # one's own does not stop
    ({"state": S.EXECUTING}, {"fp": "g"}, ("DIVERGENT", None, None)),
    ({"state": S.EXECUTING}, {}, ("AMBIGUOUS", S.AMBIGUOUS, 2)),
    ({"state": S.EXECUTING, "provider_ttl_s": 50.0, "created_at": datetime(1970, 1, 1, tzinfo=timezone.utc)}, {"dedup": True}, ("AMBIGUOUS", S.AMBIGUOUS, 2)),
    ({"state": S.EXECUTING, "provider_ttl_s": 100.0, "created_at": datetime(1970, 1, 1, tzinfo=timezone.utc)}, {"dedup": True}, ("PROCEED", None, 2)),  # at the limit is within
    ({"state": S.EXECUTING}, {"asks": True}, ("RECONCILE", None, 2)),
    ({"state": S.EXECUTING}, {"asks": True, "dedup": True}, ("RECONCILE", None, 2)),
    ({"state": S.EXECUTING}, {"dedup": True}, ("PROCEED", None, 2)),
    ({"state": S.FAILED}, {}, ("PROCEED", S.CLAIMED, 2)),
    ({"state": S.INTENDED}, {}, ("PROCEED", S.CLAIMED, 2)),
]


def test_leased_table(spark):
    ledger = effects(spark, [{"key": f"k{i}"} | row for i, (row, _, _) in enumerate(LEASED) if row is not None])
    requests = asks(spark, [{"key": f"k{i}"} | ask for i, (_, ask, _) in enumerate(LEASED)])
    got = {r.key: (r.outcome, r.new_state, r.new_token) for r in claims.decide_leased(requests, ledger, 100.0, 30.0).collect()}
    assert got == {f"k{i}": want for i, (_, _, want) in enumerate(LEASED)}


def test_leased_batch_lets_one_act(spark):
    got = claims.decide_leased(asks(spark, [{"key": "k"}, {"key": "k", "owner": "b"}]), effects(spark, []), 100.0, 30.0).orderBy("arrival").collect()
    assert [(r.outcome, r.new_token, r.new_lease_expires) for r in got] == [("PROCEED", 1, 130.0), ("BUSY", None, None)]


def test_recovery_table(spark):
    rows = [
        ({"state": S.CLAIMED}, None, S.INTENDED), ({"state": S.EXECUTING, "reconcilable": True, "tool": "asks"}, "SETTLED", S.SUCCEEDED), ({"state": S.EXECUTING, "reconcilable": True, "tool": "retries"}, "ABSENT", S.INTENDED),
        ({"state": S.EXECUTING, "reconcilable": True, "tool": "asks"}, "ABSENT", S.AMBIGUOUS), ({"state": S.EXECUTING, "reconcilable": True, "tool": "asks"}, "UNKNOWN", S.AMBIGUOUS), ({"state": S.EXECUTING, "reconcilable": True, "tool": "undeclared"}, "SETTLED", S.AMBIGUOUS),
        ({"state": S.EXECUTING, "reconcilable": True, "tool": "asks"}, "RAISED", S.EXECUTING), ({"state": S.EXECUTING, "provider_dedup": True, "provider_ttl_s": 3600.0}, None, S.INTENDED), ({"state": S.EXECUTING, "provider_dedup": True, "provider_ttl_s": 3599.0}, None, S.AMBIGUOUS),
        ({"state": S.EXECUTING, "provider_dedup": True}, None, S.INTENDED), ({"state": S.EXECUTING}, None, S.AMBIGUOUS), *[({"state": s}, None, s) for s in (S.INTENDED, S.SUCCEEDED, S.FAILED, S.AMBIGUOUS)],
    ]
    ledger = effects(spark, [{"key": f"k{i}"} | r for i, (r, _, _) in enumerate(rows)])
    reads = spark.createDataFrame([(f"k{i}", v, "{}") for i, (_, v, _) in enumerate(rows) if v], S.PROVIDER_READS)
    tools = spark.createDataFrame([("asks", "surface", True), ("retries", "retry", True)], "tool string, on_absent string, has_reconcile boolean")
    now = F.lit(T0 + timedelta(hours=1)).cast("timestamp")
    got = {r.key: r.to_state for r in recovery.recover(ledger, tools, reads, now).collect()}
    assert got == {f"k{i}": want for i, (_, _, want) in enumerate(rows)}
    taken = spark.createDataFrame([("a", "surface"), ("b", "retry"), ("c", "retry"), ("d", "retry")], "key string, on_absent string")
    reads = spark.createDataFrame([("a", "ABSENT", None), ("b", "ABSENT", None), ("c", "SETTLED", None)], S.PROVIDER_READS)
    assert {r.key: r.action for r in recovery.reconcile_on_takeover(taken, reads).collect()} == {"a": "AMBIGUATE", "b": "DISPATCH", "c": "ADOPT", "d": "AMBIGUATE"}


def test_writes_are_fenced_and_written_once(spark):
    ledger = effects(spark, [{"key": "a", "state": S.EXECUTING, "lease_owner": "o", "lease_expires": 5.0}, {"key": "b", "state": S.EXECUTING, "fencing_token": 2}, {"key": "c", "state": S.SUCCEEDED}])
    w = spark.createDataFrame([(k, 1, S.FAILED, None, None, "no") for k in "abcz"], "key string, token int, state string, result string, result_ref string, error string")
    after, hits = tr.fence(ledger, w, T0)
    assert {r.key: r.applied for r in hits.collect()} == {"a": True, "b": False, "c": False, "z": False}
    a = after.where("key = 'a'").first()
    assert (a.state, a.error, a.lease_owner, a.settled_at is not None) == (S.FAILED, "no", None, True)
    e = spark.createDataFrame([(k, f, "1", None, "x") for k, f in (("a", False), ("b", True), ("c", True))], "key string, failed boolean, result string, result_ref string, error string")
    healed, hits = tr.late_evidence(after, e, T0)
    assert {r.key: r.applied for r in hits.collect()} == {"a": True, "b": False, "c": False}
    a = healed.where("key = 'a'").first()
    assert (a.state, a.result, a.error, a.resolved_by) == (S.SUCCEEDED, "1", None, "late_evidence")
    done, hits = tr.record_success(healed, spark.createDataFrame([("b", "2", None), ("c", "9", None)], "key string, result string, result_ref string"), T0)
    assert {r.key: r.applied for r in hits.collect()} == {"b": True, "c": False}
    assert done.count() == 3


def test_reduce_ignores_illegal_edges(spark):
    log = [("a", 1, S.CLAIMED, None), ("a", 2, S.SUCCEEDED, None), ("a", 3, S.FAILED, None), ("b", 1, S.AMBIGUOUS, None), ("b", 2, S.SUCCEEDED, None), ("b", 3, S.SUCCEEDED, "late_evidence"), ("c", 2, S.CLAIMED, None), ("c", 1, S.FAILED, None)]
    got = tr.reduce_transitions(spark.createDataFrame(log, "key string, seq long, to_state string, resolved_by string"))
    assert {r.key: (r.state, r.seq) for r in got.collect()} == {"a": (S.SUCCEEDED, 2), "b": (S.SUCCEEDED, 3), "c": (S.CLAIMED, 2)}
