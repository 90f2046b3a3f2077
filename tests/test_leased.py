"""Several writers on one ledger, heartbeats, hooks, adapters, defaults, crash seams, horizons."""

import json
import os
import subprocess
import sys
import time
from functools import reduce

import pytest
from pyspark.sql import functions as F

import onceflow
from onceflow import schema as S
from onceflow.errors import LedgerError
from onceflow.operators import claims
from onceflow.operators import transitions as tr
from onceflow.plans.declarations import Declaration, Registry
from onceflow.plans.engine import Engine, bind, call, dispatcher, effect
from onceflow.plans.leased import Heartbeat, LeasedEngine
from onceflow.plans.notices import Hooks, Metrics
from onceflow.plans.protocols import Coordinate, RuntimeAdapter, Store
from onceflow.streaming import horizons

from .test_engine import World, calls, outcomes

L0, L2 = Declaration("mail"), Declaration("pay", provider_key_param="idem", clean_failures=(ValueError,))


class Clock:
    def __init__(self, at):
        self.at = at

    def __call__(self):
        return self.at


def writer(spark, path, owner, clock, *declarations, **kwargs):
    return LeasedEngine(spark, path, Registry(declarations or [L0, L2]), b"s", owner=owner, clock=clock, lease_seconds=30.0, **kwargs)


def ask(engine, spark, tool, rows):
    return engine.identify(calls(spark, rows), tool, arrival=F.col("n"), key=F.col("k"), args=["to"])


def killed(pdf):
    raise SystemError("killed")


def test_two_writers_settle_once(spark, tmp_path):
    clock, world = Clock(100.0), World(tmp_path / "world")
    a, b = (writer(spark, str(tmp_path / "l"), o, clock) for o in "AB")
    rows = [("k", "x", ""), ("k", "x", ""), ("k", "y", ""), (" ", "q", "")]
    assert outcomes(a.settle(ask(a, spark, "mail", rows), dispatcher(world))) == {0: "PROCEED", 1: "REPLAY", 2: "DIVERGENT", 3: "NO_COORDINATE"}
    again = b.settle(ask(b, spark, "mail", rows[:1]), dispatcher(world))
    assert [(r.outcome, r.result) for r in again.collect()] == [("REPLAY", '{"sent": "x"}')] and len(world.lines()) == 1
    row = a.ledger.read().first()
    assert (row.state, row.lease_owner, row.fencing_token) == (S.SUCCEEDED, None, 1)
    with pytest.raises(LedgerError):
        Engine(spark, str(tmp_path / "l"), Registry([]), b"s")


def test_takeover_by_level(spark, tmp_path):
    """A writer dies with its batch out. While its lease lives others wait; after it, what a level allows is done."""
    answers = {"SETTLED": ("SETTLED", {"found": 1}), "ABSENT": ("ABSENT", None), "UNKNOWN": ("UNKNOWN", None)}
    l1 = [Declaration(f"ask-{v.lower()}", reconcile=lambda key, v=v: answers[v], on_absent="retry", provider_read="strong") for v in answers]
    clock, world = Clock(100.0), World(tmp_path / "world")
    a, b = (writer(spark, str(tmp_path / "l"), o, clock, L0, L2, *l1) for o in "AB")
    tools = ["mail", "pay", "ask-settled", "ask-absent", "ask-unknown"]
    batch = lambda e, to: reduce(lambda x, y: x.unionByName(y), [ask(e, spark, t, [("k", to, "")]) for t in tools])
    with pytest.raises(Exception):  # noqa: B017
        a.settle(batch(a, "x"), killed)
    assert {r.state for r in b.ledger.read().collect()} == {S.EXECUTING}
    settle = lambda to: {r.tool: r for r in b.settle(batch(b, to), dispatcher(world), wait_timeout=0).collect()}
    assert {r.outcome for r in settle("x").values()} == {"BUSY"}
    clock.at = 131.0
    got = settle("x")
    assert {t: r.outcome for t, r in got.items()} == {"mail": "AMBIGUOUS", "pay": "PROCEED", "ask-settled": "REPLAY", "ask-absent": "PROCEED", "ask-unknown": "AMBIGUOUS"}
    assert got["ask-settled"].result == '{"found": 1}' and len(world.lines()) == 2
    assert {r.tool: (r.state, r.fencing_token) for r in b.ledger.read().collect()} == {t: (S.AMBIGUOUS if got[t].outcome == "AMBIGUOUS" else S.SUCCEEDED, 2) for t in tools}


def test_late_winner_heals(spark, tmp_path):
    """A writer that lost its lease while its effects were out: its record is refused by its token, and healed with what it knows."""
    clock, world = Clock(100.0), World(tmp_path / "world")
    path = str(tmp_path / "l")
    a, b = writer(spark, path, "A", clock, heartbeat_interval=3600), writer(spark, path, "B", clock)
    requests = ask(a, spark, "mail", [("k", "x", "")]).unionByName(ask(a, spark, "pay", [("k", "x", "")]))
    sent, real = {}, a._send

    def overtaken(leaders, dispatch, where):
        out = real(leaders, dispatch, where)
        clock.at += 31
        sent.update({r.tool: r.outcome for r in b.settle(requests, dispatcher(world), wait_timeout=0).collect()})
        return out

    a._send = overtaken
    got = {r.tool: r.outcome for r in a.settle(requests, dispatcher(world)).collect()}
    # an L0 effect was made ambiguous by the takeover: the late success heals it; a deduplicating provider's was settled by the peer, whose result is adopted
    assert sent == {"mail": "AMBIGUOUS", "pay": "PROCEED"} and got == {"mail": "PROCEED", "pay": "REPLAY"}
    rows = a.ledger.read().collect()
    assert {r.state for r in rows} == {S.SUCCEEDED} and {r.resolved_by for r in rows if r.tool == "mail"} == {"late_evidence"}


def test_heartbeat(spark, tmp_path):
    clock = Clock(100.0)
    a = writer(spark, str(tmp_path / "l"), "A", clock, heartbeat_interval=0.05)
    seen = []

    def slow(pdf):
        time.sleep(3)
        return pdf.assign(outcome="ok", result="1", result_ref=None, error=None)[["key", "outcome", "result", "result_ref", "error"]]

    real = a._beat
    a._beat = lambda rows: seen.append(real(rows)) or seen[-1]
    assert outcomes(a.settle(ask(a, spark, "mail", [("a", "x", ""), ("b", "x", "")]), slow)) == {0: "PROCEED", 1: "PROCEED"}
    assert seen and set(seen) == {2}

    calls_ = []

    def failing():
        calls_.append(1)
        raise RuntimeError("down")

    with Heartbeat(failing, 1, 0.01):
        time.sleep(0.2)
    n = len(calls_)
    time.sleep(0.05)
    assert n > 1 and len(calls_) == n  # it goes on after a failure, and ends with the batch


def test_dispatch_is_not_trusted(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "l"), Registry([L0]), b"s")

    def odd(pdf):
        ok = pdf.assign(outcome="ok", result="1", result_ref=None, error=None)[["key", "outcome", "result", "result_ref", "error"]]
        names = dict(zip(pdf["to"], pdf["key"], strict=True))
        ok = ok[ok["key"] != names.get("lost")]
        twice = ok[ok["key"] == names.get("twice")]
        differ = ok[ok["key"] == names.get("differ")].assign(result="2")
        ok.loc[ok["key"] == names.get("wrong"), "outcome"] = "fine"
        return __import__("pandas").concat([ok, twice, differ, twice.assign(key="foreign")])

    rows = [(t, t, "") for t in ("lost", "twice", "differ", "wrong", "good")]
    got = engine.settle(ask(engine, spark, "mail", rows).coalesce(1), odd)
    assert outcomes(got) == {0: "UNKNOWN", 1: "PROCEED", 2: "UNKNOWN", 3: "UNKNOWN", 4: "PROCEED"}
    state = engine.ledger.read().groupBy("state").count().collect()
    assert {r.state: r["count"] for r in state} == {S.EXECUTING: 3, S.SUCCEEDED: 2}


def test_equal_writes_count_once(spark):
    rows = spark.createDataFrame([("a", "EXECUTING"), ("b", "EXECUTING")], "key string, state string").select("key", "state", *[F.lit(None).cast(S.EFFECTS[c].dataType).alias(c) for c in ("result", "result_ref", "error", "settled_at")])
    writes = spark.createDataFrame([("a", "1", None), ("a", "1", None), ("b", "1", None), ("b", "2", None)], "key string, result string, result_ref string")
    after, hits = tr.record_success(rows, writes, "2024-01-01")
    assert sorted((r.key, r.state, r.result) for r in after.collect()) == [("a", "SUCCEEDED", "1"), ("b", "EXECUTING", None)]
    assert {(r.key, r.applied) for r in hits.collect()} == {("a", True), ("b", False)}


def test_a_null_flag_promises_nothing(spark):
    ledger = S.evolve(spark.createDataFrame([("a", "f", "EXECUTING", None, None), ("b", "f", "CLAIMED", None, 60.0)], "key string, fingerprint string, state string, lease_owner string, lease_expires double"))
    requests = spark.createDataFrame([("a", "f", 1, None, None, "w"), ("b", "f", 2, True, None, "w")], "key string, fingerprint string, arrival long, provider_dedup boolean, reconcilable boolean, owner string")
    got = {r.key: r.outcome for r in claims.decide_leased(requests, ledger, 50.0, 30.0).collect()}
    assert got == {"a": "AMBIGUOUS", "b": "BUSY"}


def test_hooks(spark, tmp_path):
    heard, frames, metrics = [], [], Metrics()

    def loud(key):
        heard.append(key)
        raise RuntimeError("telemetry is down")

    hooks = Hooks(on_replay=loud, on_ambiguous=heard.append, on_notices=lambda df: frames.append(df.count()), metrics=metrics)
    engine, world = Engine(spark, str(tmp_path / "l"), Registry([L0, L2]), b"s", hooks=hooks), World(tmp_path / "world")
    mail = effect(engine, L0, world)
    mail(calls(spark, [("a", "x", ""), ("a", "x", ""), ("a", "x", "")]), arrival=F.col("n"), key=F.col("k"), args=["to"])
    assert metrics.snapshot() == {"settled": 1, "replayed": 2, "ambiguous": 0, "failed": 0} and metrics.settled == 1 and len(heard) == 2 and frames == [3]
    with pytest.raises(Exception):  # noqa: B017
        engine.settle(ask(engine, spark, "mail", [("z", "x", "")]), killed)
    engine.recover()
    assert metrics.snapshot()["ambiguous"] == 1 and len(heard) == 3


def test_rounds_may_be_bounded_and_need_not_be(spark, tmp_path):
    engine, world = Engine(spark, str(tmp_path / "l"), Registry([L2]), b"s"), World(tmp_path / "world")
    rows = [("a", "bad", "")] * 2
    assert outcomes(engine.settle(ask(engine, spark, "pay", rows), dispatcher(world, (ValueError,)), rounds=1)) == {0: "FAILED", 1: "PENDING"} and len(world.lines()) == 1
    assert set(outcomes(engine.settle(ask(engine, spark, "pay", rows), dispatcher(world, (ValueError,)))).values()) == {"FAILED"} and len(world.lines()) == 3


def test_adapter_and_defaults(spark, tmp_path):
    class Runtime:
        def current_coordinate(self):
            return Coordinate("run-1", b"step-7")

    engine = Engine(spark, str(tmp_path / "l"), Registry([L0]), b"s", adapter=Runtime())
    assert isinstance(Runtime(), RuntimeAdapter) and isinstance(engine.ledger, Store)
    row = calls(spark, [("a", "x", "")])
    named = engine.identify(row, "mail", arrival=F.col("n"), args=["to"]).first()
    own = engine.identify(row, "mail", arrival=F.col("n"), args=["to"], key=F.col("k")).first()
    other = engine.identify(row, "mail", arrival=F.col("n"), args=["to"], runtime_scope=F.lit("run-1"), runtime_site=F.lit("step-7").cast("binary")).first()
    assert named.scope == "run-1" and named.refused is None and named.key == other.key != own.key
    left_out = engine.identify(row, "mail", arrival=F.col("n"), args=["to"], defaults={"cc": "none"}).first()
    given = engine.identify(row.withColumn("cc", F.lit("none")), "mail", arrival=F.col("n"), args=["to", "cc"], defaults={"cc": "x"}).first()
    assert left_out.fingerprint == given.fingerprint != named.fingerprint

    def send(to, cc="none", *more, **rest):
        return f"{to},{cc}"

    assert bind(send, ("a",), {}) == bind(send, ("a", "none"), {}) == {"to": "a", "cc": "none"} and bind(send, ("a",), {"z": 1})["z"] == 1
    with pytest.raises(LedgerError):
        bind(send, (), {})
    assert call(engine, L0, send, "a", at={"key": "c"}) == "a,none"
    assert onceflow.safe(send) is send


SCRIPT = """
import sys, json
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from onceflow.plans.declarations import Declaration, Registry
from onceflow.plans.leased import LeasedEngine
from onceflow.plans.engine import dispatcher
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
e = LeasedEngine(spark, {path!r}, Registry([Declaration("mail")]), b"s", owner="A", clock=lambda: 100.0)
rows = spark.createDataFrame([(0, "k", "x")], "n long, k string, to string")
def world(r):
    open({world!r}, "a").write(json.dumps({{"to": r["to"]}}) + "\\n")
e.settle(e.identify(rows, "mail", arrival=F.col("n"), key=F.col("k"), args=["to"]), dispatcher(world))
"""


@pytest.mark.parametrize(("place", "sent", "state"), [("after_dispatch", 1, S.EXECUTING)])
def test_a_crash_leaves_what_the_ledger_can_tell(spark, tmp_path, place, sent, state):
    """The driver dies at a named place; another writer, after the lease, never sends an effect twice that may have been sent."""
    path, world = str(tmp_path / "l"), World(tmp_path / "world")
    script = SCRIPT.format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), path=path, world=world.path)
    env = os.environ | {"ONCEFLOW_TESTING": "1", "ONCEFLOW_CRASH_AT": place}
    assert subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, timeout=180).returncode == 137
    b = writer(spark, path, "B", Clock(200.0))
    assert (len(world.lines()), b.ledger.read().first().state) == (sent, state)
    got = b.settle(ask(b, spark, "mail", [("k", "x", "")]), dispatcher(world), wait_timeout=0).first().outcome
    assert got == {S.CLAIMED: "PROCEED", S.EXECUTING: "AMBIGUOUS"}[state] and len(world.lines()) == (1 if state == S.CLAIMED else sent)


def test_horizons_pass(spark, tmp_path):
    """An effect beyond its provider's memory and a lease that nobody renewed are told when the stream's time passes them; news that comes first counts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    src.mkdir()
    schema = "key string, state string, provider_dedup boolean, provider_ttl_s double, created_at timestamp, lease_expires double, ts timestamp"
    at = lambda s: f"1970-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    row = lambda key, s, state="EXECUTING", ttl=60.0, lease=None: json.dumps({"key": key, "state": state, "provider_dedup": True, "provider_ttl_s": ttl, "created_at": at(0), "lease_expires": lease, "ts": at(s)})
    batches = [[row("a", 1), row("b", 1), row("c", 1, ttl=3600.0), row("d", 1, ttl=None)], [row("b", 30, "SUCCEEDED")], [row("z", 200, "SUCCEEDED")], [row("z", 201, "SUCCEEDED")]]
    leases = [[row("e", 1, lease=30.0), row("f", 1, lease=30.0)], [row("f", 20, lease=3000.0)], [row("z", 200, "SUCCEEDED")], [row("z", 201, "SUCCEEDED")]]
    try:
        for name, news, rows, want in (("ttl", horizons.provider_news, batches, [("a", "PROVIDER_FORGOT")]), ("lease", horizons.lease_news, leases, [("e", "LEASE_ENDED")])):
            (src / name).mkdir()
            stream = news(spark.readStream.schema(schema).json(str(src / name)))
            query = horizons.passed_horizons(stream).writeStream.format("memory").queryName(f"horizons_{name}").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
            try:
                for i, lines in enumerate(rows):
                    (src / name / f"{i}.json").write_text("\n".join(lines))
                    query.processAllAvailable()
                assert [(r.key, r.reason) for r in spark.table(f"horizons_{name}").collect()] == want
            finally:
                query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_durability_and_vacuum(spark, tmp_path):
    from onceflow.sources.store import Ledger

    path = str(tmp_path / "l")
    assert Ledger(spark, path, create=True, synced=False).version() == 0 and Ledger(spark, path).synced_commits in (True, False)
    engine = Engine(spark, path, Registry([L0]), b"s")
    engine.settle(ask(engine, spark, "mail", [(k, "x", "") for k in "abc"]), dispatcher(World(tmp_path / "w")))
    before = engine.ledger.read().count()
    engine.ledger.compact()
    assert engine.ledger.vacuum(1) and engine.ledger.read().count() == before == 3
    assert len(os.listdir(tmp_path / "l" / "commits")) <= 2 and not (tmp_path / "l" / "_batches").exists()
