"""Batches, crashes between the two commits, streams."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from onceflow import schema as S
from onceflow.errors import AmbiguousOutcome, DivergentRetry, LedgerError, NoCoordinate
from onceflow.plans.declarations import Declaration, Registry
from onceflow.plans.engine import Engine, dispatcher, effect, guard
from onceflow.streaming import settle as streaming

L0, L2 = Declaration("mail", {"body": "content"}), Declaration("pay", provider_key_param="idem", clean_failures=(ValueError,))


class World:
    """What effects leave behind: a line each in a file that all workers append to."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, request):
        with open(self.path, "a") as f:
            f.write(json.dumps({"key": request["key"], "to": request["to"]}) + "\n")
        if request["to"] == "bad":
            raise ValueError("declined")
        if request["to"] == "lost":
            raise TimeoutError("no answer")
        return {"sent": request["to"]}

    def lines(self):
        return [json.loads(x) for x in open(self.path)] if os.path.exists(self.path) else []


def calls(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, k string, to string, body string")


def outcomes(df):
    return {r.n: r.outcome for r in df.collect()}


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "ledger"), Registry([L0, L2]), b"secret")


def test_batches_settle_once(spark, engine, tmp_path):
    world = World(tmp_path / "world")
    mail = effect(engine, L0, world)
    first = mail(calls(spark, [("a", "x", "1"), ("a", "x", "2"), ("a", "y", "1"), ("b", "z", ""), (" ", "q", "")]), arrival=F.col("n"), key=F.col("k"), args=["to", "body"])
    assert outcomes(first) == {0: "PROCEED", 1: "REPLAY", 2: "DIVERGENT", 3: "PROCEED", 4: "NO_COORDINATE"}
    assert {r.n: r.result for r in first.where("outcome = 'REPLAY'").collect()} == {1: '{"sent": "x"}'}
    again = mail(calls(spark, [("a", "x", "3"), ("b", "w", ""), ("c", "lost", ""), ("c", "lost", "")]), arrival=F.col("n"), key=F.col("k"), args=["to", "body"])
    assert outcomes(again) == {0: "REPLAY", 1: "DIVERGENT", 2: "UNKNOWN", 3: "IN_FLIGHT"}
    assert [x["to"] for x in world.lines()] == ["x", "z", "lost"] or sorted(x["to"] for x in world.lines()) == ["lost", "x", "z"]
    assert {r.state: r["count"] for r in engine.ledger.read().groupBy("state").count().collect()} == {S.SUCCEEDED: 2, S.EXECUTING: 1}


def test_clean_failures_let_the_next_try(spark, engine, tmp_path):
    world = World(tmp_path / "world")
    pay = effect(engine, L2, world)
    got = pay(calls(spark, [("a", "bad", ""), ("a", "bad", ""), ("a", "ok", "")]), arrival=F.col("n"), key=F.col("k"), args=["to", "body"])
    assert outcomes(got) == {0: "FAILED", 1: "FAILED", 2: "DIVERGENT"}
    assert len(world.lines()) == 2 and engine.ledger.read().first().error == "ValueError: declined"
    with pytest.raises(LedgerError):

        async def later(request):
            return 1

        dispatcher(later)


def test_crash_between_the_commits(spark, engine, tmp_path):
    """A batch whose second commit never came: by level, the effect is surfaced, asked about, or may go again."""
    path = engine.ledger.path
    world = World(tmp_path / "world")

    def crash(pdf):
        for r in pdf.to_dict("records"):
            world(r)
        raise SystemError("killed")

    for decl in (L0, L2):
        with pytest.raises(Exception):  # noqa: B017
            engine.settle(engine.identify(calls(spark, [("a", "x", "")]), decl.tool, arrival=F.col("n"), key=F.col("k"), args=["to", "body"]), crash)
    assert [r.state for r in engine.ledger.read().collect()] == [S.EXECUTING] * 2
    sent = len(world.lines())
    again = Engine(spark, path, Registry([L0, L2]), b"secret")
    with pytest.raises(AmbiguousOutcome):
        guard(again, L0, world, {"to": "x", "body": ""}, key="a")
    assert len(world.lines()) == sent  # an L0 effect is never sent twice by recovery
    row = calls(spark, [("a", "x", "")])
    assert outcomes(effect(again, L2, world)(row, arrival=F.col("n"), key=F.col("k"), args=["to", "body"])) == {0: "PROCEED"}


def test_reconcile_adopts(spark, tmp_path):
    decl = Declaration("ask", reconcile=lambda key: ("SETTLED", {"found": True}))
    engine = Engine(spark, str(tmp_path / "ledger"), Registry([decl]), b"s")

    def crash(pdf):
        raise SystemError("killed")

    ask = engine.identify(calls(spark, [("a", "x", "")]), "ask", arrival=F.col("n"), key=F.col("k"), args=["to", "body"])
    with pytest.raises(Exception):  # noqa: B017
        engine.settle(ask, crash)
    again = Engine(spark, engine.ledger.path, Registry([decl]), b"s")
    assert [(r.from_state, r.to_state) for r in again.recover().collect()] == [(S.EXECUTING, S.SUCCEEDED)]
    assert outcomes(again.settle(ask, crash)) == {0: "REPLAY"}


def test_one_call_and_rotation(spark, engine, tmp_path):
    world = World(tmp_path / "world")
    args = {"to": "x", "body": "1"}
    assert guard(engine, L0, world, args, key="k") == {"sent": "x"} == guard(engine, L0, world, args | {"body": "2"}, key="k")
    with pytest.raises(DivergentRetry):
        guard(engine, L0, world, args | {"to": "y"}, key="k")
    with pytest.raises(NoCoordinate):
        guard(engine, L0, world, args, step="s")
    guard(engine, L0, world, args, step="s", scope="run")
    guard(engine, L0, world, args, step="s", scope="run", occurrence=2)
    assert len(world.lines()) == 3
    rotated = Engine(spark, engine.ledger.path, Registry([L0]), b"new", verify_secrets=(b"secret",))
    assert guard(rotated, L0, world, args, key="k") == {"sent": "x"}
    with pytest.raises(DivergentRetry):
        guard(rotated, L0, world, args | {"to": "y"}, key="k")
    with pytest.raises(LedgerError):
        Engine(spark, engine.ledger.path, Registry([]), b"a", verify_secrets=(b"a",))


def test_streams(spark, engine, tmp_path):
    world = World(tmp_path / "world")
    src = str(tmp_path / "in")
    calls(spark, [("a", "x", ""), ("a", "x", ""), ("b", "y", "")]).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("n long, k string, to string, body string").parquet(src)
    requests = engine.identify(stream, "mail", arrival=F.col("n"), key=F.col("k"), args=["to", "body"])
    for _ in range(2):  # the second start finds nothing new
        streaming.settle_stream(requests, engine, dispatcher(world), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert outcomes(spark.read.parquet(str(tmp_path / "out"))) == {0: "PROCEED", 1: "REPLAY", 2: "PROCEED"} and len(world.lines()) == 2
    engine.ledger.update(lambda s: (s.withColumn("state", F.lit(S.AMBIGUOUS)), None))
    ev = str(tmp_path / "ev")
    engine.ledger.read().select("key", F.lit(False).alias("failed"), F.lit("1").alias("result"), F.lit(None).cast("string").alias("result_ref"), F.lit(None).cast("string").alias("error")).write.parquet(ev)
    late = spark.readStream.schema("key string, failed boolean, result string, result_ref string, error string").parquet(ev)
    streaming.late_evidence_stream(late, engine.ledger, str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.state for r in engine.ledger.read().collect()} == {S.SUCCEEDED}


def test_stateful_decisions(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    src.mkdir()
    schema = "key string, fingerprint string, arrival long"
    query = streaming.decide_stream(spark.readStream.schema(schema).json(str(src))).writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, rows in enumerate([[("a", "f", 1), ("a", "g", 2)], [("a", "f", 3), ("b", "f", 4)]]):
            (src / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("key", "fingerprint", "arrival"), r, strict=True))) for r in rows))
            query.processAllAvailable()
        time.sleep(0.1)
        got = {r.arrival: r.outcome for r in spark.table("decisions").collect()}
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {1: "PROCEED", 2: "DIVERGENT", 3: "REPLAY", 4: "PROCEED"}
