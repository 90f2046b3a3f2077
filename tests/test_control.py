import io
import json
import sqlite3
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onceflow import schema as S
from onceflow.errors import CommitConflict, DeclarationError, LedgerError, LedgerNotFound
from onceflow.functions import identity as I
from onceflow.operators import audit as A
from onceflow.operators import metrics, scanner
from onceflow.plans import declarations as D
from onceflow.sources import store
from onceflow.sources.sqlite_file import read_effects
from onceflow.sources.store import Ledger
from tests.test_decisions import T0, effects

SOURCE = '''
import requests as r, smtplib, boto3, stripe, httpx
from requests import post as send
s = r.Session()
with smtplib.SMTP("h") as m:
    m.sendmail("a", "b", "c")
q = boto3.client("sqs")
def go(db):
    r.post("u")
    r.get("u")
    send("u")
    s.request("PUT", "u")
    s.request("GET", "u")
    stripe.Refund.create(amount=1)
    q.send_message(x=1)
    q.list_queues()
    db.execute(f"INSERT INTO {1}")
    db.execute("SELECT 1")
    smtplib.SMTP("h").send_message(1)
    r.delete("u")  # effect: safe
    r.put("# effect: safe")
@sk.effect(decl)
def a(): r.post("u")
@sk.effect
def b(): r.post("u")
@safe
def c(): r.post("u")
def d(): r.post("u")
eng.guard(decl, d)
'''


def test_scanner_finds_what_it_should(spark):
    lines = [f[1] for f in scanner.scan_source(SOURCE)]
    text = SOURCE.split("\n")
    assert [text[n - 1].strip() for n in lines] == [
        'm.sendmail("a", "b", "c")', 'r.post("u")', 'send("u")', 's.request("PUT", "u")', "stripe.Refund.create(amount=1)", "q.send_message(x=1)", 'db.execute(f"INSERT INTO {1}")', 'smtplib.SMTP("h").send_message(1)', 'r.put("# effect: safe")', 'def b(): r.post("u")',
    ]
    assert scanner.scan_source("# effect: safe-file\nimport requests\nrequests.post(1)") == []
    assert [f[3] for f in scanner.scan_source("def (")] == [scanner.NOT_VERIFIED] == [f[3] for f in scanner.scan_source("x = 1\0")]
    assert scanner.scan_source("(" * 5000 + ")" * 5000)[0][3] == scanner.NOT_VERIFIED


def test_sources_of_one_task_are_dealt_out(spark):
    sources = spark.range(200).selectExpr("concat('f', id) AS path", "CAST('def (' AS BINARY) AS content").coalesce(1)
    tasks = scanner.scan(sources).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in tasks) == 200 and len(tasks) > 4 and max(r["count"] for r in tasks) < 60


def test_scan_of_folders(spark, tmp_path, capsys):
    from onceflow.cli import main

    for name, body in {"a.py": SOURCE, "b.py": "x = 1", ".hidden/c.py": SOURCE, "build/d.py": SOURCE, "bad.py": "def (", "e.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "latin.py").write_bytes(b"x = '\xff'")
    (tmp_path / "empty").mkdir()
    findings, n = scanner.scan_roots(spark, [str(tmp_path), str(tmp_path / "none"), str(tmp_path / "empty")])
    assert n == 4
    assert {(r.path.rsplit("/", 1)[-1], r.code): r["count"] for r in findings.groupBy("path", "code").count().collect()} == {("a.py", "OF001"): 10, ("bad.py", "OF000"): 1, ("latin.py", "OF000"): 1, ("none", "OF000"): 1, ("empty", "OF000"): 1}
    sarif = json.loads(scanner.report(findings, n, "sarif", str(tmp_path)))["runs"][0]
    assert len(sarif["results"]) == 14 and sarif["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a.py"
    assert json.loads(scanner.report(findings, n, "json"))["summary"] == {"files_scanned": 4, "findings": 14}
    assert main(["scan", str(tmp_path), "--check"], spark) == 1 and "OF001" in capsys.readouterr().out
    assert main(["scan", str(tmp_path / "b.py"), "--check", "-o", str(tmp_path / "out")], spark) == 0
    assert main(["scan", str(tmp_path), "-o", str(tmp_path / "no" / "out")], spark) == 2


DOC = {
    "sed": 1, "tool": "pay", "level": "l2r", "args": {"amount": {"class": "identity", "normalize": "money", "type": "money"}, "note": {"class": "content"}, "user_id": {"class": "content", "force": True}, "*": {"class": "volatile"}},
    "provider_key": {"param": "idem", "ttl_s": 60}, "reconcile": {"ref": "python:m:f", "provider_read": "strong"}, "ambiguous": {"default": "retry"}, "x-new": {},
}


def test_documents_round_trip_and_bind():
    doc = D.parse(DOC)
    assert D.parse(D.emit(doc)) == doc
    d = D.load(DOC, {"python:m:f": lambda k: None})
    assert (d.level, d.provider_ttl_s, d.class_of("note"), d.class_of("other"), d.normalizers) == ("L2R", 60.0, "content", "volatile", {"amount": "money"})
    assert d.identity({"amount": "$1.50", "note": "x", "z": 1}) == {"amount": "1.5"}
    assert D.bind(D.unbind(d, "python:m:f"), {"python:m:f": d.reconcile}).level == "L2R"


@pytest.mark.parametrize(
    "change",
    [
        {"sed": 2}, {"sed": True}, {"tool": ""}, {"level": "l9"}, {"level": "l0am"}, {"level": "l3"}, {"args": {"amount": {"klass": "identity"}}}, {"args": {"amount": {"normalize": "upper"}}}, {"args": {"id": {"class": "content"}}}, {"args": {"*": {"normalize": "trim"}}},
        {"provider_key": None}, {"provider_key": {}}, {"provider_key": {"param": "p", "ttl_s": -1}}, {"provider_key": {"param": "p", "encoding": "uuid"}}, {"reconcile": {"ref": "python:m:g"}}, {"reconcile": {"ref": "python:m:f", "provider_read": "weak"}},
        {"result": {"replay": "refetch"}}, {"result": {"replay": "marker"}}, {"fingerprint": {"version": 2}}, {"fingerprint": {"version": True}},
    ],
)
def test_documents_refused(change):
    with pytest.raises(DeclarationError):
        D.load(DOC | change, {"python:m:f": lambda k: None})


def test_declarations_refused():
    class ProviderTimeout(Exception):
        pass

    for bad in ({"clean_failures": (OSError,)}, {"clean_failures": (ProviderTimeout,)}, {"normalizers": {"a": "upper"}}, {"on_absent": "retry"}, {"on_absent": "x"}, {"provider_read": "x"}):
        with pytest.raises(LedgerError):
            D.Declaration("t", **bad)
    registry = D.Registry([D.Declaration("t")])
    registry.add(D.Declaration("t"))
    with pytest.raises(LedgerError):
        registry.add(D.Declaration("t", normalizers={"a": "trim"}))


def test_message_equals_python(spark):
    d = D.Declaration("t", {"note": "content"}, normalizers={"to": "email"})
    df = spark.createDataFrame([(" A@B.c ", 1, 1.5, "x", True), ("b", None, None, None, False)], "to string, n int, f double, note string, has_n boolean")
    schema = T.StructType([f for f in df.schema.fields if f.name != "has_n"])
    for r in df.select("*", d.message(schema).alias("m"), d.message(schema, present={"n": F.col("has_n")}).alias("p")).collect():
        named = {"to": r.to, "n": r.n, "f": r.f, "note": r.note}
        assert I.hashlib.sha256(r.m).hexdigest() == I.hashlib.sha256(D.C.encode(d.identity(named))).hexdigest()
        absent = {k: v for k, v in named.items() if k != "n" or r.has_n}
        assert bytes(r.p) == D.C.encode(d.identity(absent))


def test_store_commits_and_conflicts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    with pytest.raises(LedgerNotFound):
        Ledger(spark, path)
    with Ledger(spark, path, create=True) as a:
        assert a.read().count() == 0
        a.write(effects(spark, [{"key": "k"}]), 0)
        with pytest.raises(CommitConflict):
            a.write(effects(spark, []), 0)
        tries = []

        def change(state):
            if not tries:  # another writer gets in between
                a.write(effects(spark, [{"key": "k"}, {"key": "other"}]), 1)
            tries.append(state.count())
            return state.withColumn("state", F.lit(S.SUCCEEDED)), None

        a.update(change)
        assert len(tries) == 2 and a.version() == 3 and {(r.key, r.state) for r in a.read().collect()} == {("k", S.SUCCEEDED), ("other", S.SUCCEEDED)}
        assert [(r.key, r.state) for r in a.read(1).collect()] == [("k", S.INTENDED)] and a.read(2).count() == 2
        monkeypatch.setattr(store, "COMPACT", 4)
        a.update(lambda state: (state.where("key = 'k'").withColumn("state", F.lit(S.FAILED)), None))
        assert a.version() == 5 and a._commit(5)["deltas"] == [] and {(r.key, r.state) for r in a.read().collect()} == {("k", S.FAILED), ("other", S.SUCCEEDED)}
        assert len(a.vacuum(1)) == 6 and a.read().count() == 2  # four deltas, two that lost the race
    with pytest.raises(LedgerError):
        Ledger(spark, path, create=True, multi_worker=True)
    (tmp_path / "ledger" / "_meta.json").write_text(json.dumps({"schema_version": 99, "mode": "single"}))
    (tmp_path / "ledger" / "._meta.json.crc").unlink(missing_ok=True)
    with pytest.raises(LedgerError):
        Ledger(spark, path)


def test_audit_filters_and_exports(spark, tmp_path):
    from onceflow.cli import main
    from onceflow.http import answer

    rows = [{"key": f"k{i}", "tool": "mail" if i < 2 else "pay", "state": S.SUCCEEDED, "result": '{"a": 1}', "scope": "global", "created_at": datetime(2024, 1, 1 + i, tzinfo=timezone.utc)} for i in range(3)]
    ledger = effects(spark, rows)
    keys = lambda **f: [r.key for r in A.audit(ledger, **f).collect()]
    assert keys() == ["k0", "k1", "k2"] and keys(tool="mail") == ["k0", "k1"] and keys(tool="mail", limit=1) == ["k0"] and keys(state=S.AMBIGUOUS) == []
    assert keys(since="2024-01-02T05:30:00+05:30", until="2024-01-03T00:00:00Z") == ["k1"]
    for bad in ({"state": "DONE"}, {"since": "yesterday"}, {"since": "2024-01-01T00:00:00"}, {"limit": -1}):
        with pytest.raises(LedgerError):
            keys(**bad)
    out = io.StringIO()
    assert A.export(A.audit(ledger), out) == 3 and json.loads(out.getvalue())[0]["result"] == {"a": 1}
    out = io.StringIO()
    assert A.export(A.audit(ledger), out, "csv") == 3 and out.getvalue().startswith("key,scope,tool")
    with pytest.raises(LedgerError):
        A.export(ledger, out, "xml")
    assert A.recorded_result(ledger, "k0") == {"a": 1}
    with pytest.raises(KeyError):
        A.recorded_result(ledger, "none")
    path = str(tmp_path / "l")
    Ledger(spark, path, create=True).write(ledger, 0)
    assert answer(spark, path, "GET", "tool=pay")[0] == 200 and answer(spark, path, "POST", "")[0] == 405 and answer(spark, path, "GET", "limit=x")[0] == 400 and answer(spark, path, "GET", "state=x")[0] == 400 and answer(spark, path + "x", "GET", "")[0] == 404
    assert main(["audit", path, "--tool", "mail", "-o", str(tmp_path / "o.csv"), "--format", "csv"], spark) == 0 and len((tmp_path / "o.csv").read_text().splitlines()) == 3
    assert main(["audit", path, "--state", "x"], spark) == 1
    A.write(A.audit(ledger), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3


def test_metrics(spark):
    events = spark.createDataFrame([("settled",), ("settled",), ("failed",)], "event string")
    assert {r.event: r.n for r in metrics.event_counts(events).collect()} == {"settled": 2, "failed": 1, "replayed": 0, "ambiguous": 0}
    assert metrics.total_settled(events).first().n == 2
    numbers = spark.range(250_001).selectExpr("cast(pmod(id * 7919, 250001) as double) v")
    assert {r.p: r.value for r in metrics.percentiles(numbers, "v").collect()} == {50.0: 125000.0, 95.0: 237500.0, 99.0: 247500.0, 100.0: 250000.0}
    same = spark.range(150_000).selectExpr("cast(id > 10 as double) v")
    assert {r.p: r.value for r in metrics.percentiles(same, "v", (0,)).collect()} == {0.0: 0.0, 100.0: 1.0}
    odd = [float("-inf"), -1e300, -2.5, -0.0, 0.0, 5e-324, 1e-5, 3.0, 1e300, float("inf"), None]
    got = metrics.percentiles(spark.createDataFrame([(v,) for v in odd], "v double"), "v", tuple(100 * i / 9 for i in range(9))).orderBy("p").collect()
    assert [r.value for r in got] == sorted(v for v in odd if v is not None)
    longs = [-(2**63), -1, 0, 2**53, 2**53 + 1, 2**63 - 1]
    got = metrics.percentiles(spark.createDataFrame([(v,) for v in longs], "v long"), "v", tuple(20.0 * i for i in range(5))).orderBy("p").collect()
    assert [r.value for r in got] == longs and metrics.percentiles(same.limit(0), "v").count() == 0
    f, n = (spark.createDataFrame(x, "repo string, path string") for x in ([("a", "x")], [("a", "x"), ("a", "y"), ("b", "z")]))
    assert {r.repo: (r.files, r.findings) for r in metrics.flag_density(f, n).collect()} == {"a": (2, 1), "b": (1, 0), None: (3, 1)}


def test_sqlite_import(spark, tmp_path):
    path = str(tmp_path / "l.db")
    with sqlite3.connect(path) as c:
        names = [f.name for f in S.EFFECTS.fields]
        c.execute(f"CREATE TABLE effects ({', '.join(names)})")
        for i in range(20):
            row = {"key": f"k{i}", "scope": "s", "tool": "t", "fingerprint": "f", "state": S.SUCCEEDED, "provider_dedup": 1, "reconcilable": 0, "created_at": "2024-01-01T00:00:00.000001+00:00", "fencing_token": 0}
            c.execute(f"INSERT INTO effects VALUES ({', '.join('?' * len(names))})", [row.get(n) for n in names])
    df = read_effects(spark, path, parts=3)
    assert df.schema["created_at"].dataType == T.TimestampType() and df.count() == 20 and A.audit(df, tool="t").count() == 20
    assert df.where("provider_dedup and not reconcilable").count() == 20
    with pytest.raises(LedgerNotFound):
        read_effects(spark, path + "x")
    (tmp_path / "text").write_text("not a database, but long enough to be read as one " * 20)
    with pytest.raises(LedgerError):
        read_effects(spark, str(tmp_path / "text"))
    assert T0


def test_a_batch_merges_only_its_keys(spark, tmp_path):
    """Deltas are cut to the keys asked for before they are merged, with a base and without one."""
    ledger = Ledger(spark, str(tmp_path / "l"), create=True)
    rows = lambda keys, state: effects(spark, [{"key": k, "state": state} for k in keys])
    for i, state in enumerate((S.CLAIMED, S.EXECUTING, S.SUCCEEDED)):
        ledger.update(lambda _, i=i, state=state: (rows([f"k{n}" for n in range(i, 20)], state), None))
    keys = spark.createDataFrame([("k0",), ("k1",), ("k7",), ("k7",), ("other",)], "key string")
    want = {"k0": S.CLAIMED, "k1": S.EXECUTING, "k7": S.SUCCEEDED}
    plan = ledger.read(keys=keys)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("max_by") < plan.index("LeftSemi")  # the join stands below the merge
    for _ in range(2):
        some = ledger.read(keys=keys)
        assert {r.key: r.state for r in some.collect()} == want and some.columns == S.EFFECTS.names
        seen = []
        ledger.update(lambda found, seen=seen: (None, seen.extend(r.key for r in found.collect())), keys=keys)
        assert sorted(seen) == sorted(want)
        ledger.compact()
    ledger.update(lambda found: (found.withColumn("state", F.lit(S.FAILED)), None), keys=keys.where("key = 'k1'"))
    assert {r.key: r.state for r in ledger.read(keys=keys).collect()} == want | {"k1": S.FAILED} and ledger.read().count() == 20
