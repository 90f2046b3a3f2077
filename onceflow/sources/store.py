"""A ledger on shared storage: a Parquet base and deltas, named by numbered commits.

<path>/_meta.json holds the schema version and the coordination mode. Commit n is <path>/commits/<n>.json, created only if it is not
there yet; it names a base and the deltas since, folders below <path>/state. A delta holds the rows that a commit changed, so a batch costs what it
touches, not what the ledger holds; every COMPACT deltas become a new base. A writer reads commit n, decides, writes its delta, and creates commit n + 1;
if another has created it, the decision is made again on what that one wrote. Readers see the last commit; lost executors and crashed
writers leave folders that no commit names. On a store whose rename can overwrite, one writer at a time must be arranged outside.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onceflow.errors import CommitConflict, LedgerError, LedgerNotFound
from onceflow.schema import EFFECTS, KEY_VERSION, SCHEMA_VERSION, evolve


#: Deltas that a read merges before they become a base.
COMPACT = 16


class _Files:
    """The few file operations that a commit needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str, synced: bool | None = None):
        self.jvm, self.root, self.synced = spark._jvm, root.rstrip("/"), synced
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(name))] if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether this call created the file: written aside, then renamed without overwriting."""
        aside = self.path(f"_aside/{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        out.write(bytearray(text.encode()))
        if self.synced and not out.hasCapability("hsync"):
            out.close()
            self.fs.delete(aside, False)
            raise LedgerError(f"{self.root}: this storage can't be made to keep a commit through a power loss; synced=False accepts that")
        out.hsync() if self.synced is not False and out.hasCapability("hsync") else out.flush()
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        self.fs.mkdirs(self.path(name).getParent())
        try:
            none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            kinds = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
            kinds[0] = none
            context.rename(aside, self.path(name), kinds)
            return True
        except Exception as e:  # noqa: BLE001  py4j wraps FileAlreadyExistsException
            if "FileAlreadyExists" not in str(e):
                raise
            self.fs.delete(aside, False)
            return False


class Ledger:
    """A ledger's current state and its commits. Use as a context manager where an open handle should be bounded.

    synced: True refuses storage that can't be told to bring a commit's name to disk, False accepts that a power loss may take the last
    commits and is faster, None does what the storage can. The rows are as durable as the storage makes a closed file."""

    def __init__(self, spark: SparkSession, path: str, *, create: bool = False, multi_worker: bool = False, synced: bool | None = None):
        self.spark, self.path, self.files = spark, path.rstrip("/"), _Files(spark, path, synced)
        if not self.files.exists("_meta.json"):
            if not create:
                raise LedgerNotFound(f"no ledger at {path}")
            self.files.create("_meta.json", json.dumps({"schema_version": SCHEMA_VERSION, "key_version": KEY_VERSION, "mode": "multi" if multi_worker else "single"}))
        try:
            self.meta = json.loads(self.files.read("_meta.json"))
        except ValueError as e:
            raise LedgerError(f"{path} is not a ledger") from e
        if self.meta["schema_version"] > SCHEMA_VERSION:
            raise LedgerError(f"{path} has schema version {self.meta['schema_version']}; this build knows {SCHEMA_VERSION}")
        if create and (self.meta["mode"] == "multi") != multi_worker:
            raise LedgerError(f"{path} is a {self.meta['mode']}-worker ledger")

    @property
    def synced_commits(self) -> bool:
        """Whether a commit's name is on disk, as far as the storage tells, when the commit returns."""
        probe = self.files.path(f"_aside/{uuid.uuid4().hex}")
        out = self.files.fs.create(probe, False)
        try:
            return self.files.synced is not False and out.hasCapability("hsync")
        finally:
            out.close()
            self.files.fs.delete(probe, False)

    @property
    def multi_worker(self) -> bool:
        return self.meta["mode"] == "multi"

    def __enter__(self) -> Ledger:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open between commits."""

    def version(self) -> int:
        return max((int(n.removesuffix(".json")) for n in self.files.names("commits") if n.endswith(".json")), default=0)

    def _commit(self, version: int) -> dict[str, Any]:
        return json.loads(self.files.read(f"commits/{version:020d}.json")) if version else {"base": None, "deltas": []}

    def _load(self, name: str) -> DataFrame:
        return evolve(self.spark.read.parquet(f"{self.path}/state/{name}"))

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The state at a version, by default the last; a ledger without commits is empty. The base is read as it lies: the
        keys that deltas have touched are few and go to it, by broadcast where they are small. keys: rows (key, ...) whose keys alone are wanted; other rows are dropped
        where they are read, before deltas are merged."""
        only = None if keys is None else keys.select("key").distinct()
        kept = lambda rows: rows if only is None else rows.join(only, "key", "left_semi").select(*rows.columns)
        commit = self._commit(self.version() if version is None else version)
        if not commit["base"] and not commit["deltas"]:
            return self.spark.createDataFrame([], EFFECTS)
        if not commit["deltas"]:
            return kept(self._load(commit["base"]))
        late = [self._load(d) for d in commit["deltas"]]
        if len(late) > 1:
            tagged = kept(reduce(DataFrame.unionByName, [d.withColumn("delta", F.lit(i)) for i, d in enumerate(late)]))
            rest = [c for c in EFFECTS.names if c != "key"]
            # the key itself, not one out of the row: what is joined next by key then needs no shuffle
            last = tagged.groupBy("key").agg(F.max_by(F.struct(*rest), "delta").alias("row")).select(*["key" if c == "key" else f"row.{c}" for c in EFFECTS.names])
        else:
            last = kept(late[0])
        return kept(self._load(commit["base"])).join(last.select("key"), "key", "left_anti").select(*EFFECTS.names).unionByName(last) if commit["base"] else last

    def _write(self, rows: DataFrame, on: int) -> str:
        name = f"{on + 1:020d}-{uuid.uuid4().hex}"
        # rows of a state side by side, and keys in order within files: row groups then prune by both
        evolve(rows).sortWithinPartitions("state", "key").write.parquet(f"{self.path}/state/{name}")
        return name

    def _create(self, on: int, base: str | None, deltas: list[str], note: str) -> int:
        entry = {"base": base, "deltas": deltas, "at": datetime.now(UTC).isoformat(), "note": note}
        if not self.files.create(f"commits/{on + 1:020d}.json", json.dumps(entry)):
            raise CommitConflict(f"version {on + 1} is taken")
        return on + 1

    def write(self, changed: DataFrame, on: int, note: str = "") -> int:
        """Commits the rows, one a key, that differ from version `on`; CommitConflict if that has a successor already."""
        commit = self._commit(on)
        return self._create(on, commit["base"], [*commit["deltas"], self._write(changed, on)], note)

    def compact(self) -> int:
        """Makes base and deltas one base; the state stays as it is."""
        on = self.version()
        return self._create(on, self._write(self.read(on), on), [], "compact")

    def update(self, change: Callable[[DataFrame], tuple[DataFrame | None, Any]], note: str = "", tries: int = 10, keys: DataFrame | None = None) -> Any:
        """Reads, changes, commits; on a conflict all three again, so the decision is always about what is there. change gives
        (changed rows, answer); None instead of rows makes no commit. keys: it gets the rows with these keys, so that it costs what they are."""
        for _ in range(tries):
            on = self.version()
            changed, answer = change(self.read(on, keys))
            if changed is None:
                return answer
            try:
                self.write(changed, on, note)
            except CommitConflict:
                continue
            if len(self._commit(on + 1)["deltas"]) >= COMPACT:
                with contextlib.suppress(CommitConflict):  # another writer's turn
                    self.compact()
            return answer
        raise CommitConflict(f"no commit in {tries} tries")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes what none of the last commits names, older commits, and the batches' own tables; returns what went of the state. No writer may be at work, and no
        result of a batch may still be read."""
        last = self.version()
        commits = [self._commit(v) for v in range(max(1, last - keep + 1), last + 1)]
        named = {n for c in commits for n in (c["base"], *c["deltas"])}
        gone = [n for n in self.files.names("state") if n not in named]
        for n in gone:
            self.files.fs.delete(self.files.path(f"state/{n}"), True)
        for v in range(last - keep, 0, -1):
            if not self.files.fs.delete(self.files.path(f"commits/{v:020d}.json"), False):
                break  # those before went earlier
        self.files.fs.delete(self.files.path("_batches"), True)
        return gone
