"""A Python data source that reads a table of an SQLite file, read-only, by ranges of rowid, for importing a ledger kept in one."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from onceflow.errors import LedgerError, LedgerNotFound


@dataclass
class _Range(InputPartition):
    low: int
    high: int


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def partitions(self) -> list[_Range]:
        with connect(self.path) as c:
            low, high = c.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(s, min(high, s + step - 1)) for s in range(low, high + 1, step)] or [_Range(0, -1)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with connect(self.path) as c:
            yield from c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """format("sqlite_file"), options path (on storage that executors see), table, parts; a schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def reader(self, schema) -> SqliteReader:
        table = self.options["table"]
        if not table.replace("_", "").isalnum():
            raise LedgerError(f"not a table name: {table!r}")
        return SqliteReader(self.options["path"], table, [f.name for f in schema.fields], int(self.options.get("parts", "8")))


def connect(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise LedgerNotFound(f"no ledger at {path}")
    c = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        c.execute("PRAGMA schema_version").fetchone()
    except sqlite3.DatabaseError as e:
        raise LedgerError(f"{path} is not a database") from e
    return c


#: What such a table stores, before times and flags have their types.
STORED = (
    "key string, scope string, tool string, fingerprint string, state string, provider_dedup long, provider_ttl_s double, reconcilable long, result string, result_ref string, error string, "
    "created_at string, settled_at string, fencing_token long, lease_owner string, lease_expires double, resolved_by string, key_version string, fingerprint_version string, secret_id string"
)


def read_effects(spark: SparkSession, path: str, table: str = "effects", parts: int = 8):
    """The effects of a file as a ledger."""
    from onceflow.schema import evolve

    connect(path).close()
    spark.dataSource.register(SqliteSource)
    return evolve(spark.read.format("sqlite_file").schema(STORED).option("path", path).option("table", table).option("parts", parts).load())
