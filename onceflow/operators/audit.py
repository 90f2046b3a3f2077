"""The audit trail: filtered, ordered, exported. Filters fail closed: what can't be a value of theirs is refused, never an empty answer."""

from __future__ import annotations

import csv
import json
from datetime import datetime
from functools import reduce
from typing import IO, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onceflow.errors import LedgerError
from onceflow.schema import AUDIT, EXECUTING, STATES


def instant(value: str | datetime) -> datetime:
    """A time with a zone."""
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value)
        except ValueError as e:
            raise LedgerError(f"not an ISO-8601 time: {value!r}") from e
    if value.tzinfo is None:
        raise LedgerError("a time filter needs a zone")
    return value


def conditions(*, scope: str | None = None, tool: str | None = None, state: str | None = None, since: str | datetime | None = None, until: str | datetime | None = None) -> list[Column]:
    if state is not None and state not in STATES:
        raise LedgerError(f"no state {state!r}; there are {', '.join(STATES)}")
    tests = [F.col(c) == v for c, v in (("state", state), ("scope", scope), ("tool", tool)) if v is not None]
    if since is not None:
        tests.append(F.col("created_at") >= F.lit(instant(since)))
    if until is not None:
        tests.append(F.col("created_at") < F.lit(instant(until)))
    return tests


def audit(ledger: DataFrame, *, limit: int | None = None, ordered: bool = True, **filters: Any) -> DataFrame:
    """Rows that pass all filters, oldest first; since counts, until does not. The filters reach the scan."""
    if limit is not None and limit < 0:
        raise LedgerError(f"a limit of {limit}")
    tests = conditions(**filters)
    out = ledger.where(reduce(lambda a, b: a & b, tests)) if tests else ledger
    out = out.select(*[c for c in AUDIT if c in ledger.columns])
    if ordered or limit is not None:
        out = out.orderBy("created_at", "key")
    return out if limit is None else out.limit(limit)


def lookup(ledger: DataFrame, key: str) -> DataFrame:
    """One key's row: its state, fingerprint, secret id and result."""
    return ledger.where(F.col("key") == key).select("key", "state", "fingerprint", "secret_id", "result", "result_ref")


def recorded_result(ledger: DataFrame, key: str) -> Any:
    """The result of a settled effect; its marker where it has none; KeyError for an unknown key."""
    row = lookup(ledger, key).select("result", "result_ref").first()
    if row is None:
        raise KeyError(key)
    return json.loads(row.result) if row.result is not None else row.result_ref


def keys_in(ledger: DataFrame, state: str) -> DataFrame:
    return ledger.where(conditions(state=state)[0]).select("key")


def backlog(ledger: DataFrame) -> DataFrame:
    return ledger.where((F.col("state") == EXECUTING) & F.col("reconcilable")).select("key", "tool")


def as_variant(rows: DataFrame) -> DataFrame:
    """Rows with the result parsed."""
    return rows.withColumn("result", F.try_parse_json("result"))


def _plain(row: Any) -> dict[str, Any]:
    d = row.asDict()
    return {k: v.isoformat() if isinstance(v, datetime) else v for k, v in d.items()}


def export(rows: DataFrame, dest: IO[str], fmt: str = "json") -> int:
    """Streams rows to an open text file, a partition at a time: a JSON array with results parsed, or CSV with the stored text verbatim."""
    if fmt not in ("json", "csv"):
        raise LedgerError(f"no format {fmt!r}")
    n, out = 0, csv.writer(dest)
    if fmt == "csv":
        out.writerow(rows.columns)
    else:
        dest.write("[")
    for row in rows.toLocalIterator():
        d = _plain(row)
        if fmt == "csv":
            out.writerow(d.values())
        else:
            if d.get("result") is not None:
                d["result"] = json.loads(d["result"])
            dest.write((",\n " if n else "") + json.dumps(d))
        n += 1
    if fmt == "json":
        dest.write("]\n")
    return n


def write(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """The same at scale: JSON lines or CSV parts, written by the executors."""
    if fmt == "json":
        as_variant(rows).write.json(path)
    elif fmt == "csv":
        rows.write.option("header", True).csv(path)
    else:
        raise LedgerError(f"no format {fmt!r}")
