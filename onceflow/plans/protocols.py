"""What the engine asks of the things around it: a runtime that names calls, and a store that keeps the ledger."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple, Protocol, runtime_checkable

from pyspark.sql import DataFrame


class Coordinate(NamedTuple):
    """Where a runtime says that a call stands; both parts stay the same when the call is made again."""

    scope: str
    call_site: bytes


@runtime_checkable
class RuntimeAdapter(Protocol):
    """A runtime that may name the batch in progress. Its answer is the second rung of the ladder, after a business key."""

    def current_coordinate(self) -> Coordinate | None:
        """None: this runtime does not know; the ladder goes on."""
        ...


@runtime_checkable
class Store(Protocol):
    """Where a ledger is kept. Decisions are made in `update`, from what is there, and committed all at once or made again."""

    path: str

    @property
    def multi_worker(self) -> bool:
        """Whether several writers share the ledger, each under leases."""
        ...

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        ...

    def read(self, version: int | None = None) -> DataFrame:
        """One row an effect, by default as of the last commit."""
        ...

    def update(self, change: Callable[[DataFrame], tuple[DataFrame | None, Any]], note: str = "", tries: int = 10, keys: DataFrame | None = None) -> Any:
        """Commits the rows that `change` gives for what is there, if any, and returns its answer. keys: rows (key, ...); `change` gets the rows with these keys."""
        ...
