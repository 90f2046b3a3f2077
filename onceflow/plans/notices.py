"""What is told of a batch: counts, and hooks for what someone should hear of. Telling never fails a batch: what a hook raises is logged."""

from __future__ import annotations

import logging
import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onceflow.schema import AMBIGUOUS, EVENTS

log = logging.getLogger(__name__)

#: Which event an outcome is, if any. Meeting an effect that was ambiguous before is no new event.
_EVENT_OF = {"PROCEED": "settled", "REPLAY": "replayed", "FAILED": "failed", "SURFACED": "ambiguous"}


def event(outcome: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in _EVENT_OF.items() for x in pair])[outcome]


def notices(settled: DataFrame) -> DataFrame:
    """(key, event) of settled requests (key, outcome); outcomes that are no event give none."""
    return settled.select("key", event(F.col("outcome")).alias("event")).where("event is not null")


def recovery_notices(moves: DataFrame) -> DataFrame:
    """(key, event) of recovery moves (key, to_state): what became ambiguous."""
    return moves.where(F.col("to_state") == AMBIGUOUS).select("key", F.lit("ambiguous").alias("event"))


class Metrics:
    """Counts of events over the life of an engine. `record` may be overridden to push them elsewhere."""

    def __init__(self) -> None:
        self._counts: Counter[str] = Counter()
        self._lock = threading.Lock()

    def record(self, event: str, n: int = 1) -> None:
        with self._lock:
            self._counts[event] += n

    def snapshot(self) -> dict[str, int]:
        """All events; those not seen are 0."""
        with self._lock:
            return {e: self._counts[e] for e in EVENTS}

    @property
    def settled(self) -> int:
        return self.snapshot()["settled"]


class Hooks:
    """on_ambiguous and on_replay are called with each key, from the driver, a partition of keys at a time; on_notices with the DataFrame (key, event), for
    batches too large for that."""

    def __init__(self, *, on_ambiguous: Callable[[str], object] | None = None, on_replay: Callable[[str], object] | None = None, on_notices: Callable[[DataFrame], object] | None = None, metrics: Metrics | None = None):
        self.by_event = {"ambiguous": on_ambiguous, "replayed": on_replay}
        self.on_notices, self.metrics = on_notices, metrics

    def tell(self, rows: DataFrame) -> dict[str, int]:
        """Counts of rows (key, event) by event, after all who asked have been told. rows must read from storage: it is read more than once."""
        counts = {r.event: r.n for r in rows.groupBy("event").agg(F.count("*").alias("n")).collect()}  # four rows at most
        if counts.get("ambiguous"):
            log.warning("%d effects are now ambiguous: nobody can know whether they happened; resolve them", counts["ambiguous"])
        if counts.get("replayed"):
            log.info("%d requests were served a recorded result", counts["replayed"])
        if self.metrics is not None:
            for name, n in counts.items():
                _guarded(self.metrics.record, name, n)
        if self.on_notices is not None:
            _guarded(self.on_notices, rows)
        for name, hook in self.by_event.items():
            if hook is not None and counts.get(name):
                for row in rows.where(F.col("event") == name).select("key").toLocalIterator():
                    _guarded(hook, row.key)
        return counts


def _guarded(call: Callable[..., object], *args: object) -> None:
    try:
        call(*args)
    except Exception:  # noqa: BLE001  telling must not undo what is committed
        log.exception("a hook raised")
