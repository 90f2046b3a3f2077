"""onceflow: a Spark-native engine that decides, records and audits side effects."""

from collections.abc import Callable
from typing import TypeVar

__version__ = "0.2.0"

_F = TypeVar("_F", bound=Callable[..., object])


def safe(fn: _F) -> _F:
    """Marks a function as reviewed: the scanner leaves the calls in it alone. It changes nothing else."""
    return fn
