"""onceflow scan PATH... and onceflow audit LEDGER. Exit 0, or 1 for findings under --check and for refusals, 2 for usage and unwritable output."""

from __future__ import annotations

import argparse
import contextlib
import inspect
import os
import sys
import tempfile
from collections.abc import Callable, Iterator, Sequence
from typing import IO

from pyspark.sql import SparkSession

from onceflow import __version__
from onceflow.errors import LedgerError
from onceflow.operators.audit import conditions

#: What a ledger may be filtered by: the parameters of the operator that does it.
FILTERS = tuple(inspect.signature(conditions).parameters)


def _scan(spark: SparkSession, args: argparse.Namespace, out: IO[str]) -> int:
    from onceflow.operators.scanner import scan_roots, write_report

    findings, files = scan_roots(spark, [os.path.abspath(p) for p in args.paths])
    n = write_report(findings, files, out, args.format, os.getcwd())
    out.write("\n")
    return int(args.check and n > 0)


def _audit(spark: SparkSession, args: argparse.Namespace, out: IO[str]) -> int:
    from onceflow.operators.audit import audit, export
    from onceflow.sources.store import Ledger

    rows = audit(Ledger(spark, args.ledger).read(), limit=args.limit, **{k: getattr(args, k) for k in FILTERS})
    print(f"{export(rows, out, args.format)} rows", file=sys.stderr)
    return 0


#: Each command: what runs it, its help, its formats (the first is the default), and its own arguments.
COMMANDS: dict[str, tuple[Callable[..., int], str, tuple[str, ...], dict[str, dict]]] = {
    "scan": (_scan, "find consequential calls without a guard", ("text", "json", "sarif"), {"paths": {"nargs": "*", "default": ["."]}, "--check": {"action": "store_true"}}),
    "audit": (_audit, "query a ledger", ("json", "csv"), {"ledger": {}, **{f"--{f}": {} for f in FILTERS}, "--limit": {"type": int}}),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="onceflow")
    p.add_argument("--version", action="version", version=f"onceflow {__version__}")
    commands = p.add_subparsers(dest="command", required=True)
    for name, (_, text, formats, own) in COMMANDS.items():
        c = commands.add_parser(name, help=text)
        for arg, kind in (own | {"--format": {"choices": formats, "default": formats[0]}, "--output": {}}).items():
            c.add_argument(*(["-o"] if arg == "--output" else []), arg, **kind)
    return p


@contextlib.contextmanager
def _output(path: str | None) -> Iterator[IO[str]]:
    """Standard output, or a file that takes the place of an older one only when all of it has been written."""
    if path is None:
        yield sys.stdout
        return
    handle, aside = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".onceflow-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            yield out
        os.replace(aside, path)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(aside)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        with _output(args.output) as out:
            return COMMANDS[args.command][0](spark or SparkSession.builder.appName("onceflow").getOrCreate(), args, out)
    except LedgerError as e:
        print(f"onceflow: {e}", file=sys.stderr)
        return 1
    except OSError as e:  # the output can't be opened, or not written to the end
        print(f"onceflow: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
