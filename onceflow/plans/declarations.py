"""Declarations of tools: which arguments are identity, what a provider can promise, and the document format they come in.

The control plane is small and stays on the driver; `declarations_frame` is the table that decisions join with, one row a tool.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onceflow.errors import DeclarationError, LedgerError
from onceflow.functions import canonical as C
from onceflow.functions import normalizers as N

log = logging.getLogger("onceflow.declarations")

IDENTITY, CONTENT, VOLATILE = "identity", "content", "volatile"


def catches_timeouts(kind: type[BaseException]) -> bool:
    """Whether an exception type would also take a timeout for a clean failure."""
    return issubclass(TimeoutError, kind) or any("timeout" in c.__name__.lower() for c in kind.__mro__)


@dataclass(frozen=True)
class Declaration:
    """What is known of a tool. An argument without a class has the default one; undeclared arguments are identity."""

    tool: str
    classes: Mapping[str, str] = field(default_factory=dict)
    default: str = IDENTITY
    normalizers: Mapping[str, str] = field(default_factory=dict)
    provider_key_param: str | None = None
    provider_ttl_s: float | None = None
    clean_failures: tuple[type[BaseException], ...] = ()
    reconcile: Callable[[str], Any] | None = None
    on_absent: str = "surface"
    provider_read: str = "eventual"

    def __post_init__(self) -> None:
        refuse = lambda why: LedgerError(f"{self.tool}: {why}")
        if unknown := sorted(set(self.normalizers.values()) - N.NAMES):
            raise refuse(f"no normalizer {unknown[0]!r}; there are {sorted(N.NAMES)}")
        if broad := [k.__name__ for k in self.clean_failures if catches_timeouts(k)]:
            raise refuse(f"{broad[0]} also means a timeout, after which the effect may have happened; it is no clean failure")
        if self.on_absent not in ("surface", "retry"):
            raise refuse(f"on_absent is surface or retry, not {self.on_absent!r}")
        if self.provider_read not in ("strong", "eventual"):
            raise refuse(f"provider_read is strong or eventual, not {self.provider_read!r}")
        if self.on_absent == "retry" and self.provider_read != "strong":
            raise refuse("retrying what a read did not find needs a strong read; an eventual one may miss an effect that happened")

    @property
    def provider_dedup(self) -> bool:
        return self.provider_key_param is not None

    @property
    def level(self) -> str:
        return {(True, True): "L2R", (False, True): "L1", (True, False): "L2"}.get((bool(self.provider_key_param), self.reconcile is not None), "L0")

    def class_of(self, arg: str) -> str:
        return self.classes.get(arg, self.default)

    def identity(self, named: Mapping[str, Any]) -> dict[str, Any]:
        """The identity arguments of one call, strings normalized as declared."""
        chosen = {k: v for k, v in named.items() if self.class_of(k) == IDENTITY}
        return {k: N.normalize(self.normalizers[k], v) if k in self.normalizers and isinstance(v, str) else v for k, v in chosen.items()}

    def message(self, schema: T.StructType, *, present: Mapping[str, Column] | None = None) -> Column:
        """Canonical bytes of the identity arguments held in columns, chosen when the plan is made. Normalizers take string columns only.

        A column can't be absent, which differs from null: `present` gives, for arguments that may be missing from a call, whether they are there."""
        fields = [f for f in schema.fields if self.class_of(f.name) == IDENTITY]
        encoded = []
        for f in fields:
            value = F.col(f.name)
            if isinstance(f.dataType, T.StringType) and f.name in self.normalizers:
                value = N.COLUMNS[self.normalizers[f.name]](value)
            encoded.append((f.name, C.canonical(value, f.dataType) if C.native(f.dataType) else C.canonical_udf(value)))
        if not present:
            return C.mapping(encoded)
        ordered = sorted(encoded, key=lambda e: C.encode(e[0]))
        there = [present.get(name, F.lit(True)) for name, _ in ordered]
        parts = [F.when(p, F.concat(C.binary(C.encode(name)), value)).otherwise(C.binary("")) for (name, value), p in zip(ordered, there, strict=True)]
        return F.concat(C.binary("M"), C.count(sum((p.cast("long") for p in there), F.lit(0))), *parts)


def level_column(provider_key: Column, reconcile: Column) -> Column:
    """The rung that capabilities give: L2R for both, L1 for a read, L2 for a key, else L0."""
    return F.when(provider_key & reconcile, "L2R").when(reconcile, "L1").when(provider_key, "L2").otherwise("L0")


class Registry:
    """Declarations by tool. A tool declared twice must be declared alike, normalizers included."""

    def __init__(self, declarations: Iterable[Declaration] = ()):
        self._by_tool: dict[str, Declaration] = {}
        for d in declarations:
            self.add(d)

    def add(self, d: Declaration) -> Declaration:
        shape = lambda x: (dict(x.classes), x.default, dict(x.normalizers), x.provider_key_param, x.provider_ttl_s, x.clean_failures, x.reconcile is None, x.on_absent, x.provider_read)
        old = self._by_tool.setdefault(d.tool, d)
        if shape(old) != shape(d):
            raise LedgerError(f"{d.tool} is declared in two ways")
        return old

    def __getitem__(self, tool: str) -> Declaration:
        return self._by_tool[tool]

    def __contains__(self, tool: str) -> bool:
        return tool in self._by_tool

    def __iter__(self):
        return iter(self._by_tool.values())

    def frame(self, spark: SparkSession) -> DataFrame:
        """tool, level, provider_dedup, provider_ttl_s, reconcilable, has_reconcile, on_absent."""
        rows = [(d.tool, d.level, d.provider_dedup, d.provider_ttl_s, d.reconcile is not None, d.reconcile is not None, d.on_absent) for d in self]
        return spark.createDataFrame(rows, "tool string, level string, provider_dedup boolean, provider_ttl_s double, reconcilable boolean, has_reconcile boolean, on_absent string")


# -- the document format: a table of fields drives reading, writing and refusing

#: Fixed values of the format, version 1.
MAJOR = 1
DOCUMENT_LEVELS = ("l0am", "l0al", "l1", "l2", "l2r", "l3")
OF_LEVEL = {"L0": "l0am", "L1": "l1", "L2": "l2", "L2R": "l2r"}
IDENTITY_TYPES = ("money", "account", "email", "phone", "card", "iban")

_STR, _NUM, _BOOL, _INT, _STRS = "a string", "a number of 0 and more", "true or false", "an integer", "a list of strings"


@dataclass(frozen=True)
class _Field:
    kind: str
    default: Any = None
    among: tuple[str, ...] | None = None
    needed: bool = False


_REFETCH = {"ref": _Field(_STR, needed=True), "fields": _Field(_STRS, ())}
_BLOCKS: dict[str, dict[str, _Field]] = {
    "args": {"class": _Field(_STR, IDENTITY, (IDENTITY, CONTENT, VOLATILE)), "normalize": _Field(_STR, None, tuple(sorted(N.NAMES))), "type": _Field(_STR), "force": _Field(_BOOL, False)},
    "provider_key": {"param": _Field(_STR, needed=True), "ttl_s": _Field(_NUM), "encoding": _Field(_STR)},
    "reconcile": {"ref": _Field(_STR, needed=True), "window_s": _Field(_NUM), "provider_read": _Field(_STR, "eventual", ("eventual", "strong"))},
    "result": {"replay": _Field(_STR, "value", ("value", "marker", "refetch")), "refetch": _Field("a mapping")},
    "ambiguous": {"default": _Field(_STR, "halt", ("halt", "retry")), "escalate_after_s": _Field(_NUM)},
    "fingerprint": {"version": _Field(_INT, 1)},
}
_TOP = ("sed", "tool", "level", *_BLOCKS)


def _is(kind: str, v: Any) -> bool:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {_STR: isinstance(v, str), _NUM: number and v >= 0, _BOOL: isinstance(v, bool), _INT: isinstance(v, int) and not isinstance(v, bool), _STRS: isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v)}.get(kind, isinstance(v, Mapping))


def _block(raw: Any, fields: dict[str, _Field], where: str) -> dict[str, Any]:
    """A block's fields with defaults. Unknown names are refused, unless private (x-...)."""
    if not isinstance(raw, Mapping):
        raise DeclarationError(f"{where}: a mapping is needed")
    if unknown := [k for k in raw if k not in fields and not str(k).startswith("x-")]:
        raise DeclarationError(f"{where}: no field {unknown[0]!r}; there are {sorted(fields)}")
    out = {}
    for name, f in fields.items():
        v = raw.get(name)
        if v is None or (f.needed and v == ""):
            if f.needed:
                raise DeclarationError(f"{where}.{name} is missing")
            v = f.default
        elif not _is(f.kind, v):
            raise DeclarationError(f"{where}.{name} must be {f.kind}, not {v!r}")
        elif f.among and v not in f.among:
            raise DeclarationError(f"{where}.{name}: {v!r} is none of {list(f.among)}")
        out[name] = float(v) if f.kind == _NUM and v is not None else tuple(v) if f.kind == _STRS else v
    return out


@dataclass(frozen=True)
class Document:
    """A parsed document: blocks as mappings with all their fields, None where a block is absent."""

    tool: str
    level: str | None
    args: Mapping[str, Mapping[str, Any]]
    blocks: Mapping[str, Mapping[str, Any] | None]

    def __getitem__(self, block: str) -> Mapping[str, Any] | None:
        return self.blocks[block]


def parse(raw: Any) -> Document:
    """Checks a document. Unknown blocks at the top are noted and left; all else unknown is refused."""
    if not isinstance(raw, Mapping):
        raise DeclarationError("a document is a mapping")
    if not _is(_INT, raw.get("sed")) or raw["sed"] != MAJOR:
        raise DeclarationError(f"major version {raw.get('sed')!r}; {MAJOR} is implemented")
    for k in raw:
        if k not in _TOP:
            log.warning("unknown block %r is ignored", k)
    head = _block({k: v for k, v in raw.items() if k in ("tool", "level")}, {"tool": _Field(_STR, needed=True), "level": _Field(_STR)}, "document")
    level = head["level"] and head["level"].lower()
    if level and level not in DOCUMENT_LEVELS:
        raise DeclarationError(f"level {level!r} is none of {list(DOCUMENT_LEVELS)}")
    args = {}
    given = raw.get("args") if raw.get("args") is not None else {}
    if not isinstance(given, Mapping):
        raise DeclarationError("args: a mapping is needed")
    for name, spec in given.items():
        args[name] = a = _block(spec, _BLOCKS["args"], f"args.{name}")
        if a["class"] == CONTENT and (a["type"] in IDENTITY_TYPES or name == "id" or name.endswith("_id")):
            if not a["force"]:
                raise DeclarationError(f"args.{name} reads like identity; as content, duplicates would pass: force says it is meant")
            log.warning("args.%s is identity forced to content", name)
    blocks: dict[str, Mapping[str, Any] | None] = {}
    for name in ("provider_key", "reconcile", "result", "ambiguous", "fingerprint"):
        there = raw.get(name) is not None
        needs = any(f.needed for f in _BLOCKS[name].values())
        blocks[name] = _block(raw[name] if there else {}, _BLOCKS[name], name) if there or not needs else None
    result = dict(blocks["result"])
    if result["refetch"] is not None:
        result["refetch"] = _block(result["refetch"], _REFETCH, "result.refetch")
    elif result["replay"] == "refetch":
        raise DeclarationError("result.replay refetch needs result.refetch")
    blocks["result"] = result
    for name, levels in (("provider_key", ("l2", "l2r")), ("reconcile", ("l1", "l2r"))):
        if level in levels and blocks[name] is None:
            raise DeclarationError(f"level {level} needs a {name} block")
    return Document(head["tool"], level, args, blocks)


def emit(doc: Document) -> dict[str, Any]:
    """A mapping that parses to the same document; fields at their defaults are left out."""
    slim = lambda block, name: {k: v for k, v in block.items() if v != _BLOCKS[name][k].default or _BLOCKS[name][k].needed}
    out: dict[str, Any] = {"sed": MAJOR, "tool": doc.tool} | ({"level": doc.level} if doc.level else {})
    if doc.args:
        out["args"] = {k: {"class": a["class"]} | slim(a, "args") for k, a in doc.args.items()}
    for name, block in doc.blocks.items():
        if block is not None and (kept := slim(block, name)):
            if kept.get("refetch") is not None:
                kept["refetch"] = {"ref": kept["refetch"]["ref"], "fields": list(kept["refetch"]["fields"])}
            out[name] = kept
    return out


def bind(doc: Document, reads: Mapping[str, Callable[[str], Any]]) -> Declaration:
    """The declaration that a document means. reads: the callables that reconcile.ref may name, an allow-list; nothing is imported.

    What can't be honoured, and would weaken the guarantee, is refused; what is only not enforced is noted."""
    refuse = {
        "that fingerprint version is not implemented": doc["fingerprint"]["version"] != 1,
        f"level {doc.level} is not implemented": doc.level in ("l3", "l0al"),
        "only result.replay value is implemented": doc["result"]["replay"] != "value" or doc["result"]["refetch"] is not None,
        "the provider key is given as 64 hex digits; no other encoding": bool(doc["provider_key"]) and doc["provider_key"]["encoding"] not in (None, "hex"),
        "a normalizer for all arguments is not implemented": doc.args.get("*", {}).get("normalize") is not None,
    }
    for why, so in refuse.items():
        if so:
            raise DeclarationError(f"{doc.tool}: {why}")
    for what, so in {"ambiguous.default retry": doc["ambiguous"]["default"] != "halt", "ambiguous.escalate_after_s": doc["ambiguous"]["escalate_after_s"] is not None, "reconcile.window_s": bool(doc["reconcile"]) and doc["reconcile"]["window_s"] is not None}.items():
        if so:
            log.warning("%s: %s is not enforced", doc.tool, what)
    read = None
    if doc["reconcile"]:
        ref = doc["reconcile"]["ref"]
        if ref not in reads:
            raise DeclarationError(f"{doc.tool}: reconcile.ref {ref!r} is not among the reads allowed")
        read = reads[ref]
    named = {k: a for k, a in doc.args.items() if k != "*"}
    d = Declaration(
        doc.tool, {k: a["class"] for k, a in named.items()}, doc.args.get("*", {"class": IDENTITY})["class"], {k: a["normalize"] for k, a in named.items() if a["normalize"]},
        doc["provider_key"] and doc["provider_key"]["param"], doc["provider_key"] and doc["provider_key"]["ttl_s"], (), read, "surface", doc["reconcile"]["provider_read"] if doc["reconcile"] else "eventual",
    )
    if doc.level and OF_LEVEL[d.level] != doc.level:
        raise DeclarationError(f"{doc.tool}: level {doc.level} is declared, the blocks give {OF_LEVEL[d.level]}")
    return d


def load(raw: Any, reads: Mapping[str, Callable[[str], Any]] | None = None) -> Declaration:
    return bind(parse(raw), reads or {})


def unbind(d: Declaration, ref: str | None = None) -> Document:
    """The document of a declaration; on_absent and clean_failures have no place in one. ref names the read."""
    if d.reconcile is not None and not ref:
        raise DeclarationError(f"{d.tool}: the read needs a name")
    raw: dict[str, Any] = {"sed": MAJOR, "tool": d.tool, "level": OF_LEVEL[d.level], "args": {k: {"class": c, "normalize": d.normalizers.get(k), "force": c == CONTENT} for k, c in d.classes.items()} | ({} if d.default == IDENTITY else {"*": {"class": d.default}})}
    if d.provider_key_param:
        raw["provider_key"] = {"param": d.provider_key_param, "ttl_s": d.provider_ttl_s}
    if d.reconcile is not None:
        raw["reconcile"] = {"ref": ref, "provider_read": d.provider_read}
    return parse(raw)
