"""What goes wrong, by kind. The set-based operators report outcomes as data; these are for the strict, per-call surface."""

from __future__ import annotations


class LedgerError(Exception):
    """Any refusal of the engine."""


class NoCoordinate(LedgerError):
    """An effect without a stable identity, or with two."""


class DivergentRetry(LedgerError):
    """A key that comes back with other identity arguments."""


class RegeneratedDuplicate(LedgerError):
    """Reserved: the same action under another plan epoch."""


class AmbiguousOutcome(LedgerError):
    """Nobody can know whether the effect happened."""


class EffectInFlight(LedgerError):
    """The effect is being executed, or a crash left it so."""


class SchemeMismatch(LedgerError):
    """Evidence under another key or fingerprint scheme, or a signing secret that has left the keyring."""


class CanonicalizationError(LedgerError):
    """A value without a canonical form."""


class NormalizerError(LedgerError):
    """A value that a declared normalizer can't take."""


class DeclarationError(LedgerError):
    """A declaration document that is malformed or can't be honoured."""


class LedgerNotFound(LedgerError):
    """No ledger at the path: never read as an empty history."""


class CommitConflict(LedgerError):
    """Another writer committed first; decide again."""


#: Outcomes of the set-based decisions and the error that strict mode raises for each.
STRICT = {
    "DIVERGENT": DivergentRetry,
    "AMBIGUOUS": AmbiguousOutcome,
    "IN_FLIGHT": EffectInFlight,
    "SCHEME_MISMATCH": SchemeMismatch,
    "NO_COORDINATE": NoCoordinate,
}


def raise_first(rows) -> None:
    """Raises for the first row (key, outcome) whose outcome is an error."""
    for row in rows:
        if kind := STRICT.get(row["outcome"]):
            raise kind(f"{row['key']}: {row['outcome'].lower()}")
