"""Normalizers of identity strings, as Columns and as Python functions: trim, nfc-trim, email, phone-e164, url-canonical, money.

The Column forms run in the JVM on strings in normal form C (every ASCII string is); `nfc` brings others there through an Arrow UDF,
Spark having no function for it. A value that a normalizer can't take gives null as a Column, NormalizerError in Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from decimal import Decimal, InvalidOperation

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from onceflow.errors import NormalizerError
from onceflow.functions.identity import strip

#: scheme, authority, path, query of any string: the expression of RFC 3986, appendix B.
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: user information, host (an IPv6 address in brackets), port of an authority.
_AUTHORITY = r"(?s)^(?:(.*)@)?(\[[^\]]*\]|[^:]*)(?::(.*))?$"
DEFAULT_PORTS = {"http": "80", "https": "443"}


def nfc(s: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            plain = pc.all(pc.string_is_ascii(b)).as_py()
            yield b if plain is not False else pa.array([x and unicodedata.normalize("NFC", x) for x in b.to_pylist()], pa.string())

    return run(s)


def trim(s: Column) -> Column:
    return strip(s)


def nfc_trim(s: Column) -> Column:
    return strip(nfc(s))


def email(s: Column, *, is_nfc: bool = False) -> Column:
    return F.lower(strip(s if is_nfc else nfc(s)))


def phone_e164(s: Column) -> Column:
    return F.concat(F.when(strip(s).startswith("+"), "+").otherwise(""), F.regexp_replace(s, "[^0-9]", ""))


def url_canonical(s: Column) -> Column:
    """Scheme and host lowered, a default port and the fragment gone; null where the port is no number below 65536. The brackets of
    an IPv6 host stay."""
    part = lambda i: F.regexp_extract(strip(s), _URL, i)
    scheme, authority = F.lower(part(1)), part(2)
    of = lambda i: F.regexp_extract(authority, _AUTHORITY, i)
    user, host, port = of(1), F.lower(of(2)), of(3)
    number = F.regexp_replace(port, "^0+(?=.)", "")
    shown = (port != "") & ~F.coalesce(F.create_map(*[F.lit(x) for p in DEFAULT_PORTS.items() for x in p])[scheme] == number, F.lit(False))
    net = F.concat(F.when(F.contains(authority, F.lit("@")), F.concat(user, F.lit("@"))).otherwise(""), host, F.when(shown, F.concat(F.lit(":"), number)).otherwise(""))
    out = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(net != "", F.concat(F.lit("//"), net)).otherwise(""), part(3), F.when(part(4) != "", F.concat(F.lit("?"), part(4))).otherwise(""))
    return F.when((port == "") | (port.rlike("^[0-9]+$") & (F.try_to_number(F.lpad(number, 5, "0"), F.lit("99999")) < 65536) & (F.length(number) < 6)), out)


def money(s: Column) -> Column:
    """A plain decimal without trailing zeros; null where there is no amount. Up to 38 digits, 18 of them after the point."""
    clean = F.regexp_replace(s, "[^0-9.-]", "")
    value = clean.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    text = F.when(value, clean)
    sign, digits = F.when(text.startswith("-"), "-").otherwise(""), F.regexp_replace(text, "^-", "")
    whole = F.regexp_replace(F.regexp_extract(digits, r"^([0-9]*)", 1), "^0+", "")
    fraction = F.regexp_replace(F.regexp_extract(digits, r"\.([0-9]*)$", 1), "0+$", "")
    number = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))
    return F.when(text.isNull(), None).when(number == "0", "0").otherwise(F.concat(sign, number))


COLUMNS: dict[str, Callable[[Column], Column]] = {"trim": trim, "nfc-trim": nfc_trim, "email": email, "phone-e164": phone_e164, "url-canonical": url_canonical, "money": money}


# -- in Python, for the per-call surface


def _url(s: str) -> str:
    scheme, authority, path, query = (x or "" for x in re.match(_URL, s.strip()).groups())
    user, host, port = re.match(_AUTHORITY, authority).groups()
    scheme = scheme.lower()
    if port and not (port.isascii() and port.isdigit() and int(port) < 65536):
        raise NormalizerError(f"not a port: {port!r}")
    shown = f":{int(port)}" if port and str(int(port)) != DEFAULT_PORTS.get(scheme) else ""
    net = (f"{user}@" if user is not None else "") + host.lower() + shown
    return (f"{scheme}:" if scheme else "") + (f"//{net}" if net else "") + path + (f"?{query}" if query else "")


def _money(s: str) -> str:
    clean = re.sub("[^0-9.-]", "", s)
    try:
        value = Decimal(clean).normalize()
    except InvalidOperation as e:
        raise NormalizerError(f"no amount in {s!r}") from e
    return format(abs(value) if not value else value, "f")  # there is no negative zero


PYTHON: dict[str, Callable[[str], str]] = {
    "trim": str.strip,
    "nfc-trim": lambda s: unicodedata.normalize("NFC", s).strip(),
    "email": lambda s: unicodedata.normalize("NFC", s).strip().lower(),
    "phone-e164": lambda s: "+" * s.lstrip().startswith("+") + re.sub("[^0-9]", "", s),
    "url-canonical": _url,
    "money": _money,
}
NAMES = frozenset(PYTHON)


def normalize(name: str, value: str) -> str:
    if name not in PYTHON:
        raise NormalizerError(f"no normalizer {name!r}; there are {sorted(NAMES)}")
    return PYTHON[name](value)
