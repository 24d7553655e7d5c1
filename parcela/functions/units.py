"""Amounts with units: a small grammar, exponent vectors and conversion to canonical units.

    amount  := noise* (unit noise*)* number (noise* unit)* noise*
    unit    := atom exponent? ( ("/" | "*" | "de" | blank) atom exponent? )*
    number  := digits with "." and "," as grouping or decimal mark

An atom has a scale, an offset and a vector of exponents over ``DIMENSIONS``. The atoms of an
amount multiply: scales multiply and exponents add, so "miles de UF" is 1000 UF^1. Currencies
are dimensions of their own; a rate such as pesos per UF is a factor of dimension CLP^1 UF^-1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

DIMENSIONS = ("UF", "CLP", "USD", "length", "mass", "time", "temperature")


def _dims(**powers: int) -> tuple[int, ...]:
    return tuple(powers.get(d, 0) for d in DIMENSIONS)


@dataclass(frozen=True)
class Unit:
    scale: float = 1.0
    offset: float = 0.0
    dims: tuple[int, ...] = _dims()

    def times(self, other: Unit, power: int = 1) -> Unit:
        """The product with ``other`` to a power; an offset survives only in a unit that stands alone."""
        alone = not any(self.dims) and self.scale == 1.0 and power == 1
        return Unit(self.scale * other.scale**power, other.offset if alone else 0.0, tuple(a + power * b for a, b in zip(self.dims, other.dims)))


_UF, _CLP, _USD = Unit(dims=_dims(UF=1)), Unit(dims=_dims(CLP=1)), Unit(dims=_dims(USD=1))
_MIL, _MILLON = Unit(1e3), Unit(1e6)

#: The spellings of unit atoms, in lower case without accents.
ATOMS: dict[str, Unit] = {
    "uf": _UF, "u.f.": _UF, "u.f": _UF, "unidades de fomento": _UF, "unidad de fomento": _UF, "clf": _UF,
    "clp": _CLP, "$": _CLP, "peso": _CLP, "pesos": _CLP, "pesos chilenos": _CLP,
    "us$": _USD, "u$s": _USD, "usd": _USD, "us": _USD, "dolar": _USD, "dolares": _USD, "usd$": _USD,
    "mil": _MIL, "miles": _MIL, "k": _MIL, "lucas": _MIL.times(_CLP), "luca": _MIL.times(_CLP), "m$": _MIL.times(_CLP),
    "mm": _MILLON, "millon": _MILLON, "millones": _MILLON, "mill": _MILLON, "mill.": _MILLON, "mm$": _MILLON.times(_CLP),
    "palos": _MILLON.times(_CLP), "palo": _MILLON.times(_CLP),
    "m": Unit(dims=_dims(length=1)), "mt": Unit(dims=_dims(length=1)), "mts": Unit(dims=_dims(length=1)), "metro": Unit(dims=_dims(length=1)),
    "metros": Unit(dims=_dims(length=1)), "cm": Unit(0.01, dims=_dims(length=1)), "km": Unit(1e3, dims=_dims(length=1)),
    "ft": Unit(0.3048, dims=_dims(length=1)), "pies": Unit(0.3048, dims=_dims(length=1)), "ha": Unit(1e4, dims=_dims(length=2)),
    "hectarea": Unit(1e4, dims=_dims(length=2)), "hectareas": Unit(1e4, dims=_dims(length=2)), "m2": Unit(dims=_dims(length=2)),
    "mt2": Unit(dims=_dims(length=2)), "mts2": Unit(dims=_dims(length=2)), "m3": Unit(dims=_dims(length=3)),
    "kg": Unit(dims=_dims(mass=1)), "g": Unit(1e-3, dims=_dims(mass=1)), "mes": Unit(2629746.0, dims=_dims(time=1)), "ano": Unit(31556952.0, dims=_dims(time=1)),
    "h": Unit(3600.0, dims=_dims(time=1)), "s": Unit(dims=_dims(time=1)),
    "kelvin": Unit(dims=_dims(temperature=1)), "°c": Unit(1.0, 273.15, _dims(temperature=1)), "°f": Unit(5 / 9, 459.67 * 5 / 9, _dims(temperature=1)),
}

#: Words that say nothing about the unit.
NOISE = ("aprox.", "aprox", "aproximado", "aproximadamente", "desde", "valor", "precio", "mensual", "mensuales", "c/u", "+", "~", ".-", "-", ":", "(", ")", ".", ",")

_POWER = re.compile(r"\^?(-?\d)(?!\d)")
_SUPERSCRIPT = str.maketrans("²³", "23")
_LEXEME = re.compile("|".join(re.escape(a) + (r"(?![a-z$])" if a[-1].isalpha() else "") for a in sorted([*ATOMS, *NOISE, "de", "/", "*", "por"], key=len, reverse=True)))
_NUMBER = re.compile(r"-?\d+(?:[.,'’   ]?\d+)*")
_GROUPED = re.compile(r"[1-9]\d{0,2}[.,]\d{3}")


def plain(text: str) -> str:
    """Lower case, compatibility forms composed, accents off, outer blanks off."""
    if text.isascii():
        return text.lower().strip()
    kept = text.translate(_SUPERSCRIPT)
    return "".join(c for c in unicodedata.normalize("NFKD", kept.lower()) if not unicodedata.combining(c)).strip()


@lru_cache(maxsize=1 << 14)
def parse_unit(text: str) -> Unit | None:
    """The product of the atoms in ``text`` (plain form); null if anything in it is unknown."""
    unit, at, power = Unit(), 0, 1
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        m = _LEXEME.match(text, at)
        if m is None:
            return None
        word, at = m.group(), m.end()
        if word == "/":
            power = -1
        elif word in ATOMS:
            exponent = _POWER.match(text, at)
            # "m2" is an atom of its own; "m^2" and "m 2" only with the mark or directly after
            if exponent:
                at = exponent.end()
            unit, power = unit.times(ATOMS[word], power * int(exponent.group(1)) if exponent else power), 1
    return unit


def read_number(text: str, scaled: bool) -> float | None:
    """The number written in ``text``; ``scaled``: a word such as thousands or millions goes with it.

    Two different marks: the last is the decimal one. One mark more than once groups digits. A
    single mark before exactly three digits groups too ("1.685", "130,000"), unless a zero leads
    or a comma goes with a scale word ("2,721 mil UF"). Otherwise it is the decimal mark.
    """
    s = re.sub(r"['’   ]", "", text)
    dots, commas = s.count("."), s.count(",")
    if dots and commas:
        last = max(s.rfind("."), s.rfind(","))
        s = re.sub("[.,]", "", s[:last]) + "." + s[last + 1 :]
    elif dots > 1 or commas > 1:
        s = re.sub("[.,]", "", s)
    elif dots or commas:
        if _GROUPED.fullmatch(s.lstrip("-")) and not (commas and scaled):
            s = re.sub("[.,]", "", s)
        else:
            s = s.replace(",", ".")
    try:
        return float(s)
    except ValueError:
        return None


@dataclass(frozen=True)
class Amount:
    value: float  # in the unit as written
    unit: Unit

    @property
    def base(self) -> float:
        """In the base units of its dimensions."""
        return self.value * self.unit.scale + self.unit.offset


def parse_amount(text: str | None) -> Amount | None:
    """The amount written in ``text``; null for null, blank, words without a number and unknown units."""
    if text is None:
        return None
    s = plain(text)
    numbers = list(_NUMBER.finditer(s))
    if len(numbers) > 1:  # digits that belong to a unit ("m2") are no number of their own
        numbers = [m for m in numbers if not (m.start() and s[m.start() - 1].isalpha() and s[: m.end()].endswith(("m2", "m3", "mt2", "mts2")))]
    if len(numbers) != 1:
        return None
    m = numbers[0]
    before, after = parse_unit(s[: m.start()].strip()), parse_unit(s[m.end() :].strip())
    if before is None or after is None:
        return None
    unit = before.times(after) if any(before.dims) or before.scale != 1.0 else after
    if before.dims == after.dims and any(before.dims):  # "$ 100 pesos" names its unit twice
        unit = Unit(before.scale * after.scale, 0.0, before.dims)
    value = read_number(m.group(), unit.scale >= 1e3)
    return None if value is None else Amount(value, unit)


@dataclass(frozen=True)
class Plausible:
    """Where a number without currency lies between ``above`` and ``upto``, it stands in ``factor`` x ``currency``."""

    currency: str
    factor: float
    above: float
    upto: float


#: Prices in UF of listings end near 100,000; a larger bare price is in pesos.
PRICE_RANGES = (Plausible("UF", 1, 0, 1e5), Plausible("CLP", 1, 1e5, float("inf")))
#: Monthly expenses: up to 18 UF, 18 to 5,000 thousands of pesos, and pesos beyond.
EXPENSE_RANGES = (Plausible("UF", 1, 0, 18), Plausible("CLP", 1e3, 18, 5e3), Plausible("CLP", 1, 5e3, float("inf")))

_SUFFIX = {1.0: "", 1e3: "_MIL", 1e6: "_MM"}


@dataclass(frozen=True)
class Money:
    value: float  # in units of ``code``
    code: str  # CLP, CLP_MIL, CLP_MM, USD, UF, UF_MIL ...
    base: float  # in whole ``currency``
    currency: str


def parse_money(text: str | None, ranges: Sequence[Plausible]) -> Money | None:
    """An amount of money with its unit; a missing currency is the one in which it is plausible.

    Null for what holds no number, for units that aren't money and for amounts that fit no range.
    """
    a = parse_amount(text)
    if a is None:
        return None
    if any(a.unit.dims):
        named = [d for d, p in zip(DIMENSIONS, a.unit.dims) if p]
        if len(named) != 1 or named[0] not in ("UF", "CLP", "USD") or max(a.unit.dims) != 1:
            return None
        scale, currency, base = a.unit.scale, named[0], a.base
    else:
        fit = next((r for r in ranges if r.above < a.base <= r.upto), ranges[0] if a.base <= 0 else None)
        if fit is None:
            return None
        scale, currency, base = a.unit.scale * fit.factor, fit.currency, a.base * fit.factor
    return Money(base / scale, currency + _SUFFIX.get(scale, f"_E{scale:g}"), base, currency)
