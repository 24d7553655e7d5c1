"""Columns read from the raw listing fields; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing value, compared in lower case without outer blanks.
MISSING_WORDS = (
    "", "-", "--", "n/a", "na", "nan", "none", "null", "s/i", "s/d", "sin informacion", "sin información", "no informado",
    "no informada", "sin dato", "sin datos", "no disponible", "no aplica", "nd", "n/d",
)

_ISO = r"^\s*\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?\s*(?:Z|z|[+-]\d{2}(?::?\d{2})?)?\s*$"
_LOCAL = r"^\s*(\d{2})[-/](\d{2})[-/](\d{4})[ T](\d{2}:\d{2}:\d{2})\s*$"
_UNZONED = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?)$"


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind (``trim`` alone drops only spaces)."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def is_missing(c: Column) -> Column:
    """True for null, blank, a dash and words for "nothing" or "not given"."""
    return c.isNull() | F.lower(trimmed(c)).isin(*MISSING_WORDS)


def aviso(url: Column) -> Column:
    """The first number of exactly ten digits in the address, as bigint; null where there is none."""
    return F.regexp_extract(url, r"(?<!\d)(\d{10})(?!\d)", 1).try_cast("bigint")


def instant(text: Column, local_offset: str = "-03:00") -> Column:
    """The instant (microseconds since 1970 in UTC, bigint) of a time in any of the known notations.

    ISO dates with a blank or T, fraction, Z or an offset of hours or hours and minutes, and
    day-month-year. A time without offset is local, ``local_offset`` from UTC. Null if unreadable.
    """
    bare = F.regexp_replace(text, r"^\s+|\s+(?=[Zz+\-]\S*\s*$)|\s+$", "")
    iso = F.regexp_replace(bare, _LOCAL, "$3-$2-$1 $4")
    zoned = F.regexp_replace(iso, _UNZONED, "$1" + local_offset)
    return F.unix_micros(F.when(text.rlike(_ISO + "|" + _LOCAL), zoned).try_cast("timestamp"))


def local_day(at: Column, local_offset_hours: int = -3) -> Column:
    """The local calendar day of an instant."""
    return F.date_from_unix_date(F.floor((at + F.lit(local_offset_hours * 3_600_000_000)) / F.lit(86_400_000_000.0)).cast("int"))
