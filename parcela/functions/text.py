"""String columns: transliteration, cleaning, truncation and normal forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that become several ASCII characters, or a single one by custom.
SPELLED = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ", "—": "--", "…": "...", "«": "<<", "»": ">>",
    "©": "(c)", "®": "(r)", "™": "tm", "°": "deg", "€": "EUR", "½": "1/2", "¼": "1/4", "¾": "3/4", "№": "No", "±": "+-", "§": "SS", "£": "PS", "¥": "Y=", "¢": "C/",
    "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff",
}
#: How letters of other scripts are spelled, in their alphabets' order.
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split()))
_CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e io zh z i i k l m n o p r s t u f kh ts ch sh shch \" y ' e iu ia".split()))
for _a, _b in (_GREEK | _CYRILLIC).items():
    SPELLED |= {_a: _b, _a.upper(): _b.capitalize()} if _a != "ς" else {_a: _b}
_SINGLE = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i", "ŧ": "t", "Ŧ": "T", "ħ": "h", "Ħ": "H", "–": "-", "‐": "-", "‑": "-", "‒": "-",
    "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "¿": "?", "¡": "!", "º": "o", "ª": "a", "·": "*", "•": "*", "´": "'", "`": "`", "¨": '"', "¬": "!", "µ": "u", "¶": "P",
    "¸": ",", "×": "x", "÷": "/", "¦": "|", "²": "2", "³": "3", "¹": "1", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}


def _bases(start: int, stop: int, keep_ascii: bool) -> dict[str, str]:
    """By rule: each character whose decomposition is one base character and marks, with its base."""
    out = {}
    for cp in range(start, stop):
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c and (base.isascii() or not keep_ascii):
            out[c] = base
    return out


#: One character for one, for ASCII output.
ASCII_TABLE = _bases(0xC0, 0x250, True) | _bases(0x1E00, 0x1F00, True) | _SINGLE | {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
#: One character for one, without marks, in the scripts below U+2000.
ACCENT_TABLE = _bases(0xC0, 0x2000, False)

#: The white space of Python's and Unicode's definitions.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it. Without it, an
    expression of expressions grows with the product of their mentions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def transliterate(c: Column) -> Column:
    """Latin letters, digits and punctuation as ASCII; characters without a spelling are dropped."""
    out = F.translate(c, "".join(ASCII_TABLE), "".join(ASCII_TABLE.values()))

    def spelled(x: Column) -> Column:
        known = F.create_map(*[F.lit(y) for pair in SPELLED.items() for y in pair])
        kept = F.regexp_replace(x, f"[^\\x00-\\x7F{''.join(SPELLED)}]+", "")
        return F.array_join(F.transform(F.split(kept, ""), lambda y: F.coalesce(F.try_element_at(known, y), y)), "")

    # few texts still hold another character: one scan tells
    return let(out, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), spelled(x)).otherwise(x))


def clean_string(c: Column) -> Column:
    """Text for payload and blob: a quoted list is opened, then ASCII, tags off, white space collapsed,
    other marks than ``.,!?-()`` blanked, outer blanks off. Case stays; blanks made by the last
    replacement stay too. Null gives the empty text."""
    inner = lambda x: F.substring(x, F.lit(3), F.length(x) - 4)
    opened = lambda x: F.replace(F.replace(inner(x), F.lit('"""'), F.lit('"')), F.lit("\\n"), F.lit(" "))
    s = let(F.coalesce(c.cast("string"), F.lit("")), lambda x: F.when(x.startswith('"[') & x.endswith(']"'), opened(x)).otherwise(x))
    s = transliterate(s)
    s = F.regexp_replace(s, "<[^>]+>", "")
    s = F.regexp_replace(s, r"[\s\x1c-\x1f]{2,}|[\t\n\x0b\f\r\x1c-\x1f]", " ")
    s = F.regexp_replace(s, r"[^\w\s.,!?\-()]", " ")
    return F.trim(s)


#: ``clean_text`` in tables: the spelling of each character that has one, and each ASCII character or, if it isn't kept, a blank.
_SPELLINGS = ASCII_TABLE | SPELLED
_KEPT = "".join(chr(k) if re.match(r"[\w\s.,!?\-()]", chr(k)) else " " for k in range(128))
_FOREIGN, _TAG, _WHITE = re.compile(r"[^\x00-\x7f]"), re.compile("<[^>]+>"), re.compile(r"\s{2,}|[\t\n\x0b\f\r\x1c-\x1f]")


def clean_text(s: str | None) -> str:
    """``clean_string`` of one text."""
    if not s:
        return ""
    if s.startswith('"[') and s.endswith(']"'):
        s = s[2:-2].replace('"""', '"').replace("\\n", " ") if len(s) > 3 else ""
    if not s.isascii():
        s = _FOREIGN.sub(lambda m: _SPELLINGS.get(m[0], ""), s)
    if "<" in s:
        s = _TAG.sub("", s)
    return _WHITE.sub(" ", s).translate(_KEPT).strip(" ")


def clip_text(s: str, size: int) -> str:
    """``truncated`` of one text."""
    return s if len(s) <= size else s[:size] + "..."


@F.pandas_udf(StringType())
def cleaned(texts: pd.Series) -> pd.Series:
    """``clean_string`` in Arrow batches, each distinct text once. Where every row needs it, this is
    several times faster than the expression, whose translations and patterns walk each text anew;
    the expression serves where it is reached for few rows only."""
    codes, distinct = pd.factorize(texts)
    out = np.array([*map(clean_text, distinct), ""], dtype=object)
    return pd.Series(out[codes])  # code -1 (null) is the last


def truncated(c: Column, size: int) -> Column:
    """At most ``size`` code points, then three dots if anything was cut."""
    return F.regexp_replace(c, rf"(?s)^(.{{{size}}}).+$", "$1...")


def shortened(c: Column, size: int) -> Column:
    """At most ``size`` code points, the three dots of a cut included."""
    return F.regexp_replace(c, rf"(?s)^(.{{{size - 3}}}).{{4,}}$", "$1...")


def collapsed(c: Column) -> Column:
    """White space of any kind collapsed to single blanks, outer blanks off."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, accents off (composed or not), white space collapsed, outer blanks off."""
    s = F.translate(F.lower(c), "".join(ACCENT_TABLE), "".join(ACCENT_TABLE.values()))
    return collapsed(F.regexp_replace(s, r"\p{Mn}+", ""))


def preprocess_text(c: Column, size: int = 2000) -> Column:
    """Text for an embedder: white space collapsed, cut at ``size``; null gives the empty text."""
    return truncated(collapsed(F.coalesce(c, F.lit(""))), size)


def quoted(c: Column) -> Column:
    """A text as a quoted literal of the reports: single quotes unless it holds only single ones."""
    s = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for a, b in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(a), F.lit(b))
    double = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    single = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return let(s, lambda x: F.when(x.contains("'") & ~x.contains('"'), double(x)).otherwise(single(x)))
