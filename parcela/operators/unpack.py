"""Several values packed in one field: a quote-aware finite-state tokenizer (problem 3)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lexemes of the automaton: each step consumes one, so that a run of plain characters is one step.
_JSON_STRING = re.compile(r'"((?:[^"\\]++|\\.)*+)(?:"|\\?$)', re.S)
_CSV_STRING = re.compile(r'"((?:[^"\\]++|\\.|"")*+)(?:"|\\?$)', re.S)
_QUOTE_STRING = re.compile(r"'((?:[^'\\]++|\\.|'(?!\s*(?:[,;|\]}:]|$)))*+)(?:'|\\?$)", re.S)
_COLON = re.compile(r"\s*:")
_LITERAL = re.compile(r"[^,\]}]+")
_GAP = re.compile(r"(?:[,;|\s]|\\[nNr])+")
_SCHEME = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//|www\.")
#: What may begin a bare value after a delimiter: a quote, an address with a scheme, or a file name
#: that ends at the next delimiter. Anything else belongs to the value before it, as addresses hold
#: commas, semicolons and bars of their own.
_BEGINS = re.compile(r"""(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//|www\.|["']|[\w\-.~%]+\.(?i:jpe?g|png|webp|gif|avif|svg|bmp|tiff?)(?=[,;|\s]|\\[nNr]|$)|$""")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: A quote doubled around something, which tells doubled quoting from empty values.
_DOUBLED = re.compile(r'""[^\s",:;|\[\]{}]')
_RUNS = re.compile('"+')
_NULLS = ("null", "none", "nan")


def unwrap(text: str) -> str:
    """Take off levels of quoting around a bracketed text, and undo as many doublings of its quotes."""
    s = text.strip()
    while True:  # each level shortens the text
        if len(s) > 2 and s[0] == s[-1] == '"' and s[1:].lstrip()[:1] in ("{", "["):
            s = s[1:-1].strip()
        elif s[:1] in ("{", "[") and _DOUBLED.search(s) and all(len(r) % 2 == 0 for r in _RUNS.findall(s)):
            s = s.replace('""', '"')
        else:
            break
    return s


def _unescape(body: str) -> str:
    """Escapes replaced; halves of a pair of surrogates are joined, a lone one becomes the replacement character."""
    if "\\" not in body:
        return body
    s = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), body)
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if "\\ud" in body.lower() else s


def _bare(s: str) -> list[str]:
    """Values outside of quotes and brackets: a delimiter counts where a value can begin after it."""
    values, begin = [], 0
    for gap in _GAP.finditer(s):
        if _BEGINS.match(s, gap.end()) or not _SCHEME.match(s, begin):
            values.append(s[begin : gap.start()])
            begin = gap.end()
    values.append(s[begin:])
    return [v for x in values if (v := x.strip("\"' \t\r\n")) and v.lower() not in _NULLS]


def split_values(text: str | None, member: str = "images") -> list[str]:
    """The values of a packed field in order, repeated ones too, without quotes and escapes.

    Reads JSON lists, JSON objects (of which the list ``member`` counts), lists of a programming
    language, quotes doubled any number of times, and bare values between commas, semicolons, bars,
    blanks, line ends or written-out line ends, mixed at will. Delimiters count outside of quotes
    only, and after a bare address only where another value begins. Blank items and bare nulls are
    no values. Null, empty and blank texts hold none; a quote or bracket never closed ends with the text.
    """
    if text is None:
        return []
    s = unwrap(text)
    values: list[str] = []
    stack: list[list] = []  # for each open bracket: is it an object, do its items count, its last key
    at, end = 0, len(s)
    while at < end:
        c = s[at]
        if c == '"' or c == "'":
            m = (_QUOTE_STRING if c == "'" else _JSON_STRING if stack else _CSV_STRING).match(s, at)
            body, at = _unescape(m[1]), m.end()
            if stack and stack[-1][0] and (colon := _COLON.match(s, at)):
                stack[-1][2], at = body, colon.end()
                continue
            if not stack:
                body = body.replace('""', '"')
            if (not stack or stack[-1][1]) and (body := body.strip()):
                values.append(body)
        elif c == "[" or c == "{":
            if not stack:
                counts = c == "["
            elif stack[-1][0]:
                counts = c == "[" and len(stack) == 1 and stack[-1][2] == member
            else:
                counts = c == "[" and stack[-1][1]
            stack.append([c == "{", counts, None])
            at += 1
        elif c == "]" or c == "}":
            if stack:
                stack.pop()
            at += 1
        elif gap := _GAP.match(s, at):
            at = gap.end()
        elif stack:
            if c == ":":
                at += 1
                continue
            m = _LITERAL.match(s, at)
            at = m.end()
            if stack[-1][1] and (v := m[0].strip()).lower() not in _NULLS:
                values.append(v)
        else:
            values.extend(_bare(s[at:]))
            break
    return values


def values_udf(member: str = "images"):
    """A vectorised ``split_values``: text to list of values; null gives an empty list."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_values(t, member))

    return split


def unpacked(rows: DataFrame, id_column: str, packed: Column, position: str = "posicion", value: str = "imagen") -> DataFrame:
    """One row for each value: id, position from 1, value. Rows without values give none.

    A narrow plan without shuffle. The generator takes the tokenizer's result itself: over a column
    named before it, a filter of empty lists would be inferred, pushed down and tokenize once more.
    """
    lists = rows.select(F.col(id_column), packed.alias("packed")).filter(F.col("packed").isNotNull())
    split = lists.select(id_column, F.posexplode(values_udf()(F.col("packed"))).alias("p", value))
    return split.select(id_column, (F.col("p") + 1).cast("int").alias(position), value)
