"""Lines that fail to parse kept apart with their reason, valid ones loaded (problem 6).

Strict load plus anti-join: only conforming lines are loaded, under their offsets; subtracting the
loaded offsets from the raw ones leaves the lines to be diagnosed.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of the scraped files, in order.
COLUMNS = (
    "execution_time", "url_propiedad", "portal", "tipo_propiedad", "operacion", "comuna", "barrio", "latitud", "longitud", "precio_uf",
    "m2_util", "m2_total", "dormitorios", "banios", "corredora", "codigo_interno", "url_plp", "posicion", "seller_thermometer",
    "estacionamiento", "bodega", "orientacion", "gastos_comunes", "piso", "anio", "titulo_propiedad", "images", "descripcion",
)

_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'
_RECORD = re.compile(f"{_FIELD}(?:,{_FIELD})*+", re.S)
_WRAPPED = re.compile(r'"(?:[^"]++|"")*+"', re.S)
_BLANK = re.compile(r"[\s﻿]*")

csv.field_size_limit(1 << 30)


def strip_line(line: str) -> str:
    """Without line ends; a record wrapped whole in one more pair of quotes is unwrapped."""
    s = line.strip("\r\n")
    if len(s) > 1 and s[0] == '"' and _WRAPPED.fullmatch(s):
        inner = s[1:-1].replace('""', '"')
        if "," in inner:
            return inner
    return s


def images_valid(text: str) -> bool:
    """Blank, a JSON list or a JSON object with a list ``images``, quotes possibly doubled."""
    s = text.strip()
    if not s:
        return True
    while True:  # each round shortens the text
        try:
            x = json.loads(s)
        except (ValueError, RecursionError):
            x = None
        if isinstance(x, str) and x.strip()[:1] in ("{", "["):
            s = x.strip()
            continue
        if isinstance(x, list) or isinstance(x, dict) and isinstance(x.get("images"), list):
            return True
        if x is not None:
            return False
        if len(s) > 2 and s[0] == s[-1] == '"' and s[1:].lstrip()[:1] in ("{", "["):
            s = s[1:-1].strip()
        elif '""' in s:
            s = s.replace('""', '"')
        else:
            return False


def description_valid(text: str) -> bool:
    """A list literal, begun with bracket and quote, must end with the same quote and a bracket."""
    s = text.strip()
    if len(s) > 1 and s[0] == "[" and s[1] in "\"'":
        return len(s) >= 4 and s.endswith(s[1] + "]")
    return True


def fields(record: str) -> list[str] | None:
    """The fields of a strictly well-formed record; null for broken quoting."""
    if not _RECORD.fullmatch(record):
        return None
    return next(csv.reader([record.replace("\r", " ").replace("\n", " ")])) if "\n" in record or "\r" in record else next(csv.reader([record]), [""])


def load(line: str | None, width: int) -> list[str] | None:
    """The fields of a conforming line; null for any other and for blank lines."""
    if line is None or _BLANK.fullmatch(line):
        return None
    found = fields(strip_line(line))
    if found is None or len(found) != width or not images_valid(found[-2]) or not description_valid(found[-1]):
        return None
    return found


def reason(line: str, width: int) -> str | None:
    """Why a line doesn't conform: the first reason that holds; null if it is blank or conforms."""
    if _BLANK.fullmatch(line):
        return None
    found = fields(strip_line(line))
    if found is None:
        return "comillas"
    if len(found) != width:
        return "pocas_columnas" if len(found) < width else "muchas_columnas"
    return None if images_valid(found[-2]) and description_valid(found[-1]) else "valor_invalido"


def loaded(lines: DataFrame, id_column: str = "linea_id", line: str = "linea", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The conforming lines as rows: the id and one string column for each field."""
    width = len(columns)

    def strict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [(i, *f) for i, t in zip(b[id_column], b[line]) if (f := load(t, width)) is not None]
            yield pd.DataFrame(good, columns=[id_column, *columns])

    kind = dict(lines.dtypes)[id_column]
    return lines.select(id_column, line).mapInPandas(strict, f"{id_column} {kind}, " + ", ".join(f"{c} string" for c in columns))


def conforming_ids(lines: DataFrame, id_column: str = "linea_id", line: str = "linea", width: int = len(COLUMNS)) -> DataFrame:
    """The ids that ``loaded`` loads, by the same strict load, without carrying the fields."""

    def strict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[load(t, width) is not None for t in b[line]], [id_column]]

    kind = dict(lines.dtypes)[id_column]
    return lines.select(id_column, line).mapInPandas(strict, f"{id_column} {kind}")


def rejected(lines: DataFrame, id_column: str = "linea_id", line: str = "linea", width: int = len(COLUMNS)) -> DataFrame:
    """``id``, ``motivo`` of the lines that aren't blank and don't conform.

    The strict load's offsets are subtracted from the raw ones, and only what remains is diagnosed:
    the diagnosis is a map over batches, below which nothing is pushed. Null lines count as blank.
    The ids must be unique; lines may repeat. An empty table gives none.
    """
    raw = lines.select(id_column, line).filter(F.col(line).rlike(r"[^\s\x{feff}]"))
    rest = raw.join(conforming_ids(lines, id_column, line, width), id_column, "left_anti")

    def diagnose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            why = b[line].map(lambda t: reason(t, width))
            yield pd.DataFrame({id_column: b[id_column], "motivo": why})[why.notna().to_numpy()]

    kind = dict(lines.dtypes)[id_column]
    return rest.select(id_column, line).mapInPandas(diagnose, f"{id_column} {kind}, motivo string")
