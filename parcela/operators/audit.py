"""Data-quality audit: an issue row for every value that couldn't be read, and its summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcela.functions import numbers as N
from parcela.operators.payload import BLOB_FIELDS, BlobMaker

#: The audited number columns, in order of the report.
NUMBERS = ("precio_uf", "m2_util", "m2_total", "dormitorios", "banios", "estacionamiento", "bodega", "piso", "anio", "gastos_comunes")


#: The other audited columns, and what is told of them.
PLACE, IMAGES, BLOB = "LATITUD/LONGITUD", "IMAGES", "BLOB_SEMANTICO"
BLOB_SHORT = "Contenido semántico insuficiente para embedding (título/descripción vacíos o muy cortos)"
BLOB_RAW, BLOB_USED = "(combinación título/descripción/comuna/otros)", "(blob vacío o muy corto)"
#: Least length of a blob that is worth a vector.
LEAST = 10

_ISSUE = "row_index {0}, seq int, url string, column string, raw_value string, issue_type string, message string, value_used string, requires_manual_review boolean"
_LETTER = re.compile("[A-Za-z0-9]")


def _short(s: str, size: int) -> str:
    return s if len(s) <= size else s[: size - 3] + "..."


def price_issue(text: str | None) -> tuple[str, str] | None:
    """Message and value used of a price; a text without a number counts as 0, which is in range."""
    if problem := N.read_problem(text):
        return problem, "0.0"
    value = N.read_numeric(text)
    if value < 0:
        return f"Precio UF negativo ({value}); se usó 0", "0.0"
    return (f"Precio UF extremo ({value}); se acotó a 100000", "100000.0") if value > 100_000 else None


def place_issue(lat: str | None, lon: str | None) -> str | None:
    if not lat and not lon:
        return None
    if problem := N.read_problem(lat) or N.read_problem(lon):
        return problem
    y, x = N.read_numeric(lat), N.read_numeric(lon)
    return None if y == 0 and x == 0 or -55 <= y <= -17 and -109 <= x <= -66 else f"Coordenadas fuera de Chile: ({y}, {x})"


def _is_short(make: BlobMaker, blob: tuple) -> bool:
    """Whether the blob is too short. Enough letters in the title, without what cleaning takes off whole, tell at once."""
    title = blob[0]
    if title and "<" not in title and "\\" not in title and len(_LETTER.findall(title)) >= LEAST:
        return False
    return len(make(*blob).strip(" ")) < LEAST


def issues(rows: DataFrame, index: str = "row_id", exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row for each problem: ``row_index``, ``seq`` (place in its row, from 0), url, column, raw value,
    type, message, value used, review mark. ``exclude``: types left out.

    One map over Arrow batches without shuffle, as images need a strict JSON parser in any case;
    equal values are read once. Null and blank fields have no problem. An empty table gives none.
    """
    other = ("latitud", "longitud", "images", *BLOB_FIELDS)
    used = [c for c in rows.columns if c in {*NUMBERS, *other, "url_propiedad", index}]

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, price, place = lru_cache(1 << 14)(N.read_problem), lru_cache(1 << 14)(price_issue), lru_cache(1 << 14)(place_issue)
        images, make = lru_cache(1 << 12)(N.images_issue), BlobMaker()
        for b in batches:
            b = b.astype(object).where(b.notna(), None)
            fields = [(c.upper(), price if c == "precio_uf" else number, list(b[c])) for c in NUMBERS]
            out: list[tuple] = []
            for k, (i, url, lat, lon, packed, *blob) in enumerate(zip(b[index], b["url_propiedad"], *[b[c] for c in other])):
                own = []
                for name, read, values in fields:
                    if told := read(values[k]):
                        told, value = told if read is price else (told, "0.0")
                        own.append((name, _short(values[k], 100), "numeric_invalid", told, value))
                if told := place(lat, lon):
                    own.append((PLACE, _short(f"({lat}, {lon})", 100), "coordinates_invalid", told, "(0.0, 0.0)"))
                if told := images(packed):
                    own.append((IMAGES, _short(packed, 80), "images_json_invalid", told, "(lista vacía)"))
                if _is_short(make, tuple(blob)):
                    own.append((BLOB, BLOB_RAW, "semantic_content_insufficient", BLOB_SHORT, BLOB_USED))
                out += [(i, n, ("None" if url is None else url)[:120], *x, True) for n, x in enumerate(own) if x[2] not in exclude]
            yield pd.DataFrame(out, columns=["row_index", "seq", "url", "column", "raw_value", "issue_type", "message", "value_used", "requires_manual_review"])

    return rows.select(*used).mapInPandas(audit, _ISSUE.format(dict(rows.dtypes)[index]))


def by_type(found: DataFrame) -> DataFrame:
    """Issues of each type, most first, equal numbers by name."""
    return found.groupBy("issue_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue_type")


def by_row(found: DataFrame) -> DataFrame:
    """The issues of each row in their order: at most 13 a row."""
    each = F.array_sort(F.collect_list(F.struct("seq", "column")))
    return found.groupBy("row_index").agg(F.count("*").alias("n"), F.array_join(F.transform(each, lambda x: x["column"]), ",").alias("columns"))


def summary(found: DataFrame) -> DataFrame:
    """Rows with problems and problems in all. Rows are counted after a partial count per row."""
    return found.groupBy("row_index").agg(F.count("*").alias("n")).agg(F.count("*").alias("rows_with_issues"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_issues"))


def report_lines(found: DataFrame, source: str) -> tuple[list[str], DataFrame]:
    """The head of the report (totals and types, a dozen lines) and its detail: a table of ``row_index``,
    ``seq`` and the ``text`` of every issue, with its row's heading before the first of a row."""
    total = summary(found).first()
    head = ["# Reporte de auditoría: limpieza de strings", "", f"**Archivo auditado:** `{source}`", f"**Total de registros con problemas:** {total.rows_with_issues}", f"**Total de incidencias:** {total.total_issues}", "", "## Resumen por tipo", ""]
    head += [f"- `{r.issue_type}`: {r.n}" for r in by_type(found).collect()]  # four types at most
    head += ["", "## Detalle (registros a corregir o revisar)", ""]
    own = W.partitionBy("row_index")  # at most 13 issues a row
    first, last = F.col("seq") == F.min("seq").over(own), F.col("seq") == F.max("seq").over(own)
    title = F.when(first, F.concat(F.lit("### Fila "), F.col("row_index").cast("string"), F.lit(" — "), F.substring("url", 1, 70), F.lit("...\n\n"))).otherwise(F.lit(""))
    body = F.concat(
        F.lit("- **Columna:** "), F.col("column"), F.lit("\n  - Valor original: `"), F.substring(F.coalesce("raw_value", F.lit("")), 1, 80), F.lit("`\n  - Problema: "), F.col("message"),
        F.lit("\n  - Valor aplicado por cleaner: "), F.col("value_used"), F.lit("\n"), F.when(last, F.lit("\n")).otherwise(F.lit("")),
    )
    return head, found.select("row_index", "seq", F.concat(title, body).alias("text"))


def markdown(found: DataFrame, source: str) -> Iterator[str]:
    """The report's lines with the issues of all rows, one partition in the driver at a time."""
    head, detail = report_lines(found, source)
    yield from head
    for r in detail.orderBy("row_index", "seq").toLocalIterator():
        yield from r.text.split("\n")


def write_markdown(found: DataFrame, source: str, path: str) -> None:
    """The report as text files in order, written by the executors: the head, then the detail."""
    head, detail = report_lines(found, source)
    top = found.sparkSession.createDataFrame([(None, k, t) for k, t in enumerate(head)], detail.schema)
    top.unionByName(detail).orderBy(F.asc_nulls_first("row_index"), "seq").select("text").write.mode("overwrite").text(path)


def write_csv(found: DataFrame, path: str) -> None:
    """The eight report columns in order, with a header."""
    found.select("row_index", "url", "column", "raw_value", "issue_type", "message", "value_used", "requires_manual_review").write.mode("overwrite").csv(path, header=True)
