"""Raw listing rows to text blob and typed payload; one narrow projection without shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parcela.functions import numbers as N
from parcela.functions import text as T
from parcela.operators.predicate import predicate

#: Least length of a blob that is kept.
LEAST_BLOB = 4


#: The fields of the blob.
BLOB_FIELDS = ("titulo_propiedad", "comuna", "barrio", "tipo_propiedad", "operacion", "dormitorios", "banios", "m2_util", "estacionamiento", "bodega", "descripcion")


class BlobMaker:
    """Makes the blob of one row after the other; short values are cleaned once."""

    def __init__(self) -> None:
        self.clean, self.number = lru_cache(maxsize=1 << 14)(T.clean_text), lru_cache(maxsize=1 << 14)(N.read_numeric)

    def __call__(self, title, comuna, barrio, kind, operation, room, bath, size, cars, store, text) -> str:
        clean, number = self.clean, self.number
        title, comuna, barrio, operation = clean(title), clean(comuna), clean(barrio), clean(operation)
        room, bath, size = number(room), number(bath), number(size)
        parts = [
            title, title, comuna and f"Comuna {comuna}", barrio and f"Barrio {barrio}", clean(kind), operation and f"en {operation}",
            room > 0 and f"{N.whole(room)} dormitorios", bath > 0 and f"{N.whole(bath)} baños", size > 0 and f"{N.whole(size)} metros cuadrados útiles",
            number(cars) > 0 and "con estacionamiento", number(store) > 0 and "con bodega", T.clip_text(T.clean_text(text), 1000),
        ]
        return T.clip_text(T.clean_text(" ".join(p for p in parts if p)), 2000)


@F.pandas_udf(StringType())
def _blobs(titles: pd.Series, comunas: pd.Series, barrios: pd.Series, kinds: pd.Series, operations: pd.Series, rooms: pd.Series, baths: pd.Series, sizes: pd.Series, parking: pd.Series, storage: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([*map(BlobMaker(), titles, comunas, barrios, kinds, operations, rooms, baths, sizes, parking, storage, texts)], dtype=object)


def semantic_blob(row: dict[str, Column]) -> Column:
    """Title twice, place, kind, rooms, size, extras and description in one text, cleaned and cut at 2000;
    in Arrow batches, as every row needs it (``blob_expression`` takes ten times as long)."""
    return _blobs(*[row[c] for c in BLOB_FIELDS])


def blob_expression(row: dict[str, Column], clean: Callable[[Column], Column] = T.clean_string) -> Column:
    """``semantic_blob`` of built-in expressions, for conditions that reach it for few rows."""
    text = lambda c: F.nullif(clean(row[c]), F.lit(""))  # noqa: E731  (null parts are left out)
    number = lambda c: N.clean_numeric(row[c])
    count = lambda c, word: F.when(number(c) > 0, F.concat(N.truncated_int(number(c)).cast("string"), F.lit(f" {word}")))
    extra = lambda c: F.when(number(c) > 0, F.lit(f"con {c}"))
    joined = F.concat_ws(
        " ", text("titulo_propiedad"), text("titulo_propiedad"), F.concat(F.lit("Comuna "), text("comuna")), F.concat(F.lit("Barrio "), text("barrio")),
        text("tipo_propiedad"), F.concat(F.lit("en "), text("operacion")), count("dormitorios", "dormitorios"), count("banios", "baños"), count("m2_util", "metros cuadrados útiles"),
        extra("estacionamiento"), extra("bodega"), T.truncated(text("descripcion"), 1000),
    )
    return T.truncated(clean(joined), 2000)


def payload(row: dict[str, Column], cleaned: Callable[[Column], Column] = T.cleaned) -> dict[str, Column]:
    """The 22 payload columns; none of them is null. ``cleaned``: ``clean_string`` instead for a filter, which needs few of them."""
    lat, lon = N.clean_coordinates(row["latitud"], row["longitud"])
    text, number = lambda c: cleaned(row[c]), lambda c: N.clean_numeric(row[c])
    whole = lambda c: N.truncated_int(N.clean_numeric(row[c]))
    images = N.parse_images(row["images"])
    return {
        "url": F.coalesce(row["url_propiedad"], F.lit("None")), "portal": text("portal"), "tipo_propiedad": text("tipo_propiedad"), "operacion": text("operacion"),
        "comuna": text("comuna"), "barrio": text("barrio"), "latitud": lat, "longitud": lon, "precio_uf": N.clean_price(row["precio_uf"]),
        "m2_util": number("m2_util"), "m2_total": number("m2_total"), "dormitorios": whole("dormitorios"), "banios": whole("banios"),
        "estacionamiento": whole("estacionamiento"), "bodega": whole("bodega"), "anio": whole("anio"), "piso": whole("piso"), "gastos_comunes": number("gastos_comunes"),
        "titulo": F.substring(text("titulo_propiedad"), 1, 500), "descripcion": text("descripcion"), "images": images, "n_images": F.size(images),
    }


def _columns(rows: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in rows.columns}


def with_blob(rows: DataFrame, id_column: str = "row_id") -> DataFrame:
    """id and ``semantic_text`` of every row."""
    return rows.select(id_column, semantic_blob(_columns(rows)).alias("semantic_text"))


def has_content(blob: Column) -> Column:
    return F.length(F.trim(blob)) >= LEAST_BLOB


def blob_reaches(row: dict[str, Column], size: int) -> Column:
    """Whether the blob's length is at least ``size`` (of few characters).

    A title, description or place with so many ASCII letters and digits and without what cleaning
    takes off whole (tags, written-out line ends) tells at once. The blob is built for the rest, by
    built-in expressions, which a condition reaches only where none of these tells.
    """
    plain = lambda c: ~row[c].rlike(r"[<\\]") & row[c].rlike(rf"(?s)(?:[A-Za-z0-9].*?){{{size}}}")
    told = reduce(lambda a, b: a | b, [F.coalesce(plain(c), F.lit(False)) for c in ("titulo_propiedad", "comuna", "tipo_propiedad")])
    return F.when(told, F.lit(True)).otherwise(F.length(F.trim(blob_expression(row))) >= size)


def with_content(made: DataFrame) -> DataFrame:
    """The rows with enough ``semantic_text``. The row number, which no filter passes, keeps the
    filter above the projection, so that the text isn't computed once more below it."""
    kept = made.withColumn("_n", F.monotonically_increasing_id())
    return kept.filter(has_content(F.col("semantic_text")) & (F.col("_n") >= 0)).drop("_n")


def points(rows: DataFrame, id_column: str = "row_id", filters: Mapping | None = None) -> DataFrame:
    """id, ``semantic_text`` and payload of the rows with enough content that pass ``filters`` on payload
    columns; texts are compared without case and accents. Blobs are made of what passes."""
    own = _columns(rows)
    rows = rows.filter(predicate(filters, True, payload(own, T.clean_string))) if filters else rows
    made = rows.select(id_column, semantic_blob(own).alias("semantic_text"), *[c.alias(n) for n, c in payload(own).items()])
    return with_content(made)


def statistics(rows: DataFrame, batch_size: int = 1000) -> DataFrame:
    """One row of counters of a load: processed, embedded, uploaded, failed, batches, success rate."""
    good = blob_reaches(_columns(rows), LEAST_BLOB)
    counted = rows.agg(F.count("*").alias("total_processed"), F.count_if(good).alias("total_uploaded"))
    rate = F.coalesce(F.try_divide(F.col("total_uploaded") * 100.0, F.col("total_processed")), F.lit(0.0))
    return counted.select(
        "total_processed", F.col("total_uploaded").alias("total_embedded"), "total_uploaded", (F.col("total_processed") - F.col("total_uploaded")).alias("failed_records"),
        F.ceil(F.col("total_processed") / batch_size).cast("bigint").alias("batches"), F.format_string("%.1f%%", rate).alias("success_rate"),
    )


def with_status(rows: DataFrame, id_column: str = "row_id") -> DataFrame:
    """id, ``status`` and ``reason`` of every row: 'uploaded', or 'failed' with why it gives no point."""
    good = blob_reaches(_columns(rows), LEAST_BLOB)
    return rows.select(id_column, good.alias("_good")).select(id_column, F.when(F.col("_good"), "uploaded").otherwise("failed").alias("status"), F.when(~F.col("_good"), "insufficient semantic content").alias("reason"))


def final_report(counted: DataFrame, seconds: float, collection: str, model: str, dimension: int) -> DataFrame:
    """The counters of ``statistics`` with time, records a second (0 in no time) and configuration: one row a line of the report, in order."""
    c = lambda n: F.col(n).cast("string")
    rate = F.format_string("%.1f", F.col("total_processed") / F.lit(float(seconds))) if seconds > 0 else F.lit("0.0")
    lines = {
        "Total Records Processed": c("total_processed"), "Successfully Embedded": c("total_embedded"), "Successfully Uploaded": c("total_uploaded"), "Failed Records": c("failed_records"),
        "Batches Processed": c("batches"), "Success Rate": F.col("success_rate"), "Collection Name": F.lit(collection), "Embedding Model": F.lit(model), "Vector Dimension": F.lit(str(dimension)),
        "Total Execution Time": F.lit(f"{seconds:.1f}"), "Records per Second": rate,
    }
    return counted.select(F.posexplode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in lines.items()])).alias("linea", "_l")).select("linea", F.col("_l.k").alias("nombre"), F.col("_l.v").alias("valor"))
