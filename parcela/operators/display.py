"""Hits and payloads as they are shown: defaults for what is missing, number formats, images, JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parcela.functions.text import truncated

#: What is shown for a field that a hit doesn't have.
MISSING = {"comuna": "No especificada"}
NOT_GIVEN = "N/A"
#: Most characters of a payload's JSON, and of a description.
JSON_SIZE, TEXT_SIZE = 2000, 200


@F.pandas_udf(StringType())
def two_decimals(values: pd.Series) -> pd.Series:
    """A number with two decimals, rounded by its exact value; null stays null."""
    return values.map(lambda v: None if pd.isna(v) else f"{v:.2f}").astype(object)


@F.pandas_udf(StringType())
def thousands(values: pd.Series) -> pd.Series:
    """A number without decimals, its thousands set off by commas; null stays null."""
    return values.map(lambda v: None if pd.isna(v) else f"{v:,.0f}").astype(object)


def capitalized(c: Column) -> Column:
    """The first letter in upper, all others in lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def result_view(hits: DataFrame, *keep: str) -> DataFrame:
    """What is shown of each hit (payload columns): texts with their defaults, and null for a line that is left out.

    Barrio, storage, year, floor and expenses show only where they say something. Columns that the
    hits don't have count as null.
    """
    c = lambda n: F.col(n) if n in hits.columns else F.lit(None)
    told = lambda n: F.coalesce(c(n).cast("string"), F.lit(MISSING.get(n, NOT_GIVEN))).alias(n)
    some = lambda n: F.when(c(n).cast("double") > 0, c(n).cast("string")).alias(n)
    text = lambda n: F.when(c(n).cast("string") != "", c(n).cast("string"))
    return hits.select(
        *keep, told("comuna"), text("barrio").alias("barrio"), two_decimals(F.coalesce(c("precio_uf").cast("double"), F.lit(0.0))).alias("precio_uf"),
        *map(told, ("dormitorios", "banios", "m2_util", "m2_total", "estacionamiento", "tipo_propiedad", "operacion")), *map(some, ("bodega", "anio", "piso")),
        F.when(c("gastos_comunes").cast("double") > 0, thousands(c("gastos_comunes").cast("double"))).alias("gastos_comunes"),
        text("titulo").alias("titulo"), truncated(text("descripcion"), TEXT_SIZE).alias("descripcion"), text("url").alias("url"),
    )


def shown_images(hits: DataFrame, *keep: str, images: str = "images") -> DataFrame:
    """One row for each image of a hit, numbered from 1."""
    return hits.select(*keep, F.posexplode(images).alias("_n", "imagen")).select(*keep, (F.col("_n") + 1).alias("numero"), "imagen")


@F.pandas_udf(StringType())
def _indented(dumps: pd.Series) -> pd.Series:
    return dumps.map(lambda d: json.dumps(json.loads(d), indent=2, ensure_ascii=False, sort_keys=True)[:JSON_SIZE])


def payload_json(hits: DataFrame, *keep: str) -> DataFrame:
    """``json`` of all other columns, keys in order, indented by two, at most ``JSON_SIZE`` characters."""
    names = sorted(n for n in hits.columns if n not in keep)
    return hits.select(*keep, _indented(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).alias("json"))
