"""The queries of the general data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.operators import impute, quarantine, snapshots, spatial, units, unpack
from parcela.sources.tables import table

LISTINGS = "lyon_balmaceda_scraper"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return units.foreign_units(table(spark, folder, LISTINGS))


def p1_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return units.canonical_amounts(table(spark, folder, LISTINGS), table(spark, folder, "valores_moneda"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.listing_changes(table(spark, folder, LISTINGS), table(spark, folder, "corridas"), table(spark, folder, "valores_moneda"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return unpack.unpacked(table(spark, folder, LISTINGS), "row_id", F.col("images"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return impute.filled_from_listing(table(spark, folder, LISTINGS))


def p5_filled(spark: SparkSession, folder: str) -> DataFrame:
    return impute.filled(table(spark, folder, LISTINGS), table(spark, folder, "valores_moneda"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return quarantine.rejected(table(spark, folder, "scraper_lineas"))


def p6_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return quarantine.loaded(table(spark, folder, "scraper_lineas"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.places(table(spark, folder, LISTINGS), table(spark, folder, "comunas"), table(spark, folder, "puntos_interes"))


QUERIES = {f.__name__: f for f in (p1_found, p1_canonical, p2_found, p3_found, p5_found, p5_filled, p6_found, p6_loaded, p7_found)}
