"""The queries of the text problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm import bpe, leaks, pii, topics
from parcela.sources.tables import table
from parcela.storage import materialize

#: The key of the pseudonyms in these queries; a real one is kept secret.
DEMO_KEY = "clave de ejemplo"


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(table(spark, folder, "lyon_balmaceda_scraper"), "row_id", F.col("descripcion"))


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(table(spark, folder, "lyon_balmaceda_scraper"), "row_id", F.col("descripcion"), DEMO_KEY)


def p4_redacted_dates(spark: SparkSession, folder: str) -> DataFrame:
    """With dates, too, which ``p4_redacted`` leaves unchanged."""
    return pii.redacted(table(spark, folder, "lyon_balmaceda_scraper"), "row_id", F.col("descripcion"), DEMO_KEY, dates=True)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), "doc_id", F.col("text"))


#: The indexes built so far, by application and folder: one serves all lookups.
_INDEXES: dict[tuple[str, str], DataFrame] = {}


def _index(spark: SparkSession, folder: str) -> DataFrame:
    own = spark.sparkContext.applicationId, folder
    if own not in _INDEXES:
        _INDEXES[own] = materialize(leaks.positional_index(table(spark, folder, "documents")), "segments")
    return _INDEXES[own]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.look_up(_index(spark, folder), table(spark, folder, "items_evaluacion"))


def p9_proximity(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.look_up(_index(spark, folder), table(spark, folder, "items_evaluacion"), slack=2)


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return topics.document_subjects(table(spark, folder, "documents"), table(spark, folder, "etiquetas"), table(spark, folder, "materias"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "materia")


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and sentences of each subject in the corpus."""
    return _subjects(spark, folder).groupBy("materia").agg(F.count("*").alias("documentos"), F.sum("oraciones").alias("oraciones"))


QUERIES = {f.__name__: f for f in (p4_found, p4_redacted, p4_redacted_dates, p8_ids, p9_found, p9_proximity, p10_found, p10_composition)}
#: Every twelve consecutive words of a table's texts, as (id, g).
_GRAMS = """SELECT {0}, array_to_string(w[s : s + 11], ' ') AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS s FROM (
    SELECT {0}, regexp_extract_all(strip_accents(lower({1})), '[\\p{{L}}\\p{{N}}]+') AS w FROM {2} WHERE {1} IS NOT NULL) WHERE len(w) >= 12)"""

SQL: dict[str, str] = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format('doc_id', 'text', 'documents')}) JOIN ({_GRAMS.format('item_id', 'enunciado', 'items_evaluacion')}) USING (g)",
}
