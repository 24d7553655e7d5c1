"""Queries of the cleaning, audit, search and ingest operators, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.functions import numbers as N
from parcela.functions import text as T
from parcela.functions.registry import register
from parcela.operators import audit, display, nlq, payload, search
from parcela.operators.collection import Collection, lookup
from parcela.operators.embed import embed, models
from parcela.operators.predicate import predicate
from parcela.sources import listing_csv
from parcela.sources.tables import table
from parcela.storage import shared_dir

LISTINGS = "lyon_balmaceda_scraper"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Queries with the filters and residual texts they must give.
ASKED = (
    ("casa en Buin con jardín", '{"comuna": "Buin", "tipo_propiedad": "casa"}', "casa en con jardín"),
    ("venta casa en Lo Barnechea 4 baños", '{"banios": 4, "comuna": "Lo Barnechea", "operacion": "Venta", "tipo_propiedad": "casa"}', "casa en 4 baños"),
    ("arriendo departamento 3 dormitorios", '{"dormitorios": 3, "operacion": "Arriendo", "tipo_propiedad": "departamento"}', "departamento 3 dormitorios"),
    ("entre 2 y 4 dormitorios, entre 20000 y 30000 uf", '{"dormitorios": {"gte": 2, "lte": 4}, "precio_uf": {"gte": 20000.0, "lte": 30000.0}}', "entre 2 y 4 dormitorios,"),
    ("casa con bodega y 2 estacionamientos", '{"bodega": {"gte": 1}, "estacionamiento": 2, "tipo_propiedad": "casa"}', "bodega y 2 estacionamientos"),
    ("depto piso 5, gastos comunes menos de 100 mil", '{"gastos_comunes": {"lte": 100000.0}, "piso": 5, "tipo_propiedad": "departamento"}', "piso 5, gastos comunes menos 100 mil"),
    ("casa en Las Condes de un piso", '{"comuna": "Las Condes", "tipo_propiedad": "casa"}', "un piso"),
    ("más de 20000 uf casa en Vitacura", '{"comuna": "Vitacura", "precio_uf": {"gte": 20000.0}, "tipo_propiedad": "casa"}', "más 20000 uf"),
    ("casa con cocina amplia", '{"comuna": "Colina", "tipo_propiedad": "casa"}', "casa con amplia"),
    ("departamento en nunoa", '{"barrio": "Ñuñoa", "comuna": "Ñuñoa", "tipo_propiedad": "departamento"}', "departamento en nunoa"),
    ("casa con más de 100 m2 y menos de 200 m2", '{"m2_util": {"lte": 200.0}, "tipo_propiedad": "casa"}', "más 100 m2 y"),
    ("departamento familiar gastos comunes hasta 80000", '{"gastos_comunes": {"lte": 80000000.0}, "tipo_propiedad": "departamento"}', "familiar gastos comunes hasta 80000"),
    ("departamento año 2024", '{"tipo_propiedad": "departamento"}', "año 2024"),
    ("terreno desde 25000", '{"anio": {"gte": 2500}}', "terreno desde 25000"),
    ("ventana grande en providensia", '{"comuna": "Providencia", "operacion": "Venta"}', "ventana grande"),
    ("departamento con mas de 2 estacionamientos", '{"estacionamiento": {"gte": 3}, "tipo_propiedad": "departamento"}', "mas 2 estacionamientos"),
    ("depto con estacionamiento", '{"estacionamiento": {"gte": 1}, "tipo_propiedad": "departamento"}', "depto con estacionamiento"),
    ("casa con 2 bodegas", '{"bodega": 2, "tipo_propiedad": "casa"}', "2 bodegas"),
    ("casa construida entre 2010 y 2020", '{"anio": {"gte": 2010, "lte": 2020}, "tipo_propiedad": "casa"}', "construida entre 2010 y 2020"),
    ("departamento despues de 2015", '{"anio": {"gte": 2015}, "tipo_propiedad": "departamento"}', "despues 2015"),
    ("casa antes de 1990", '{"anio": {"lte": 1990}, "tipo_propiedad": "casa"}', "antes 1990"),
    ("depto construido 2018", '{"anio": 2018, "tipo_propiedad": "departamento"}', "construido 2018"),
    ("departamento desde piso 8", '{"piso": {"gte": 8}, "tipo_propiedad": "departamento"}', "desde piso 8"),
    ("casa gastos comunes mas de 50000", '{"gastos_comunes": {"gte": 50000.0}, "tipo_propiedad": "casa"}', "gastos comunes mas 50000"),
    ("casa entre 2 y 3 baños", '{"banios": {"gte": 2, "lte": 3}, "tipo_propiedad": "casa"}', "entre 2 y 3 baños"),
    ("departamento en portal inmobiliario", '{"portal": "Portal Inmobiliario", "tipo_propiedad": "departamento"}', "portal inmobiliario"),
    ("casa sobre 300 m2 total", '{"m2_total": {"gte": 300.0}, "tipo_propiedad": "casa"}', "casa"),
    ("casa entre 80 y 120 metros", '{"m2_util": {"gte": 80.0, "lte": 120.0}, "tipo_propiedad": "casa"}', "casa"),
    ("casa desde 5000 hasta 8000 uf", '{"precio_uf": {"gte": 5000.0, "lte": 8000.0}, "tipo_propiedad": "casa"}', "casa"),
    ("depto desde los 3000 uf", '{"precio_uf": {"gte": 3000.0}, "tipo_propiedad": "departamento"}', "depto"),
    ("casa hasta 9000 uf", '{"precio_uf": {"lte": 9000.0}, "tipo_propiedad": "casa"}', "casa"),
    ("arriendo depto 20000-30000 uf", '{"operacion": "Arriendo", "precio_uf": {"gte": 20000.0, "lte": 30000.0}, "tipo_propiedad": "departamento"}', "depto"),
)
#: Misspelled names, the comuna they resemble most, the ratio to four places, and whether it suffices.
NEARLY = (("lo barnehea", "lo barnechea", 0.9565, True), ("providensia", "providencia", 0.9091, True), ("santigo", "santiago", 0.9333, True), ("la renia", "la reina", 0.875, True), ("puente ato", "puente alto", 0.9524, True), ("maul", "macul", 0.8889, True), ("bin", "buin", 0.8571, True), ("buen", "buin", 0.75, False), ("cocina", "colina", 0.8333, True))
#: Ends of lines after 26 plain fields, with the image and description fields they must give.
_PLAIN = ",".join(f"c{k}" for k in range(26))
LINES = (
    (1, _PLAIN + ',"{""n"": 3, ""images"": [""u1"",""u2""]}","[\'t, x\']"', '{"n": 3, "images": ["u1","u2"]}', "['t, x']"),
    (2, '"' + _PLAIN + ',""{""""n"""": 3, """"images"""": [""""u1"""",""""u2""""]}"",""[\'t, x\']"""', '{""""n"""": 3, """"images"""": [""""u1"""","u2""""]}""', "['t, x']\"\""),
    (3, _PLAIN + ",img", "img", ""),
    (4, _PLAIN + ",a,b,c", "a,b,c", ""),
    (5, _PLAIN + ",[a,b,c", "[a,b,c", ""),
    (6, "\r", None, None),
)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, LISTINGS)


def _columns(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in df.columns}


# --- texts


@query
def clean_string_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.cleaned(F.col("text")).alias("clean"))


@query
def clean_string_listings(spark, folder):
    return _rows(spark, folder).select("row_id", T.clean_string(F.col("descripcion")).alias("descripcion"), T.clean_string(F.col("comuna")).alias("comuna"))


@query
def strip_html_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.regexp_replace("text", "<[^>]+>", "").alias("plain"))


@query
def preprocess_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.preprocess_text(F.col("text")).alias("prepared"))


@query
def truncate_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.truncated(F.col("text"), 200).alias("cut"), T.shortened(F.col("text"), 100).alias("short"))


@query
def normalize_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


# --- numbers, positions, images


@query
def clean_numeric(spark, folder):
    fields = ("precio_uf", "gastos_comunes", "m2_util", "m2_total", "dormitorios", "banios")
    return _rows(spark, folder).select("row_id", *[N.clean_numeric(F.col(c)).alias(c) for c in fields])


@query
def clean_price(spark, folder):
    return _rows(spark, folder).select("row_id", N.clean_price(F.col("precio_uf")).alias("precio_uf"))


@query
def clean_coordinates(spark, folder):
    lat, lon = N.clean_coordinates(F.col("latitud"), F.col("longitud"))
    return _rows(spark, folder).select("row_id", lat.alias("latitud"), lon.alias("longitud"))


@query
def parse_images(spark, folder):
    return _rows(spark, folder).select("row_id", N.parse_images(F.col("images")).alias("i")).select("row_id", F.size("i").cast("bigint").alias("n_images"), F.array_join("i", "|").alias("images"))


@query
def normalize_images(spark, folder):
    found = _rows(spark, folder).select("row_id", N.normalized_images(N.parse_images(F.col("images"))).alias("i"))
    return found.select("row_id", F.size("i").cast("bigint").alias("n_images"), F.array_join("i", "|").alias("images"))


# --- blob, payload, load


@query
def semantic_blob(spark, folder):
    return payload.with_blob(_rows(spark, folder))


@query
def content_filter(spark, folder):
    rows = _rows(spark, folder)
    return rows.filter(payload.blob_reaches(_columns(rows), payload.LEAST_BLOB)).select("row_id")


@query
def payload_projection(spark, folder):
    rows = _rows(spark, folder)
    made = rows.select("row_id", *[c.alias(n) for n, c in payload.payload(_columns(rows)).items()])
    return made.withColumn("images", F.array_join("images", "|"))


@query
def pipeline_stats(spark, folder):
    return payload.statistics(_rows(spark, folder))


@query
def ingest_points(spark, folder):
    made = payload.points(_rows(spark, folder))
    return made.select("row_id", "url", "n_images", embed(F.col("semantic_text")).alias("vector"))


def _filled_lines(spark, folder):
    return table(spark, folder, "scraper_lineas").filter(F.rtrim(F.regexp_replace("linea", "[\r\n]+$", "")) != "").select("linea_id", "linea")


@query
def ingest_batches(spark, folder):
    return listing_csv.batches(_filled_lines(spark, folder).select("linea_id"), "linea_id", 1000).groupBy("batch").agg(F.count("*").alias("n"), F.min("linea_id").alias("first_id"), F.max("linea_id").alias("last_id"))


@query
def ingest_skip_rows(spark, folder):
    return listing_csv.batches(_filled_lines(spark, folder).select("linea_id"), "linea_id", 500, skip=250).select("linea_id", "batch")


@query
def csv_row_parse(spark, folder):
    lines = spark.createDataFrame([(i, t) for i, t, _, _ in LINES], "id int, value string")
    return listing_csv.parsed(lines, keep=("id",)).select("id", "images", "descripcion")


@query
def csv_parse_lines(spark, folder):
    return listing_csv.parsed(table(spark, folder, "scraper_lineas"), line="linea", keep=("linea_id",))


@query
def collection_info(spark, folder):
    made = Collection(spark, f"{shared_dir(spark)}/parcela/{spark.sparkContext.applicationId}", f"info-{uuid.uuid4().hex}").create(64)
    made.append(table(spark, folder, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"), "label"), id_column="vec_id")
    info = made.info()
    made.drop()
    return spark.createDataFrame([(info["dimension"], info["distance"], info["points_count"])], "dimension int, distance string, points_count long")


@query
def embed_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", embed(F.col("text")).alias("vector"))


@query
def csv_full_scan(spark, folder):
    return listing_csv.parsed(table(spark, folder, "scraper_lineas"), line="linea", keep=("linea_id",)).select("linea_id")


@query
def csv_lenient_read(spark, folder):
    read = listing_csv.lenient(table(spark, folder, "scraper_lineas"), "linea", ("linea_id",), quote='"', escape='"')
    return read.select("linea_id", F.col("_corrupt").isNotNull().alias("corrupt"), "portal")


@query
def ingest_payload(spark, folder):
    return payload.points(_rows(spark, folder)).select("row_id", "url", "n_images", "semantic_text")


@query
def row_status(spark, folder):
    return payload.with_status(_rows(spark, folder))


@query
def final_report(spark, folder):
    return payload.final_report(payload.statistics(_rows(spark, folder)), 8.0, "propiedades", "hash-64", 64)


@query
def collection_lifecycle(spark, folder):
    """Every step of a collection's life, with whether it exists and its points after it."""
    c = Collection(spark, f"{shared_dir(spark)}/parcela/{spark.sparkContext.applicationId}", f"life-{uuid.uuid4().hex}")
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    told: list[tuple[int, str, bool, int]] = []

    def step(name: str, added: int = 0) -> None:
        told.append((len(told), name, c.exists(), c.count() if c.exists() else 0, added))

    step("none")
    c.create(64)
    step("create")
    step("append", c.append(rows, id_column="vec_id", batch="a"))
    step("repeat", c.append(rows, id_column="vec_id", batch="a"))
    step("second", c.append(rows, id_column="vec_id", batch="b"))
    step("empty", c.append(rows.limit(0), id_column="vec_id", batch="c"))
    c.recreate(64)
    step("recreate")
    c.drop()
    step("drop")
    return spark.createDataFrame(told, "step int, name string, present boolean, points long, added long")


@query
def embedding_models(spark, folder):
    return models(spark)


@query
def sql_functions(spark, folder):
    """The registered functions, called in SQL."""
    register(spark)
    _rows(spark, folder).createOrReplaceTempView("_parcela_listings")
    return spark.sql("SELECT row_id, clean_string(comuna) AS comuna, clean_numeric(m2_util) AS m2_util, clean_price(precio_uf) AS precio_uf, size(parse_images(images)) AS n_images FROM _parcela_listings")


# --- display


def _payloads(spark, folder):
    rows = _rows(spark, folder)
    return rows.select("row_id", *[c.alias(n) for n, c in payload.payload(_columns(rows)).items()])


@query
def result_display(spark, folder):
    return display.result_view(_payloads(spark, folder), "row_id")


@query
def result_images(spark, folder):
    return display.shown_images(_payloads(spark, folder).select("row_id", "images"), "row_id")


@query
def payload_dump(spark, folder):
    return display.payload_json(_payloads(spark, folder).select("row_id", "comuna", "n_images", "dormitorios", "tipo_propiedad"), "row_id")


@query
def capitalize_text(spark, folder):
    return _rows(spark, folder).select("row_id", display.capitalized(F.col("comuna")).alias("comuna"), display.capitalized(F.col("operacion")).alias("operacion"))


# --- filters


@query
def filter_eq(spark, folder):
    return _rows(spark, folder).filter(predicate({"tipo_propiedad": "departamento", "operacion": "Venta"})).select("row_id", "comuna")


@query
def filter_range(spark, folder):
    return table(spark, folder, "part").filter(predicate({"p_size": {"gte": 10, "lt": 20}, "p_retailprice": {"gt": 950.0, "lte": 1500.0}})).select("p_partkey", "p_size")


@query
def filter_conj(spark, folder):
    return table(spark, folder, "orders").filter(predicate({"o_orderstatus": "F", "o_totalprice": {"gte": 100000.0, "unknown": 3}})).select("o_orderkey", "o_totalprice")


@query
def filter_accents(spark, folder):
    return _rows(spark, folder).filter(predicate({"operacion": "venta"}, fold_accents=True)).select("row_id")


@query
def lookup_by_payload(spark, folder):
    return lookup(_rows(spark, folder).select("row_id", "url_propiedad", "portal"), {"portal": "Casa Vitrina"}, 10, "row_id")


# --- search


def _vector(spark, folder, vec_id):
    return list(table(spark, folder, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first().embedding)


def _scored(df):
    return df.select("vec_id", "label", F.round("score", 6).alias("score"))


@query
def knn_topk(spark, folder):
    return _scored(search.knn(table(spark, folder, "embeddings"), _vector(spark, folder, 0), 10))


@query
def knn_filtered(spark, folder):
    return _scored(search.knn(table(spark, folder, "embeddings"), _vector(spark, folder, 0), 10, {"label": {"gte": 1, "lte": 5}, "vec_id": {"lt": 400}}))


@query
def knn_labels(spark, folder):
    """Nearest among all vectors of a range of labels."""
    return _scored(search.knn(table(spark, folder, "embeddings"), _vector(spark, folder, 0), 10, {"label": {"gte": 1, "lte": 5}}))


@query
def knn_threshold(spark, folder):
    return _scored(search.knn(table(spark, folder, "embeddings"), _vector(spark, folder, 3), 10, {"label": 2}, 0.1))


@query
def knn_zero_vector(spark, folder):
    return _scored(search.knn(table(spark, folder, "embeddings"), [0.0] * 64, 5))


@query
def knn_batch(spark, folder):
    rows = table(spark, folder, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.knn_batch(rows, asked, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query
def cosine_pairs(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.round(search.cosine(F.col("embedding"), _vector(spark, folder, 7)), 6).alias("score"))


# --- queries in words


def _asked(spark):
    return spark.createDataFrame([(k, q) for k, (q, _, _) in enumerate(ASKED)], "id int, query string").select("id", nlq.parsed_query(F.col("query")).alias("p"))


@query
def extract_filters(spark, folder):
    return _asked(spark).select("id", F.col("p.filters").alias("filters"))


@query
def query_clean(spark, folder):
    return _asked(spark).select("id", F.col("p.query_clean").alias("query_clean"))


@query
def extract_price_range(spark, folder):
    return _asked(spark).select("id", F.get_json_object("p.filters", "$.precio_uf.gte").cast("double").alias("low"), F.get_json_object("p.filters", "$.precio_uf.lte").cast("double").alias("high"))


@query
def extract_area(spark, folder):
    return _asked(spark).select("id", F.get_json_object("p.filters", "$.m2_util.gte").cast("double").alias("low"), F.get_json_object("p.filters", "$.m2_util.lte").cast("double").alias("high"))


@query
def fuzzy_comuna(spark, folder):
    @F.pandas_udf("name string, ratio double")
    def nearest(texts):
        import pandas as pd

        found = [nlq.likeness(t) for t in texts]
        return pd.DataFrame([(f[0], round(f[2], 4)) for f in found], columns=["name", "ratio"])

    asked = spark.createDataFrame([(a,) for a, _, _, _ in NEARLY], "query string").select("query", nearest("query").alias("n"))
    return asked.select("query", F.col("n.name").alias("comuna"), F.col("n.ratio").alias("ratio"), (F.col("n.ratio") >= nlq.LIKENESS).alias("accepted"))


@query
def search_listings(spark, folder):
    """A query in words over the payload: filters, residual text, vector, best five."""
    rest, filters = nlq.extract_filters("arriendo departamento 2 dormitorios con terraza soleada")
    made = payload.points(_rows(spark, folder), filters=filters)
    asked = spark.range(1).select(embed(F.lit(rest)).alias("v")).first().v
    found = made.select("row_id", "url", "comuna", embed(F.col("semantic_text")).alias("vector"))
    return search.knn(found, asked, 5, id_column="row_id", vector="vector").select("row_id", "url", "comuna", F.round("score", 5).alias("score"))


# --- audit


@query
def audit_issues(spark, folder):
    return audit.issues(_rows(spark, folder))


@query
def audit_exclude(spark, folder):
    return audit.issues(_rows(spark, folder), exclude=("images_json_invalid",)).drop("seq")


@query
def audit_by_type(spark, folder):
    return audit.by_type(audit.issues(_rows(spark, folder)))


@query
def audit_by_row(spark, folder):
    return audit.by_row(audit.issues(_rows(spark, folder)))


@query
def audit_summary(spark, folder):
    return audit.summary(audit.issues(_rows(spark, folder)))
