import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcela.functions import numbers as N
from parcela.functions import text as T
from parcela.functions.listing import aviso, instant, is_missing
from parcela.operators import audit, nlq, payload, search
from parcela.operators.collection import Collection, lookup
from parcela.operators.embed import embed
from parcela.operators.predicate import predicate
from parcela.plans.listing_queries import ASKED, LINES, NEARLY
from parcela.sources import listing_csv
from parcela.streaming.ingest import stream_into


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").select("o").collect()]


def test_numbers(spark):
    cases = {"1,234,567": 0.0, "1.234,56": 1.23456, "1.234.567,89": 0.0, "100.000": 100.0, "1,234.56": 1234.56, "1,234,567.8": 1234567.8, "1e5": 15.0, "12-14": 0.0, "N/A": 0.0, "": 0.0, " ": 0.0, "-5": -5.0, "5.": 5.0, ".5": 0.5, "UF 3.226": 3.226, "$ 1,5": 1.5, "32": 32.0, None: 0.0}
    assert apply(spark, N.clean_numeric, list(cases)) == list(cases.values())
    assert apply(spark, N.clean_price, ["-5", "100000", "100001", "13.83569483488356"]) == [0.0, 100000.0, 100000.0, 13.83569483488356]
    assert apply(spark, N.number_problem, ["", None, " ", "32", "N/A", "1.2.3", "it's"]) == [None, None, None, None, "Sin dígitos extraíbles (original: 'N/A')", "No convertible a número (original: '1.2.3')", "Sin dígitos extraíbles (original: \"it's\")"]
    places = spark.createDataFrame([("-33.7", "-70.7"), ("0", "0"), ("-33.7", "0"), ("-17", "-66"), ("-16.99", "-70"), (None, None)], "a string, o string")
    y, x = N.clean_coordinates(F.col("a"), F.col("o"))
    assert [tuple(r) for r in places.select(y, x).collect()] == [(-33.7, -70.7), (0, 0), (0, 0), (-17, -66), (0, 0), (0, 0)]


def test_strings(spark):
    cases = {None: "", "<b>Casa</b> ñandú": "Casa nandu", "a  b@@c": "a b  c", "2026\\n\\nSi": "2026 n nSi", '"[hola\\nmundo]"': "hola mundo", "Año (2024)! $5": "Ano (2024)!  5", '"[]"': "", "«x» y": "y"}
    assert apply(spark, T.clean_string, list(cases)) == list(cases.values())
    assert apply(spark, lambda c: T.truncated(c, 3), ["abc", "abcd", "🏠abc", None, ""]) == ["abc", "abc...", "🏠ab...", None, ""]
    assert apply(spark, lambda c: T.shortened(c, 5), ["abcde", "abcdef", "a\nbcdef"]) == ["abcde", "ab...", "a\n..."]
    assert apply(spark, T.normalize_text, [" ÁRBOL  ñandú\tx ", "й́"]) == ["arbol nandu x", "и"]
    assert apply(spark, T.preprocess_text, [None, " a \n b "]) == ["", "a b"]
    long = apply(spark, T.clean_string, ["á<b>" * 100_000])[0]
    assert len(long) == 100_000 and long.isascii()


def test_images(spark):
    cases = ['{"n_img": 2, "images": ["u1","u2"]}', '{""n_img"": 1, ""images"": [""u1""]}', '"{""images"": [""u1""]}"', '["u1"]', "[]", None, "", '{"n_img": 0}', "{bad", '{"images":[""]}', '{""""n_img"""": 0, """"images"""": [""""u1"""","u2""""]}""']
    assert apply(spark, N.parse_images, cases) == [["u1", "u2"], ["u1"], ["u1"], ["u1"], [], [], [], [], [], [], []]
    assert apply(spark, N.parse_images, ['["\\ud83c.jpg", 5]']) == [["\ufffd.jpg", "5"]]
    assert apply(spark, lambda c: N.normalized_images(N.parse_images(c)), ['["a", " ", "b"]']) == [["a", "b"]]


def test_times_and_listing_numbers(spark):
    us = lambda t: int(pd.Timestamp(t).value // 1000)
    cases = {"2026-01-06 17:07:24.799147-03": us("2026-01-06 20:07:24.799147"), "2026-01-07T01:12:49.683599Z": us("2026-01-07 01:12:49.683599"), "2026-01-06 19:10:03+00": us("2026-01-06 19:10:03"), "04-02-2026 15:25:34": us("2026-02-04 18:25:34"), "2026-01-06 06:40:57-03:00": us("2026-01-06 09:40:57"), " 2026-01-06 06:40:57 ": us("2026-01-06 09:40:57"), "pendiente": None, "": None, None: None, "2026": None, "31-02-2026 10:00:00": None, "2026-13-01 00:00:00Z": None}
    assert apply(spark, instant, list(cases)) == list(cases.values())
    assert apply(spark, aviso, ["x-3000000047/", "?id=3005890607&t=1772345437834", "30000000471", None, "a 123"]) == [3000000047, 3005890607, None, None, None]
    assert apply(spark, is_missing, [None, "", " ", "-", "N/A", "No informado", "0", "x"]) == [True] * 6 + [False] * 2


def test_blob_payload_and_issues_of_a_shifted_row(spark, listings):
    row = {"url_propiedad": "http://example.com", "portal": "Portal Inmobiliario", "tipo_propiedad": "Departamento", "operacion": "Venta", "comuna": "Se Vende Promesa De Compraventa 100 Uf Departamento 1d 1b", "barrio": "n_img 3 Departamento", "m2_util": "11", "banios": "32", "titulo_propiedad": "Titulo de prueba", "descripcion": "Descripcion de prueba"}
    rows = listings([row, {}])
    got = {r.row_id: r.semantic_text for r in payload.with_blob(rows).collect()}
    assert got == {1: "Titulo de prueba Titulo de prueba Comuna Se Vende Promesa De Compraventa 100 Uf Departamento 1d 1b Barrio n_img 3 Departamento Departamento en Venta 32 banos 11 metros cuadrados utiles Descripcion de prueba", 2: ""}
    made = payload.points(rows).collect()
    assert len(made) == 1 and made[0].banios == 32 and made[0].m2_util == 11.0 and made[0].images == [] and made[0].n_images == 0 and made[0].precio_uf == 0.0
    assert all(v is not None for v in made[0])
    assert [(r.row_index, r.issue_type) for r in audit.issues(rows).collect()] == [(2, "semantic_content_insufficient")]
    assert payload.statistics(rows).first().asDict() == {"total_processed": 2, "total_embedded": 1, "total_uploaded": 1, "failed_records": 1, "batches": 1, "success_rate": "50.0%"}
    assert payload.statistics(rows.limit(0)).first().success_rate == "0.0%"


def test_audit(spark, listings, tmp_path):
    rows = listings([{"precio_uf": "-5", "anio": "N/A", "images": "{bad", "latitud": "1", "longitud": "2", "titulo_propiedad": "Una casa muy bonita"}, {"precio_uf": "200000", "m2_util": "1.2.3", "titulo_propiedad": "Una casa muy bonita"}])
    found = audit.issues(rows)
    got = [(r.row_index, r.column, r.issue_type, r.message, r.value_used) for r in found.orderBy("row_index", "seq").collect()]
    assert got == [
        (1, "PRECIO_UF", "numeric_invalid", "Precio UF negativo (-5.0); se usó 0", "0.0"),
        (1, "ANIO", "numeric_invalid", "Sin dígitos extraíbles (original: 'N/A')", "0.0"),
        (1, "LATITUD/LONGITUD", "coordinates_invalid", "Coordenadas fuera de Chile: (1.0, 2.0)", "(0.0, 0.0)"),
        (1, "IMAGES", "images_json_invalid", "JSON inválido: Expecting property name enclosed in double quotes: line 1 co", "(lista vacía)"),
        (2, "PRECIO_UF", "numeric_invalid", "Precio UF extremo (200000.0); se acotó a 100000", "100000.0"),
        (2, "M2_UTIL", "numeric_invalid", "No convertible a número (original: '1.2.3')", "0.0"),
    ]
    assert [tuple(r) for r in audit.by_type(found).collect()] == [("numeric_invalid", 4), ("coordinates_invalid", 1), ("images_json_invalid", 1)]
    assert tuple(audit.summary(found).first()) == (2, 6) and tuple(audit.summary(found.limit(0)).first()) == (0, 0)
    assert audit.issues(rows, exclude=("numeric_invalid",)).count() == 2
    text = "\n".join(audit.markdown(found, "x.csv"))
    assert "**Total de incidencias:** 6" in text and "### Fila 2" in text
    audit.write_csv(found, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["row_index", "url", "column", "raw_value", "issue_type", "message", "value_used", "requires_manual_review"]


@pytest.mark.parametrize(("asked", "filters", "rest"), ASKED)
def test_queries_in_words(asked, filters, rest):
    got = nlq.extract_filters(asked)
    assert (got[0], got[1]) == (rest, json.loads(filters))


@pytest.mark.parametrize(("text", "name", "ratio", "accepted"), NEARLY)
def test_nearly_spelled(text, name, ratio, accepted):
    found, _, r = nlq.likeness(text)
    assert (found, round(r, 4), r >= nlq.LIKENESS) == (name, ratio, accepted)


def test_lines(tmp_path, spark):
    for _, line, images, text in LINES:
        got = listing_csv.parse_line(line)
        assert (got is None) if images is None else (got[26], got[27]) == (images, text)
    assert listing_csv.parse_line("a,b") == ["a", "b"] + [""] * 26
    header = "EXECUTION_TIME,URL_PROPIEDAD\n"
    (tmp_path / "a.csv").write_text(header + "\n".join(f"t{k},u{k}" for k in range(10)) + "\n\n", encoding="utf-8")
    rows = listing_csv.read(spark, str(tmp_path), skip_rows=3)
    assert sorted(r.url_propiedad for r in rows.collect()) == [f"u{k}" for k in range(3, 10)]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20")  # the file in several splits
        assert {(r.nro_linea, r.url_propiedad) for r in listing_csv.read(spark, str(tmp_path)).collect()} == {(k + 2, f"u{k}") for k in range(10)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_batches(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n"))
    got = {r.batch: (r.a, r.b, r.c) for r in listing_csv.batches(rows, "n", 300, skip=50).groupBy("batch").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c")).collect()}
    assert got == {0: (50, 349, 300), 1: (350, 649, 300), 2: (650, 949, 300), 3: (950, 999, 50)}


def test_predicate(spark):
    rows = spark.createDataFrame([(1, "Ñuñoa", 5.0), (2, "nunoa", None), (3, None, 9.0)], "id int, comuna string, p double")
    ids = lambda f, **k: [r.id for r in rows.filter(predicate(f, **k)).orderBy("id").collect()]
    assert ids(None) == ids({}) == [1, 2, 3] and ids({"comuna": "Ñuñoa"}) == [1] and ids({"comuna": "NUNOA"}, fold_accents=True) == [1, 2]
    assert ids({"p": {"gte": 5, "lt": 9}}) == [1] and ids({"p": {"gt": 5, "unknown": 0}}) == [3] and ids({"p": {"lte": 9}, "comuna": "Ñuñoa"}) == [1]


def test_search(spark):
    rnd = random.Random(2)
    data = [(k, [rnd.gauss(0, 1) for _ in range(8)], k % 3) for k in range(120)] + [(900, [0.0] * 8, 0), (901, None, 0)]
    rows = spark.createDataFrame(data, "vec_id int, embedding array<float>, label int")
    full = [(r.vec_id, r.score) for r in search.knn(rows, data[0][1], 1000).collect()]
    top = [(r.vec_id, r.score) for r in search.knn(rows, data[0][1], 7).collect()]
    assert top == full[:7] and len(full) == 121 and dict(full)[900] == 0.0 and full[0][0] == 0
    over = [(r.vec_id, r.score) for r in search.knn(rows, data[0][1], 1000, threshold=0.3).collect()]
    assert over == [x for x in full if x[1] >= 0.3]
    assert {r.label for r in search.knn(rows, data[0][1], 5, {"label": 1}).collect()} == {1}
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    batch = {(r.query_id, r["rank"]): r.vec_id for r in search.knn_batch(rows, asked, 4).collect()}
    for q in range(0, 120, 20):
        assert [batch[q, k] for k in (1, 2, 3, 4)] == [r.vec_id for r in search.knn(rows, data[q][1], 4).collect()]
    assert [batch[900, k] for k in (1, 2, 3, 4)] == [0, 1, 2, 3]
    search_block, search.BLOCK_BYTES = search.BLOCK_BYTES, 128
    try:
        assert {(r.query_id, r["rank"]): r.vec_id for r in search.knn_batch(rows, asked, 4).collect()} == batch
    finally:
        search.BLOCK_BYTES = search_block
    assert search.knn_batch(rows, asked.limit(0), 4).count() == 0 and search.knn(rows.limit(0), data[0][1], 3).count() == 0


def test_collection_and_stream(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "store"), "casas")
    assert c.drop() and not c.exists()
    c.create(4).create(4)
    with pytest.raises(ValueError):
        c.create(5)
    rows = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0])], "name string, vector array<float>")
    assert c.append(rows) == 2 and c.append(rows) == 2
    assert c.info() == {"name": "casas", "dimension": 4, "distance": "cosine", "points_count": 4}
    assert {r.name for r in lookup(c.points(), {"name": "a"}, vector="vector").collect()} == {"a"} and "vector" not in lookup(c.points(), {}, vector="vector").columns
    with pytest.raises(Exception, match="dimension 4"):
        c.append(spark.createDataFrame([("x", [1.0])], rows.schema))
    assert c.recreate(64).count() == 0
    (tmp_path / "in").mkdir()
    line = ",".join(["2026-01-01", "u"] + ["Casa grande"] * 24 + ["[]", "Casa con patio"])
    (tmp_path / "in" / "a.csv").write_text("EXECUTION_TIME,URL_PROPIEDAD\n" + line + "\n", encoding="utf-8")
    for _ in range(2):  # the second run finds nothing new
        stream_into(spark, str(tmp_path / "in"), c, str(tmp_path / "ck")).awaitTermination()
    assert c.count() == 1 and len(c.points().first().vector) == 64


def test_embedder(spark):
    got = apply(spark, lambda c: embed(c), ["casa grande", " ", None, "casa grande"])
    assert got[0] == got[3] and got[1] == got[2] == [0.0] * 64 and abs(sum(x * x for x in got[0]) - 1) < 1e-6


def test_embedding_of_whole_texts(spark):
    from parcela.operators.embed import embed

    long = "casa " * 500
    df = spark.createDataFrame([(long,), (long + "jardín " * 300,)], "t string")
    cut, whole = df.select(embed(F.col("t")).alias("v")).collect(), df.select(embed(F.col("t"), size=None).alias("v")).collect()
    assert cut[0].v == cut[1].v and whole[0].v != whole[1].v


def test_both_ways_to_clean_agree(spark, listings):
    rnd = random.Random(9)
    texts = [None, "", '"[]"', '"[x\\ny]"', '"["""a""" b]"', "Ж щит Ωmega ς", "½ № ﬁ 🏠 <b\n>x</b> \x1c y", "x" * 3000]
    texts += ["".join(rnd.choice("aZ9 \t\n<>\\\"[]ñÉß—…Юя🏡@.,-()_\x1f") for _ in range(rnd.randrange(40))) for _ in range(300)]
    assert apply(spark, T.clean_string, texts) == apply(spark, T.cleaned, texts) == [T.clean_text(t) for t in texts]
    numbers = ["1,5", "-", "1e5", "9" * 30, "-" + "9" * 400, "2.5.1", " 7 ", "0", None]
    assert apply(spark, N.clean_numeric, numbers) == [N.read_numeric(t) for t in numbers]
    assert apply(spark, lambda c: N.truncated_int(N.clean_numeric(c)), numbers) == [N.whole(N.read_numeric(t)) for t in numbers]
    assert apply(spark, N.number_problem, ["x'y", "1.2.3", "5", " "]) == [N.read_problem(t) for t in ("x'y", "1.2.3", "5", " ")]
    rows = listings([{"titulo_propiedad": t, "descripcion": t, "comuna": u, "dormitorios": n, "m2_util": n} for t, u, n in zip(texts, reversed(texts), numbers * 40)], clash=False)
    own = {c: F.col(c) for c in rows.columns}
    assert rows.filter(~payload.semantic_blob(own).eqNullSafe(payload.blob_expression(own))).count() == 0
    for size in (4, 10):
        assert rows.filter(payload.blob_reaches(own, size) != (F.length(F.trim(payload.semantic_blob(own))) >= size)).count() == 0


def test_tiles_give_the_best(monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "TILE_CELLS", 640)
    rng = np.random.default_rng(3)
    q, rows = rng.normal(size=(50, 4)).round(1), rng.normal(size=(333, 4)).round(1)  # with ties
    score, name = search.best_of(q, rows, np.arange(333), 7)
    full = np.round(q @ rows.T, 12)
    order = np.lexsort((np.broadcast_to(np.arange(333), full.shape), -full), axis=1)[:, :7]
    assert (name == order).all() and np.allclose(score, np.take_along_axis(full, order, axis=1))
    assert search.best_of(q, rows[:3], np.arange(3), 7)[0].shape == (50, 3)


def test_many_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 1 << 20)  # 70,000 queries of 8 dimensions are five blocks
    vec = F.array(*[F.sin(F.col("id") * (k + 1) + k) for k in range(8)])
    rows = spark.range(500).select(F.col("id").alias("vec_id"), vec.alias("embedding"))
    asked = spark.range(70_000).select(F.col("id").alias("query_id"), vec.alias("embedding"))
    found = search.knn_batch(rows, asked, 3)
    total = found.agg(F.count("*"), F.sum("rank"), F.sum(F.when((F.col("rank") == 1) & (F.col("query_id") < 500), (F.col("query_id") == F.col("vec_id")).cast("int")))).first()
    assert tuple(total) == (210_000, 70_000 * 6, 500)
    some = {(r.query_id, r["rank"]): r.vec_id for r in found.filter("query_id in (7, 69999)").collect()}
    for q in (7, 69_999):
        v = asked.filter(F.col("query_id") == q).first().embedding
        assert [some[q, k] for k in (1, 2, 3)] == [r.vec_id for r in search.knn(rows, v, 3).collect()]
