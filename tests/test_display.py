import os

import pytest
from pyspark.sql import functions as F

from parcela import audit_main
from parcela.functions.registry import register
from parcela.operators import audit, display, payload
from parcela.operators.collection import Collection
from parcela.operators.embed import MODELS, Model, dimension_of, embed, hashing_embedder, models
from parcela.sources import listing_csv
from parcela.storage import materialize, scratch


def test_results_with_defaults(spark):
    hits = spark.createDataFrame([(1, None, "", 1234.5, 0, None, 80_500.5, 0, "x" * 250, ["u1", "u2"]), (2, "Buin", "Centro", None, 3, 2015, None, 2, "", [])], "id int, comuna string, barrio string, precio_uf double, dormitorios int, anio int, gastos_comunes double, bodega int, descripcion string, images array<string>")
    a, b = display.result_view(hits, "id").orderBy("id").collect()
    assert (a.comuna, a.barrio, a.precio_uf, a.dormitorios, a.banios, a.anio, a.gastos_comunes, a.bodega, a.descripcion, a.url) == ("No especificada", None, "1234.50", "0", "N/A", None, "80,500", None, "x" * 200 + "...", None)
    assert (b.comuna, b.barrio, b.precio_uf, b.anio, b.bodega, b.descripcion) == ("Buin", "Centro", "0.00", "2015", "2", None)
    assert [tuple(r) for r in display.shown_images(hits, "id").collect()] == [(1, 1, "u1"), (1, 2, "u2")]
    dump = display.payload_json(hits.select("id", "precio_uf", "comuna"), "id").orderBy("id").first().json
    assert dump == '{\n  "comuna": null,\n  "precio_uf": 1234.5\n}'
    assert len(display.payload_json(hits.select("id", F.repeat(F.lit("á"), 9000).alias("t")), "id").first().json) == 2000
    assert display.result_view(hits.limit(0), "id").count() == 0 and [r[0] for r in spark.range(1).select(display.capitalized(F.lit("ñUÑOA x"))).collect()] == ["Ñuñoa x"]


def test_functions_in_sql(spark):
    assert {"clean_string", "clean_numeric", "embed_text"} <= set(register(spark))
    got = spark.sql("SELECT clean_string('<b>Ñandú</b>') a, clean_numeric('1.234,5') b, clean_price('-3') c, number_problem('x') d, parse_images('[\"u\"]') e, images_problem('{') IS NULL f, size(embed_text('casa')) g, clean_numeric(NULL) h").first()
    assert tuple(got) == ("Nandu", 1.2345, 0.0, "Sin dígitos extraíbles (original: 'x')", ["u"], False, 64, 0.0)


def test_models(spark, monkeypatch):
    assert [tuple(r) for r in models(spark).collect()][:1] == [("hash-64", 64, 2000)]
    monkeypatch.setitem(MODELS, "own", Model("own", lambda: hashing_embedder(7)))
    assert MODELS["own"].info() == {"model_name": "own", "dimension": 7, "max_length": None} and dimension_of(hashing_embedder) == 64
    rows = spark.createDataFrame([("casa",)], "t string")
    assert len(rows.select(embed(F.col("t"), lambda: hashing_embedder(7), dimension=None).alias("v")).first().v) == 7  # the dimension is what the model gives
    with pytest.raises(Exception, match="embedder gave"):
        rows.select(embed(F.col("t"), lambda: hashing_embedder(7)).alias("v")).collect()


def test_a_repeated_batch_is_there_once(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "x").create(2)
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "name string, vector array<float>")
    assert c.append(rows, batch="s-1") == 2 and c.append(rows, batch="s-1") == 2 and c.count() == 2
    assert c.append(rows.limit(0), batch="s-2") == 0 and c.append(rows.limit(1)) == 1 and c.count() == 3
    assert set(c.points().columns) == {"id", "name", "vector"}


def test_skipped_rows_are_parsed_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("EXECUTION_TIME,URL_PROPIEDAD\nt0,u0\n\n\nt1,u1\nt2,u2\n", encoding="utf-8")
    assert [r.url_propiedad for r in listing_csv.read(spark, str(tmp_path), skip_rows=2).collect()] == ["u2"]
    plan = listing_csv.read(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Window" in plan and plan.count("MapInPandas") >= 2
    read = listing_csv.lenient(spark.createDataFrame([('a,"b,c"',), ("a",), (None,)], "value string"), names=("x", "y"))
    assert [(r.x, r.y, r._corrupt) for r in read.collect()] == [("a", "b,c", None), ("a", None, "a")]


def test_reports(spark, listings, tmp_path):
    lines = [",".join(["2026-01-01", f"http://x/{k}", "p", "casa", "Venta", "Buin", "b", "-33", "-70", "N/A" if k % 2 else "5", *["1"] * 15, "Una casa muy grande", "[]", "Casa con patio"]) for k in range(2500)]
    (tmp_path / "in.csv").write_text("EXECUTION_TIME,URL_PROPIEDAD\n" + "\n".join(lines), encoding="utf-8")
    made = audit_main.run(spark, str(tmp_path / "in.csv"), str(tmp_path / "out" / "r.CSV"))
    assert {k: os.path.basename(v) for k, v in made.items()} == {"csv": "r.CSV", "md": "r.md"}
    text = [r.value for r in spark.read.text(made["md"]).collect()]
    found = audit.issues(listing_csv.read(spark, str(tmp_path / "in.csv")).withColumn("row_id", F.col("nro_linea") - 1))
    assert sum(t.startswith("### Fila ") for t in text) == found.select("row_index").distinct().count() >= 1250  # all rows, not the first thousand
    assert text[0].startswith("# Reporte") and sum(t.startswith("### Fila ") for t in audit.markdown(found, "in.csv")) >= 1250
    assert spark.read.csv(made["csv"], header=True).count() == found.count()
    none = audit_main.run(spark, str(tmp_path / "in.csv"), str(tmp_path / "none"), "md", ("numeric_invalid", "coordinates_invalid", "images_json_invalid", "semantic_content_insufficient"))
    assert list(none) == ["md"] and "**Total de incidencias:** 0" in [r.value for r in spark.read.text(none["md"]).collect()]


def test_status_and_report_of_a_load(spark, listings):
    rows = listings([{"titulo_propiedad": "Casa con patio"}, {}])
    assert [tuple(r) for r in payload.with_status(rows).orderBy("row_id").collect()] == [(1, "uploaded", None), (2, "failed", "insufficient semantic content")]
    report = {r.nombre: r.valor for r in payload.final_report(payload.statistics(rows), 0.5, "c", "m", 3).collect()}
    assert report["Records per Second"] == "4.0" and report["Success Rate"] == "50.0%" and report["Vector Dimension"] == "3"
    assert {r.nombre: r.valor for r in payload.final_report(payload.statistics(rows.limit(0)), 0, "c", "m", 3).collect()}["Records per Second"] == "0.0"


def test_scratch_tables_are_removed(spark):
    with scratch(spark):
        t = materialize(spark.range(3).toDF("n"), "x")
        files = t.inputFiles()
        assert t.count() == 3
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
