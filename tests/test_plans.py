"""Plans have the shape that large inputs need: narrow where no rows need to meet, filters and columns in the scan."""

import os
import re

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
QUERIES = entry.queries()


def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p6_loaded", "p7_found", "semantic_blob", "payload_projection", "audit_issues", "clean_numeric", "content_filter", "cosine_pairs"])
def test_no_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, name):
    if name in ("p10_found", "p10_composition", "p5_filled"):  # fitted when called; covered by the tests of their results
        return
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


def test_filters_and_columns_reach_the_scan(spark):
    assert "EqualTo(tipo_propiedad,departamento)" in plan(spark, "filter_eq") and "GreaterThanOrEqual(label,1)" in plan(spark, "knn_filtered")
    assert re.search(r"ReadSchema: struct<row_id:bigint,precio_uf:string,gastos_comunes:string>", plan(spark, "p1_found"))
    assert "TakeOrderedAndProject" in plan(spark, "knn_topk")
    assert "descripcion" not in re.search("ReadSchema: .*", plan(spark, "p3_found")).group()


def test_orders_of_any_key(spark, tmp_path):
    rows = [(k, "F", 100000.0) for k in (1, 999_999, 1_000_000, 6_000_000_000)] + [(2_000_000, "O", 100000.0), (3_000_000, "F", 99999.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.o_orderkey for r in QUERIES["filter_conj"](spark, str(tmp_path)).collect()) == [1, 999_999, 1_000_000, 6_000_000_000]


def steps(spark, name):
    """The operators of a plan from the top down, as they stand in its outline."""
    return re.findall(r"^[ :+\-*]*([A-Za-z]\w+)(?: (\w+))?.*\(\d+\)$", plan(spark, name).split("\n\n")[0], re.M)


def test_the_tokenizer_runs_once(spark):
    assert [s for s, _ in steps(spark, "p3_found")].count("ArrowEvalPython") == 1


def test_diagnosis_stands_above_the_subtraction(spark):
    own = [" ".join(s) for s in steps(spark, "p6_found")]
    joins = [k for k, s in enumerate(own) if "LeftAnti" in s]
    maps = [k for k, s in enumerate(own) if s.startswith("MapInPandas")]
    assert len(joins) == 1 and len(maps) == 2 and maps[0] < joins[0] < maps[1] and not any(s.startswith("ArrowEvalPython") for s in own)


def test_prices_are_parsed_above_the_layout(spark):
    own = [s for s, _ in steps(spark, "p2_found")]
    assert own.count("ArrowEvalPython") == 1 and own.index("ArrowEvalPython") < own.index("Sort") < own.index("Exchange")
