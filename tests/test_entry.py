import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def rows(frame, columns):
    out = []
    for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False):
        out.append(tuple(round(float(v), 6) if isinstance(v, float) else v if v is None or isinstance(v, str | bool) else int(v) for v in r))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SMALL)
    if name not in SQL:
        got.write.format("noop").mode("overwrite").save()
        return
    got, want = got.toPandas(), tables.execute(SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
