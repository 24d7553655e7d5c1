import csv
import io

import pytest
from hypothesis import given
from hypothesis import strategies as st

from parcela.operators import quarantine as Q

P = ",".join(f"c{k}" for k in range(26))
GOOD = P + ',"{""n_img"": 1, ""images"": [""u""]}","[\'hola, mundo\']"'


def wrap(line):
    return '"' + line.replace('"', '""') + '"'


@pytest.mark.parametrize(
    ("line", "why"),
    [
        (GOOD, None), (GOOD + "\r\n", None), (wrap(GOOD), None), (wrap(GOOD) + "\r", None), (P + ",,", None), (P + ",[],x", None), ("", None), ("  \r", None),
        (P + ',"{""n_img"": 0}",x', "valor_invalido"), (P + ",fotos.zip,", "valor_invalido"), (P + ",\"{'images': []}\",x", "valor_invalido"), (P + ",,\"['sin fin\"", "valor_invalido"), (P + ',,"[""x...""', "comillas"),
        (P + ",,\"['x']...\"", "valor_invalido"), (P + ",,[OFERTA] casa", None), (P + ",,\"['x'\"\"]\"", "valor_invalido"),
        (P + ",x", "pocas_columnas"), ("a", "pocas_columnas"), (GOOD + ",mas", "muchas_columnas"), (wrap(GOOD + ",mas"), "muchas_columnas"),
        (P + ',,"sin cerrar', "comillas"), (P + ',,"x"y', "comillas"), (P + ',,dice "hola"', "comillas"), (wrap(P + ',,"x"y'), "comillas"), ('a,"b', "comillas"), (wrap(GOOD)[:-4], "comillas"),
        (P + ',"{""""n_img"""": 1, """"images"""": [""""u""""]}",x', None),
    ],
)
def test_reasons(line, why):
    assert Q.reason(line, 28) == why
    assert (Q.load(line, 28) is not None) == (why is None and bool(line.strip()))


@given(st.lists(st.text(alphabet='ab,"\' ñ[', max_size=8), min_size=28, max_size=28))
def test_written_records_load(values):
    values[26], values[27] = "", "x"
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    assert Q.load(out.getvalue(), 28) == values and Q.load(wrap(out.getvalue()), 28) == values


def test_lines_are_parted(spark):
    rows = [(1, GOOD, "z"), (2, P, "z"), (3, None, "z"), (4, " ", "z"), (5, P, "z"), (6, wrap(GOOD), "z"), (7, P + ',,"' + "x" * 300_000, "z")]
    lines = spark.createDataFrame(rows, "linea_id long, linea string, motivo string")
    assert {tuple(r) for r in Q.rejected(lines).collect()} == {(2, "pocas_columnas"), (5, "pocas_columnas"), (7, "comillas")}
    loaded = Q.loaded(lines)
    assert {r.linea_id for r in loaded.collect()} == {1, 6} and loaded.columns == ["linea_id", *Q.COLUMNS]
    assert Q.rejected(lines.limit(0)).count() == 0 and Q.loaded(lines.limit(0)).count() == 0
