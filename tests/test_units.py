import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from parcela.functions.units import EXPENSE_RANGES, PRICE_RANGES, DIMENSIONS, parse_amount, parse_money, parse_unit
from parcela.operators import units


@pytest.mark.parametrize(
    ("text", "code", "base"),
    [
        ("UF 12.640", "UF", 12640), ("U.F. 10.194", "UF", 10194), ("9,28 UF", "UF", 9.28), ("UF9.72", "UF", 9.72), ("UF 2.980,00", "UF", 2980), ("58000.0000000000000", "UF", 58000),
        ("16.85860368630000", "UF", 16.8586036863), ("4731.3", "UF", 4731.3), ("9,889 mil UF", "UF_MIL", 9889), ("UF 2,721 mil", "UF_MIL", 2721), ("2,506 miles de UF", "UF_MIL", 2506),
        ("735k", "CLP_MIL", 735_000), ("1.173 mil", "CLP_MIL", 1_173_000), ("M$ 991", "CLP_MIL", 991_000), ("1.012 lucas", "CLP_MIL", 1_012_000), ("351 MIL", "CLP_MIL", 351_000),
        ("CLP 2669500", "CLP", 2_669_500), ("$ 513.860.000", "CLP", 513_860_000), ("$516.400.-", "CLP", 516_400), ("626970000", "CLP", 626_970_000), ("624000.0", "CLP", 624_000),
        ("529,4 millones de pesos", "CLP_MM", 529_400_000), ("MM$ 99,12", "CLP_MM", 99_120_000), ("$ 963,8 mill.", "CLP_MM", 963_800_000), ("101,2 MM", "CLP_MM", 101_200_000),
        ("US$ 601", "USD", 601), ("74.343 dólares", "USD", 74_343), ("US$1,008,196", "USD", 1_008_196), ("u$s 981", "USD", 981), ("2505810 usd", "USD", 2_505_810), ("0", "UF", 0),
    ],
)
def test_prices(text, code, base):
    m = parse_money(text, PRICE_RANGES)
    assert (m.code, round(m.base, 6)) == (code, pytest.approx(base))


@pytest.mark.parametrize(("text", "code", "base"), [("66", "CLP_MIL", 66_000), ("0,9", "UF", 0.9), ("128,000", "CLP", 128_000), ("MM$ 0,036", "CLP_MM", 36_000), ("100 mil aprox", "CLP_MIL", 100_000), ("$ 47.982 aprox.", "CLP", 47_982), ("M$136", "CLP_MIL", 136_000), ("9.94 uf", "UF", 9.94), ("$ 20 mil", "CLP_MIL", 20_000)])
def test_expenses(text, code, base):
    m = parse_money(text, EXPENSE_RANGES)
    assert (m.code, m.base) == (code, pytest.approx(base))


@pytest.mark.parametrize("text", [None, "", "  ", "consultar", "Sin gastos", "s/i", "nan", "12 - 14", "5 manzanas", "UF", "3 m2", "$" * 100_000])
def test_no_amount(text):
    assert parse_money(text, PRICE_RANGES) is None


def test_dimensions_multiply_and_offsets_apply():
    unit = parse_unit("uf/m2")
    assert dict(zip(DIMENSIONS, unit.dims))["UF"] == 1 and dict(zip(DIMENSIONS, unit.dims))["length"] == -2
    assert parse_amount("65 m2").base == 65 and parse_amount("1,5 ha").base == 15_000 and parse_amount("2 km").base == 2_000
    assert parse_amount("20 °C").base == pytest.approx(293.15) and parse_amount("68 °F").base == pytest.approx(293.15)


@given(st.integers(1, 10**9))
def test_grouping_only_formats(n):
    for text in (f"{n:,}".replace(",", "."), f"$ {n:,}", f"{n} pesos"):
        m = parse_money(text if "$" in text or "pesos" in text else f"CLP {text}", PRICE_RANGES)
        assert (m.code, m.base) == ("CLP", n)


@given(st.text(max_size=40))
def test_any_text_parses_or_not(text):
    parse_money(text, EXPENSE_RANGES)


def test_foreign_units_and_canonical(spark, listings):
    rows = listings([
        {"execution_time": "2026-01-06 23:30:00-03", "precio_uf": "$ 39.000.000", "gastos_comunes": "2 UF"},
        {"execution_time": "2026-01-07T02:30:00Z", "precio_uf": "US$ 39.000", "gastos_comunes": "90.000"},
        {"execution_time": None, "precio_uf": "$ 39.000.000", "gastos_comunes": "66"},
        {"precio_uf": None, "gastos_comunes": ""},
        {"precio_uf": "0", "gastos_comunes": "0"},
        {"execution_time": "2026-01-06 10:00:00-03", "precio_uf": "1.000 UF", "gastos_comunes": "consultar"},
    ])
    found = {tuple(r) for r in units.foreign_units(rows).collect()}
    assert found == {(1, "precio_uf", "CLP"), (1, "gastos_comunes", "UF"), (2, "precio_uf", "USD"), (3, "precio_uf", "CLP"), (3, "gastos_comunes", "CLP_MIL")}
    rates = spark.createDataFrame([(datetime.date(2026, 1, 6), 39_000.0, 1_000.0)], "fecha date, uf_clp double, usd_clp double")
    got = {r.row_id: (r.precio, r.gastos) for r in units.canonical_amounts(rows, rates).collect()}
    assert got == {1: (1000.0, 78_000.0), 2: (1000.0, 90_000.0), 3: (None, 66_000.0), 4: (None, None), 5: (0.0, 0.0), 6: (1000.0, None)}
    assert units.foreign_units(rows.limit(0)).count() == 0 and units.canonical_amounts(rows.limit(0), rates.limit(0)).count() == 0
