import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcela.operators.unpack import split_values, unpacked

A, B, C = "https://cdn.example/fit,w_800/1/a.jpg", "http://m.example/2;v=2/b.jpg?x=1|2", "3000000001_c.webp"


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (None, []), ("", []), (" ", []), ("[]", []), ('{"n_img": 3}', []), ('{"n_img": 0, "images": []}', []), (A, [A]), (f"{A}, ", [A]), (f";{A}|{B}", [A, B]),
        (json.dumps({"n_img": 9, "images": [A, "", None, " ", B, A]}), [A, B, A]), (json.dumps([A, B]), [A, B]), (str([A, B]), [A, B]),
        (json.dumps({"images": [A, B]}).replace("/", "\\/"), [A, B]), (json.dumps({"n_img": 2, "images": [A, B]}).replace('"', '""'), [A, B]),
        ('"' + json.dumps({"images": [A, B]}).replace('"', '""') + '"', [A, B]), (json.dumps({"images": [A, B]}).replace('"', '""""'), [A, B]),
        (f"{A}; {B};{A} {B}\n{A}\\n{B} | {C}", [A, B, A, B, A, B, C]), (f'"{A}","{B}"', [A, B]), (f'"{A}";"{B}"', [A, B]), ('"a""b.jpg","c.jpg"', ['a"b.jpg', "c.jpg"]),
        (f"{C},{C} {C}|{C}", [C] * 4), ('["null", null]', ["null"]), ('{"other": ["z.jpg"], "images": ["y.jpg"], "n": [1]}', ["y.jpg"]), ("['it''s.jpg']", ["it''s.jpg"]), ('["a\\u00e1.jpg"]', ["aá.jpg"]), ('["\\ud83c\\udfe1.jpg"]', ["🏡.jpg"]), ('["\\ud83c.jpg"]', ["\ufffd.jpg"]),
        ('["a.jpg"', ["a.jpg"]), ('["a.jpg', ["a.jpg"]), ('[""]', []), ('["", "x.jpg"]', ["x.jpg"]),
    ],
)
def test_notations(text, values):
    assert split_values(text) == values


urls = st.lists(st.from_regex(r"https://[a-z]{2,8}\.example/(fit,w_\d{3}/|\d{3};v=2/)?[a-z0-9]{3,8}\.(jpg|webp)(\?x=1\|2)?", fullmatch=True), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(urls, st.sampled_from([", ", ",", ";", "; ", " | ", "|", " ", "\n", "\\n"]), st.integers(0, 3))
def test_round_trips(values, separator, levels):
    assert split_values(separator.join(values)) == values
    text = json.dumps({"n_img": len(values), "images": values})
    for _ in range(levels):
        text = text.replace('"', '""')
    assert split_values(text) == values
    assert split_values(str(values)) == values


def test_long_fields_end():
    many = [f"https://x.example/{k}.jpg" for k in range(50_000)]
    assert split_values(json.dumps(many)) == many and split_values(" ".join(many)) == many
    split_values('"' * 100_001), split_values("[" * 100_000), split_values("\\" * 100_001)


@given(st.text(max_size=60))
def test_any_text_ends(text):
    assert all(v.strip() for v in split_values(text))


def test_rows_with_positions(spark, listings):
    rows = listings([{"images": json.dumps([A, "", B, A])}, {"images": None}, {"images": "[]"}, {"images": C}, {"images": C}])
    got = [tuple(r) for r in unpacked(rows, "row_id", F.col("images")).orderBy("row_id", "posicion").collect()]
    assert got == [(1, 1, A), (1, 2, B), (1, 3, A), (4, 1, C), (5, 1, C)]
    assert unpacked(rows.limit(0), "row_id", F.col("images")).count() == 0
