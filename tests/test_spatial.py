import math
import random

import numpy as np
import pytest

from parcela.operators import spatial

SQUARES = [(1, "POLYGON((-71 -34, -70 -34, -70 -33, -71 -33, -71 -34))"), (2, "POLYGON((-70 -34, -69 -34, -69 -33, -70 -33, -70 -34))"), (3, "POLYGON((-68 -34, -67 -33.2, -67.5 -33, -68 -34))")]


def _distance(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * spatial.EARTH_M * math.asin(math.sqrt(h))


def _inside(wkt, x, y):
    ring = spatial.rings(wkt)[0]
    odd = False
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def _points(n, seed):
    rnd = random.Random(seed)
    return np.array([(rnd.uniform(-34.2, -32.8), rnd.uniform(-71.2, -66.8)) if rnd.random() > 0.3 else (-33.45 + rnd.gauss(0, 0.002), -70.66 + rnd.gauss(0, 0.002)) for _ in range(n)])


@pytest.mark.parametrize("spread", ["plain", "date line", "pole"])
def test_near_points_against_brute_force(spread):
    q, r = _points(700, 1), _points(300, 2)
    if spread == "date line":
        q[:, 1], r[:, 1] = (q[:, 1] + 69.0 + 180 + 180) % 360 - 180, (r[:, 1] + 69.0 + 180 + 180) % 360 - 180
    if spread == "pole":
        q[:, 0], r[:, 0] = -90 + abs(q[:, 0] + 33.5), -90 + abs(r[:, 0] + 33.5)
    reach = np.array([random.Random(k).choice([50, 400, 900, 20_000]) for k in range(len(r))])
    a, b = spatial.NearPoints(np.arange(len(r)), r[:, 0], r[:, 1], reach).join(q[:, 0], q[:, 1])
    got = set(zip(a.tolist(), b.tolist()))
    want = {(i, j) for i in range(len(q)) for j in range(len(r)) if _distance(*q[i], *r[j]) <= reach[j]}
    assert len(a) == len(got) and got == want


def test_regions_against_brute_force():
    q = np.vstack([_points(3000, 3), [[-33.5, -70.0], [-34.0, -70.5], [-33.0, -69.5]]])
    a, b = spatial.Regions([i for i, _ in SQUARES], [w for _, w in SQUARES]).join(q[:, 0], q[:, 1])
    want = {(k, j) for k in range(len(q)) for j, (_, w) in enumerate(SQUARES) if _inside(w, q[k, 1], q[k, 0])}
    assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == want
    assert sum(x == 3000 for x in a) == 1  # a shared border belongs to one region


def _tables(spark):
    comunas = spark.createDataFrame([*SQUARES, (None, None), (9, None)], "comuna_id long, poligono string")
    pois = spark.createDataFrame([(50, -33.45, -70.66, 900), (51, -33.45, -70.66, 900), (52, -33.46, -70.66, 100), (53, None, -70.0, 100), (54, -33.45, -70.66, None)], "poi_id long, latitud double, longitud double, radio_m int")
    return comunas, pois


def test_places(spark, listings):
    comunas, pois = _tables(spark)
    rows = listings([
        {"latitud": "-33.45", "longitud": "-70.66"}, {"latitud": " -33,45", "longitud": "-70,66 "}, {"latitud": "-33.45", "longitud": "-70.66"}, {"latitud": None, "longitud": "-70.66"}, {"latitud": "33.45", "longitud": "70.66"},
        {"latitud": "-3345", "longitud": "-7066"}, {"latitud": "nan", "longitud": ""}, {"latitud": "-33.457", "longitud": "-70.66"}, {"latitud": "-50", "longitud": "-100"},
    ])
    got = [tuple(r) for r in spatial.places(rows, comunas, pois).collect()]
    want = [(i, "comuna", 1) for i in (1, 2, 3, 8)] + [(i, "punto", p) for i in (1, 2, 3, 8) for p in (50, 51)]
    assert sorted(got) == sorted(want)
    assert spatial.places(rows.limit(0), comunas, pois).count() == 0
    assert {r.clase for r in spatial.places(rows, comunas, pois.limit(0)).collect()} == {"comuna"} and {r.clase for r in spatial.places(rows, comunas.limit(0), pois).collect()} == {"punto"}


def test_many_references_are_split_by_cell(spark):
    q, r = _points(400, 4), _points(200, 5)
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(q)], "row_id long, lat double, lon double")
    refs = spark.createDataFrame([(k, float(a), float(b), [300.0, 2500.0][k % 2]) for k, (a, b) in enumerate(r)], "ref_id long, lat double, lon double, reach double")
    got = [(x.row_id, x.ref_id) for x in spatial.near_points(points, refs).collect()]
    want = {(i, j) for i in range(len(q)) for j in range(len(r)) if _distance(*q[i], *r[j]) <= [300.0, 2500.0][j % 2]}
    assert len(got) == len(set(got)) and set(got) == want
    assert spatial.near_points(points, refs.limit(0)).count() == 0


def _same(spark, q, r, reach, **sizes):
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(q)], "row_id long, lat double, lon double")
    refs = spark.createDataFrame([(k, float(a), float(b), float(m)) for k, ((a, b), m) in enumerate(zip(r, reach))], "ref_id long, lat double, lon double, reach double")
    got = [(x.row_id, x.ref_id) for x in spatial.near_points(points, refs, **sizes).collect()]
    want = {(i, j) for i in range(len(q)) for j in range(len(r)) if _distance(*q[i], *r[j]) <= reach[j]}
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("spread", ["plain", "date line", "pole"])
def test_leaves_and_shares_against_brute_force(spark, spread):
    q, r = _points(500, 6), _points(200, 7)
    if spread == "date line":
        q[:, 1], r[:, 1] = (q[:, 1] + 69.0 + 360) % 360 - 180, (r[:, 1] + 69.0 + 360) % 360 - 180
    if spread == "pole":
        q[:, 0], r[:, 0] = -90 + abs(q[:, 0] + 33.5) / 10, -90 + abs(r[:, 0] + 33.5) / 10
    q[:200] = q[0]  # a crowd in one place, more than a leaf may hold at any level
    reach = [random.Random(k).choice([50, 400, 20_000, 300_000]) for k in range(len(r))]
    _same(spark, q, r, reach, target=30, most=20)


def test_leaves_cover_all_positions(spark):
    q = _points(3000, 8)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in q], "lat double, lon double")
    leaves = spatial.Leaves.of(points, 50)
    own = leaves.find(spatial.cell_code(q[:, 0], q[:, 1]))
    assert np.bincount(own, minlength=len(leaves.count)).tolist() == leaves.count.tolist() and leaves.count.sum() == 3000 and (leaves.level > spatial._FIRST).any()
    low, high = leaves.boxes()
    assert ((q >= low[own] - 1e-9) & (q <= high[own] + 1e-9)).all()


def test_regions_of_any_number(spark):
    q = np.vstack([_points(800, 9), [[-33.5, -70.0]]])
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(q)], "row_id long, lat double, lon double")
    own = [*SQUARES, (4, "POLYGON((-72 -35, -66 -35, -66 -32, -72 -32, -72 -35))")]
    shapes = spark.createDataFrame([*own, (5, "")], "ref_id long, wkt string")
    got = [(x.row_id, x.ref_id) for x in spatial.containing_regions(points, shapes, target=20, most=2).collect()]
    want = {(k, j) for k in range(len(q)) for j, w in own if _inside(w, q[k, 1], q[k, 0])}
    assert len(got) == len(set(got)) and set(got) == want


def test_places_beyond_the_bounds(spark, listings, monkeypatch):
    comunas, pois = _tables(spark)
    rows = listings([{"latitud": str(-33.45 + 0.001 * k), "longitud": "-70.66"} for k in range(12)])
    want = sorted(tuple(r) for r in spatial.places(rows, comunas, pois).collect())
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 1)
    assert sorted(tuple(r) for r in spatial.places(rows, comunas, pois).collect()) == want and want
    assert spatial.places(rows.limit(0), comunas, pois).count() == 0
