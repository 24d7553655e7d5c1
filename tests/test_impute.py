import random

import numpy as np
import pandas as pd

from parcela.operators import impute

MISSING = {None, "", " ", "-", "N/A", "nan", "None", "s/i", "No informado", "Sin información"}


def _clean(field, v):
    if v in MISSING or field == "m2_util" and v in ("0", "0.0"):
        return None
    return v.strip().lower() if field == "barrio" else str(int(float(v.split()[0].rstrip("D").replace(",", "."))))


def _brute(rows):
    out, groups = set(), {}
    for r in rows:
        if r["aviso"] and r["t"] is not None:
            groups.setdefault(r["aviso"], []).append(r)
    for own in groups.values():
        own.sort(key=lambda r: (r["t"], r["row_id"]))
        for f in impute.FIELDS:
            held = [_clean(f, r[f]) for r in own]
            for k, r in enumerate(own):
                if held[k] is None:
                    v = next((h for h in reversed(held[:k]) if h is not None), None) or next((h for h in held[k:] if h is not None), None)
                    if v is not None:
                        out.add((r["row_id"], f, v))
    return out


def _rows(n, hot):
    rnd, rows = random.Random(3), []
    for k in range(n):
        t = rnd.choice([None, *range(400)]) if rnd.random() < 0.3 else rnd.randrange(100_000)
        rows.append({
            "row_id": k + 1, "aviso": 3000000000 + (0 if rnd.random() < hot else rnd.randrange(1, 200)) if rnd.random() > 0.05 else None, "t": t,
            "m2_util": rnd.choice([*MISSING, "0", "65.00", "100,00", "89 m2", " 70"]), "dormitorios": rnd.choice([*MISSING, "0", "2", "3D", "2 dorm.", "1.0"]), "barrio": rnd.choice([*MISSING, "Villa Ñ", " Población X "]),
        })
    return rows


def _table(listings, rows):
    stamp = lambda t: "n/a" if t is None else str(pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=t)) + "+00"
    return listings([{**{f: r[f] for f in impute.FIELDS}, "row_id": r["row_id"], "url_propiedad": r["aviso"] and f"u-{r['aviso']}-x", "execution_time": stamp(r["t"])} for r in rows])


def test_carry_against_brute_force_with_a_hot_listing(spark, listings):
    rows = _rows(3000, 0.4)
    got = [tuple(r) for r in impute.filled_from_listing(_table(listings, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)


def test_a_hot_group_is_cut(spark):
    rows = [(1, t, t, "v" if t in (5, 900) else None) for t in range(1000)] + [(g, 0, 5000 + g, None) for g in range(2, 50)]
    df = spark.createDataFrame(rows, "g long, at long, tie long, v string")
    out = impute.carried(df, "g", "at", "tie", ["v"], parts=16)
    got = {(r.g, r.at): r.v_fill for r in out.collect()}
    assert len(got) == len(rows)
    assert all(got[1, t] == "v" for t in range(1000))  # from the 5th, before it from the later ones
    assert got[2, 0] is None
    none = spark.createDataFrame([], df.schema)
    assert impute.carried(none, "g", "at", "tie", ["v"]).count() == 0


def test_everything_is_filled_and_marked(spark, listings):
    rnd, rows = random.Random(1), []
    for k in range(600):
        big = k % 2
        rows.append({"row_id": k + 1, "execution_time": "2026-01-01 00:00:00Z", "url_propiedad": f"u-{3000000000 + k}", "tipo_propiedad": "casa" if big else "departamento", "operacion": "Venta", "comuna": "Sur" if big else "Norte",
                     "barrio": ("Villa A" if big else "Villa B") if rnd.random() > 0.2 else None, "m2_util": str(180 + rnd.randrange(20) if big else 50 + rnd.randrange(10)) if rnd.random() > 0.2 else "s/i", "m2_total": str(220 if big else 60),
                     "dormitorios": str(5 if big else 2) if rnd.random() > 0.2 else "", "banios": str(4 if big else 1), "precio_uf": "UF 20.000" if big else "UF 3.000", "latitud": "-33.5", "longitud": "-70.6"})
    table = listings(rows)
    rates = spark.createDataFrame([], "fecha date, uf_clp double, usd_clp double")
    got = {(r.row_id, r.campo): (r.valor, r.origen) for r in impute.filled(table, rates).collect()}
    want = {(r["row_id"], f) for r in rows for f in impute.FIELDS if r[f] in MISSING}
    assert set(got) == want and {o for _, o in got.values()} == {"als"}
    right = lambda f, ok: np.mean([ok(int(k[0]) % 2 == 0, v[0]) for k, v in got.items() if k[1] == f])
    assert right("barrio", lambda big, v: v == ("villa a" if big else "villa b")) > 0.95
    assert right("dormitorios", lambda big, v: abs(int(v) - (5 if big else 2)) <= 1) > 0.95
    assert right("m2_util", lambda big, v: (120 < int(v) < 260) == big) > 0.95
    assert impute.filled(table.limit(0), rates).count() == 0


def test_masked_values_are_found_again(spark, monkeypatch):
    rnd, rows = random.Random(4), []
    for k in range(1500):
        c = rnd.randrange(6)
        size = 4.0 + 0.15 * c + rnd.gauss(0, 0.05)
        barrio = f"barrio {c} {0 if rnd.random() < 0.7 else rnd.randrange(1, 4)}"
        rows.append((k, size, size + rnd.gauss(0.1, 0.02), float(round(1 + 0.6 * c)), 1.0 + c // 3, 8.0 + c * 0.2, -33.0 - c * 0.05, -70.0, "casa", "venta", f"comuna {c}", barrio, barrio.upper()))
    names = ["registro", *impute.NUMERIC, *impute.CATEGORICAL, "barrio_escrito"]
    cells = spark.createDataFrame(rows, "registro long, " + ", ".join(f"{n} double" for n in impute.NUMERIC) + ", " + ", ".join(f"{n} string" for n in names[8:]))
    found = impute.held_out(cells).toPandas()
    size, rooms, area = (found[found.campo == f] for f in impute.FIELDS)
    assert min(map(len, (size, rooms, area))) > 200
    error = abs(size.estimado.astype(float) / size.valor.astype(float) - 1)
    assert error.median() < 0.06 and (rooms.valor == rooms.estimado).mean() > 0.8
    assert (area.valor == area.estimado).mean() > 0.6 and all(e.split()[1] == v.split()[1] for e, v in zip(area.estimado, area.valor))
    monkeypatch.setattr(impute, "CATEGORIES", 5)  # the tail shares rows; estimates are of the frequent ones
    fitted = impute.LowRank().fit(cells)
    got = set(fitted.decode(cells.limit(300).toPandas()).barrio)
    assert got and got <= set(fitted.written) and len(fitted.written) == 5
