import datetime
import random

import pandas as pd

from parcela.operators import snapshots
from parcela.storage import TooLarge  # noqa: F401

RUNS = [(7, "2026-01-01 00:00:00", "2026-01-01 12:00:00"), (8, "2026-01-08 00:00:00", "2026-01-08 12:00:00"), (9, "2026-01-15 00:00:00", "2026-01-15 12:00:00"), (10, "2026-01-22 00:00:00", "2026-01-22 12:00:00")]


def _runs(spark):
    return spark.createDataFrame([(i, datetime.datetime.fromisoformat(a), datetime.datetime.fromisoformat(b)) for i, a, b in RUNS], "corrida_id int, inicio timestamp_ntz, fin timestamp_ntz")


def _rates(spark):
    days = pd.date_range("2025-12-28", "2026-01-31")
    return spark.createDataFrame([(d.date(), 40_000.0 + k, 1_000.0) for k, d in enumerate(days)], "fecha date, uf_clp double, usd_clp double")


def _brute(rows):
    by_run = [{} for _ in RUNS]
    for r in rows:
        for k, (_, a, b) in enumerate(RUNS):
            if r["aviso"] is not None and a <= r["t"] <= b:
                old = by_run[k].get(r["aviso"])
                if old is None or (r["t"], r["row_id"]) > old[:2]:
                    by_run[k][r["aviso"]] = (r["t"], r["row_id"], r["uf"])
    out = set()
    for k in range(1, len(RUNS)):
        before, now = by_run[k - 1], by_run[k]
        for a in set(before) | set(now):
            if a not in before:
                out.add((a, RUNS[k][0], "added"))
            elif a not in now:
                out.add((a, RUNS[k][0], "removed"))
            elif before[a][2] and now[a][2] and abs(now[a][2] - before[a][2]) > 0.005 * before[a][2]:
                out.add((a, RUNS[k][0], "changed"))
    return out


def test_against_brute_force(spark, listings):
    rnd, rows, plain = random.Random(5), [], []
    for k in range(1500):
        day = rnd.choice([1, 1, 8, 8, 15, 22, 3])
        t = datetime.datetime(2026, 1, day, rnd.randrange(0, 12), rnd.randrange(60))
        uf = rnd.choice([None, 0.0, 1000.0, 1004.0, 1010.0, 2000.0])
        a = rnd.choice([None, *range(3000000000, 3000000150), *[3000000001] * 75])  # one key holds a third
        notation = rnd.choice([t.strftime("%Y-%m-%d %H:%M:%S.000000+00"), t.strftime("%Y-%m-%dT%H:%M:%S.000000Z"), (t - datetime.timedelta(hours=3)).strftime("%d-%m-%Y %H:%M:%S"), (t - datetime.timedelta(hours=3)).strftime("%Y-%m-%d %H:%M:%S-03:00")])
        rows.append({"row_id": k + 1, "execution_time": notation, "url_propiedad": None if a is None else f"https://x.example/{a}/casa?t=12345678901", "precio_uf": None if uf is None else f"UF {uf:.2f}".replace(".", ",")})
        plain.append({"row_id": k + 1, "aviso": a, "t": t.isoformat(" "), "uf": uf})
    rows += [{"row_id": 9001, "execution_time": "pendiente", "url_propiedad": "x-3000000001"}, {"row_id": 9002, "execution_time": "2026-01-08 01:00:00Z", "url_propiedad": "12345678901"}]
    got = [tuple(r) for r in snapshots.listing_changes(listings(rows), _runs(spark), _rates(spark)).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(plain)


def test_conversion_at_each_local_day(spark, listings):
    rows = [
        {"execution_time": "2026-01-01 01:00:00Z", "url_propiedad": "a-3000000001", "precio_uf": "$ 40.003.000"},  # local day 2025-12-31: 40,003 pesos
        {"execution_time": "2026-01-08 05:00:00Z", "url_propiedad": "b_3000000001#", "precio_uf": "1.000 UF"},
    ]
    assert snapshots.listing_changes(listings(rows), _runs(spark), _rates(spark)).filter("cambio = 'changed'").count() == 0


def test_empty_tables(spark, listings):
    rows = listings([{"execution_time": "2026-01-01 01:00:00Z", "url_propiedad": "a-3000000001"}])
    assert snapshots.listing_changes(rows.limit(0), _runs(spark), _rates(spark)).count() == 0
    assert snapshots.listing_changes(rows, _runs(spark).limit(0), _rates(spark)).count() == 0
    assert [tuple(r) for r in snapshots.listing_changes(rows, _runs(spark), _rates(spark).limit(0)).collect()] == [(3000000001, 8, "removed")]


def test_batches_of_any_size():
    data = pd.DataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 4, 6.0), (2, 2, 1.0), (2, 3, 2.0), (3, 4, None)], columns=["key", "run", "value"])
    whole = None
    for size in (1, 2, 3, 6):
        parts = [data.iloc[a : a + size] for a in range(0, 6, size)]
        got = sorted(map(tuple, pd.concat(list(snapshots.merge_stream(1, 4, 0.005)(iter(parts)))).values.tolist()))
        whole = whole or got
        assert got == whole
    assert (2, 3, "changed") in whole and (1, 3, "removed") in whole and (1, 4, "added") in whole and (2, 4, "removed") in whole and (3, 4, "added") in whole
