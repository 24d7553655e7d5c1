import random
import unicodedata

from parcela.llm import leaks

VOCABULARY = "el la de una dos tasador finca deslinde poniente quinta comuneros piden partición según título registro vecino lote camino real".split()


def _brute(docs, items, length, slack=0):
    out = set()
    for d, t in docs:
        w = leaks.words(t)
        for i, e in items:
            own = leaks.words(e)
            for a in range(len(own) - length + 1):
                if slack == 0:
                    if any(w[s : s + length] == own[a : a + length] for s in range(len(w) - length + 1)):
                        out.add((d, i))
                elif any(all(any(0 <= s + k + o < len(w) and w[s + k + o] == own[a + k] for o in range(-slack, slack + 1)) for k in range(length)) for s in range(-length, len(w))):
                    out.add((d, i))
    return out


def _case(seed):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice(VOCABULARY) + (str(rnd.randrange(3)) if rnd.random() < 0.2 else "") for _ in range(n))
    items = [(k, text(rnd.randrange(3, 30))) for k in range(12)] + [(100, None), (101, ""), (102, "tres palabras solas")]
    docs = [(k, text(rnd.randrange(0, 60))) for k in range(60)] + [(900, None), (901, ""), (902, " \n ")]
    for k in range(40):
        i, e = items[rnd.randrange(12)]
        w = e.split()
        a = rnd.randrange(len(w))
        piece = " ".join(w[a : a + rnd.randrange(4, 20)])
        if k % 3 == 0:
            piece = unicodedata.normalize("NFD", piece.upper()).replace(" ", ",\r\n ")
        docs.append((1000 + k, text(5) + " " + piece + ". " + text(5)))
    return docs, items


def test_phrases_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = _case(seed)
        d = spark.createDataFrame([(*x, "z") for x in docs] + [(1000, docs[-40][1], "z")], "doc_id long, text string, item_id string")
        i = spark.createDataFrame([(*x, 0) for x in items + items[:2]], "item_id long, enunciado string, doc_id int")
        got = [tuple(r) for r in leaks.leaked(d, i, length=6).collect()]
        assert len(got) == len(set(got)) and set(got) == _brute(docs, items, 6)


def test_proximity_against_brute_force(spark):
    docs, items = _case(3)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, enunciado string")
    exact, near = {tuple(r) for r in leaks.leaked(d, i, 6).collect()}, {tuple(r) for r in leaks.leaked(d, i, 6, slack=1).collect()}
    assert exact <= near <= _brute(docs, items, 6, slack=1)
    moved = spark.createDataFrame([(1, "el deslinde muy poniente de la finca toca quinta")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "el deslinde poniente de la finca toca")], "item_id long, enunciado string")
    assert leaks.leaked(moved, item, 6).count() == 0 and leaks.leaked(moved, item, 6, slack=1).count() == 1


def _displaced(seed):
    rnd = random.Random(seed)
    docs, items = _case(seed)
    for k in range(120):
        w = items[k % 12][1].split()
        for _ in range(rnd.randrange(1, 5)):
            a = rnd.randrange(len(w))
            w[a:a] = rnd.choice((["muy"], ["muy", "bien"], [])) or [w.pop(a)] * rnd.randrange(2)
        docs.append((2000 + k, " ".join(w)))
    return docs, items


def test_proximity_equals_brute_force(spark):
    for seed, slack in ((5, 1), (6, 2)):
        docs, items = _displaced(seed)
        d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, enunciado string")
        want = _brute(docs, items, 6, slack)
        assert len(want) > len(_brute(docs, items, 6)) and {tuple(r) for r in leaks.leaked(d, i, 6, slack).collect()} == want


def test_displaced_anchor(spark):
    own = "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11".split()
    moved = " ".join([*own[:4], "x", "x", *own[4:9], "x", "x", *own[9:]])
    others = [(k, " ".join(own[1:])) for k in (2, 3)]  # the first word is the rarest
    d, i = spark.createDataFrame([(1, moved), *others], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(own))], "item_id long, enunciado string")
    assert [tuple(r) for r in leaks.leaked(d, i, 12, 2).collect()] == [(1, 1)] and leaks.leaked(d, i, 12, 1).count() == 0


def test_empty_tables_and_small_segments(spark, monkeypatch):
    docs, items = _case(4)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, enunciado string")
    assert leaks.leaked(d.limit(0), i, 6).count() == 0 and leaks.leaked(d, i.limit(0), 6).count() == 0
    monkeypatch.setattr(leaks, "SEGMENT", 40)
    assert {tuple(r) for r in leaks.leaked(d, i, 6).collect()} == _brute(docs, items, 6)


def test_words():
    assert leaks.words("Á-B́c ñ_2x  ﬁn—Ü") == ["a", "bc", "n", "2x", "ﬁn", "u"] and leaks.words(None) == []


def test_one_index_for_any_items_in_blocks(spark, monkeypatch):
    docs, items = _case(7)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, enunciado string")
    index = leaks.positional_index(d).cache()
    monkeypatch.setattr(leaks, "ITEMS", 4)
    assert {tuple(r) for r in leaks.look_up(index, i, 6).collect()} == _brute(docs, items, 6)
    others = [(1, docs[3][1]), (2, docs[-1][1])]
    o = spark.createDataFrame(others, "item_id long, enunciado string")
    assert {tuple(r) for r in leaks.look_up(index, o, 5).collect()} == _brute(docs, others, 5)
    near = leaks.positional_index(d, gap=1)  # documents that lie too close are moved apart
    assert {tuple(r) for r in leaks.look_up(near, i, 6).collect()} == _brute(docs, items, 6)
    assert {tuple(r) for r in leaks.look_up(near, i, 6, slack=1).collect()} == _brute(docs, items, 6, slack=1)
    index.unpersist()
