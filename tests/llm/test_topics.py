import random

from parcela.llm import topics

SUBJECTS = {
    "salud": "vacuna consultorio inhalador nutrición clínica anticuerpos fractura urgencia".split(),
    "legal": "contrato escritura embargo notaría usufructo fianza desahucio mandato".split(),
    "deporte": "cancha entrenador pista maratón camarín árbitro medalla piscina".split(),
}
FRAMES = ["Se comparan {} y {} caso a caso.", "Primero {}; luego {} según la etapa.", "El equipo explica cómo {} se relaciona con {}.", "Ni {} ni {} bastan por sí solos."]
CHATTER = ["Quedan 50 unidades por vender.", "Nadie contestó el teléfono del aviso.", "La visita duró 40 minutos."]


def _corpus(n, seed=1):
    rnd, docs, truth = random.Random(seed), [], {}
    for d in range(n):
        own = rnd.sample(sorted(SUBJECTS), rnd.choice([1, 1, 2]))
        said = [rnd.choice(CHATTER) for _ in range(2)]
        for s in own:
            said += [rnd.choice(FRAMES).format(*rnd.sample(SUBJECTS[s], 2)) for _ in range(rnd.choice([3, 4]))]
        other = next(s for s in SUBJECTS if s not in own)
        said.append(rnd.choice(FRAMES).format(*rnd.sample(SUBJECTS[other], 2)))  # a passing mention
        rnd.shuffle(said)
        text = rnd.choice([" ", "\n", "\r\n"]).join(said)
        docs.append((d, text.upper() if d % 10 == 0 else text))
        truth[d] = set(own)
    return docs, truth


def test_held_out_documents(spark):
    docs, truth = _corpus(400)
    docs += [(9001, None), (9002, ""), (9003, " … 123 "), (9004, docs[3][1])]
    truth[9004] = truth[3]
    d = spark.createDataFrame([(*x, "z", [1]) for x in docs], "doc_id long, text string, materia string, marks array<int>")
    labels = [(k, m, "a1") for k in range(0, 120) for m in truth[k]] + [(0, m, "a2") for m in truth[0]] + [(5, "desconocida", "a1"), (77_777, "salud", "a1"), (None, "salud", "a1"), (6, None, "a1")]
    e = spark.createDataFrame(labels, "doc_id long, materia string, anotador string")
    m = spark.createDataFrame([(s, "x") for s in SUBJECTS], "materia string, definicion string")
    got: dict = {}
    for r in topics.document_subjects(d, e, m).collect():
        got.setdefault(r.doc_id, set()).add(r.materia)
        assert r.oraciones >= 3
    held = [k for k in truth if k >= 120]
    tp = sum(len(got.get(k, set()) & truth[k]) for k in held)
    wrong = sum(len(got.get(k, set()) ^ truth[k]) for k in held)
    assert 2 * tp / (2 * tp + wrong) > 0.97
    assert not {9001, 9002, 9003} & set(got) and got[9004] == got[3]


def test_empty_tables(spark):
    docs, truth = _corpus(20)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(k, m) for k in truth for m in truth[k]], "doc_id long, materia string")
    m = spark.createDataFrame([(s,) for s in SUBJECTS], "materia string")
    assert topics.document_subjects(d.limit(0), e, m).count() == 0
    assert topics.document_subjects(d, e, m.limit(0)).count() == 0
    assert topics.document_subjects(d, e.limit(0), m).count() == 0 and topics.document_subjects(d, e.limit(0), m.limit(1)).count() == 0
    unknown = m.union(spark.createDataFrame([("sin etiquetas",)], "materia string"))
    assert "sin etiquetas" not in {r.materia for r in topics.document_subjects(d, e, unknown).collect()}


def test_sentences():
    assert topics.sentences("Uno dos. TRES cuatro!\r\nÁrbol <br>x1 .") == [["uno", "dos"], ["tres", "cuatro"], ["arbol"]]
    assert topics.sentences(None) == topics.sentences(" 12 - ") == []
    assert len(topics.sentences("hola. " * 50_000)) == 50_000


def test_sentences_at_once_are_the_sentences():
    texts = ["Uno dos. TRES cuatro!\r\nÁrbol <br>x1 .", "", " 12 - ", "a. b. Sí no \x00 \x01 más.", "Ñandú\n\notro  • fin", "hola. " * 500]
    words, sizes, owner = topics.hashed_sentences(texts)
    want = [(d, [topics.word_hash(w) for w in s]) for d, t in enumerate(texts) for s in topics.sentences(t)]
    edge = [0, *sizes.cumsum().tolist()]
    assert [(d, words[a:b].tolist()) for d, a, b in zip(owner.tolist(), edge, edge[1:])] == want


def test_loadings_are_the_sentences_mixtures():
    import numpy as np

    f = topics.Factors(["a", "b"], background=1, vocabulary=np.arange(3), h=np.array([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.1, 0.1, 0.8]], np.float32), anchor=np.eye(2, 3, dtype=np.float32))
    bag = topics.Bag(np.array([0, 0, 2, 1, 1]), np.array([0, 0, 0, 2, 2]), np.array([0, 0, 0]), np.array([3, 1, 4]))
    some, mass, _ = f.load(bag)
    assert some.tolist() == [0, 2] and mass[0].argmax() == 0 and mass[1].argmax() == 1 and f.sentence_subjects(bag).tolist() == [0, -1, 1]
