import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcela.llm import pii

KEY = b"k" * 32


def spans(text):
    return [(m.kind, text[m.start : m.end]) for m in pii.mentions(text)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Hablar c/ L. Berastaluz en Pasaje Tinajas #555 o al fono (2) 08452636.", [("nombre", "L. Berastaluz"), ("direccion", "Pasaje Tinajas #555"), ("telefono", "(2) 08452636")]),
        ("Depósito a nombre de Verdejal Garcendía, Rodrigo, cédula 35.812.087-3, aviso a ventas.pichunante@oficina.invalid. A 10", [("nombre", "Verdejal Garcendía, Rodrigo"), ("rut", "35.812.087-3"), ("email", "ventas.pichunante@oficina.invalid")]),
        ("ADMINISTRA DON XIMENA LEPUMÁN (M.P@OFICINA.INVALID).", [("nombre", "XIMENA LEPUMÁN"), ("email", "M.P@OFICINA.INVALID")]),
        ("su propietario, L. Morandelli, 44789927-2.\\nInteresados, rodrigo_22 @ llaves.example.net.", [("nombre", "L. Morandelli"), ("rut", "44789927-2"), ("email", "rodrigo_22 @ llaves.example.net")]),
        ("Currículum a pg[at]mail[punto]example[punto]org, cc tomas (arroba) correo.example.", [("email", "pg[at]mail[punto]example[punto]org"), ("email", "tomas (arroba) correo.example")]),
        ("por la Sra. verónica olavarreta garcendía.<br>Cel. 912649458 (XIMENA MORANDELLI).", [("nombre", "verónica olavarreta garcendía"), ("telefono", "912649458"), ("nombre", "XIMENA MORANDELLI")]),
        ("Cocina equipada.\\nVerónica Garcendía — 9-1722-2996.", [("nombre", "Verónica Garcendía"), ("telefono", "9-1722-2996")]),
        ("Ubicado en El Trapiche 4989 of. 643. Publica Nido Austral SpA.", [("direccion", "El Trapiche 4989 of. 643")]),
        ("Fono +56 9 1695 6237 / 9 17 96 58 72. WhatsApp +56 (9) 1634-8940!!", [("telefono", "+56 9 1695 6237"), ("telefono", "9 17 96 58 72"), ("telefono", "+56 (9) 1634-8940")]),
        ("Firma el contrato M. Pichunante por poder de ALEJANDRA.", [("nombre", "M. Pichunante"), ("nombre", "ALEJANDRA")]),
        ("Síguenos en @nido_austral para ver. A pasos de Av. El Trapiche. Rol de avalúo 7221-33. Inscrito a fojas 50.537.585 N° 89 del año 1991. Cód. ref. 73270250. Medidor de luz N° 93812817.", []),
        ("Frente al colegio Profesora Amunda Rivel, con locomoción. A 10 minutos de calle Doña Berenice, sector. Casa en venta, Doña Mencía. Desde UF 6.459. Buses 506 y 912.", []),
        ("Publica Corretajes Tañedor y Asociados.", []), ("", []), (" \n ", []),
    ],
)
def test_mentions(text, found):
    assert spans(text) == found


def test_address_that_is_a_sentence():
    assert spans("Casa amplia. Los Aromos del Sur 1432. Con patio.") == [("direccion", "Los Aromos del Sur 1432")]
    assert spans("El Trapiche 4989, depto 12. Living.") == [("direccion", "El Trapiche 4989, depto 12")]
    for other in ("Casa. Superficie Total 120. Patio.", "Terraza 20 m2. Piso 5. Año 2010.", "Linda vista. tiene jardines 3. Ley 20898.", "Ubicación. El Trapiche 10 minutos."):
        assert spans(other) == []


def test_places_survive_odd_characters():
    text = "İ🏡\\n<br>Atte. Loreto Rucamil.​Cel. 912649458"
    for m in pii.mentions(text):
        assert text[m.start : m.end] in ("Loreto Rucamil", "912649458")
    assert len(pii.mentions(text)) == 2
    assert pii.mentions(None) == []


@settings(max_examples=60)
@given(st.integers(2, 10**9), st.data())
def test_feistel_is_a_permutation_with_inverse(size, data):
    v = data.draw(st.integers(0, size - 1))
    assert pii.unfeistel(pii.feistel(v, size, KEY), size, KEY) == v


def test_feistel_covers_its_range():
    assert sorted(pii.feistel(v, 1000, KEY) for v in range(1000)) == list(range(1000))
    assert [pii.feistel(v, 1000, KEY) for v in range(50)] != [pii.feistel(v, 1000, b"other") for v in range(50)]


def test_pseudonyms_keep_format_and_link():
    a, b = pii.pseudo_rut("35.812.087-3", KEY), pii.pseudo_rut("358120873", KEY)
    assert a.replace(".", "").replace("-", "") == b and pii.check_digit(int(b[:-1])) == b[-1]
    p, q = pii.pseudo_phone("+56 9 1695 6237", KEY), pii.pseudo_phone("9-1695-6237", KEY)
    assert p[-4:] == q[-4:] and p.startswith("+56 9 ") and q[1] == q[6] == "-" and p != "+56 9 1695 6237"
    assert pii.check_digit(12_345_678) == "5" and pii.check_digit(10_000_013) == "K"


def test_redaction_changes_only_mentions():
    text = "Casa. Dueño: Tomás Rucamil, RUT 35.812.087-3. Reserva el 27/1/2026. Escribir a T.R@x.example o t.r (arroba) x.example."
    out = pii.redact(text, KEY)
    assert out.startswith("Casa. Dueño: <NOMBRE ") and "Reserva el 27/1/2026. Escribir a <EMAIL " in out and "Tomás" not in out and "35.812.087" not in out
    tags = [x.split(">")[0] for x in out.split("<EMAIL ")[1:]]
    assert tags[0] == tags[1]  # one address in two notations
    assert "27/1/2026" not in pii.redact(text, KEY, dates=True)
    assert pii.redact(None, KEY) is None and pii.redact("", KEY) == "" and pii.redact("Nada.", KEY) == "Nada."


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    for m in pii.mentions(text):
        assert 0 <= m.start < m.end <= len(text)


def test_long_texts_end():
    pii.redact("a" * 300_000 + " 9" * 50_000 + "@" * 1000, KEY)


def test_tables(spark):
    rows = spark.createDataFrame([(1, "Atte. Loreto Rucamil.", 5), (2, None, 5), (3, "", 5), (4, "Atte. Loreto Rucamil.", 5)], "row_id long, descripcion string, tipo int")
    assert sorted(map(tuple, pii.found(rows, "row_id", F.col("descripcion")).collect())) == [(1, "nombre", 7), (4, "nombre", 7)]
    out = {r.row_id: r.texto for r in pii.redacted(rows, "row_id", F.col("descripcion"), "clave").collect()}
    assert out[1] == out[4] and out[2] is None and out[3] == "" and "Loreto" not in out[1]
    assert pii.found(rows.limit(0), "row_id", F.col("descripcion")).count() == 0


#: Sentences in other words than the test tables', with the names and addresses they hold.
OTHER_WORDS = [
    ("Me llamo Juan Pérez Soto y arriendo mi casa.", ["Juan Pérez Soto"]),
    ("El arrendatario es Pedro Muñoz Rojas, muy buen pagador.", ["Pedro Muñoz Rojas"]),
    ("Los Alerces 1234, Ñuñoa.", ["Los Alerces 1234"]),
    ("La propiedad está en Los Alerces 1234, Ñuñoa, cerca del metro.", ["Los Alerces 1234"]),
    ("Para coordinar escríbale a Marcela Fuentes Díaz por la mañana.", ["Marcela Fuentes Díaz"]),
    ("La casa pertenece a la familia de Rodrigo Tapia Núñez desde 1980.", ["Rodrigo Tapia Núñez"]),
    ("Nuestra ejecutiva Carolina Vega Lagos lo recibirá en la entrada.", ["Carolina Vega Lagos"]),
    ("Cualquier duda la resuelve don Ernesto Salas, conserje del edificio.", ["Ernesto Salas"]),
    ("El dueño anterior, Luis Alberto Contreras, remodeló los baños.", ["Luis Alberto Contreras"]),
    ("Vendo por herencia de mi abogada Patricia del Río Mena.", ["Patricia del Río Mena"]),
    ("Nos vemos en Avenida Grecia 2045, frente a la rotonda.", ["Avenida Grecia 2045"]),
    ("Hay una copia de la llave en Pasaje Cipreses 88, casa 3.", ["Pasaje Cipreses 88, casa 3"]),
    ("Mi hermana Daniela Ortiz Bravo muestra el departamento los sábados.", ["Daniela Ortiz Bravo"]),
    ("Terreno plano de 5000 m2 en San Bernardo, con agua.", []),
    ("Vista al Parque Juan Pablo Segundo y a la cordillera.", []),
    ("A pasos del colegio Pedro de Valdivia y del metro.", []),
    ("Excelente barrio Jorge Alessandri Rodríguez, muy tranquilo.", []),
    ("Edificio nuevo en Santiago 2024, entrega en marzo.", []),
    # written after the rules; recall and precision were 0.89 before years and adjacency were told apart
    ("Quien atiende es Gonzalo Meza Pinto, corredor independiente.", ["Gonzalo Meza Pinto"]),
    ("Por favor preguntar en portería a Verónica Salinas Cruz.", ["Verónica Salinas Cruz"]),
    ("El contrato lo firmó Héctor Ibáñez Mora ante notario.", ["Héctor Ibáñez Mora"]),
    ("Transferir la reserva a Camila Andrade Ríos antes del lunes.", ["Camila Andrade Ríos"]),
    ("Hola, soy Matías Herrera Lobos y vendo mi departamento.", ["Matías Herrera Lobos"]),
    ("La administradora, Gloria Pizarro, tiene las llaves.", ["Gloria Pizarro"]),
    ("Se entrega firmado por Teresa Godoy Araya.", ["Teresa Godoy Araya"]),
    ("El vendedor Nicolás San Martín responde el mismo día.", ["Nicolás San Martín"]),
    ("Mi nombre es Beatriz Olea Fuenzalida, dueña directa.", ["Beatriz Olea Fuenzalida"]),
    ("La encargada es R. Valdebenito, del segundo piso.", ["R. Valdebenito"]),
    ("Ofrezco casa; trato con Esteban Lillo Parra (+56 9 8765 4321).", ["Esteban Lillo Parra"]),
    ("Los planos los hizo la arquitecta Silvia Rojas Paz.", ["Silvia Rojas Paz"]),
    ("Hermosa casa en Las Violetas 455, Providencia.", ["Las Violetas 455"]),
    ("Oficina ubicada en Huérfanos 1160 of. 1203, centro.", ["Huérfanos 1160 of. 1203"]),
    ("Camino El Volcán 20310, sector alto.", ["Camino El Volcán 20310"]),
    ("El punto de encuentro es calle Merced 820.", ["calle Merced 820"]),
    ("Nos mudamos a Av. Irarrázaval 3100, depto 54.", ["Av. Irarrázaval 3100, depto 54"]),
    ("El inmueble queda en José Miguel Carrera 77, Rengo.", ["José Miguel Carrera 77"]),
    ("Departamento con vista al Cerro Manuel Montt, sin ruido.", []),
    ("Cerca del Hospital Luis Calvo Mackenna y de la plaza.", []),
    ("Condominio Francisco de Aguirre, con portería.", []),
    ("Construida en Concepción 1998, remodelada.", []),
    ("Gran living, cocina Luis XV, tres baños.", []),
    ("Arriendo en Viña del Mar 450 mil mensuales.", []),
]
#: Written last, and not used to change a rule.
LAST_WORDS = [
    ("La casa la cuida Ramón Astudillo Vera, vecino de siempre.", ["Ramón Astudillo Vera"]),
    ("Puede retirar el formulario donde la secretaria Lorena Quezada.", ["Lorena Quezada"]),
    ("Fue tasada por Ignacio Barros Leyton en enero.", ["Ignacio Barros Leyton"]),
    ("El comprador, Vicente Maldonado Sáez, ya depositó.", ["Vicente Maldonado Sáez"]),
    ("Consultas a la señora Olga Paredes después de las seis.", ["Olga Paredes"]),
    ("Mi hijo Benjamín Soto Caro puede mostrarla.", ["Benjamín Soto Caro"]),
    ("Depositar el arriendo a Mónica Riquelme Toro.", ["Mónica Riquelme Toro"]),
    ("Nuestro agente Raúl Cifuentes: raul@correo.example", ["Raúl Cifuentes"]),
    ("La llave está donde el conserje, S. Carvajal.", ["S. Carvajal"]),
    ("Se vende parcela en Los Maitenes 321, Curacaví.", ["Los Maitenes 321"]),
    ("Local comercial en Bandera 642, piso 3.", ["Bandera 642, piso 3"]),
    ("Dirección: General Holley 2381.", ["General Holley 2381"]),
    ("Queda en calle Nueva de Lyon 96, local 4.", ["calle Nueva de Lyon 96, local 4"]),
    ("Cerca de la Plaza Pedro Montt y del río.", []),
    ("Condominio Los Robles 2, casas nuevas.", []),
    ("Llegada en Navidad 2025 con descuento.", []),
    ("Estilo Luis Felipe, pisos de roble.", []),
    ("Colegio María Inmaculada a dos cuadras.", []),
]


@pytest.mark.parametrize(("cases", "least"), [(OTHER_WORDS, 0.9), (LAST_WORDS, 0.84)])
def test_other_words_than_the_tables(cases, least):
    hits = wrong = missed = 0
    for text, want in cases:
        got = [w for k, w in spans(text) if k in ("nombre", "direccion")]
        hits += len(set(got) & set(want))
        wrong += len(set(got) - set(want))
        missed += len(set(want) - set(got))
    print("recall", hits / (hits + missed), "precision", hits / (hits + wrong))
    assert hits / (hits + missed) >= least and hits / (hits + wrong) >= 0.9


def test_pseudonyms_leak_nothing():
    for raw in ("RUT 0.123.456-7", "RUT 123.456-7", "RUT 1.234.567-4", "RUT 98.765.432-5"):
        out = pii.redact(raw, KEY)
        assert out == raw or raw[4:-2].strip("0.") not in out
    bare, full = pii.pseudo_rut("12.345.678", KEY), pii.pseudo_rut("12.345.678-5", KEY)
    assert full[:-2] == bare and len(bare) == 10 and pii.check_digit(int(bare.replace(".", ""))) == full[-1]
    assert pii.pseudo_rut("0.123.456-0", KEY)[:2] == "0." and "123.456" not in pii.pseudo_rut("0.123.456-0", KEY)
    shapes = {pii._pseudo_date("05/03/1980", KEY), pii._pseudo_date("5/3/1980", KEY).replace("/0", "/")}
    assert all(len(x) == 10 for x in (pii._pseudo_date("05/03/1980", KEY), pii._pseudo_date("01-12-2001", KEY))) and len(shapes) == 2
    assert "31/02/1999" not in pii.redact("nació el 31/02/1999", KEY, dates=True)
    tags = {pii._tag(f"persona {k}", "nombre", KEY) for k in range(20_000)}
    assert len(tags) == 20_000 and all(len(t) == 32 for t in tags)
