"""Personal information in free text: found, and replaced by typed placeholders (problem 4).

Validated numbers are replaced by format-preserving Feistel pseudonyms: a keyed permutation of the
numbers of the same format, so that equal values get equal pseudonyms in every document, whatever
their notation, and different values different ones. Names, emails and addresses have no format to
permute in; they get a keyed tag of their folded form.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- keyed permutations ------------------------------------------------------------------------


def feistel(value: int, size: int, key: bytes, rounds: int = 8) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network over the least even number of
    bits that holds ``size``, walked along its cycle until the value lies in range again."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(rounds):
            digest = hashlib.blake2b(bytes([r]) + size.to_bytes(16, "big") + right.to_bytes(16, "big"), key=key, digest_size=8).digest()
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def unfeistel(value: int, size: int, key: bytes, rounds: int = 8) -> int:
    """The inverse of ``feistel``."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(rounds)):
            digest = hashlib.blake2b(bytes([r]) + size.to_bytes(16, "big") + left.to_bytes(16, "big"), key=key, digest_size=8).digest()
            left, right = right ^ (int.from_bytes(digest, "big") & mask), left
        value = (left << half) | right
        if value < size:
            return value


def check_digit(number: int) -> str:
    """The check digit (modulus 11) of an identity number."""
    total, factor = 0, 2
    while number:
        number, digit = divmod(number, 10)
        total += digit * factor
        factor = 2 if factor == 7 else factor + 1
    return "0123456789K0"[11 - total % 11]


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


#: Dates are permuted among the days of the years 1900 to 2099.
DAYS = 73_049


def has_check_digit(text: str) -> bool:
    """Whether an identity number is written with its check digit: after a dash, as a fourth character of
    its last group, or, in plain digits, if the last one is right."""
    plain = re.sub(r"[^0-9kK]", "", text)
    if "-" in text or plain[-1:] in ("k", "K"):
        return True
    if "." in text:
        return len(text.rsplit(".", 1)[1].strip()) > 3
    return len(plain) > 7 and check_digit(int(plain[:-1])) == plain[-1]


def pseudo_rut(text: str, key: bytes) -> str:
    """An identity number with its body permuted among those of as many digits, the check digit, if it is
    written, made to fit, and its notation kept. Equal bodies get equal pseudonyms, with check digit or without."""
    plain, checked = re.sub(r"[^0-9kK]", "", text), has_check_digit(text)
    written = plain[:-1] if checked else plain
    body = int(written)
    low = 10 ** (len(str(body)) - 1) if body else 0
    body = low + feistel(body - low, (10 * low or 10) - low, key + b"rut" + str(len(str(body))).encode())
    digits = f"{body:0{len(written)}d}"
    if not checked:
        return _refill(text, digits)
    dv = check_digit(body)
    it = iter(digits + (dv.lower() if "k" in text else dv))
    return "".join(next(it) if c in "0123456789kK" else c for c in text)


def pseudo_phone(text: str, key: bytes) -> str:
    """A phone with its last eight digits permuted; country, kind and notation kept."""
    digits = re.sub(r"\D", "", text)
    tail = digits[-8:]
    new = f"{feistel(int(tail), 10 ** len(tail), key + b'telefono'):0{len(tail)}d}"
    return _refill(text, digits[: -len(tail)] + new)


def pseudo_day(day: int, key: bytes) -> int:
    """A day, counted from 1900-01-01, permuted among ``DAYS``."""
    return feistel(day, DAYS, key + b"fecha")


# --- finding mentions --------------------------------------------------------------------------

# The patterns run over lower case: what writes mentions writes them in any case.

#: Letters for words of names and streets.
_L = "a-zà-öø-ÿ"

_MARKUP = re.compile(r"\\[nNrRtT]|<[^<>]{1,40}>|[\u200b\ufeff]")

_AT = re.compile(r"@|[\[(]\s?(?:at|arroba)\s?[\])]|(?<=\s)(?:arroba|at)(?=\s)")
_LOCAL = re.compile(r"[\w.+%-]{0,63}[\w+%-]$")
_DOMAIN = re.compile(r"[a-z0-9-]+(?:(?:\.|\s?[\[(](?:punto|dot)[\])]\s?|\spunto\s)[a-z0-9-]+)+")
_PHONE = re.compile(
    r"(?=[+(\d])(?<![\w+@.,/-])(?<![\d][ ])(?<![$#°º] )(?:(?<=/)|(?<=/ )|(?<![/]))"
    r"(?:(?:\+|00)?56[ .-]?)?(?:\(0?(?:[29]|[3-7]\d)\)|0?[29])(?:[ .-]?\d{4}[ .-]?\d{4}|(?:[ .-]\d\d){4})(?![\w]|[.,-]?\d)"
)
_RUT = re.compile(r"(?=\d)(?<![\w.,+-])(?:\d{1,2}\.\d{3}\.\d{3}\s?-\s?[\dk]|\d{7,8}\s?-\s?[\dk]|\d{1,2}\.\d{3}\.\d{3}[\dk]?(?=\W)|\d{7,8}[\dk])(?![\w]|-\d)")
#: Words before a number without dash that make it an identity number.
_RUT_BEFORE = re.compile(r"(?:\brut\b|\br\.u\.t\.?|\brun\b|c[eé]dula(?: de identidad)?|\bc\.?i\.|transferencia al|identidad|(?:propietari[oa]|due[nñ][oa])[,:][^<\n]{1,60},)[\s:.]*(?:n[°ºo]\.?\s*)?$")
#: Words before a number that make it something else.
_OTHER_BEFORE = re.compile(r"(?:fojas|n[°º]|nro\.?|ref\.?|c[oó]d\.?|medidor|rol|ley|uf|\$|clp|permiso|folio|aviso|id)[\s:.]*$")

#: Kinds of street.
_KIND = r"(?:avenida|avda\.?|av\.?|calle|pasaje|pje\.?|psje\.?|camino|camino a|paseo|alameda|ruta|callej[oó]n|diagonal)"
_STREET = rf"(?:(?:[{_L}]\.|[{_L}][{_L}'’]*|\d{{1,2}} de [{_L}]+)(?:\s+[{_L}][{_L}'’]*){{0,4}})"
_NUMBER = r"\s*,?\s*(?:(?:n[°ºo]\.?|nro\.?|num\.?|n[uú]mero|\#)\s*)?\d{1,5}(?![\d]|[.,]\d|\s*(?:m2|m²|metros|minutos|cuadras?|dormitorios?|uf|%|piezas|ba[nñ]os)\b)"
_UNIT = r"(?:\s*,?\s*(?:depto|dpto|departamento|casa|of|oficina|piso|torre|block|local)\.?\s*(?:n[°º]\s*)?[\dA-Za-z-]{1,6}\b)*"
_KIND_AT = re.compile(r"\b(?:a[vl]|c[al]|pa|p[js]|ru|di)")
_ADDRESS = re.compile(rf"(?<![\w@])(?P<a>{_KIND}\s+{_STREET}{_NUMBER})(?P<u>{_UNIT})")
#: Words after which a street may stand without its kind.
_ADDRESS_BEFORE = (
    r"ubicad[oa]s? en|direcci[oó]n(?: exacta)?:?|queda en|retirar llaves en|llaves en|conserjer[ií]a de|vive en|domicilio:?(?: en)?|"
    r"domiciliad[oa] en|visitar en|oficina(?:s)? en|atendemos en|nuestra oficina|casa matriz:?|sucursal:?|"
    rf"(?:hablar c/|hablar con|contactar a)\s[{_L}.,\s]{{1,60}}?\sen"
)
_PLACE_AT = re.compile(r"\b(?:ubic|dire|qued|reti|llav|cons|vive|domi|visi|ofic|aten|nues|casa|sucu|habl|cont)")
_PLACED = re.compile(rf"\b(?:{_ADDRESS_BEFORE})\s+(?P<a>{_STREET}{_NUMBER})(?P<u>{_UNIT})")
#: An address that is a sentence of its own: by its form, or in any case before a fixed continuation.
_ALONE_AT = re.compile(r"^|(?<=[.!?\]'\"]\s)|(?<=-\s)|(?<=\s\s)|(?<=\n)")
_ALONE = re.compile(rf"\s*(?P<a>(?P<s>(?:[{_L}][{_L}'’]*)(?:\s+[{_L}][{_L}'’]*){{0,4}}){_NUMBER})(?P<u>{_UNIT})(?:(?P<c>\s*,\s*a media cuadra)|(?=\s*(?:[.,;!?\])'\"\n]|-\s|\s\s|$)))")
#: Words within a street's name that stand in lower case.
_SMALL = frozenset("de del la las los el y e".split())
#: Words before a number that make it something else than a house number.
_NO_STREET = re.compile(
    r"\b(?:fojas|nro|ref|referencia|c[oó]digo|c[oó]d|medidor|rol|ley|uf|clp|permiso|folio|aviso|id|a[nñ]o|piso|pisos|depto|dpto|departamentos?|casas?|oficinas?|torre|block|local|lote|"
    r"sitio|parcela|bodegas?|estacionamientos?|dormitorios?|ba[nñ]os?|piezas|suites?|superficie|[uú]til|total|terreno|precio|valor|gastos|arriendo|venta|fono|tel[eé]fono|tel|cel|celular|"
    r"whatsapp|buses|bus|micros?|l[ií]nea|metro|ruta|km|desde|hasta|edificio|condominio|etapa|entrega|"
    r"enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\b"
    r"|^(?:a|en|con|por|para|entre|son|hay|tiene|s[oó]lo|m[aá]s)\b|\b(?:a|en|con|por|para|de|del|y|e|o|la|las|el|los)$"
)

_WORD = rf"[{_L}][{_L}'’-]+"
#: Words that end a name that isn't set off by a mark.
_STOP = (
    "en al a el la los las del de por con que o y e u su sus cédula cedula rut run para desde hasta tel fono cel whatsapp vive tiene aviso "
    "directamente email correo escribir visitas llamar contactar firma poder cc"
).split()
_NAME_WORD = rf"(?!(?:{'|'.join(_STOP)})\b){_WORD}"
_NAME = rf"(?:(?:[{_L}]\.\s?){{1,2}}{_NAME_WORD}(?:\s{_NAME_WORD}){{0,2}}|{_NAME_WORD}(?:\s{_NAME_WORD}){{0,3}}(?:,\s{_NAME_WORD}(?:\s{_NAME_WORD})?(?=\s*(?:[.,;)(<\\'\"!?—–\n]|-|\s\s|$|al\b|en\b|por\b|a\b|o\b|$)))?)"
_TITLE = r"(?:(?:do[nñ]a?|sra?s?\.?|srta\.?|se[nñ]or(?:a|ita)?)\s+)?"
#: What stands before a person's name.
_NAME_BEFORE = (
    r"su\s+propietari[oa],|por\s+(?:la|el)\s+sr(?:t?a)?\.|a\s+nombre\s+de|su\s+due[nñ][oa]|due[nñ][oa]:|propietari[oa]:|por\s+poder\s+de|las\s+llaves\s+las\s+tiene|"
    r"visitas\s+con|firma\s+el\s+contrato|hablar\s+(?:c/|con)|contactar\s+(?:a|con)|administra\s+do[nñ]a?|atte\.|atentamente,?|saluda\s+atte\.?|"
    r"preguntar\s+por|consultar\s+(?:a|con)|corredor[a]?:|contacto:|agente:"
)
_NAME_FROM = re.compile(r"\b(?:su|por|a n|due|prop|las l|visi|firm|habl|cont|admi|att|aten|salu|preg|cons|corr|agen)")
_NAMED = re.compile(rf"(?<![\w@])(?:{_NAME_BEFORE})\s+{_TITLE}(?P<n>{_NAME})")
#: A name right before a dash and a phone, or in brackets right after a phone.
_NAME_AT_END = re.compile(rf"(?P<n>(?:(?:[{_L}]\.\s?){{1,2}}{_WORD}(?:\s{_WORD}){{0,2}}|{_WORD}(?:\s{_WORD}){{0,3}}(?:,\s{_WORD})?))\s*(?:—|–|--|-|:)\s*$")
_IN_BRACKETS = re.compile(rf"\s*\(\s*{_TITLE}(?P<n>(?:(?:[{_L}]\.\s?){{1,2}})?{_WORD}(?:\s{_WORD}){{0,3}}(?:,\s{_WORD}(?:\s{_WORD})?)?)\s*\)")
_SENTENCE = re.compile(r"[.!?:;]\s+|\n+|\s{2,}|\s-\s|^\[['\"]|[\])]\s")
#: Words of companies and of other things than persons; a phrase with one is no name.
_NO_PERSON = re.compile(
    r"\b(?:propiedades|inmobiliaria|corretajes?|corredora|asesor[ií]as|gesti[oó]n|bienes|ra[ií]ces|ltda|limitada|spa|s\.a|asociados|administraci[oó]n|edificio|"
    r"condominio|conserjer[ií]a|whatsapp|fono|cel|tel[eé]fono|celular|consultas?|agende|visita|ventas?|oficina|colegio|escuela|liceo|estaci[oó]n|parque|plaza|"
    r"municipalidad|notar[ií]a|banco|interesados|escribir|llamar|directo|contacto|nido|llave|publica)\b",
)

# What the fixed cues don't tell is scored by its form and its sentence.

_CAP = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’-]+"
#: Frequent given names, in alphabetical order, without accents.
_GIVEN = frozenset(
    "abel adolfo adriana agustin agustina alberto alejandra alejandro alfonso alfredo alicia alonso amanda ana andrea andres angela angelica anibal antonia antonio ariel arturo barbara beatriz benjamin bernardo "
    "camila camilo carla carlos carmen carolina catalina cecilia cesar claudia claudio constanza cristian cristina cristobal daniel daniela david diego eduardo elena elisa emilia emilio enrique ernesto esteban "
    "eugenia fabian federico felipe fernanda fernando florencia francisca francisco gabriel gabriela gaston gloria gonzalo graciela guillermo gustavo hector hernan hugo ignacio ines isabel isidora ivan jaime "
    "javier javiera jeannette joaquin jorge jose josefa juan juana julia julian julio karen laura leonardo leonor loreto lorena lucia luis luisa macarena magdalena manuel marcela marcelo marco margarita maria "
    "mariana mario marta martin martina mateo matias mauricio maximiliano mercedes miguel monica natalia nicolas olga oscar pablo pamela paola patricia patricio paula paulina pedro pilar rafael ramon raul rebeca "
    "ricardo roberto rocio rodrigo rosa ruben sandra santiago sebastian sergio silvia simon sofia soledad susana tamara teresa tomas valentina valeria veronica vicente victor victoria violeta viviana ximena yolanda".split()
)
#: A run of capitalised words; particles may stand inside.
_PERSON = re.compile(rf"(?<![\w@.-])(?P<g>{_CAP}|[A-ZÀ-ÖØ-Þ]\.)(?P<r>(?:\s(?:(?:de|del|de la|de los|y|e)\s)?(?:{_CAP}|[A-ZÀ-ÖØ-Þ]\.)){{1,4}})(?![\w@])")
#: Words for persons and their doings; they are evidence for a name in their sentence.
_ABOUT = re.compile(
    r"\b(?:ll[aá]m[aoe]\w*|soy|nombre|atiend\w*|contact\w*|due[nñ][oa]s?|propietari[oa]s?|arrendatari[oa]s?|arrendador[a]?|corredor[a]?|agente|ejecutiv[oa]|administrador[a]?|conserje|vendedor[a]?|titular|firm\w+|"
    r"represent\w+|herman[oa]|hij[oa]|espos[oa]|viud[oa]|don|do[nñ]a|sra?|srta|se[nñ]or[a]?|client[ea]|notari[oa]|abogad[oa]|habl\w+|escrib\w+|pregunt\w+|consult\w+|coordin\w+|muestr\w+|mostrar\w*|entreg\w+|"
    r"inquilin[oa]|aval|comprador[a]?|tasador[a]?|arquitect[oa]|encargad[oa]|secretari[oa]|familia|pertenec\w+|vive[n]?|vivi[oó]|herencia|sucesi[oó]n|dice|cuenta|recib\w+|responsable|asesor[a]?|a cargo|deposit\w+|transfer\w+|trat\w+)\b"
)
#: What stands right before a name of a place, street or house instead.
_THING_BEFORE = re.compile(
    r"\b(?:calle|avenida|avda|av|pasaje|pje|psje|camino|paseo|alameda|ruta|diagonal|plaza|parque|estaci[oó]n|metro|colegio|escuela|liceo|jard[ií]n|universidad|instituto|hospital|cl[ií]nica|edificio|condominio|villa|"
    r"poblaci[oó]n|sector|barrio|comuna|ciudad|cerro|lago|r[ií]o|playa|torre|centro|mall|iglesia|parroquia|puente|teatro|museo|estadio|club|banco|notar[ií]a|inmobiliaria|propiedades|publica)\.?\s+(?:(?:de|del|la|el|los|las|do[nñ]a|don|san|santa)\s+)*$"
)
#: An address inside of a sentence: a preposition, capitalised words, a house number.
_INSIDE = re.compile(rf"(?<![\w])(?:en|En|EN)\s+(?P<a>(?P<s>{_CAP}(?:\s(?:(?:de|del|la|las|los|el|y)\s){{0,2}}{_CAP}){{0,4}})\s*,?\s*(?:(?:N[°ºo]|n[°ºo]|nro|Nro|#)\.?\s*)?\d{{2,5}})(?P<u>(?:\s*,?\s*(?i:depto|dpto|departamento|casa|of|oficina|piso|torre|block|local)\.?\s*(?:n[°º]\s*)?[\dA-Za-z-]{{1,6}}\b)*)(?![\d\w]|[.,]\d|\s*(?:m2|m²|metros|minutos|cuadras?|dormitorios?|uf|UF|%|piezas|ba[nñ]os|casas|deptos|mil|millones|pesos|hect[aá]reas|ha|personas|a[nñ]os)\b)")
#: A number that may be a year is a house's only before its unit or a place.
_YEAR, _PLACE_AFTER = re.compile(r"(?:19|20)\d\d$"), re.compile(rf"\s*,\s*{_CAP}")
_BORDER = re.compile(r"[.!?]\s|[\n;<>]|\\n|\s-\s")

#: A date of a person's life; found only on request.
_DATE = re.compile(r"(?<![\d/.-])(?P<d>\d{1,2})(?P<s>[/.-])(?P<m>\d{1,2})(?P=s)(?P<y>(?:19|20)\d{2})(?![\d/-])")

KINDS = ("email", "telefono", "rut", "direccion", "nombre")


@dataclass(frozen=True)
class Mention:
    kind: str
    start: int
    end: int


def _mask(text: str) -> str:
    """Markup and written-out line ends blanked out, at the same length, so that they end words."""
    return _MARKUP.sub(lambda m: "\n" + " " * (len(m[0]) - 1), text.replace("\u00a0", " ")) if "\\" in text or "<" in text or "\u00a0" in text or "\u200b" in text or "\ufeff" in text else text


def _lower(s: str) -> str:
    """Lower case at the same length, so that places stay."""
    low = s.lower()
    return low if len(low) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


def _street(words: str) -> bool:
    """Whether words before a number are written as a street's name: capitalised, and of nothing else that has numbers."""
    own = words.split()
    return own[0][0].isupper() and all(w[0].isupper() or w in _SMALL for w in own) and not _NO_STREET.search(words.lower())


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


@lru_cache(maxsize=1 << 16)
def _given(word: str) -> bool:
    return _plain(word) in _GIVEN


def _borders(masked: str) -> list[int]:
    """Where sentences begin; an initial's dot ends none."""
    out = [0]
    for m in _BORDER.finditer(masked):
        a = m.start()
        if not (masked[a] == "." and masked[a - 1 : a].isupper() and not masked[a - 2 : a - 1].isalpha()):
            out.append(m.end())
    return out


def _scored(masked: str, low: str, contacts: list[int]) -> Iterator[tuple[int, int]]:
    """Names told by their own form and their sentence. A known given name counts 2, an initial or a
    particle's surname 1; a word about persons before it in the sentence 2, after it 1, a phone, email or
    identity number in the sentence 1, and 1 more for either right beside it; from 4 on it is a name."""
    begins: list[int] = []
    for m in _PERSON.finditer(masked):
        a, b = m.span()
        words = m.group().split()
        first = next((k for k, w in enumerate(words) if _given(w)), None)
        if first is not None and first > 0 and words[first - 1] not in ("de", "del", "la", "los", "y", "e"):
            # what stands before the given name is the sentence's first word or a title
            skip = sum(len(w) + 1 for w in words[:first])
            a, words = a + skip, words[first:]
        if len(words) < 2 or first is None and not words[0].endswith("."):
            continue
        begins = begins or _borders(masked)
        at = bisect.bisect_right(begins, a) - 1
        start, stop = begins[at], begins[at + 1] if at + 1 < len(begins) else len(masked)
        before = low[start:a]
        if _THING_BEFORE.search(before[-80:]) or _NO_PERSON.search(low[a:b]) or re.match(r"\s*,?\s*(?:n[°ºo]\.?\s*|#)?\d", low[b : b + 8]):
            continue
        told = [x.end() for x in _ABOUT.finditer(before)]
        reached = bisect.bisect_left(contacts, a)
        beside = bool(told) and len(before) - told[-1] <= 6 or reached < len(contacts) and contacts[reached] - b <= 4
        score = beside + (2 if first is not None else 1) + 2 * bool(told) + bool(_ABOUT.search(low[b:stop])) + (bisect.bisect_left(contacts, stop) > bisect.bisect_left(contacts, start))
        if score >= 4:
            yield a, b


def mentions(text: str | None) -> list[Mention]:
    """The mentions in a text, in order and without overlap; null, empty and blank texts have none."""
    if not text:
        return []
    masked = _mask(text)
    s = _lower(masked)
    found: list[Mention] = []
    taken = bytearray(len(s))

    def add(kind: str, a: int, b: int) -> bool:
        if b <= a or any(taken[a:b]):
            return False
        taken[a:b] = b"\1" * (b - a)
        found.append(Mention(kind, a, b))
        return True

    for m in _AT.finditer(s):
        # a blank on one side only is that before an account's name
        a, b = m.start() - s[: m.start()].endswith(" "), m.end() + s.startswith(" ", m.end())
        if m[0] == "@" and (a < m.start()) != (b > m.end()):
            continue
        local, domain = _LOCAL.search(s, max(0, a - 64), a), _DOMAIN.match(s, b)
        if local and domain:
            add("email", local.start(), domain.end())
    phones = []
    for m in _RUT.finditer(s):
        before, plain = s[max(0, m.start() - 90) : m.start()], re.sub(r"[^0-9kK]", "", m[0])
        named = bool(_RUT_BEFORE.search(before))
        if not named and (_OTHER_BEFORE.search(before) or "-" not in m[0]):
            continue
        if len(plain) < 8 or (not named and check_digit(int(plain[:-1])) != plain[-1].upper()):
            continue
        add("rut", m.start(), m.end())
    for m in _PHONE.finditer(s):
        if not _OTHER_BEFORE.search(s[max(0, m.start() - 16) : m.start()]) and add("telefono", m.start(), m.end()):
            phones.append(m)
    for m in _KIND_AT.finditer(s):
        if m := _ADDRESS.match(s, m.start()):
            add("direccion", m.start("a"), m.end("u"))
    for m in _PLACE_AT.finditer(s):
        if m := _PLACED.match(s, m.start()):
            add("direccion", m.start("a"), m.end("u"))
    for m in _ALONE_AT.finditer(s):
        if (m := _ALONE.match(s, m.start())) and (m["c"] or _street(text[m.start("s") : m.end("s")])):
            add("direccion", m.start("a"), m.end("u"))
    for m in _NAME_FROM.finditer(s):
        if (m := _NAMED.match(s, m.start())) and not _NO_PERSON.search(m["n"]):
            add("nombre", m.start("n"), m.end("n"))
    for m in phones:
        a = max(0, m.start() - 80)
        breaks = [b.end() for b in _SENTENCE.finditer(s, a, m.start() - 3)]
        begin = max([a if a == 0 else a + 1, *breaks])
        n = _NAME_AT_END.search(s, begin, m.start())
        if n and s[begin : n.start("n")].strip(" '\"[-*•") == "" and not _NO_PERSON.search(n["n"]):
            add("nombre", n.start("n"), n.end("n"))
        n = _IN_BRACKETS.match(s, m.end())
        if n and not _NO_PERSON.search(n["n"]):
            add("nombre", n.start("n"), n.end("n"))
    for m in _INSIDE.finditer(masked):
        if _street(m["s"]) and (not _YEAR.search(m["a"]) or m["u"] or _PLACE_AFTER.match(masked, m.end())):
            add("direccion", m.start("a"), m.end("u"))
    contacts = sorted(x.start for x in found if x.kind in ("telefono", "email", "rut"))
    for a, b in _scored(masked, s, contacts):
        add("nombre", a, b)
    return sorted(found, key=lambda x: x.start)


def _folded(text: str) -> str:
    kept = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[a-z0-9@.+]+", kept))


def _canonical_email(text: str) -> str:
    s = re.sub(r"\s?[\[(]\s?(?:at|arroba)\s?[\])]\s?|\s(?:arroba|at)\s|\s?@\s?", "@", text.lower())
    return re.sub(r"\s?[\[(](?:punto|dot)[\])]\s?|\spunto\s", ".", s)


def _tag(text: str, kind: str, key: bytes) -> str:
    form = _canonical_email(text) if kind == "email" else _folded(text)
    return hashlib.blake2b(kind.encode() + b":" + form.encode(), key=key, digest_size=16).hexdigest()


def redact(text: str | None, key: bytes, dates: bool = False) -> str | None:
    """The text with each mention replaced by ``<TYPE value>`` and otherwise unchanged.

    The value of a phone or identity number is its pseudonym in the same notation, that of a name,
    email or address a keyed tag. With ``dates``, dates are replaced too, permuted among days. Null
    stays null; a text without mentions stays as it is.
    """
    if not text:
        return text
    out, at = [], 0
    spans = mentions(text)
    if dates:
        inside = lambda m: any(x.start < m.end() and m.start() < x.end for x in spans)
        spans = sorted([*spans, *[Mention("fecha", m.start(), m.end()) for m in _DATE.finditer(text) if not inside(m)]], key=lambda x: x.start)
    for x in spans:
        raw = text[x.start : x.end]
        value = {"rut": pseudo_rut, "telefono": pseudo_phone, "fecha": _pseudo_date}.get(x.kind, lambda t, k: _tag(t, x.kind, k))(raw, key)
        out += [text[at : x.start], f"<{x.kind.upper()} {value}>"]
        at = x.end
    return "".join([*out, text[at:]])


def _pseudo_date(text: str, key: bytes) -> str:
    """A date in the same format: leading zeros stay. What isn't a day of ``DAYS`` gets a tag."""
    m = _DATE.fullmatch(text)
    try:
        day = (datetime.date(int(m["y"]), int(m["m"]), int(m["d"])) - datetime.date(1900, 1, 1)).days
    except ValueError:
        return _tag(text, "fecha", key)
    new = datetime.date(1900, 1, 1) + datetime.timedelta(days=pseudo_day(day, key))
    zeros = m["d"].startswith("0") or m["m"].startswith("0")
    return f"{new:%d{m['s']}%m{m['s']}%Y}" if zeros or len(m["d"]) + len(m["m"]) == 4 else f"{new.day}{m['s']}{new.month}{m['s']}{new.year}"


def found(rows: DataFrame, id_column: str, text: Column) -> DataFrame:
    """``id``, ``tipo``, ``inicio`` (1-based code point in the raw text) of every mention; no shuffle."""

    @F.pandas_udf("array<struct<tipo:string,inicio:int>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(m.kind, m.start + 1) for m in mentions(t)])

    return rows.select(id_column, F.inline(find(text))).select(id_column, "tipo", "inicio")


def redacted(rows: DataFrame, id_column: str, text: Column, key: str, dates: bool = False) -> DataFrame:
    """``id`` and ``texto``: every row, its mentions replaced; no shuffle. ``key`` must be kept secret."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, secret, dates))

    return rows.select(id_column, replace(text).alias("texto"))
