"""For each listing query that SQL can express, the SQL for the same tables (DuckDB)."""

from __future__ import annotations

from parcela.plans.listing_queries import ASKED, LINES, NEARLY


def q(text: str | None) -> str:
    """A text as a literal."""
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


L = "lyon_balmaceda_scraper"
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


#: Spellings that taking off accents doesn't give, written down here once more, so that a wrong entry in the library's tables shows.
_ONE = {"øØđĐðÐłŁı": "oOdDdDlLi", "–‐‑‒‘’‚“”„¿¡ºª·•´¬×÷²³¹": "----'',\"\"\"?!oa**'!x/231", "０１２３４５６７８９": "0123456789", "\u00a0\u2002\u2003\u2009\u202f\u3000": "      "}
_MORE = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "—": "--", "…": "...", "«": "<<", "»": ">>", "©": "(c)", "®": "(r)", "™": "tm", "°": "deg", "€": "EUR",
    "½": "1/2", "¼": "1/4", "¾": "3/4", "№": "No", "±": "+-", "§": "SS", "£": "PS", "ﬁ": "fi", "ﬂ": "fl",
}
_LETTERS = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ы": "y", "э": "e", "ю": "iu", "я": "ia"}
#: The audited number columns, in order of the report.
NUMBERS = ("precio_uf", "m2_util", "m2_total", "dormitorios", "banios", "estacionamiento", "bodega", "piso", "anio", "gastos_comunes")


def ascii_(x: str) -> str:
    out = f"translate(strip_accents({x}), {q(''.join(_ONE))}, {q(''.join(_ONE.values()))})"
    for a, b in (_MORE | _LETTERS | {k.upper(): v.capitalize() for k, v in _LETTERS.items()}).items():
        out = f"replace({out}, {q(a)}, {q(b)})"
    return sub(out, r"[^\x00-\x7F]", "")


def clean(x: str) -> str:
    s = f"coalesce({x}, '')"
    opened = f"CASE WHEN starts_with({s}, '\"[') AND ends_with({s}, ']\"') THEN replace(replace(substring({s}, 3, greatest(length({s}) - 4, 0)), '\"\"\"', '\"'), '\\n', ' ') ELSE {s} END"
    s = sub(ascii_(opened), "<[^>]+>", "")
    return f"trim({sub(sub(s, r'[\s\x0b\x1c-\x1f]+', ' '), r'[^\w\s.,!?\-()]', ' ')})"


def marks(x: str) -> str:
    k = sub(x, "[^0-9.,-]", "")
    commas, dots = f"length({sub(k, '[^,]', '')})", f"length({sub(k, '[^.]', '')})"
    return f"CASE WHEN {commas} > 0 AND {dots} = 0 THEN replace({k}, ',', '.') WHEN {commas} > 1 OR ({commas} = 1 AND {dots} = 1) THEN replace({k}, ',', '') ELSE {k} END"


def num(x: str) -> str:
    return f"coalesce(try_cast({marks(x)} AS DOUBLE), 0.0)"


def price(x: str) -> str:
    return f"least(greatest({num(x)}, 0.0), 100000.0)"


def in_chile(y: str, x: str) -> str:
    return f"({y} BETWEEN -55 AND -17 AND {x} BETWEEN -109 AND -66)"


def cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '...' ELSE {x} END"


def short(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n - 3}) || '...' ELSE {x} END"


def blob() -> str:
    """A query with row_id and semantic_text; the cleaned fields are computed once below it."""
    text = lambda c: f"nullif({clean(c)}, '') AS {c}"
    number = lambda c: f"{num(c)} AS {c}"
    fields = ", ".join([*map(text, ("titulo_propiedad", "comuna", "barrio", "tipo_propiedad", "operacion", "descripcion")), *map(number, ("dormitorios", "banios", "m2_util", "estacionamiento", "bodega"))])
    some = lambda c, word: f"CASE WHEN {c} > 0 THEN CAST(trunc({c}) AS BIGINT) || ' {word}' END"
    parts = f"""concat_ws(' ', titulo_propiedad, titulo_propiedad, 'Comuna ' || comuna, 'Barrio ' || barrio, tipo_propiedad, 'en ' || operacion, {some('dormitorios', 'dormitorios')},
        {some('banios', 'baños')}, {some('m2_util', 'metros cuadrados útiles')}, CASE WHEN estacionamiento > 0 THEN 'con estacionamiento' END, CASE WHEN bodega > 0 THEN 'con bodega' END, {cut('descripcion', 1000)})"""
    return f"SELECT row_id, {cut('b', 2000)} AS semantic_text FROM (SELECT row_id, {clean('p')} AS b FROM (SELECT row_id, {parts} AS p FROM (SELECT row_id, {fields} FROM {L})))"


def image_lists(keep: str = "x IS NOT NULL") -> str:
    """A query with row_id and the list i of its images."""
    fixed = "replace(replace(replace(images, '\"\"', '\"'), '\"{', '{'), '}\"', '}')"
    found = "CASE WHEN NOT coalesce(json_valid(f), false) THEN [] WHEN json_type(f) = 'ARRAY' THEN json_extract_string(f, '$[*]') WHEN json_type(f, '$.images') = 'ARRAY' THEN json_extract_string(f, '$.images[*]') ELSE [] END"
    return f"SELECT row_id, list_filter({found}, lambda x: {keep}) AS i FROM (SELECT row_id, {fixed} AS f FROM {L})"


def images(keep: str = "x IS NOT NULL") -> str:
    """A query with row_id, n_images and the images joined by bars."""
    return f"SELECT row_id, CAST(len(i) AS BIGINT) AS n_images, array_to_string(i, '|') AS images FROM ({image_lists(keep)})"


def issue(column: str, raw: str, kind: str, message: str, used: str, source: str) -> str:
    return f"SELECT row_id AS row_index, substring(coalesce(url_propiedad, 'None'), 1, 120) AS url, '{column}' AS \"column\", {raw} AS raw_value, '{kind}' AS issue_type, {message} AS message, {used} AS value_used, true AS requires_manual_review FROM {source} WHERE {message} IS NOT NULL"


def problem(x: str) -> str:
    s = sub(x, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    source = f"' (original: ' || substring('''' || {s} || '''', 1, 80) || ')'"
    return f"CASE WHEN coalesce({s}, '') = '' THEN NULL WHEN {marks(s)} = '' THEN 'Sin dígitos extraíbles' || {source} WHEN try_cast({marks(s)} AS DOUBLE) IS NULL THEN 'No convertible a número' || {source} END"


def issues() -> str:
    out = []
    for c in NUMBERS:
        if c == "precio_uf":
            v = num(c)
            message = f"CASE WHEN {problem(c)} IS NOT NULL THEN {problem(c)} WHEN {v} < 0 THEN 'Precio UF negativo (' || CAST({v} AS VARCHAR) || '); se usó 0' WHEN {v} > 100000 THEN 'Precio UF extremo (' || CAST({v} AS VARCHAR) || '); se acotó a 100000' END"
            out.append(issue(c.upper(), short(c, 100), "numeric_invalid", message, f"CASE WHEN {problem(c)} IS NULL AND {v} > 100000 THEN '100000.0' ELSE '0.0' END", L))
        else:
            out.append(issue(c.upper(), short(c, 100), "numeric_invalid", problem(c), "'0.0'", L))
    y, x = num("latitud"), num("longitud")
    outside = f"CASE WHEN NOT ({y} = 0 AND {x} = 0) AND NOT {in_chile(y, x)} THEN 'Coordenadas fuera de Chile: (' || CAST({y} AS VARCHAR) || ', ' || CAST({x} AS VARCHAR) || ')' END"
    message = f"CASE WHEN coalesce(latitud, '') <> '' OR coalesce(longitud, '') <> '' THEN coalesce({problem('latitud')}, {problem('longitud')}, {outside}) END"
    shown = "'(' || coalesce(latitud, 'None') || ', ' || coalesce(longitud, 'None') || ')'"
    out.append(issue("LATITUD/LONGITUD", short(shown, 100), "coordinates_invalid", message, "'(0.0, 0.0)'", L))
    low = "CASE WHEN length(trim(semantic_text)) < 10 THEN 'Contenido semántico insuficiente para embedding (título/descripción vacíos o muy cortos)' END"
    out.append(issue("BLOB_SEMANTICO", "'(combinación título/descripción/comuna/otros)'", "semantic_content_insufficient", low, "'(blob vacío o muy corto)'", f"(SELECT b.row_id, url_propiedad, semantic_text FROM ({blob()}) b JOIN {L} USING (row_id))"))
    return " UNION ALL ".join(out)


def bad_images() -> str:
    """Rows whose image field gives no list, as (row_index, column)."""
    fixed = "replace(replace(replace(trim(images), '\"\"', '\"'), '\"{', '{'), '}\"', '}')"
    return f"SELECT row_id AS row_index, 'IMAGES' AS \"column\" FROM (SELECT row_id, images, {fixed} AS f FROM {L}) WHERE trim(coalesce(images, '')) <> '' AND NOT CASE WHEN coalesce(json_valid(f), false) THEN json_type(f) = 'ARRAY' OR json_exists(f, '$.images') ELSE false END"


_PAYLOAD_TEXT = {"portal": "portal", "tipo_propiedad": "tipo_propiedad", "operacion": "operacion", "comuna": "comuna", "barrio": "barrio", "descripcion": "descripcion"}


def payload() -> str:
    y, x = num("latitud"), num("longitud")
    lat = lambda v: f"CASE WHEN {in_chile(y, x)} THEN {v} ELSE 0.0 END"
    whole = lambda c: f"CAST(trunc({num(c)}) AS BIGINT) AS {c}"
    fields = ["l.row_id", "coalesce(url_propiedad, 'None') AS url", *[f"{clean(c)} AS {n}" for n, c in _PAYLOAD_TEXT.items()], f"{lat(y)} AS latitud", f"{lat(x)} AS longitud", f"{price('precio_uf')} AS precio_uf"]
    fields += [f"{num(c)} AS {c}" for c in ("m2_util", "m2_total", "gastos_comunes")] + [whole(c) for c in ("dormitorios", "banios", "estacionamiento", "bodega", "anio", "piso")]
    fields += [f"substring({clean('titulo_propiedad')}, 1, 500) AS titulo", "i.images", "CAST(i.n_images AS INTEGER) AS n_images"]
    return f"SELECT {', '.join(fields)} FROM {L} l JOIN ({images()}) i ON l.row_id = i.row_id"


_COS = "coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 0.0)"


def near(vec: int, k: int, where: str = "true", least: float = -2.0) -> str:
    return f"SELECT vec_id, label, round(s, 6) AS score FROM (SELECT e.vec_id, e.label, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec}) v WHERE {where}) WHERE s >= {least} ORDER BY s DESC, vec_id LIMIT {k}"


def values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)}) t({names})"


_BOUND = lambda field, k: f"try_cast(json_extract_string(f, '$.{field}.{k}') AS DOUBLE)"
_FILTERS = values([(str(k), q(f)) for k, (_, f, _) in enumerate(ASKED)], "id, f")
_LINES = "(SELECT linea_id, row_number() OVER (ORDER BY linea_id) - 1 AS place FROM scraper_lineas WHERE rtrim(regexp_replace(linea, '[\r\n]+$', '')) <> '')"

_TEXT = lambda c, none: f"coalesce({c}, {q(none)}) AS {c}"
_SOME = lambda c: f"CASE WHEN {c} > 0 THEN CAST({c} AS VARCHAR) END AS {c}"


def shown() -> str:
    told = [f"CAST({c} AS VARCHAR) AS {c}" for c in ("comuna", "dormitorios", "banios", "m2_util", "m2_total", "estacionamiento", "tipo_propiedad", "operacion")]
    return f"""SELECT row_id, {', '.join(told)}, nullif(barrio, '') AS barrio, printf('%.2f', precio_uf) AS precio_uf, {', '.join(map(_SOME, ('bodega', 'anio', 'piso')))},
        CASE WHEN gastos_comunes > 0 THEN format('{{:,}}', CAST(round_even(gastos_comunes, 0) AS BIGINT)) END AS gastos_comunes, nullif(titulo, '') AS titulo, nullif({cut('descripcion', 200)}, '') AS descripcion, nullif(url, '') AS url FROM ({payload()})"""


_N = "(SELECT count(*) FROM embeddings)"
_LIFE = ["(0, 'none', false, 0, 0)", "(1, 'create', true, 0, 0)", f"(2, 'append', true, {_N}, {_N})", f"(3, 'repeat', true, {_N}, {_N})", f"(4, 'second', true, 2 * {_N}, {_N})", f"(5, 'empty', true, 2 * {_N}, 0)", "(6, 'recreate', true, 0, 0)", "(7, 'drop', false, 0, 0)"]
_STATS = f"SELECT count(*) AS n, count(*) FILTER (length(trim(semantic_text)) > 3) AS good FROM ({blob()})"
_REPORT = (
    ("Total Records Processed", "CAST(n AS VARCHAR)"), ("Successfully Embedded", "CAST(good AS VARCHAR)"), ("Successfully Uploaded", "CAST(good AS VARCHAR)"), ("Failed Records", "CAST(n - good AS VARCHAR)"),
    ("Batches Processed", "CAST(CAST(ceil(n / 1000.0) AS BIGINT) AS VARCHAR)"), ("Success Rate", "printf('%.1f%%', CASE WHEN n = 0 THEN 0.0 ELSE good * 100.0 / n END)"), ("Collection Name", "'propiedades'"),
    ("Embedding Model", "'hash-64'"), ("Vector Dimension", "'64'"), ("Total Execution Time", "'8.0'"), ("Records per Second", "printf('%.1f', n / 8.0)"),
)

SQL: dict[str, str] = {
    "csv_full_scan": "SELECT linea_id FROM scraper_lineas WHERE regexp_replace(linea, '[\\r\\n]+$', '') <> ''",
    "ingest_payload": f"SELECT b.row_id, coalesce(l.url_propiedad, 'None') AS url, CAST(i.n_images AS INTEGER) AS n_images, semantic_text FROM ({blob()}) b JOIN {L} l USING (row_id) JOIN ({images()}) i USING (row_id) WHERE length(trim(semantic_text)) > 3",
    "row_status": f"SELECT row_id, CASE WHEN length(trim(semantic_text)) > 3 THEN 'uploaded' ELSE 'failed' END AS status, CASE WHEN length(trim(semantic_text)) <= 3 THEN 'insufficient semantic content' END AS reason FROM ({blob()})",
    "final_report": " UNION ALL ".join(f"SELECT {k} AS linea, '{name}' AS nombre, {value} AS valor FROM ({_STATS})" for k, (name, value) in enumerate(_REPORT)),
    "collection_lifecycle": f"SELECT * FROM (VALUES {', '.join(_LIFE)}) t(step, name, present, points, added)",
    "embedding_models": values([(q(f"hash-{n}"), str(n), "2000") for n in (64, 256, 1024)], "model_name, dimension, max_length"),
    "sql_functions": f"SELECT l.row_id, {clean('comuna')} AS comuna, {num('m2_util')} AS m2_util, {price('precio_uf')} AS precio_uf, CAST(i.n_images AS INTEGER) AS n_images FROM {L} l JOIN ({images()}) i ON l.row_id = i.row_id",
    "result_display": shown(),
    "result_images": f"SELECT row_id, CAST(unnest(range(1, len(i) + 1)) AS INTEGER) AS numero, unnest(i) AS imagen FROM ({image_lists()})",
    "payload_dump": f"""SELECT row_id, '{{' || chr(10) || '  "comuna": ' || to_json(comuna) || ',' || chr(10) || '  "dormitorios": ' || dormitorios || ',' || chr(10) || '  "n_images": ' || n_images || ',' || chr(10) || '  "tipo_propiedad": ' || to_json(tipo_propiedad) || chr(10) || '}}' AS json FROM ({payload()})""",
    "capitalize_text": f"SELECT row_id, upper(substring(comuna, 1, 1)) || lower(substring(comuna, 2)) AS comuna, upper(substring(operacion, 1, 1)) || lower(substring(operacion, 2)) AS operacion FROM {L}",
    "knn_labels": near(0, 10, "label BETWEEN 1 AND 5"),
    "clean_string_documents": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
    "clean_string_listings": f"SELECT row_id, {clean('descripcion')} AS descripcion, {clean('comuna')} AS comuna FROM {L}",
    "strip_html_documents": f"SELECT doc_id, {sub('text', '<[^>]+>', '')} AS plain FROM documents",
    "preprocess_text": f"SELECT doc_id, {cut('t', 2000)} AS prepared FROM (SELECT doc_id, coalesce(trim({sub('text', _WS, ' ')}), '') AS t FROM documents)",
    "truncate_text": f"SELECT doc_id, {cut('text', 200)} AS cut, {short('text', 100)} AS short FROM documents",
    "normalize_text": f"SELECT doc_id, trim({sub('strip_accents(lower(text))', _WS, ' ')}) AS normal FROM documents",
    "clean_numeric": f"SELECT row_id, {', '.join(f'{num(c)} AS {c}' for c in ('precio_uf', 'gastos_comunes', 'm2_util', 'm2_total', 'dormitorios', 'banios'))} FROM {L}",
    "clean_price": f"SELECT row_id, {price('precio_uf')} AS precio_uf FROM {L}",
    "clean_coordinates": f"SELECT row_id, CASE WHEN {in_chile('y', 'x')} THEN y ELSE 0.0 END AS latitud, CASE WHEN {in_chile('y', 'x')} THEN x ELSE 0.0 END AS longitud FROM (SELECT row_id, {num('latitud')} AS y, {num('longitud')} AS x FROM {L})",
    "parse_images": images(),
    "normalize_images": images("x IS NOT NULL AND trim(x) <> ''"),
    "semantic_blob": blob(),
    "content_filter": f"SELECT row_id FROM ({blob()}) WHERE length(trim(semantic_text)) > 3",
    "payload_projection": payload(),
    "pipeline_stats": f"""SELECT count(*) AS total_processed, count(*) FILTER (g) AS total_embedded, count(*) FILTER (g) AS total_uploaded, count(*) FILTER (NOT g) AS failed_records, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS batches,
        printf('%.1f%%', CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (g) * 100.0 / count(*) END) AS success_rate FROM (SELECT length(trim(semantic_text)) > 3 AS g FROM ({blob()}))""",
    "ingest_batches": f"SELECT CAST(place // 1000 AS BIGINT) AS batch, count(*) AS n, min(linea_id) AS first_id, max(linea_id) AS last_id FROM {_LINES} GROUP BY 1",
    "ingest_skip_rows": f"SELECT linea_id, CAST((place - 250) // 500 AS BIGINT) AS batch FROM {_LINES} WHERE place >= 250",
    "csv_row_parse": values([(str(i), q(a), q(b)) for i, _, a, b in LINES if a is not None], "id, images, descripcion"),
    "collection_info": "SELECT max(len(embedding)) AS dimension, 'cosine' AS distance, count(*) AS points_count FROM embeddings",
    "filter_eq": f"SELECT row_id, comuna FROM {L} WHERE tipo_propiedad = 'departamento' AND operacion = 'Venta'",
    "filter_range": "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 950 AND p_retailprice <= 1500",
    "filter_conj": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_orderkey < 1000000",
    "filter_accents": f"SELECT row_id FROM {L} WHERE strip_accents(lower(operacion)) = 'venta'",
    "lookup_by_payload": f"SELECT row_id, url_propiedad, portal FROM {L} WHERE portal = 'Casa Vitrina' ORDER BY row_id LIMIT 10",
    "knn_topk": near(0, 10),
    "knn_filtered": near(0, 10, "label BETWEEN 1 AND 5 AND vec_id < 400"),
    "knn_threshold": near(3, 10, "label = 2", 0.1),
    "knn_zero_vector": "SELECT vec_id, label, 0.0 AS score FROM embeddings ORDER BY vec_id LIMIT 5",
    "knn_batch": f"SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM (SELECT v.vec_id AS query_id, e.vec_id, {_COS} AS s FROM embeddings e JOIN embeddings v ON v.vec_id % 20 = 0)) WHERE rank <= 10",
    "cosine_pairs": f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) v",
    "extract_filters": f"SELECT id, f AS filters FROM ({_FILTERS})",
    "query_clean": values([(str(k), q(c)) for k, (_, _, c) in enumerate(ASKED)], "id, query_clean"),
    "extract_price_range": f"SELECT id, {_BOUND('precio_uf', 'gte')} AS low, {_BOUND('precio_uf', 'lte')} AS high FROM ({_FILTERS})",
    "extract_area": f"SELECT id, {_BOUND('m2_util', 'gte')} AS low, {_BOUND('m2_util', 'lte')} AS high FROM ({_FILTERS})",
    "fuzzy_comuna": values([(q(a), q(b), f"CAST({r} AS DOUBLE)", str(ok).lower()) for a, b, r, ok in NEARLY], "query, comuna, ratio, accepted"),
    "audit_exclude": issues(),
    "audit_by_type": f"SELECT issue_type, count(*) AS n FROM ({issues()}) GROUP BY 1 UNION ALL SELECT 'images_json_invalid', count(*) FROM ({bad_images()}) HAVING count(*) > 0",
    "audit_by_row": f"""SELECT row_index, count(*) AS n, string_agg("column", ',' ORDER BY list_position([{', '.join(q(c.upper()) for c in NUMBERS)}, 'LATITUD/LONGITUD', 'IMAGES', 'BLOB_SEMANTICO'], "column")) AS columns FROM (SELECT row_index, "column" FROM ({issues()}) UNION ALL {bad_images()}) GROUP BY 1""",
    "audit_summary": f"SELECT count(DISTINCT row_index) AS rows_with_issues, count(*) AS total_issues FROM (SELECT row_index FROM ({issues()}) UNION ALL SELECT row_index FROM ({bad_images()}))",
}
