"""SQL (DuckDB) for the general data problems that it can express."""

from __future__ import annotations

#: Words for a missing value.
_WORDS = """'', '-', '--', 'n/a', 'na', 'nan', 'none', 'null', 's/i', 's/d', 'sin informacion', 'sin información', 'no informado', 'no informada', 'sin dato', 'sin datos', 'no disponible', 'no aplica', 'nd', 'n/d'"""
_TRIM = "regexp_replace({0}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"
_NUMBER = "TRY_CAST(round(TRY_CAST(CASE WHEN regexp_matches(n, '^\\d{{1,3}}([.,]\\d{{3}})+$') THEN regexp_replace(n, '[.,]', '', 'g') ELSE replace(n, ',', '.') END AS DOUBLE)) AS BIGINT)"


def _missing(c: str) -> str:
    return f"({c} IS NULL OR lower({_TRIM.format(c)}) IN ({_WORDS}))"


def _number(c: str) -> str:
    first = f"regexp_extract({c}, '^[\\s\\x{{a0}}]*(\\d+(?:[.,]\\d+)*)', 1)"
    return _NUMBER.format().replace("n,", f"{first},").replace("ELSE replace(n", f"ELSE replace({first}")


_AT = """coalesce(epoch_us(TRY_CAST(CASE WHEN regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}[ T]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?$') THEN t || '-03' ELSE t END AS TIMESTAMPTZ)),
    epoch_us(try_strptime(t, '%d-%m-%Y %H:%M:%S')) + 10800000000)"""

_FIELD = """SELECT row_id, '{0}' AS campo, valor FROM (
    SELECT row_id, falta, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY aviso ORDER BY a, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        first_value(v IGNORE NULLS) OVER (PARTITION BY aviso ORDER BY a, row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS valor
    FROM (SELECT row_id, aviso, a, {1} AS v, {2} AS falta FROM filas)) WHERE falta AND valor IS NOT NULL"""

_M2 = f"CASE WHEN {_number('m2_util')} > 0 THEN CAST({_number('m2_util')} AS VARCHAR) END"
_ROOMS = f"CASE WHEN NOT {_missing('dormitorios')} THEN CAST({_number('dormitorios')} AS VARCHAR) END"
_AREA = f"CASE WHEN NOT {_missing('barrio')} THEN lower({_TRIM.format('barrio')}) END"



def _money(c: str, bare: str) -> str:
    """A query with row_id, v (number as written), unidad; ``bare``: the unit of a number without one, by its size v."""
    return f"""SELECT row_id, v, CASE WHEN u = '' THEN {bare} WHEN regexp_matches(u, 'us\\$|u\\$s|usd|dolar') THEN 'USD' WHEN regexp_matches(u, 'uf|u\\.f') THEN CASE WHEN regexp_matches(u, 'mil') THEN 'UF_MIL' ELSE 'UF' END
        WHEN regexp_matches(u, 'mm|mill') THEN 'CLP_MM' WHEN regexp_matches(u, 'm\\$|mil|lucas|k') THEN 'CLP_MIL' ELSE 'CLP' END AS unidad
    FROM (SELECT row_id, u, TRY_CAST(CASE WHEN dots > 0 AND commas > 0 THEN CASE WHEN regexp_matches(n, ',[^.]*$') THEN replace(replace(n, '.', ''), ',', '.') ELSE replace(n, ',', '') END
            WHEN dots > 1 OR commas > 1 OR (regexp_matches(n, '^[1-9]\\d{{0,2}}[.,]\\d{{3}}$') AND NOT (commas = 1 AND regexp_matches(u, 'm\\$|mm|mil|lucas|k'))) THEN regexp_replace(n, '[.,]', '', 'g') ELSE replace(n, ',', '.') END AS DOUBLE) AS v
        FROM (SELECT row_id, n, length(regexp_replace(n, '[^.]', '', 'g')) AS dots, length(regexp_replace(n, '[^,]', '', 'g')) AS commas, trim(regexp_replace(x, '\\d[\\d.,]*\\d|\\d|aprox\\.?|\\.-', '', 'g')) AS u
            FROM (SELECT row_id, regexp_extract(strip_accents(lower({c})), '\\d[\\d.,]*\\d|\\d') AS n, strip_accents(lower({c})) AS x FROM lyon_balmaceda_scraper WHERE regexp_matches({c}, '\\d'))))"""


_PRICE = _money("precio_uf", "CASE WHEN v <= 100000 THEN 'UF' ELSE 'CLP' END")
_EXPENSES = _money("gastos_comunes", "CASE WHEN v <= 18 THEN 'UF' WHEN v <= 5000 THEN 'CLP_MIL' ELSE 'CLP' END")
_AVISO = "TRY_CAST(regexp_extract(url_propiedad, '(?:^|[^0-9])([0-9]{10})(?:[^0-9]|$)', 1) AS BIGINT)"

_F = '(?:"(?:[^"]|"")*"|[^",]*)'
_UNQUOTE = "CASE WHEN starts_with({0}, '\"') THEN replace(substring({0}, 2, length({0}) - 2), '\"\"', '\"') ELSE {0} END"


def _list_in(x: str) -> str:
    """Whether a text is a JSON list, or an object with the list images."""
    return f"coalesce(CASE WHEN json_valid({x}) THEN json_type({x}) = 'ARRAY' OR json_type({x}, '$.images') = 'ARRAY' ELSE false END, false)"


def _images_valid(x: str) -> str:
    """Blank or such JSON after taking off a level of outer quotes and none, one or two doublings."""
    inner = f"CASE WHEN regexp_full_match({x}, '\"[{{\\[].*\"', 's') THEN substring({x}, 2, length({x}) - 2) ELSE {x} END"
    once = f"replace({inner}, '\"\"', '\"')"
    twice = f"replace({once}, '\"\"', '\"')"
    return f"(trim({x}) = '' OR {_list_in(x)} OR {_list_in(inner)} OR {_list_in(once)} OR {_list_in(twice)})"


_POSITION = "TRY_CAST(CASE WHEN regexp_full_match({0}, '[\\s\\x{{a0}}]*[+-]?\\d+([.,]\\d*)?[\\s\\x{{a0}}]*') THEN replace(trim({0}), ',', '.') END AS DOUBLE)"

_RECORDS = """SELECT linea_id, CASE WHEN length(s) > 1 AND regexp_full_match(s, '"(?:[^"]|"")*"', 's') AND contains(s, ',') THEN replace(substring(s, 2, length(s) - 2), '""', '"') ELSE s END AS r
    FROM (SELECT linea_id, regexp_replace(linea, '^[\\r\\n]+|[\\r\\n]+$', '', 'g') AS s FROM scraper_lineas WHERE regexp_matches(linea, '\\S'))"""
#: The columns of the files, in order.
_COLUMNS = (
    "execution_time url_propiedad portal tipo_propiedad operacion comuna barrio latitud longitud precio_uf m2_util m2_total dormitorios banios corredora codigo_interno url_plp "
    "posicion seller_thermometer estacionamiento bodega orientacion gastos_comunes piso anio titulo_propiedad images descripcion"
).split()


def _canonical(money: str, target: str) -> str:
    pesos = "CASE unidad WHEN 'UF' THEN v * uf_clp WHEN 'UF_MIL' THEN v * 1000 * uf_clp WHEN 'USD' THEN v * usd_clp WHEN 'CLP' THEN v WHEN 'CLP_MIL' THEN v * 1000 ELSE v * 1000000 END"
    whole = f"CASE unidad WHEN 'UF' THEN v WHEN 'UF_MIL' THEN v * 1000 ELSE {pesos} / uf_clp END" if target == "UF" else pesos
    return f"SELECT m.row_id, CASE WHEN v = 0 THEN 0 ELSE {whole} END AS x FROM ({money}) m JOIN dias USING (row_id) LEFT JOIN valores_moneda USING (fecha)"


SQL: dict[str, str] = {
    "p1_canonical": f"""WITH dias AS (SELECT row_id, CAST(make_timestamp({_AT} - 10800000000) AS DATE) AS fecha FROM (SELECT row_id, trim(execution_time) AS t FROM lyon_balmaceda_scraper))
    SELECT row_id, p.x AS precio, g.x AS gastos FROM lyon_balmaceda_scraper LEFT JOIN ({_canonical(_PRICE, 'UF')}) p USING (row_id) LEFT JOIN ({_canonical(_EXPENSES, 'CLP')}) g USING (row_id)""",
    "p6_loaded": f"SELECT linea_id, {', '.join(_UNQUOTE.format(c) + ' AS ' + c for c in _COLUMNS)} FROM (SELECT linea_id, "
    + ", ".join(f"regexp_extract(r, '(?s)^(?:{_F},){{{k}}}({_F})(?:,|$)', 1) AS {c}" for k, c in enumerate(_COLUMNS))
    + f" FROM ({_RECORDS}) WHERE linea_id NOT IN (SELECT linea_id FROM (__P6__)))",
    "p6_found": f"""SELECT linea_id, motivo FROM (SELECT linea_id, CASE WHEN NOT regexp_full_match(r, '{_F}(?:,{_F})*', 's') THEN 'comillas' WHEN columnas < 28 THEN 'pocas_columnas' WHEN columnas > 28 THEN 'muchas_columnas'
            WHEN NOT {_images_valid('imagenes')} OR (regexp_matches(texto, '^\\s*\\[[''"]') AND NOT (length(trim(texto)) >= 4 AND ends_with(trim(texto), substring(trim(texto), 2, 1) || ']'))) THEN 'valor_invalido' END AS motivo
        FROM (SELECT linea_id, r, columnas, {_UNQUOTE.format('i')} AS imagenes, {_UNQUOTE.format('d')} AS texto FROM (SELECT linea_id, r, length(regexp_replace(regexp_replace(r, '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) + 1 AS columnas,
            regexp_extract(r, '(?s)^(?:{_F},){{26}}({_F}),{_F}$', 1) AS i, regexp_extract(r, '(?s)^(?:{_F},){{27}}({_F})$', 1) AS d
            FROM (SELECT linea_id, CASE WHEN length(s) > 1 AND regexp_full_match(s, '"(?:[^"]|"")*"', 's') AND contains(s, ',') THEN replace(substring(s, 2, length(s) - 2), '""', '"') ELSE s END AS r
                FROM (SELECT linea_id, regexp_replace(linea, '^[\\r\\n]+|[\\r\\n]+$', '', 'g') AS s FROM scraper_lineas WHERE regexp_matches(linea, '\\S')))))) WHERE motivo IS NOT NULL""",
    "p7_found": f"""WITH pos AS (SELECT row_id, y, x FROM (SELECT row_id, {_POSITION.format('latitud')} AS y, {_POSITION.format('longitud')} AS x FROM lyon_balmaceda_scraper) WHERE y BETWEEN -55 AND -17 AND x BETWEEN -109 AND -66),
    corner AS (SELECT comuna_id, k, CAST(split_part(p, ' ', 1) AS DOUBLE) AS cx, CAST(split_part(p, ' ', 2) AS DOUBLE) AS cy FROM (SELECT comuna_id, unnest(string_split(ps, ', ')) AS p, generate_subscripts(string_split(ps, ', '), 1) AS k
        FROM (SELECT comuna_id, regexp_extract(poligono, '\\(\\((.*)\\)\\)', 1) AS ps FROM comunas))),
    edge AS (SELECT a.comuna_id, a.cx AS x1, a.cy AS y1, b.cx AS x2, b.cy AS y2 FROM corner a JOIN corner b ON b.comuna_id = a.comuna_id AND b.k = a.k + 1)
    SELECT row_id, 'comuna' AS clase, comuna_id AS ref_id FROM pos JOIN edge ON (y1 > y) <> (y2 > y) WHERE x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY 1, 3 HAVING count(*) % 2 = 1
    UNION ALL SELECT row_id, 'punto', poi_id FROM pos JOIN puntos_interes p ON 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(p.latitud - y) / 2), 2) + cos(radians(y)) * cos(radians(p.latitud)) * pow(sin(radians(p.longitud - x) / 2), 2)))) <= radio_m""",
    "p1_found": f"SELECT row_id, 'precio_uf' AS campo, unidad FROM ({_PRICE}) WHERE v > 0 AND unidad <> 'UF' UNION ALL SELECT row_id, 'gastos_comunes', unidad FROM ({_EXPENSES}) WHERE v > 0 AND unidad <> 'CLP'",
    "p2_found": f"""WITH runs AS (SELECT *, row_number() OVER (ORDER BY inicio, corrida_id) AS k FROM corridas),
    seen AS (SELECT aviso, k, arg_max(row_id, (a, row_id)) AS row_id, max(a) AS a FROM (SELECT row_id, {_AVISO} AS aviso, {_AT} AS a FROM (SELECT *, trim(execution_time) AS t FROM lyon_balmaceda_scraper))
        JOIN runs ON a BETWEEN epoch_us(inicio) AND epoch_us(fin) WHERE aviso IS NOT NULL GROUP BY 1, 2),
    snap AS (SELECT aviso, k, CASE unidad WHEN 'UF' THEN v WHEN 'UF_MIL' THEN v * 1000 WHEN 'USD' THEN v * usd_clp / uf_clp WHEN 'CLP' THEN v / uf_clp WHEN 'CLP_MIL' THEN v * 1000 / uf_clp ELSE v * 1000000 / uf_clp END AS uf
        FROM seen LEFT JOIN ({_PRICE}) p USING (row_id) LEFT JOIN valores_moneda m ON m.fecha = CAST(make_timestamp(a - 10800000000) AS DATE))
    SELECT aviso, corrida_id, cambio FROM (SELECT coalesce(b.aviso, n.aviso) AS aviso, coalesce(b.k + 1, n.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN b.uf > 0 AND n.uf > 0 AND abs(n.uf - b.uf) > 0.005 * b.uf THEN 'changed' END AS cambio
        FROM snap b FULL JOIN snap n ON n.aviso = b.aviso AND n.k = b.k + 1) JOIN runs USING (k) WHERE cambio IS NOT NULL AND k > 1""",
    "p5_found": f"""WITH filas AS (SELECT * FROM (SELECT *, TRY_CAST(regexp_extract(url_propiedad, '(?:^|[^0-9])([0-9]{{10}})(?:[^0-9]|$)', 1) AS BIGINT) AS aviso, {_AT} AS a
        FROM (SELECT *, trim(execution_time) AS t FROM lyon_balmaceda_scraper)) WHERE aviso IS NOT NULL AND a IS NOT NULL)
    {_FIELD.format('m2_util', _M2, f"({_missing('m2_util')} OR coalesce({_number('m2_util')} = 0, false))")}
    UNION ALL {_FIELD.format('dormitorios', _ROOMS, _missing('dormitorios'))}
    UNION ALL {_FIELD.format('barrio', _AREA, _missing('barrio'))}""",
}
SQL["p6_loaded"] = SQL["p6_loaded"].replace("__P6__", SQL["p6_found"])
