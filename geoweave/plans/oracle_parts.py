"""Building blocks of the checking SQL: the derived tables and the text rules, in plain SQL.

Only the fixed values are shared with the library; the logic here is written separately, in terms of
joins and grouping, so that agreement means something.
"""

from __future__ import annotations

from geoweave.functions import vocab
from geoweave.sources import derived

POINTS = derived.POINTS_SQL.format(events="events")
ADDR_RAW = derived.ADDR_SQL.format(orders="orders")
REQUESTS = derived.REQUESTS_SQL.format(addr="addr_raw")
FAULTY = derived.FAULTY_REQUESTS_SQL.format(orders="orders")
CANDIDATES = derived.CANDIDATES_SQL.format(requests="requests")
LOG = derived.REQUEST_LOG_SQL.format(events="events")
VERTICES = derived.POLY_VERTICES_SQL.format(nation="nation")
PARCEL_VERTICES = derived.PARCEL_VERTICES_SQL.format(customer="customer")


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"upper(strip_accents({x}))"


def tok(x: str) -> str:
    kept = f"regexp_replace({fold(f'coalesce({x}, {q(str())})')}, '[^A-Z0-9\\s/-]', '', 'g')"
    return f"trim(regexp_replace({kept}, '\\s+', ' ', 'g'))"


def case_map(x: str, mapping: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {x} {arms} ELSE {default} END"


def kind(x: str) -> str:
    t = tok(x)
    return case_map(t, vocab.STREET_TYPE_CANONICAL, t)


def direction(x: str) -> str:
    t = tok(x)
    return case_map(t, vocab.STREET_DIRECTION, t)


def province(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({x}), '^[0-9]+$') "
        f"THEN {case_map(f'trim({x})', vocab.PROVINCE_BY_NUMBER, 'NULL')} "
        f"ELSE {case_map(fold(f'trim({x})'), vocab.PROVINCE_BY_NAME, 'NULL')} END"
    )


def postal(x: str) -> str:
    packed = f"upper(regexp_replace({x}, '\\s+', '', 'g'))"
    clean = f"upper(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
    return (
        f"CASE WHEN regexp_matches({packed}, '^[A-Z][0-9][A-Z][0-9][A-Z][0-9]$') "
        f"THEN substr({packed}, 1, 3) || ' ' || substr({packed}, 4, 3) "
        f"WHEN length({clean}) BETWEEN 1 AND 20 THEN {clean} END"
    )


def in_list(x: str, values: list[str]) -> str:
    return f"{x} IN ({', '.join(q(v) for v in values)})"


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = (
        f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    )
    return f"(6371000.0 * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


# Standardised addresses.
ADDR = f"""
addr_raw AS ({ADDR_RAW}),
addr_tok AS (
  SELECT *, {tok('civic_number')} AS t_civic, {tok('street_name')} AS t_name, {kind('street_type')} AS t_kind,
    {direction('street_direction')} AS t_dir, {tok('city')} AS t_city,
    coalesce({postal('postal_code')}, '') AS t_postal, {tok("regexp_replace(unit, '^#', '')")} AS unit_key
  FROM addr_raw),
addr AS (
  SELECT id, civic_number, street_name, street_type, street_direction, unit, t_postal AS postal_code, city,
    province, lat, lon, unit_key, t_city || '|' || province AS city_key,
    concat_ws('|', nullif(t_name, ''), nullif(t_kind, ''), nullif(t_dir, '')) AS street_key,
    t_civic || '|' || t_name || '|' || t_kind || '|' || t_dir || '|' || t_city || '|' || province AS search_key,
    TRY_CAST(nullif(regexp_extract(civic_number, '^[0-9]+'), '') AS BIGINT) AS civic_value
  FROM addr_tok)
"""

POSTAL = """
postal_c AS (
  SELECT province, postal_code, avg(lat) AS lat, avg(lon) AS lon, count(*) AS address_count
  FROM addr WHERE postal_code <> '' GROUP BY ALL)
"""
CITY = """
city_c AS (
  SELECT province, city_key, arg_max(city, id) AS city, avg(lat) AS lat, avg(lon) AS lon, count(*) AS address_count
  FROM addr GROUP BY province, city_key)
"""
STREET = """
street_c AS (
  SELECT province, city_key, street_key, min(civic_value) AS min_civic, max(civic_value) AS max_civic,
    avg(lat) AS lat, avg(lon) AS lon, count(*) AS address_count
  FROM addr GROUP BY province, city_key, street_key)
"""


def completed(x: str) -> str:
    words = "|".join(vocab.COMPLETION_STOP_WORDS)
    return (
        f"CASE WHEN NOT regexp_matches(trim({x}), '(?i)\\b({words})\\b') "
        f"AND regexp_matches(trim({x}), '^[0-9]+\\s+\\S') THEN trim({x}) || ' Ave' ELSE trim({x}) END"
    )


def parse_ctes(source: str, column: str, key: str, out: str) -> str:
    """CTE chain that splits a free-form address; the last one is named ``out``.

    ``out`` has (key, civic, name, kind, dir, unit) with '' for absent parts.
    """
    shapes = [
        ("(?i)^(.+?),\\s*Unit\\s+#?\\s*(\\S+)\\s*$", "2", ["1"], True),
        ("(?i)^(.+?)\\s+UNIT\\s+(\\S+)\\s*$", "2", ["1"], False),
        ("(?i)^Unit\\s+(\\S+)\\s*,?\\s+(.+)$", "1", ["2"], True),
        ("(?i)^(\\d+)\\s+Unit\\s+(\\S+)\\s+(.+)$", "2", ["1", "3"], False),
        ("^(\\d+)-(\\d+)\\s+(.+)$", "1", ["2", "3"], False),
    ]
    parts = [f"{out}_0 AS (SELECT {key}, trim(coalesce({column}, '')) AS rest, '' AS unit FROM {source})"]
    for i, (pattern, unit_group, rest_groups, strip) in enumerate(shapes, 1):
        unit = f"regexp_extract(rest, '{pattern}', {unit_group})"
        if strip:
            unit = f"regexp_replace({unit}, '[,;]+$', '')"
        rest = " || ' ' || ".join(f"regexp_extract(rest, '{pattern}', {g})" for g in rest_groups)
        parts.append(
            f"{out}_{i} AS (SELECT {key}, CASE WHEN regexp_matches(rest, '{pattern}') THEN trim({rest}) ELSE rest END AS rest, "
            f"CASE WHEN regexp_matches(rest, '{pattern}') THEN {unit} ELSE unit END AS unit FROM {out}_{i - 1})"
        )
    civic = "^(\\d+[A-Za-z]?(?:\\s+\\d+/\\d+)?)\\s+(.+)$"
    parts.append(
        f"{out}_c AS (SELECT {key}, unit, rest, regexp_extract(rest, '{civic}', 1) AS civic, "
        f"trim(regexp_extract(rest, '{civic}', 2)) AS tail, "
        f"regexp_split_to_array(trim(regexp_extract(rest, '{civic}', 2)), '\\s+') AS w FROM {out}_5)"
    )
    parts.append(
        f"{out}_w AS (SELECT *, upper(w[-1]) AS l1, CASE WHEN len(w) > 1 THEN upper(w[-2]) ELSE '' END AS l2 FROM {out}_c)"
    )
    dirs = in_list("l1", list(vocab.STREET_DIRECTION))
    types = f"({in_list('l1', vocab.STREET_TYPE_TOKENS)} OR {in_list('l2', vocab.STREET_TYPE_TOKENS)})"
    parts.append(
        f"{out} AS (SELECT {key}, civic, "
        f"CASE WHEN civic = '' THEN rest WHEN {dirs} THEN CASE WHEN len(w) > 2 THEN array_to_string(w[1:len(w)-2], ' ') ELSE w[1] END "
        f"WHEN {types} THEN array_to_string(w[1:len(w)-1], ' ') ELSE tail END AS name, "
        f"CASE WHEN civic = '' THEN '' WHEN {dirs} THEN CASE WHEN len(w) > 2 THEN {kind('l2')} ELSE '' END "
        f"WHEN {types} THEN {kind('l1')} ELSE '' END AS kind, "
        f"CASE WHEN civic <> '' AND {dirs} THEN {direction('l1')} ELSE '' END AS dir, unit FROM {out}_w)"
    )
    return ",\n".join(parts)


def spelling_ctes(source: str, city: str, prov: str, out: str) -> str:
    """``out``(city, prov, token, rank): spellings of each distinct (city, prov) of ``source``."""
    unions = [f"SELECT c, p, c AS token, 0 AS rank FROM {out}_d"]
    for key, names in vocab.CITY_ALIASES.items():
        for i, name in enumerate(names):
            unions.append(
                f"SELECT c, p, {q(name)}, {1 + i} FROM {out}_d WHERE c || '|' || coalesce(p, '') = {q(key)}"
            )
    for i, prefix in enumerate(vocab.ADMIN_PREFIXES):
        unions.append(f"SELECT c, p, {q(prefix + ' ')} || c, {20 + i} FROM {out}_d")
    for i, prefix in enumerate(vocab.ADMIN_PREFIXES):
        cut = f"trim(substr(c, {len(prefix) + 2}))"
        cond = f"starts_with(c, {q(prefix + ' ')})"
        unions.append(f"SELECT c, p, {cut}, {40 + 20 * i} FROM {out}_d WHERE {cond} AND {cut} <> ''")
        for key, names in vocab.CITY_ALIASES.items():
            for k, name in enumerate(names):
                unions.append(
                    f"SELECT c, p, {q(name)}, {41 + 20 * i + k} FROM {out}_d "
                    f"WHERE {cond} AND {cut} || '|' || coalesce(p, '') = {q(key)}"
                )
    return (
        f"{out}_d AS (SELECT DISTINCT {city} AS c, {prov} AS p FROM {source} WHERE {city} <> ''),\n"
        f"{out} AS (SELECT c, p, token, min(rank) AS rank FROM ({' UNION ALL '.join(unions)}) GROUP BY c, p, token)"
    )


def requests_parsed(source: str, key: str, provinces: list[str]) -> str:
    """CTEs ending in ``pq``: parsed requests with tokens, plus ``rd``: their ranked readings."""
    return f"""
{parse_ctes(f"(SELECT *, {completed('address')} AS full_address FROM {source})", 'full_address', key, 'px')},
{parse_ctes(source, 'address', key, 'pr')},
pq AS (
  SELECT s.*, {tok('s.city')} AS q_city, {province('s.state')} AS q_prov, {postal('s.postal')} AS q_postal,
    coalesce({province('s.state')}, {q(provinces[0])}) AS key_prov,
    px.civic AS civic, {tok('px.name')} AS name, px.kind AS kind, px.dir AS dir,
    {tok("regexp_replace(px.unit, '^#', '')")} AS q_unit,
    {tok('pr.name')} AS r_name, pr.kind AS r_kind, pr.dir AS r_dir,
    upper(trim(px.civic)) AS civic_raw,
    CASE WHEN regexp_matches(upper(trim(px.civic)), '^\\d+(\\s+\\d+/\\d+)?[A-Z]?$')
      THEN TRY_CAST(regexp_extract(px.civic, '^\\s*(\\d+)', 1) AS BIGINT) END AS civic_num
  FROM {source} s JOIN px USING ({key}) JOIN pr USING ({key})),
rd_list AS (
  SELECT {key}, 1 AS rank, name, kind, dir FROM pq
  UNION ALL SELECT {key}, 2, r_name, r_kind, r_dir FROM pq
  UNION ALL SELECT {key}, 3, r_name || ' ' || r_kind, '', r_dir FROM pq WHERE r_name <> '' AND r_kind <> ''),
rd_all AS (
  SELECT * FROM rd_list
  UNION ALL SELECT {key}, rank + 3, substr(name, 5), kind, dir FROM rd_list WHERE starts_with(name, 'THE ')),
rd AS (SELECT {key}, name, kind, dir, min(rank) AS rank FROM rd_all GROUP BY {key}, name, kind, dir)"""


def cascade_ctes(source: str, key: str, provinces: list[str], hints: bool = False) -> str:
    """CTEs from requests to ``geo``(key, method, confidence, id, lon, lat, city, ..., error_code)."""
    provs = in_list("q_prov", provinces)
    hint_lat = "lat" if hints else "CAST(NULL AS DOUBLE)"
    hint_lon = "lon" if hints else "CAST(NULL AS DOUBLE)"
    variants = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(vocab.DEFAULT_STREET_TYPES))
    return f"""
{requests_parsed(source, key, provinces)},
{spelling_ctes('pq', 'q_city', 'key_prov', 'sp')},
judged AS (
  SELECT *, {hint_lat} AS hint_lat, {hint_lon} AS hint_lon,
    CASE WHEN (name <> '' OR civic <> '') AND q_city = '' AND q_prov IS NULL AND q_postal IS NULL THEN 'AMBIGUOUS_LOCATION'
      WHEN q_prov IS NOT NULL AND NOT {provs} THEN 'PROVINCE_NOT_LOADED' END AS early
  FROM pq),
valid AS (SELECT * FROM judged WHERE early IS NULL),
vspell AS (
  SELECT v.{key}, sp.token, sp.rank AS city_rank FROM valid v JOIN sp ON sp.c = v.q_city AND sp.p = v.key_prov
  UNION ALL SELECT {key}, '', 0 FROM valid WHERE q_city = ''),
exact_all AS (
  SELECT v.{key}, s.city_rank, rd.rank AS reading_rank, a.*
  FROM valid v JOIN vspell s USING ({key}) JOIN rd USING ({key})
  JOIN addr a ON a.search_key = {tok('v.civic')} || '|' || rd.name || '|' || rd.kind || '|' || rd.dir || '|' || s.token || '|' || v.key_prov
    AND (v.q_unit = '' OR a.unit_key = v.q_unit)),
exact_best AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY city_rank, reading_rank, unit <> '', id) AS rn FROM exact_all),
exact_n AS (SELECT {key}, count(DISTINCT city) AS n_cities FROM exact_all GROUP BY {key}),
exact_hit AS (
  SELECT b.*, CASE WHEN b.city_rank > 0 AND n.n_cities > 1 THEN 'AMBIGUOUS_LOCATION' END AS err
  FROM exact_best b JOIN exact_n n USING ({key}) WHERE rn = 1),
rest AS (SELECT v.* FROM valid v WHERE {key} NOT IN (SELECT {key} FROM exact_hit)),
tried AS (
  SELECT r.{key}, r.q_unit, r.civic_raw, r.civic_num, s.city_rank, t.i AS type_rank, t.kind AS try_kind,
    s.token || '|' || r.key_prov AS city_key,
    concat_ws('|', r.name, nullif(t.kind, ''), nullif(r.dir, '')) AS street_key
  FROM rest r JOIN vspell s USING ({key})
  JOIN LATERAL (SELECT 0 AS i, r.kind AS kind WHERE r.kind <> ''
    UNION ALL SELECT i, kind FROM (VALUES {variants}) d(i, kind) WHERE r.kind = '') t ON true
  WHERE r.q_city <> '' AND r.name <> ''),
street_all AS (
  SELECT t.{key}, 0 AS choice, t.city_rank, t.type_rank, CAST(0 AS BIGINT) AS off, a.id
  FROM tried t JOIN addr a ON a.city_key = t.city_key AND a.street_key = t.street_key AND a.civic_number = t.civic_raw
    AND (t.q_unit = '' OR a.unit_key = t.q_unit)
  WHERE t.civic_num IS NOT NULL
  UNION ALL
  SELECT t.{key}, 1, t.city_rank, t.type_rank, abs(n.v - t.civic_num), n.id
  FROM tried t JOIN (SELECT city_key, street_key, coalesce(civic_value, 0) AS v, min(id) AS id FROM addr GROUP BY ALL) n
    ON n.city_key = t.city_key AND n.street_key = t.street_key
  WHERE t.civic_num IS NOT NULL AND t.q_unit = ''),
street_best AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY choice, city_rank, type_rank, off, id) AS rn FROM street_all),
middle_all AS (
  SELECT t.{key}, c.lat, c.lon, c.province,
    row_number() OVER (PARTITION BY t.{key} ORDER BY t.city_rank, t.type_rank) AS rn
  FROM tried t JOIN street_c c ON c.city_key = t.city_key AND c.street_key = t.street_key
  WHERE t.civic_num IS NULL),
postal_all AS (
  SELECT r.{key}, c.lat, c.lon, c.province, c.postal_code,
    row_number() OVER (PARTITION BY r.{key} ORDER BY c.province) AS rn
  FROM rest r JOIN postal_c c ON c.postal_code = r.q_postal AND (r.q_prov IS NULL OR c.province = r.q_prov)
  WHERE {in_list('c.province', provinces)}),
postal_hit AS (
  SELECT p.* FROM postal_all p JOIN rest r USING ({key})
  WHERE rn = 1 AND (r.hint_lat IS NULL OR r.hint_lon IS NULL
    OR {haversine('r.hint_lon', 'r.hint_lat', 'p.lon', 'p.lat')} <= 5000)),
steps AS (
  SELECT {key}, 0 AS step, CAST(NULL AS VARCHAR) AS method, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS BIGINT) AS id,
    CAST(NULL AS DOUBLE) AS to_lat, CAST(NULL AS DOUBLE) AS to_lon, early AS err FROM judged WHERE early IS NOT NULL
  UNION ALL SELECT {key}, 1, 'exact', 1.0, id, lat, lon, err FROM exact_hit
  UNION ALL SELECT s.{key}, 2, 'street_interpolated', 0.75, a.id, a.lat, a.lon, NULL
    FROM street_best s JOIN addr a USING (id) WHERE rn = 1
  UNION ALL SELECT {key}, 2, 'street_interpolated', 0.75, 0, lat, lon, NULL FROM middle_all WHERE rn = 1
  UNION ALL SELECT {key}, 3, 'postal_centroid', 0.85, 0, lat, lon, NULL FROM postal_hit
  UNION ALL SELECT {key}, 9, NULL, NULL, NULL, NULL, NULL, 'ADDRESS_NOT_FOUND' FROM judged),
geo AS (
  SELECT {key}, CASE WHEN err IS NULL THEN method END AS method, CASE WHEN err IS NULL THEN confidence END AS confidence,
    CASE WHEN err IS NULL THEN id END AS id, CASE WHEN err IS NULL THEN to_lat END AS to_lat,
    CASE WHEN err IS NULL THEN to_lon END AS to_lon, err AS error_code
  FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY step) AS rn FROM steps) WHERE rn = 1)"""


def contains_ctes(points: str, vertices: str, out: str) -> str:
    """``out``(pid, ordinal): every boundary that holds each point, by summing over edges.

    ``points`` has (pid, lon, lat), ``vertices`` (ordinal, part, ring, v, lon, lat).
    """
    return f"""
{out}_e AS (
  SELECT ordinal, part, ring, lon AS x1, lat AS y1,
    coalesce(lag(lon) OVER w, last_value(lon) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS x2,
    coalesce(lag(lat) OVER w, last_value(lat) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS y2
  FROM {vertices} WINDOW w AS (PARTITION BY ordinal, part, ring ORDER BY v)),
{out}_b AS (SELECT ordinal, min(lon) AS bx0, max(lon) AS bx1, min(lat) AS by0, max(lat) AS by1 FROM {vertices} GROUP BY ordinal),
{out}_r AS (
  SELECT p.pid, e.ordinal, e.part, e.ring,
    bool_or(p.lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND p.lat BETWEEN least(y1, y2) AND greatest(y1, y2)
      AND abs((p.lat - y1) * (x2 - x1) - (p.lon - x1) * (y2 - y1)) < 1e-10)
    OR sum(CASE WHEN (y1 > p.lat) <> (y2 > p.lat) AND p.lon < (x2 - x1) * (p.lat - y1) / (y2 - y1 + 1e-10) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS hit
  FROM {points} p JOIN {out}_b b ON p.lon BETWEEN bx0 AND bx1 AND p.lat BETWEEN by0 AND by1
  JOIN {out}_e e ON e.ordinal = b.ordinal
  GROUP BY ALL),
{out}_p AS (
  SELECT pid, ordinal, part, bool_or(ring = 0 AND hit) AND NOT bool_or(ring > 0 AND hit) AS hit FROM {out}_r GROUP BY ALL),
{out} AS (SELECT DISTINCT pid, ordinal FROM {out}_p WHERE hit)"""
