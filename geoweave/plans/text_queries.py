"""Text, rule and provider queries over the derived addresses and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import rules, text, vocab
from geoweave.functions.mailing import mailing_address
from geoweave.operators import providers
from geoweave.operators.parse import parse_address, parse_requests, standardize_addresses, street_readings
from geoweave.plans import oracle_parts as O
from geoweave.plans.registry import query
from geoweave.sources import derived


def _number(x: str) -> str:
    """DuckDB text of a coordinate rounded half up to 5 places."""
    shown = f"printf('%.5f', floor({x} * 100000 + 0.5) / 100000)"
    return f"regexp_replace(regexp_replace({shown}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


@query("normalize_tokens", f"""
WITH addr_raw AS ({O.ADDR_RAW})
SELECT id, {O.fold('street_name')} AS folded, {O.tok('city')} AS city_token, {O.kind('street_type')} AS kind,
  {O.direction('street_direction')} AS dir, {O.postal('postal_code')} AS postal, {O.province('province')} AS prov,
  {O.tok("regexp_replace('#' || unit, '^#', '')")} AS unit,
  lower(trim(regexp_replace(regexp_replace(street_name, '-', '—', 'g'), '\\s+', ' ', 'g'))) AS compared
FROM addr_raw""")
def normalize_tokens(spark, sf_dir):
    """TX1-TX6, TX15, TX22."""
    c = F.col
    return derived.addresses(spark, sf_dir).select(
        "id",
        text.fold_accents(c("street_name")).alias("folded"),
        text.search_token(c("city")).alias("city_token"),
        text.street_type(c("street_type")).alias("kind"),
        text.street_direction(c("street_direction")).alias("dir"),
        text.postal_code(c("postal_code")).alias("postal"),
        text.province_code(c("province")).alias("prov"),
        text.normalize_unit(F.concat(F.lit("#"), c("unit"))).alias("unit"),
        text.comparison_name(c("street_name")).alias("compared"),
    )


@query("parse_address", f"""
WITH addr_raw AS ({O.ADDR_RAW}), requests AS ({O.REQUESTS}),
{O.parse_ctes('requests', 'address', 'req_id', 'p')}
SELECT req_id, civic, name, kind, dir, unit,
  CASE WHEN regexp_matches(upper(civic), '^\\d+(\\s+\\d+/\\d+)?[A-Z]?$') THEN TRY_CAST(regexp_extract(civic, '^\\d+') AS BIGINT) END AS civic_num,
  CASE WHEN civic <> '' THEN CASE WHEN regexp_matches(upper(civic), '^\\d+(\\s+\\d+/\\d+)?[A-Z]?$') THEN regexp_extract(upper(civic), '[A-Z]?$') ELSE '' END END AS suffix
FROM p""")
def parse_address_query(spark, sf_dir):
    """TX7-TX9."""
    parsed = parse_address(derived.requests(spark, sf_dir), "address", "p_")
    civic = text.civic_parts(F.col("p_civic"))
    return parsed.select(
        "req_id", F.col("p_civic").alias("civic"), F.col("p_name").alias("name"),
        F.col("p_type").alias("kind"), F.col("p_direction").alias("dir"),
        F.col("p_unit").alias("unit"), civic["numeric"].alias("civic_num"),
        civic["suffix"].alias("suffix"),
    )


@query("completed_address", f"""
WITH addr_raw AS ({O.ADDR_RAW}), requests AS ({O.REQUESTS})
SELECT req_id, {O.completed('address')} AS completed FROM requests""")
def completed_address(spark, sf_dir):
    """TX10."""
    return derived.requests(spark, sf_dir).select(
        "req_id", text.complete_street_type(F.col("address")).alias("completed")
    )


_TYPES, _DIRS = vocab.STREET_TYPE_VALUES, vocab.STREET_DIRECTION_VALUES


@query("address_keys", f"""
WITH {O.ADDR},
parts AS (SELECT id, city_key, street_key, search_key, string_split(street_key, '|') AS p FROM addr),
d AS (SELECT *, len(p) > 1 AND {O.in_list('p[-1]', _DIRS)} AS has_dir FROM parts),
t AS (SELECT *, CASE WHEN has_dir THEN p[1:len(p)-1] ELSE p END AS p2 FROM d),
u AS (SELECT *, len(p2) > 1 AND {O.in_list('p2[-1]', _TYPES)} AS has_type FROM t),
v AS (
  SELECT *, array_to_string(CASE WHEN has_type THEN p2[1:len(p2)-1] ELSE p2 END, ' ') AS name,
    CASE WHEN has_type THEN p2[-1] ELSE '' END AS kind, CASE WHEN has_dir THEN p[-1] ELSE '' END AS dir FROM u),
w AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS i, upper(substr(piece, 1, 1)) || lower(substr(piece, 2)) AS piece
  FROM (SELECT id, unnest(regexp_extract_all(name || ' ' || kind, '[^ /-]*[ /-]?')) AS piece,
    generate_subscripts(regexp_extract_all(name || ' ' || kind, '[^ /-]*[ /-]?'), 1) AS i FROM v)),
x AS (SELECT id, trim(string_agg(piece, '' ORDER BY i)) AS titled FROM w GROUP BY id)
SELECT v.id, city_key, street_key, search_key, name, kind, dir, concat_ws(' ', nullif(titled, ''), nullif(dir, '')) AS label
FROM v JOIN x USING (id)""")
def address_keys(spark, sf_dir):
    """TX11-TX13."""
    addr = standardize_addresses(derived.addresses(spark, sf_dir))
    parts = text.street_key_parts(F.col("street_key"))
    return addr.select(
        "id", "city_key", "street_key", "search_key", parts["name"].alias("name"),
        parts["type"].alias("kind"), parts["direction"].alias("dir"),
        text.street_label(F.col("street_key")).alias("label"),
    )


@query("mailing_lines", f"""
WITH addr_raw AS ({O.ADDR_RAW}),
m AS (
  SELECT id, trim(regexp_replace(concat_ws(' ', nullif({O.fold('civic_number')}, ''), nullif({O.fold('street_name')}, ''),
      nullif({O.case_map("regexp_replace(" + O.fold('street_type') + ", '[^A-Z]', '', 'g')", vocab.STREET_TYPE_CANONICAL, "regexp_replace(" + O.fold('street_type') + ", '[^A-Z]', '', 'g')")}, ''),
      nullif({O.direction('street_direction')}, '')), '\\s+', ' ', 'g')) AS street,
    CASE WHEN unit <> '' THEN 'UNIT ' || unit END AS unit_line, {O.fold('city')} AS town, province, {O.postal('postal_code')} AS code
  FROM addr_raw)
SELECT id, coalesce(unit_line, street) AS line1, CASE WHEN unit_line IS NOT NULL THEN street END AS line2, town, code AS postal,
  concat_ws(', ', coalesce(unit_line, street), CASE WHEN unit_line IS NOT NULL THEN street END, town || ' ' || province, code, 'CANADA') AS single_line,
  concat_ws(chr(10), coalesce(unit_line, street), CASE WHEN unit_line IS NOT NULL THEN street END,
    concat_ws('  ', town, province, code), 'CANADA') AS multi_line
FROM m""")
def mailing_lines(spark, sf_dir):
    """TX14."""
    c = F.col
    m = mailing_address(
        c("civic_number"), c("street_name"), c("street_type"), c("street_direction"), c("unit"),
        c("city"), c("province"), c("postal_code"),
    )
    return derived.addresses(spark, sf_dir).withColumn("m", m).select(
        "id", "m.line1", "m.line2", c("m.municipality").alias("town"),
        c("m.postal_code").alias("postal"), "m.single_line", "m.multi_line",
    )


@query("city_candidates", f"""
WITH faulty AS ({O.FAULTY}),
f AS (SELECT req_id, {O.tok('city')} AS c0, {O.province('state')} AS p0 FROM faulty),
{O.spelling_ctes('f', 'c0', 'p0', 'sp')}
SELECT req_id, token, row_number() OVER (PARTITION BY req_id ORDER BY rank) - 1 AS rank
FROM f JOIN sp ON sp.c = f.c0 AND sp.p IS NOT DISTINCT FROM f.p0""")
def city_candidates(spark, sf_dir):
    """TX16: one row per spelling."""
    names = derived.faulty_requests(spark, sf_dir).select(
        "req_id", text.search_token(F.col("city")).alias("c"),
        text.province_code(F.col("state")).alias("p"),
    )
    return names.select(
        "req_id", F.posexplode(text.city_candidates(F.col("c"), F.col("p"))).alias("rank", "token")
    ).withColumn("rank", F.col("rank").cast("bigint"))


@query("street_readings", f"""
WITH addr_raw AS ({O.ADDR_RAW}), requests AS ({O.REQUESTS}), {O.requests_parsed('requests', 'req_id', ['ON'])}
SELECT req_id, name, kind, dir, row_number() OVER (PARTITION BY req_id ORDER BY rank) - 1 AS rank FROM rd""")
def street_readings_query(spark, sf_dir):
    """TX17: one row per reading."""
    parsed = parse_requests(derived.requests(spark, sf_dir))
    return parsed.select("req_id", F.posexplode(street_readings()).alias("rank", "r")).select(
        "req_id", "r.name", F.col("r.type").alias("kind"), F.col("r.direction").alias("dir"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query("sanitized_text", """
SELECT doc_id, md5(nullif(substr(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), 1, 500), '')) AS digest
FROM documents""")
def sanitized_text(spark, sf_dir):
    """TX18: the cut at 500 characters is the rule itself."""
    docs = derived.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.sanitize(F.col("text"), 500)).alias("digest"))


@query("lookup_keys", f"""
WITH faulty AS ({O.FAULTY}),
n AS (
  SELECT *, nullif(trim(regexp_replace(lower(address), '\\s+', ' ', 'g')), '') AS a, nullif(trim(regexp_replace(lower(city), '\\s+', ' ', 'g')), '') AS c,
    nullif(lower(trim(state)), '') AS s, nullif(lower(trim(country)), '') AS k,
    CASE path WHEN '/api/qc' THEN 'quebecridings-2025' WHEN '/api/on' THEN 'ontarioridings-2022' ELSE 'federalridings-2024' END AS ds FROM faulty)
SELECT req_id, 'lookup:v2:' || ds || ':' || CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'coordinate:' || {_number('lon')} || ',' || {_number('lat')}
    WHEN postal <> '' THEN 'postal:' || regexp_replace(lower(postal), '\\s+', '', 'g')
    WHEN address <> '' THEN 'address:' || concat_ws(' ', a, c, s, k)
    ELSE 'query:' || coalesce(nullif(concat_ws(' ', c, s, k), ''), 'unknown') END || ':' || path AS lookup_key,
  'geocoding:v2:geogratis:{{"address":"' || lower(trim(address)) || '","postal":"' || regexp_replace(lower(trim(postal)), '\\s+', '', 'g')
    || '","city":"' || lower(trim(city)) || '","state":"' || lower(trim(state)) || '","country":"' || lower(trim(country)) || '"}}' AS geocode_key,
  CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'reverse:google:' || {_number('lat')} || ',' || {_number('lon')} END AS reverse_key,
  'suggest:v1:' || {O.tok('address')} || ':ON,QC:7:::' || CASE WHEN lat IS NOT NULL AND lon IS NOT NULL
    THEN printf('%.2f', floor(lat * 100 + 0.5) / 100) || ',' || printf('%.2f', floor(lon * 100 + 0.5) / 100) ELSE '' END || ':' AS search_key
FROM n""")
def lookup_keys(spark, sf_dir):
    """TX20, TX21."""
    c = F.col
    both = c("lat").isNotNull() & c("lon").isNotNull()
    return derived.faulty_requests(spark, sf_dir).select(
        "req_id",
        rules.lookup_key(*[c(n) for n in ("path", "address", "postal", "city", "state", "country", "lat", "lon")]).alias("lookup_key"),
        rules.geocode_key(F.lit("geogratis"), *[c(n) for n in ("address", "postal", "city", "state", "country")]).alias("geocode_key"),
        F.when(both, rules.reverse_key(c("lat"), c("lon"))).alias("reverse_key"),
        rules.search_cache_key(
            c("address"), F.array(F.lit("QC"), F.lit("ON")), F.lit(7), c("lat"), c("lon")
        ).alias("search_key"),
    )


@query("query_rules", f"""
WITH faulty AS ({O.FAULTY}),
r AS (
  SELECT *, CASE WHEN postal <> '' AND {O.postal('postal')} IS NULL THEN {O.q(vocab.MSG_POSTAL)} END AS e1,
    CASE WHEN lat IS NULL AND lon IS NULL THEN NULL WHEN lat IS NULL OR lon IS NULL THEN {O.q(vocab.MSG_COORD_PAIR)}
      WHEN abs(lat) > 90 THEN {O.q(vocab.MSG_LAT_RANGE)} WHEN abs(lon) > 180 THEN {O.q(vocab.MSG_LON_RANGE)} END AS e2,
    CASE WHEN return_raw LIKE 'colour%' THEN 'Unknown return field: colour. Supported: municipality' END AS e3,
    CASE WHEN include_raw = 'maybe' THEN {O.q(vocab.MSG_INCLUDE_PROVINCE)} END AS e4,
    CASE WHEN method_raw = 'nearest' THEN {O.q(vocab.MSG_GEOCODE_METHOD)} END AS e5,
    CASE WHEN trim(address) = '' AND postal = '' AND trim(city) = '' AND state = '' AND country = '' AND (lat IS NULL OR lon IS NULL)
      THEN {O.q(vocab.MSG_NO_LOCATION)} END AS e6,
    CASE lower(trim(include_raw)) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'no' THEN false END AS flag FROM faulty)
SELECT req_id, coalesce(e2, '') AS coordinate_error, coalesce(e1, e2, e3, e4, e5, e6) AS query_error,
  CASE WHEN NOT starts_with(path, '/api') THEN 'pathname must start with /api'
    WHEN NOT ((lat IS NOT NULL AND lon IS NOT NULL) OR postal <> '' OR address <> '') THEN {O.q(vocab.MSG_BATCH_QUERY)} END AS batch_error,
  coalesce(flag, CASE WHEN return_raw IS NOT NULL THEN false ELSE path = '/api/combined' END) AS include_province,
  CASE WHEN coalesce(method_raw, '') IN ('', 'auto') THEN 'auto' WHEN method_raw = ' Postal_Centroid ' THEN 'postal_centroid' END AS geocode_method,
  CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'coordinates' WHEN postal <> '' THEN 'postal' WHEN address <> '' THEN 'address' ELSE 'mixed' END AS query_class,
  postal <> '' AND address = '' AS postal_only,
  postal <> '' AND coalesce(method_raw, '') = ' Postal_Centroid ' AS centroid_only,
  CASE WHEN pinned IS NOT NULL AND NOT (CASE path WHEN '/api/qc' THEN pinned IN ('quebecridings-2025.geojson', '2025')
    WHEN '/api/on' THEN pinned IN ('ontarioridings-2022.geojson', '2022') ELSE pinned IN ('federalridings-2024.geojson', '2024') END)
    THEN 'DATASET_UNAVAILABLE' END AS pin_error
FROM r""")
def query_rules(spark, sf_dir):
    """VA1-VA7."""
    c = F.col
    df = derived.faulty_requests(spark, sf_dir)
    flag = rules.include_province_flag(c("include_raw"))
    method = rules.geocode_method(c("method_raw"))
    fields = ("address", "postal", "city", "state", "country", "lat", "lon", "return_raw", "include_raw", "method_raw")
    return df.select(
        "req_id",
        F.coalesce(rules.coordinate_error(c("lat"), c("lon")), F.lit("")).alias("coordinate_error"),
        rules.query_error(*[c(f) for f in fields]).alias("query_error"),
        rules.batch_row_error(
            c("req_id").cast("string"), c("path"), c("address"), c("postal"), c("lat"), c("lon")
        ).alias("batch_error"),
        rules.include_province_default(c("path"), flag, c("return_raw").isNotNull()).alias("include_province"),
        method.alias("geocode_method"),
        rules.query_class(c("address"), c("postal"), c("lat"), c("lon")).alias("query_class"),
        rules.is_postal_only(c("address"), c("postal")).alias("postal_only"),
        rules.wants_postal_centroid(c("postal"), method).alias("centroid_only"),
        rules.pin_error(c("path"), c("pinned")).alias("pin_error"),
    )


def _matches(title: str, state: str, city: str) -> str:
    code = f"coalesce({O.province(state)}, upper(trim({state})))"
    name = O.case_map(code, vocab.PROVINCE_DISPLAY_NAME, "NULL")
    checks = " OR ".join(
        f"((length({t}) > 2 OR regexp_matches({t}, '^[A-Z][A-Z]$')) AND contains(upper({title}), {t}))"
        for t in (code, f"upper({name})", O.tok(state), O.tok(city))
    )
    return (
        f"({title} <> '' AND ({state} = '' OR coalesce({checks}, false)) "
        f"AND ({city} = '' OR ({O.tok(city)} <> '' AND contains(upper({title}), {O.tok(city)}))))"
    )


_CANDS = f"""
WITH addr_raw AS ({O.ADDR_RAW}), requests AS ({O.REQUESTS}), cands AS ({O.CANDIDATES}),
full_req AS (SELECT *, {O.completed('address')} AS completed FROM requests),
words AS (
  SELECT req_id, {O.tok('w')} AS w FROM (
    SELECT req_id, unnest(regexp_split_to_array(regexp_replace(completed, '^[0-9]+\\s*', ''), '\\s+')) AS w FROM full_req)),
hits AS (
  SELECT c.req_id, c.pos, count(*) AS n FROM cands c JOIN words w USING (req_id)
  WHERE length(w.w) > 2 AND contains(upper(c.title), w.w) GROUP BY ALL),
judged AS (
  SELECT c.*, (r.city <> '' OR r.state <> '') AND {_matches('c.title', 'r.state', 'r.city')} AS regional,
    CASE WHEN regexp_extract(trim(r.address), '^[0-9]+') <> '' AND contains(upper(c.title), regexp_extract(trim(r.address), '^[0-9]+')) THEN 20 ELSE 0 END
    + 5 * coalesce(h.n, 0) + CASE WHEN qualifier = 'INTERPOLATED_POSITION' THEN 2 ELSE 0 END
    - CASE WHEN upper(c.title) LIKE '%HIGHWAY%' OR upper(c.title) LIKE '%ROUTE%' THEN 10 ELSE 0 END AS points
  FROM cands c JOIN requests r USING (req_id) LEFT JOIN hits h ON h.req_id = c.req_id AND h.pos = c.pos),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY regional DESC, CASE WHEN regional THEN -points ELSE 0 END, pos) AS rn FROM judged),
picked AS (SELECT * FROM ranked WHERE rn = 1)"""


@query("region_match", f"{_CANDS} SELECT c.req_id, c.pos, {_matches('c.title', 'r.state', 'r.city')} AS matched FROM cands c JOIN requests r USING (req_id)")
def region_match(spark, sf_dir):
    """VA8."""
    cands = derived.provider_candidates(spark, sf_dir)
    asked = derived.requests(spark, sf_dir).select("req_id", "state", "city")
    return cands.join(asked, "req_id").select(
        "req_id", "pos",
        rules.region_match(F.col("title"), F.col("state"), F.col("city")).alias("matched"),
    )


@query("provider_choice", f"{_CANDS} SELECT req_id, pos, title, qualifier, score, lon, lat FROM picked")
def provider_choice(spark, sf_dir):
    """GC15."""
    return providers.select_candidates(
        derived.provider_candidates(spark, sf_dir), derived.requests(spark, sf_dir)
    )


@query("provider_precedence", f"""{_CANDS},
j AS (
  SELECT r.req_id, r.city, r.state, p.lon AS plon, p.lat AS plat, p.qualifier, p.score, a.lon AS llon, a.lat AS llat, f.lon AS flon, f.lat AS flat
  FROM requests r LEFT JOIN picked p USING (req_id)
  LEFT JOIN (SELECT id, lon, lat FROM addr_raw WHERE id % 3 = 0) a ON a.id = r.req_id
  LEFT JOIN (SELECT id, lon, lat FROM addr_raw WHERE id % 2 = 0) f ON f.id = r.req_id),
k AS (SELECT *, CASE WHEN llon IS NOT NULL THEN 'local' WHEN plon IS NOT NULL AND (qualifier <> 'INTERPOLATED_POSITION' OR city <> '' OR state <> '')
  AND score >= 0.5 THEN 'first' WHEN flon IS NOT NULL THEN 'fallback' END AS source FROM j)
SELECT req_id, source, CASE source WHEN 'local' THEN llon WHEN 'first' THEN plon WHEN 'fallback' THEN flon END AS lon,
  CASE source WHEN 'local' THEN llat WHEN 'first' THEN plat WHEN 'fallback' THEN flat END AS lat FROM k""")
def provider_precedence(spark, sf_dir):
    """GC16: a local table with every third address stands for results found locally."""
    reqs = derived.requests(spark, sf_dir)
    addr = derived.addresses(spark, sf_dir).select(F.col("id").alias("req_id"), "lon", "lat")
    first = providers.select_candidates(derived.provider_candidates(spark, sf_dir), reqs)
    return providers.provider_precedence(
        reqs, addr.where("req_id % 3 = 0"), first, addr.where("req_id % 2 = 0")
    ).select("req_id", "source", "lon", "lat")


_RAW_JSON = """
SELECT id, CASE WHEN id % 10 = 9 THEN '{"broken": ' ELSE '{"address_components":[' ||
  CASE WHEN id % 4 = 0 THEN '' ELSE '{"long_name":"' || civic_number || '","short_name":"x","types":["street_number"]},' END ||
  '{"long_name":"","short_name":"' || street_name || '","types":["route","political"]},{"long_name":"' || city ||
  '","short_name":"c","types":["locality"]},{"long_name":"Other","types":["sublocality","locality"]}],' ||
  CASE WHEN id % 3 = 0 THEN '' ELSE '"geometry":{"location":{"lat":' || CAST(lat AS STRING) || ',"lng":-79.5}},' END ||
  '"formatted_address":"F' || CAST(id AS STRING) || '"}' END AS raw FROM {addr}
"""


@query("provider_components", f"""
WITH addr_raw AS ({O.ADDR_RAW})
SELECT id, CASE WHEN id % 10 <> 9 AND id % 4 <> 0 THEN civic_number END AS street_number,
  CASE WHEN id % 10 <> 9 THEN street_name END AS route, CASE WHEN id % 10 <> 9 THEN city END AS locality,
  CASE WHEN id % 10 <> 9 THEN 'Other' END AS neighborhood, CASE WHEN id % 10 <> 9 THEN 'F' || id END AS formatted_address,
  CASE WHEN id % 10 = 9 THEN 'malformed record' WHEN id % 3 = 0 THEN 'missing geometry.location.lat' END AS record_error
FROM addr_raw""")
def provider_components(spark, sf_dir):
    """GC17, GC18 over raw provider JSON built from the addresses."""
    addr = derived.addresses(spark, sf_dir)
    sql = _RAW_JSON.replace("{addr}", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{addr}")
    raw = spark.sql(sql, addr=addr)
    names = ["street_number", "route", "locality", "neighborhood"]
    checked = providers.validate_records(raw, "raw", "google").withColumn(
        "c", providers.address_components(F.col("raw"), names)
    )
    return checked.select("id", *[f"c.{n}" for n in names], "c.formatted_address", "record_error")
