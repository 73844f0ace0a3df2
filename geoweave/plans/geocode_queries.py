"""Geocoding queries over addresses and requests derived from the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import rules, text
from geoweave.operators import geocode as G
from geoweave.operators.aggregates import city_centroids, postal_centroids, street_ranges
from geoweave.operators.parse import standardize_addresses
from geoweave.plans import oracle_parts as O
from geoweave.plans.bulk_lookup import bulk_lookup, precompute_postal
from geoweave.plans.registry import places, query
from geoweave.plans.spatial_queries import _PATHS, boundaries, two_level
from geoweave.session import cut_lineage
from geoweave.sources import derived

PROVINCES = ["ON", "QC"]


def store(spark: SparkSession, sf_dir: str) -> G.AddressStore:
    """The standardised addresses, written once and read by every later step."""
    return G.AddressStore(cut_lineage(standardize_addresses(derived.addresses(spark, sf_dir)), "addr"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests parsed one by one, with the request id as query id."""
    none = F.lit(None).cast("double")
    reqs = requests(spark, sf_dir).withColumns({"qid": F.col("req_id"), "lat": none, "lon": none})
    return cut_lineage(G.parse_queries(reqs, PROVINCES), "parsed").where("early_error IS NULL")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.requests(spark, sf_dir)


def _flat(results: DataFrame, key: str = "req_id") -> DataFrame:
    return results.select(
        key, "method", "confidence", F.col("row.id").alias("id"),
        places("row.lat").alias("lat"), places("row.lon").alias("lon"), "error_code",
    )


_GEO_COLS = "method, confidence, id, round(to_lat + 1e-11, 9) AS lat, round(to_lon + 1e-11, 9) AS lon, error_code"
_BASE = f"WITH {O.ADDR}, {O.POSTAL}, {O.STREET}, requests AS ({O.REQUESTS})"


@query("postal_centroid", f"""
WITH {O.ADDR}, {O.POSTAL}
SELECT province, postal_code, round(lat + 1e-11, 9) AS lat, round(lon + 1e-11, 9) AS lon, address_count FROM postal_c""")
def postal_centroid(spark, sf_dir):
    """AG1."""
    c = postal_centroids(store(spark, sf_dir).addr)
    return c.withColumns({"lat": places("lat"), "lon": places("lon")})


@query("city_centroid", f"""
WITH {O.ADDR}, {O.CITY}
SELECT province, city_key, city, round(lat + 1e-11, 9) AS lat, round(lon + 1e-11, 9) AS lon, address_count FROM city_c""")
def city_centroid(spark, sf_dir):
    """AG2."""
    c = city_centroids(store(spark, sf_dir).addr)
    return c.withColumns({"lat": places("lat"), "lon": places("lon")})


@query("street_range", f"""
WITH {O.ADDR}, {O.STREET}
SELECT province, city_key, street_key, min_civic, max_civic, round(lat + 1e-11, 9) AS lat, round(lon + 1e-11, 9) AS lon, address_count
FROM street_c""")
def street_range(spark, sf_dir):
    """AG3."""
    c = street_ranges(store(spark, sf_dir).addr)
    return c.withColumns({"lat": places("lat"), "lon": places("lon")})


@query("geocode_exact", f"""
{_BASE}, {O.cascade_ctes('requests', 'req_id', PROVINCES)}
SELECT req_id, CASE WHEN err IS NULL THEN id END AS id, err AS error_code FROM exact_hit""")
def geocode_exact(spark, sf_dir):
    """GC1, GC2, TX16, TX17."""
    s = store(spark, sf_dir)
    hits = G.exact_hits(G.city_spellings(_parsed(spark, sf_dir), s), s)
    return hits.select(F.col("qid").alias("req_id"), F.col("row.id").alias("id"), "error_code")


@query("geocode_street", f"""
{_BASE}, {O.cascade_ctes('requests', 'req_id', PROVINCES)}
SELECT req_id, id, round(to_lat + 1e-11, 9) AS lat, round(to_lon + 1e-11, 9) AS lon FROM steps WHERE step = 2""")
def geocode_street(spark, sf_dir):
    """GC3, GC4 on the requests that have no exact match."""
    s = store(spark, sf_dir)
    spelled = G.city_spellings(_parsed(spark, sf_dir), s)
    exact = G.exact_hits(spelled, s)
    rest = spelled.join(exact.select("qid"), "qid", "left_anti")
    hits = G.street_hits(rest, s)
    return hits.select(
        F.col("qid").alias("req_id"), F.col("row.id").alias("id"),
        places("row.lat").alias("lat"), places("row.lon").alias("lon"),
    )


@query("geocode_cascade", f"""
{_BASE}, {O.cascade_ctes('requests', 'req_id', PROVINCES)}
SELECT req_id, {_GEO_COLS} FROM geo""")
def geocode_cascade(spark, sf_dir):
    """GC10, GC11, VA9, VA10."""
    return _flat(G.geocode(requests(spark, sf_dir), store(spark, sf_dir), PROVINCES))


@query("geocode_postal", f"""
{_BASE}, f AS (SELECT req_id, {O.postal('postal')} AS code, postal, {O.province('state')} AS prov FROM requests),
c AS (SELECT f.req_id, p.lat, p.lon, row_number() OVER (PARTITION BY req_id ORDER BY p.province) AS rn FROM f JOIN postal_c p ON p.postal_code = f.code
  AND (f.prov IS NULL OR p.province = f.prov) WHERE p.province IN ('ON', 'QC'))
SELECT f.req_id, CASE WHEN c.req_id IS NOT NULL THEN 'postal_centroid' END AS method, CASE WHEN c.req_id IS NOT NULL THEN CAST(0.85 AS DOUBLE) END AS confidence,
  CASE WHEN c.req_id IS NOT NULL THEN CAST(0 AS BIGINT) END AS id, round(lat + 1e-11, 9) AS lat, round(lon + 1e-11, 9) AS lon,
  CASE WHEN c.req_id IS NULL THEN CASE WHEN postal = '' OR code IS NULL THEN 'INVALID_QUERY' ELSE 'ADDRESS_NOT_FOUND' END END AS error_code
FROM f LEFT JOIN c ON c.req_id = f.req_id AND rn = 1""")
def geocode_postal(spark, sf_dir):
    """GC5, GC6, GC13."""
    return _flat(G.geocode_postal(requests(spark, sf_dir), store(spark, sf_dir), PROVINCES))


_LEVELS = [0.0025, 0.01, 0.05, 0.25]


def _nearest(points: str, key: str, where: str = "true", out: str = "nn") -> str:
    """Brute force: every address in the widest box, by first non-empty box, distance and id."""
    level = " ".join(
        f"WHEN a.lat BETWEEN p.lat - {w} AND p.lat + {w} AND a.lon BETWEEN p.lon - {w} AND p.lon + {w} THEN {n}"
        for n, w in enumerate(_LEVELS)
    )
    return f"""
{out}_c AS (
  SELECT p.{key}, a.id, CASE {level} END AS level, round({O.haversine('p.lon', 'p.lat', 'a.lon', 'a.lat')}, 6) AS distance
  FROM {points} p JOIN addr a ON a.lat BETWEEN p.lat - 0.25 AND p.lat + 0.25 AND a.lon BETWEEN p.lon - 0.25 AND p.lon + 0.25 AND {where}),
{out} AS (SELECT {key}, arg_min(id, (level, distance, id)) AS id, arg_min(distance, (level, distance, id)) AS distance FROM {out}_c GROUP BY {key})"""


@query("reverse_geocode", f"""
WITH {O.ADDR}, points AS ({O.POINTS}), {_nearest('points', 'pid')},
j AS (SELECT p.pid, nn.id, nn.distance, least(0.7, greatest(0.3, 1 - distance / 10000)) AS conf FROM points p LEFT JOIN nn USING (pid)),
k AS (SELECT *, CASE WHEN id IS NULL OR distance > 25000 THEN 'NO_NEARBY_ADDRESS' WHEN conf < 0.6 THEN 'LOW_CONFIDENCE_GEOCODE' END AS error_code FROM j)
SELECT pid, CASE WHEN error_code IS NULL THEN id END AS id, distance,
  CASE WHEN error_code IS NULL THEN conf END AS confidence, error_code FROM k""")
def reverse_geocode(spark, sf_dir):
    """GC12, J7."""
    out = G.reverse_geocode(derived.points(spark, sf_dir), store(spark, sf_dir))
    return out.select(
        "pid", F.col("row.id").alias("id"), "distance", "confidence", "error_code",
    )


_HINTED = f"hinted AS ({derived.HINTED_SQL.format(requests='requests')})"
_BOUNDS = (
    "(p.q_prov IS NULL OR a.province = p.q_prov) AND (p.q_city = '' OR p.q_prov IS NULL OR a.city_key = p.q_city || '|' || p.q_prov) "
    "AND (p.q_postal IS NULL OR a.postal_code = p.q_postal)"
)


@query("geocode_hinted", f"""
{_BASE}, {_HINTED}, {O.cascade_ctes('hinted', 'req_id', PROVINCES, hints=True)},
hint_points AS (SELECT r.*, r.hint_lon AS plon FROM rest r JOIN geo USING (req_id) WHERE geo.error_code = 'ADDRESS_NOT_FOUND' AND hint_lat IS NOT NULL AND hint_lon IS NOT NULL),
{_nearest('hint_points', 'req_id', _BOUNDS)},
fin AS (SELECT g.*, nn.id AS nid, nn.distance, least(0.7, greatest(0.3, 1 - nn.distance / 10000)) AS conf FROM geo g LEFT JOIN nn USING (req_id))
SELECT req_id, CASE WHEN nid IS NULL THEN method WHEN conf >= 0.6 THEN 'nearest_neighbor' END AS method,
  CASE WHEN nid IS NULL THEN confidence WHEN conf >= 0.6 THEN conf END AS confidence,
  CASE WHEN nid IS NULL THEN fin.id WHEN conf >= 0.6 THEN nid END AS id,
  CASE WHEN nid IS NULL THEN error_code WHEN conf < 0.6 THEN 'LOW_CONFIDENCE_GEOCODE' END AS error_code FROM fin""")
def geocode_hinted(spark, sf_dir):
    """GC9 with bounds, and the hint distance rule of GC5."""
    out = G.geocode(derived.hinted_requests(spark, sf_dir), store(spark, sf_dir), PROVINCES)
    return out.select(
        "req_id", "method", "confidence", F.col("row.id").alias("id"), "error_code"
    )


@query("geocode_city", f"""
WITH {O.ADDR}, {O.CITY}, requests AS ({O.REQUESTS}),
f AS (SELECT req_id, {O.tok('city')} AS q_city, {O.province('state')} AS q_prov FROM requests),
t AS (SELECT req_id, q_city, p.prov, p.pr FROM f JOIN (VALUES ('ON', 0), ('QC', 1)) p(prov, pr) ON f.q_prov IS NULL OR f.q_prov = p.prov),
{O.spelling_ctes('t', 'q_city', 'prov', 'sp')},
h AS (SELECT t.req_id, c.*, row_number() OVER (PARTITION BY t.req_id ORDER BY t.pr, sp.rank) AS rn
  FROM t JOIN sp ON sp.c = t.q_city AND sp.p = t.prov JOIN city_c c ON c.city_key = sp.token || '|' || t.prov)
SELECT req_id, 'city_centroid' AS method, CAST(0.45 AS DOUBLE) AS confidence, city, round(lat + 1e-11, 9) AS lat, round(lon + 1e-11, 9) AS lon FROM h WHERE rn = 1""")
def geocode_city(spark, sf_dir):
    """GC7, GC8: the city step, kept with a minimum confidence of 0.4."""
    reqs = requests(spark, sf_dir).select("req_id", "city", "state")
    out = G.geocode(reqs, store(spark, sf_dir), PROVINCES, min_confidence=0.4)
    return out.where("method = 'city_centroid'").select(
        "req_id", "method", "confidence", F.col("row.city").alias("city"),
        places("row.lat").alias("lat"), places("row.lon").alias("lon"),
    )


@query("city_token_matches", f"""
WITH {O.ADDR}, {O.CITY}, requests AS ({O.REQUESTS}), n AS (SELECT DISTINCT {O.tok('city')} AS q_city FROM requests),
m AS (SELECT split_part(city_key, '|', 1) AS q_city, count(*) AS matches, arg_min(city, province) AS city FROM city_c GROUP BY 1)
SELECT q_city, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN city END AS city,
  CASE WHEN matches > 1 THEN 'AMBIGUOUS_LOCATION' WHEN matches IS NULL THEN 'ADDRESS_NOT_FOUND' END AS error_code FROM n LEFT JOIN m USING (q_city)""")
def city_token_matches(spark, sf_dir):
    """GC7: the search by city name alone."""
    names = requests(spark, sf_dir).select(text.search_token(F.col("city")).alias("q_city")).distinct()
    return G.cities_by_token(names, store(spark, sf_dir)).select("q_city", "matches", "city", "error_code")


@query("address_for_point", f"""
{_BASE}, {_HINTED}, asked AS (SELECT * FROM hinted WHERE lat IS NOT NULL),
{O.cascade_ctes('asked', 'req_id', PROVINCES)}, {_nearest('asked', 'req_id')},
back AS (SELECT req_id, id FROM nn WHERE distance <= 25000 AND least(0.7, greatest(0.3, 1 - distance / 10000)) >= 0.6)
SELECT a.req_id, CASE WHEN b.id IS NOT NULL THEN 'reverse' WHEN g.error_code IS NULL THEN 'forward' END AS address_source,
  coalesce(b.id, g.id) AS id FROM asked a LEFT JOIN back b USING (req_id) LEFT JOIN geo g USING (req_id)""")
def address_for_point(spark, sf_dir):
    """GC19."""
    asked = derived.hinted_requests(spark, sf_dir).where("lat IS NOT NULL")
    out = G.address_for_point(asked, store(spark, sf_dir), PROVINCES, pid="req_id")
    return out.select("req_id", "address_source", F.col("row.id").alias("id"))


_BULK = f"""
{_BASE}, bulk AS ({derived.BULK_SQL.format(requests='requests')}),
judged0 AS (
  SELECT *, CASE WHEN path = '/other' THEN 'pathname must start with /api' WHEN NOT ((lat IS NOT NULL AND lon IS NOT NULL) OR postal <> '' OR address <> '')
      THEN 'query must include lat/lon, postal, or address' WHEN postal <> '' AND {O.postal('postal')} IS NULL THEN 'Postal code format is invalid or too long'
      WHEN lat > 90 THEN 'Latitude must be between -90 and 90 (inclusive)' END AS error,
    CASE WHEN path = '/api/on' THEN 'ontarioridings-2022' ELSE 'federalridings-2024' END AS dataset,
    path <> '/api/on' AND coalesce(CASE include_raw WHEN 'true' THEN true WHEN 'no' THEN false END, CASE WHEN return_raw IS NOT NULL THEN false ELSE path = '/api/combined' END) AS want_province
  FROM bulk),
ok_req AS (SELECT * FROM judged0 WHERE error IS NULL),
by_code AS (SELECT *, {O.postal('postal')} AS code, {O.province('state')} AS prov FROM ok_req WHERE lat IS NULL AND ((postal <> '' AND address = '') OR method_raw = 'postal_centroid')),
code_hit AS (SELECT b.req_id, p.lat AS to_lat, p.lon AS to_lon, row_number() OVER (PARTITION BY b.req_id ORDER BY p.province) AS rn
  FROM by_code b JOIN postal_c p ON p.postal_code = b.code AND (b.prov IS NULL OR p.province = b.prov)),
by_text AS (SELECT req_id, address, postal, city, state FROM ok_req WHERE lat IS NULL AND req_id NOT IN (SELECT req_id FROM by_code)),
{O.cascade_ctes('by_text', 'req_id', PROVINCES)},
placed AS (
  SELECT req_id, 'exact' AS method, lat AS to_lat, lon AS to_lon, CAST(NULL AS VARCHAR) AS err FROM ok_req WHERE lat IS NOT NULL
  UNION ALL SELECT b.req_id, CASE WHEN h.req_id IS NOT NULL THEN 'postal_centroid' END, to_lat, to_lon,
    CASE WHEN h.req_id IS NULL THEN CASE WHEN b.postal = '' THEN 'INVALID_QUERY' ELSE 'ADDRESS_NOT_FOUND' END END FROM by_code b LEFT JOIN code_hit h ON h.req_id = b.req_id AND rn = 1
  UNION ALL SELECT req_id, method, to_lat, to_lon, error_code FROM geo)"""


@query("geocode_mixed", f"{_BULK} SELECT req_id, method, round(to_lat + 1e-11, 9) AS lat, round(to_lon + 1e-11, 9) AS lon, err AS error_code FROM placed")
def geocode_mixed(spark, sf_dir):
    """GC14 on the valid requests of the bulk input."""
    bulk = derived.bulk_requests(spark, sf_dir)
    c = F.col
    error = F.coalesce(
        rules.batch_row_error(c("req_id").cast("string"), c("path"), c("address"), c("postal"), c("lat"), c("lon")),
        rules.postal_error(c("postal")), rules.coordinate_error(c("lat"), c("lon")),
    )
    valid = bulk.withColumns({"geocode_method": rules.geocode_method(c("method_raw")), "_e": error}).where("_e IS NULL")
    out = G.geocode_mixed(valid.drop("_e"), store(spark, sf_dir), PROVINCES)
    return out.select("req_id", "method", places("to_lat").alias("lat"), places("to_lon").alias("lon"), "error_code")


@query("bulk_lookup", f"""{_BULK},
pts AS (SELECT req_id AS pid, to_lon AS lon, to_lat AS lat FROM placed WHERE err IS NULL),
{two_level('pts')},
shifted_first AS (SELECT h.pid, min(h.ordinal) AS ordinal FROM hit2 h JOIN nation n ON n.n_nationkey = h.ordinal WHERE n.n_regionkey = 0 GROUP BY h.pid)
SELECT j.req_id, CASE WHEN p.err IS NULL THEN CASE WHEN j.dataset = 'ontarioridings-2022' THEN 'P_' || n.n_name ELSE t.district END END AS district,
  CASE WHEN j.want_province AND p.err IS NULL THEN t.province_district END AS province_district, p.method, coalesce(j.error, p.err) AS error
FROM judged0 j LEFT JOIN placed p USING (req_id) LEFT JOIN two t ON t.pid = j.req_id
LEFT JOIN shifted_first s ON s.pid = j.req_id LEFT JOIN nation n ON n.n_nationkey = s.ordinal""")
def bulk_lookup_query(spark, sf_dir):
    """GC20, J4, VA2, VA3."""
    out = bulk_lookup(derived.bulk_requests(spark, sf_dir), store(spark, sf_dir), boundaries(spark, sf_dir), PROVINCES)
    return out.select("req_id", "district", "province_district", "method", "error")


@query("precompute_postal", f"""
{_BASE}, codes AS (SELECT DISTINCT postal_code AS postal FROM postal_c),
one AS (SELECT postal_code AS postal, lat, lon, row_number() OVER (PARTITION BY postal_code ORDER BY province) AS rn FROM postal_c),
pts AS (SELECT row_number() OVER (ORDER BY postal) AS pid, postal, lon, lat FROM one WHERE rn = 1),
{two_level('pts')},
live AS (SELECT 'federalridings-2024' AS dataset, -1 AS region UNION ALL SELECT DISTINCT {_PATHS}, n_regionkey FROM nation
  UNION ALL SELECT unnest(['nbridings-2022', 'mbridings-2022', 'skridings-2022', 'nlridings-2022', 'peridings-2022', 'ntridings-2022', 'nuridings-2022', 'ytridings-2022']), 99),
hits AS (SELECT pid, ordinal, -1 AS region FROM hit1 UNION ALL SELECT h.pid, h.ordinal, n.n_regionkey FROM hit2 h JOIN nation n ON n.n_nationkey = h.ordinal)
SELECT p.postal, l.dataset, CAST(min(h.ordinal) AS BIGINT) AS district_ordinal
FROM pts p CROSS JOIN live l LEFT JOIN hits h ON h.pid = p.pid AND h.region = l.region GROUP BY p.postal, l.dataset""")
def precompute_query(spark, sf_dir):
    """GC21."""
    s = store(spark, sf_dir)
    codes = s.postal.select(F.col("postal_code").alias("postal"))
    out = precompute_postal(codes, s, boundaries(spark, sf_dir), PROVINCES)
    return out.select("postal", "dataset", "district_ordinal")
