"""Tables derived from the star-schema inputs: points, boundaries, addresses, requests, logs.

Each derivation is plain SQL over the input tables that Spark and other engines run alike, so that
the checking SQL can start from the very same rows. Inputs are named {table} for Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_SQL = """
SELECT event_id AS pid,
  CAST(-80 AS DOUBLE) + CAST((event_id * 37) % 1000 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon,
  CAST(43 AS DOUBLE) + CAST((event_id * 91 + event_id % 13) % 1000 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat
FROM {events}
"""

POLY_VERTICES_SQL = """
SELECT n_nationkey AS ordinal, 0 AS part, 0 AS ring, v,
  CAST(-80 + 2 * (n_nationkey % 5) AS DOUBLE) + CAST(ux AS DOUBLE) *
    CAST(CASE WHEN n_nationkey = 12 THEN 5 WHEN n_nationkey % 4 = 3 THEN 3 ELSE 4 END AS DOUBLE) / CAST(2 AS DOUBLE) AS lon,
  CAST(43 AS DOUBLE) + CAST(2 AS DOUBLE) * FLOOR(CAST(n_nationkey AS DOUBLE) / CAST(5 AS DOUBLE)) + CAST(uy AS DOUBLE) *
    CAST(CASE WHEN n_nationkey = 12 THEN 5 ELSE 4 END AS DOUBLE) / CAST(2 AS DOUBLE) AS lat
FROM {nation} CROSS JOIN (VALUES (0,0,0),(1,1,0),(2,1,1),(3,0,1),(4,0,0)) AS u(v, ux, uy)
UNION ALL
SELECT 6, 0, 1, v, CAST(-77.5 AS DOUBLE) + CAST(ux AS DOUBLE), CAST(45.5 AS DOUBLE) + CAST(uy AS DOUBLE)
FROM (VALUES (0,0,0),(1,1,0),(2,1,1),(3,0,1),(4,0,0)) AS u(v, ux, uy)
UNION ALL
SELECT 18, 1, 0, v, CAST(-72.5 AS DOUBLE) + CAST(ux AS DOUBLE) / CAST(2 AS DOUBLE), CAST(44 AS DOUBLE) + CAST(uy AS DOUBLE)
FROM (VALUES (0,0,0),(1,1,0),(2,1,1),(3,0,1),(4,0,0)) AS u(v, ux, uy)
"""

# One boundary per customer, 5 to 12 vertices, every seventh with a second part: grows with the data.
PARCEL_VERTICES_SQL = """
SELECT c_custkey AS ordinal, part, 0 AS ring, v,
  CAST((c_custkey * 7) % 500 AS DOUBLE) / CAST(8 AS DOUBLE)
    + CAST((v * v * 3 + c_custkey % 11) % 16 AS DOUBLE) / CAST(16 AS DOUBLE) + CAST(part AS DOUBLE) AS lon,
  CAST((c_custkey * 13) % 300 AS DOUBLE) / CAST(8 AS DOUBLE)
    + CAST((v * 5 + c_custkey % 7) % 16 AS DOUBLE) / CAST(16 AS DOUBLE) AS lat
FROM {customer}
CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11)) AS u(v)
CROSS JOIN (VALUES (0),(1)) AS p(part)
WHERE v < 5 + (c_custkey + part * 3) % 8 AND (part = 0 OR c_custkey % 7 = 0)
"""

ADDR_SQL = """
SELECT o_orderkey AS id,
  CAST(1 + 2 * ((o_custkey * 7 + o_orderkey * 13) % 61) AS STRING) || CASE WHEN o_orderkey % 17 = 0 THEN 'A' ELSE '' END AS civic_number,
  CASE o_orderkey % 6 WHEN 0 THEN 'MAIN' WHEN 1 THEN 'KING' WHEN 2 THEN 'VICTORIA PARK' WHEN 3 THEN 'SAINT-PAUL'
    WHEN 4 THEN 'Québec' ELSE 'WEST' END AS street_name,
  CASE o_custkey % 4 WHEN 0 THEN 'ST' WHEN 1 THEN 'AVENUE' WHEN 2 THEN 'MALL' ELSE '' END AS street_type,
  CASE WHEN o_custkey % 9 = 0 THEN 'W' ELSE '' END AS street_direction,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(100 + o_orderkey % 30 AS STRING) ELSE '' END AS unit,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE
    'M' || CAST(o_custkey % 10 AS STRING) || substr('ABCEGHJKLM', CAST(1 + o_orderkey % 10 AS INT), 1) || ' '
    || CAST(o_orderkey % 10 AS STRING) || 'T' || CAST(o_custkey % 7 AS STRING) END AS postal_code,
  CASE o_custkey % 5 WHEN 0 THEN 'FORMER TORONTO' WHEN 1 THEN 'SCARBOROUGH' WHEN 2 THEN 'CITY OF HAMILTON'
    WHEN 3 THEN 'Montréal' ELSE 'Ottawa' END AS city,
  CASE WHEN o_custkey % 5 = 3 THEN 'QC' ELSE 'ON' END AS province,
  CAST(43 AS DOUBLE) + CAST((o_orderkey * 53) % 9973 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat,
  CAST(-80 AS DOUBLE) + CAST((o_orderkey * 71) % 9967 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon
FROM {orders}
"""

REQUESTS_SQL = """
SELECT id AS req_id,
  CASE id % 4
    WHEN 0 THEN CASE WHEN unit = '' THEN '' ELSE unit || '-' END || civic_number || ' ' || street_name || ' ' || street_type
    WHEN 1 THEN 'Unit ' || CASE WHEN unit = '' THEN '1' ELSE unit END || ', ' || civic_number || ' ' || lower(street_name) || ' ' || street_type
    WHEN 2 THEN civic_number || ' The ' || street_name || ' ' || street_type
    ELSE '99999 ' || street_name || ' ' || street_type END AS address,
  CASE WHEN id % 3 = 0 THEN '' ELSE postal_code END AS postal,
  CASE city WHEN 'FORMER TORONTO' THEN 'Toronto' WHEN 'SCARBOROUGH' THEN 'Toronto' WHEN 'CITY OF HAMILTON' THEN 'Hamilton' ELSE city END AS city,
  CASE WHEN id % 7 = 0 THEN '' ELSE province END AS state
FROM {addr}
"""

REQUEST_LOG_SQL = """
SELECT event_id, ts, user_id AS key_id, user_id % 40 AS customer_id, event_type <> 'error' AS ok, event_type AS route, value AS ms
FROM {events}
"""

# The same log with keys, customers and times missing here and there.
GAPPY_LOG_SQL = """
SELECT event_id, CASE WHEN event_id % 97 = 5 THEN NULL ELSE ts END AS ts, CASE WHEN event_id % 29 = 3 THEN NULL ELSE key_id END AS key_id,
  CASE WHEN event_id % 31 = 4 THEN NULL ELSE customer_id END AS customer_id, ok, route, ms
FROM {log}
"""

PROVINCE_OF_REGION = {0: "ON", 1: "QC", 2: "BC", 3: "AB", 4: "NS"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that scans as fewer partitions than there are cores, dealt out over all cores.

    Work per row is heavy here (text rules, containment), so one small file must not mean one task. A
    table of many files already has more partitions and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS_SQL, events=spread(table(spark, sf_dir, "events")))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ADDR_SQL, orders=spread(table(spark, sf_dir, "orders")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTS_SQL, addr=addresses(spark, sf_dir))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUEST_LOG_SQL, events=table(spark, sf_dir, "events"))


def gappy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GAPPY_LOG_SQL, log=request_log(spark, sf_dir))


def _assemble(vertices: DataFrame) -> DataFrame:
    """Vertex rows to one MultiPolygon array per ordinal.

    Each level is ordered by its number, so the result does not depend on row order. The vertices are
    dealt out by boundary once, for all three levels.
    """
    ring = vertices.repartition("ordinal").groupBy("ordinal", "part", "ring").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("v", "lon", "lat"))),
            lambda s: F.array(s["lon"], s["lat"]),
        ).alias("coords")
    )
    part = ring.groupBy("ordinal", "part").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ring", "coords"))), lambda s: s["coords"]
        ).alias("rings")
    )
    return part.groupBy("ordinal").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("part", "rings"))), lambda s: s["rings"]
        ).alias("geom")
    )


def poly_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POLY_VERTICES_SQL, nation=table(spark, sf_dir, "nation"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, geom): one boundary per customer."""
    vertices = spark.sql(PARCEL_VERTICES_SQL, customer=spread(table(spark, sf_dir, "customer")))
    return _assemble(vertices)


def federal_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, ordinal, props, geom): first-level boundaries."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("ordinal"), "n_name", "n_regionkey"
    )
    regions = F.create_map(*[F.lit(x) for kv in PROVINCE_OF_REGION.items() for x in kv])
    return (
        _assemble(poly_vertices(spark, sf_dir))
        .join(nation, "ordinal")
        .select(
            F.lit("federalridings-2024").alias("dataset"),
            "ordinal",
            F.create_map(
                F.lit("FED_NAME"), F.col("n_name"),
                F.lit("PROV_CODE"), F.element_at(regions, F.col("n_regionkey")),
            ).alias("props"),
            "geom",
        )
    )


def provincial_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-level boundaries: the first set shifted by half a degree, one dataset per province."""
    from geoweave.sources.boundaries import dataset_registry

    federal = federal_districts(spark, sf_dir)
    registry = dataset_registry(spark).select(
        F.upper("code").alias("prov"), F.col("dataset").alias("prov_dataset")
    )
    shifted = F.transform(
        "geom",
        lambda p: F.transform(
            p, lambda r: F.transform(r, lambda c: F.array(c[0] + F.lit(0.5), c[1] + F.lit(0.5)))
        ),
    )
    return (
        federal.withColumn("prov", F.col("props")["PROV_CODE"])
        .join(registry, "prov")
        .select(
            F.col("prov_dataset").alias("dataset"),
            "ordinal",
            F.create_map(
                F.lit("ENGLISH_NAME"), F.concat(F.lit("P_"), F.col("props")["FED_NAME"])
            ).alias("props"),
            shifted.alias("geom"),
        )
    )


# Requests with gaps and faults in every field, one per order.
FAULTY_REQUESTS_SQL = """
SELECT o_orderkey AS req_id,
  CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '  12  Rue   Saint-Denis ' ELSE CAST(o_custkey AS STRING) || ' Main St' END AS address,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'm5v 2t' || CAST(o_custkey % 10 AS STRING) WHEN 2 THEN '9021' || CAST(o_custkey % 10 AS STRING)
    WHEN 3 THEN 'K1A0B' || CAST(o_custkey % 10 AS STRING) ELSE 'this text is far too long ' || CAST(o_custkey AS STRING) END AS postal,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' Montréal ' WHEN 2 THEN 'Toronto' ELSE 'City of Toronto' END AS city,
  CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Québec' WHEN 2 THEN '35' WHEN 3 THEN 'ont' WHEN 4 THEN 'Narnia' ELSE 'QC' END AS state,
  CASE o_orderkey % 3 WHEN 0 THEN 'Canada' ELSE '' END AS country,
  CASE o_orderkey % 8 WHEN 0 THEN CAST(o_custkey % 200 AS DOUBLE) - 95.5 WHEN 1 THEN 43.123456 WHEN 2 THEN 45.5 END AS lat,
  CASE o_orderkey % 8 WHEN 0 THEN -79.5 WHEN 2 THEN CAST(o_custkey % 500 AS DOUBLE) - 250.25 WHEN 3 THEN -75.25 END AS lon,
  CASE o_orderkey % 11 WHEN 0 THEN 'municipality' WHEN 1 THEN ' municipality , municipality' WHEN 2 THEN 'colour,municipality' WHEN 3 THEN ' ' END AS return_raw,
  CASE o_orderkey % 13 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' no ' WHEN 2 THEN 'maybe' WHEN 3 THEN '1' WHEN 4 THEN '' END AS include_raw,
  CASE o_orderkey % 9 WHEN 0 THEN 'auto' WHEN 1 THEN ' Postal_Centroid ' WHEN 2 THEN 'nearest' WHEN 3 THEN '' END AS method_raw,
  CASE o_orderkey % 5 WHEN 0 THEN '/api' WHEN 1 THEN '/api/combined' WHEN 2 THEN '/api/qc' WHEN 3 THEN '/other' ELSE '/api/on' END AS path,
  CASE o_orderkey % 10 WHEN 0 THEN '2022' WHEN 1 THEN '2024' WHEN 2 THEN 'quebecridings-2025.geojson' WHEN 3 THEN '1999' END AS pinned
FROM {orders}
"""

# Raw provider answers, three per request, with titles near and far from the request.
CANDIDATES_SQL = """
SELECT req_id, pos,
  CASE (req_id + pos) % 5 WHEN 0 THEN 'Highway 7, ' || city || ', Ontario'
    WHEN 1 THEN upper(address) || ', ' || city || ', ' || state
    WHEN 2 THEN 'Main Street, Vancouver, British Columbia'
    WHEN 3 THEN substr(address, 1, 5) || ' Route 66, ' || city || ', Quebec'
    ELSE address || ', ' || upper(city) || ', Ontario' END AS title,
  CASE WHEN (req_id + pos) % 3 = 0 THEN 'INTERPOLATED_POSITION' ELSE 'LOCATION' END AS qualifier,
  CAST((req_id * 7 + pos * 3) % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS score,
  CAST(-80 AS DOUBLE) + CAST((req_id + pos) % 100 AS DOUBLE) / CAST(10 AS DOUBLE) AS lon,
  CAST(43 AS DOUBLE) + CAST((req_id + pos) % 90 AS DOUBLE) / CAST(10 AS DOUBLE) AS lat
FROM {requests} CROSS JOIN (VALUES (0),(1),(2)) AS u(pos)
WHERE pos < 1 + req_id % 3
"""


def faulty_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FAULTY_REQUESTS_SQL, orders=spread(table(spark, sf_dir, "orders")))


def provider_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CANDIDATES_SQL, requests=requests(spark, sf_dir))


# Search queries, one per address: plain, with civic, with unit, and short prefixes.
SEARCH_QUERIES_SQL = """
SELECT id AS query_id,
  CASE id % 6 WHEN 0 THEN lower(street_name) || ' ' || lower(street_type)
    WHEN 1 THEN civic_number || ' ' || street_name || ' ' || city
    WHEN 2 THEN substr(street_name, 1, CAST(2 + id % 3 AS INT))
    WHEN 3 THEN CASE WHEN unit = '' THEN '7' ELSE unit END || '-' || CAST(1 + 2 * (id % 60) AS STRING) || ' ' || street_name
    WHEN 4 THEN CAST(1 + id % 119 AS STRING) || ' ' || lower(street_name) || ' street west'
    ELSE street_name || ' ' || province END AS q,
  CASE id % 7 WHEN 0 THEN province WHEN 1 THEN 'QC, ON' WHEN 2 THEN 'BC,QC' END AS province,
  CAST(CASE id % 9 WHEN 0 THEN 3 WHEN 1 THEN 12 END AS INT) AS max_results,
  CASE WHEN id % 5 = 0 THEN lat END AS bias_lat,
  CASE WHEN id % 5 = 0 THEN lon END AS bias_lon,
  CASE WHEN id % 8 = 1 THEN CAST(47 AS DOUBLE) END AS box_min_lat,
  CASE WHEN id % 8 = 1 THEN CAST(48.1 AS DOUBLE) END AS box_max_lat,
  CASE WHEN id % 8 = 1 THEN CAST(-76 AS DOUBLE) END AS box_min_lon,
  CASE WHEN id % 8 = 1 THEN CAST(-74.8 AS DOUBLE) END AS box_max_lon
FROM {addr}
"""


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEARCH_QUERIES_SQL, addr=addresses(spark, sf_dir))


CUSTOMERS_SQL = """
SELECT c_custkey AS customer_id,
  CASE c_custkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'metered' ELSE 'enterprise' END AS plan,
  CAST(CASE c_custkey % 5 WHEN 0 THEN 40 WHEN 1 THEN 100 ELSE 0 END AS INT) AS fuse_limit,
  c_custkey % 7 = 0 AS soft
FROM {customer}
"""

# Event rows of jobs: a job is a key and a slot, views are submissions and all else attempts. Every
# seventh key has one job with attempts only, which all succeed or all fail, so that its batches end.
JOB_EVENTS_SQL = """
SELECT key_id * 100 + CASE WHEN key_id % 7 = 0 THEN 0 ELSE event_id % 9 END AS job_id,
  CASE WHEN key_id % 7 = 0 THEN 100 + key_id % 5 ELSE key_id % 25 END AS batch_id, CAST(key_id % 4 AS INT) AS priority,
  CASE WHEN key_id % 7 <> 0 AND (route = 'view' OR event_id % 10 = 3) THEN 'submit' ELSE 'attempt' END AS kind,
  CASE WHEN key_id % 7 = 0 THEN key_id % 5 < 2 OR (key_id % 5 = 2 AND key_id % 2 = 0) ELSE ok AND key_id % 3 = 0 AND event_id % 4 = 0 END AS ok, ms, ts, event_id
FROM {log}
"""

# Access requests with origins, and the keys they use.
ACCESS_LOG_SQL = """
SELECT event_id, CASE WHEN event_id % 19 = 0 THEN NULL ELSE key_id END AS key_id,
  CASE event_id % 6 WHEN 0 THEN 'https://a.example.ca' WHEN 1 THEN 'https://SHOP.example.ca:8443/' WHEN 2 THEN 'http://example.ca'
    WHEN 3 THEN 'https://example.ca.evil.test' WHEN 4 THEN 'http://localhost:3000' END AS origin,
  CASE WHEN event_id % 4 = 1 THEN 'https://a.example.ca' END AS same_origin
FROM {log}
"""
API_KEYS_SQL = """
SELECT c_custkey AS key_id, CASE WHEN c_custkey % 11 = 0 THEN 'server' ELSE 'browser' END AS kind,
  c_custkey % 13 = 0 AS disabled,
  CASE c_custkey % 4 WHEN 0 THEN 'https://*.example.ca' WHEN 1 THEN 'https://shop.example.ca:8443' WHEN 2 THEN '*' ELSE 'http://localhost:3000' END AS origin1,
  CASE WHEN c_custkey % 3 = 0 THEN 'http://example.ca/' ELSE '' END AS origin2,
  CASE c_custkey % 17 WHEN 0 THEN NULL WHEN 1 THEN 999999999 ELSE c_custkey END AS owner
FROM {customer} WHERE c_custkey % 10 <> 9
"""

# Comparison cases with two result sets, one per order.
CASES_SQL = """
SELECT o_orderkey AS case_id,
  substr('ABCDEFGI', CAST(1 + o_orderkey % 8 AS INT), 1) AS category,
  CASE WHEN o_orderkey % 23 = 0 THEN 'Expected divergence here' END AS notes,
  CASE WHEN o_custkey % 3 = 0 THEN 'District-' || CAST(o_custkey % 7 AS STRING) END AS truth,
  CAST(CASE o_orderkey % 10 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END AS INT) AS own_status,
  CASE WHEN o_orderkey % 10 < 2 THEN '{{"code":"C' || CAST(o_orderkey % 4 AS STRING) || '","error":"' ||
      CASE o_orderkey % 3 WHEN 0 THEN 'Geocoding timeout' WHEN 1 THEN 'Circuit breaker is OPEN' ELSE 'nothing' END || '"}}'
    WHEN o_orderkey % 10 = 2 THEN '{{"properties":{{"FED_NAME":"District ' || CAST(o_custkey % 7 AS STRING) || '"}},"point":{{"lat":43.5,"lon":-79.25}}}}'
    WHEN o_orderkey % 10 = 3 THEN '{{"properties":{{}}}}'
    ELSE '{{"riding":"District-' || CAST(o_custkey % 7 AS STRING) || '","province_data":{{"properties":{{"ENGLISH_NAME":"Prov ' || CAST(o_custkey % 5 AS STRING) || '"}}}}}}' END AS own_raw,
  CAST(CASE o_orderkey % 12 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 200 END AS INT) AS other_status,
  CASE WHEN o_orderkey % 24 = 0 THEN 'no postal or point' END AS other_error,
  CASE WHEN o_orderkey % 6 = 5 THEN '{{"boundaries_centroid":[],"boundaries_concordance":[]}}'
    WHEN o_orderkey % 6 = 4 THEN '{{"boundaries_centroid":[{{"name":"X","related":{{"boundary_set_url":"/other/"}}}}],"boundaries_concordance":[{{"name":"district—' || CAST((o_custkey + o_orderkey % 2) % 7 AS STRING) || '","related":{{"boundary_set_url":"/sets/federal/"}}}}]}}'
    ELSE '{{"boundaries_centroid":[{{"name":"DISTRICT-' || CAST((o_custkey + o_orderkey % 5 % 2) % 7 AS STRING) || '","related":{{"boundary_set_url":"/sets/federal/"}}}}]}}' END AS other_raw,
  o_totalprice AS ms
FROM {orders}
"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CUSTOMERS_SQL, customer=table(spark, sf_dir, "customer"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOB_EVENTS_SQL, log=request_log(spark, sf_dir))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ACCESS_LOG_SQL, log=request_log(spark, sf_dir))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.sql(API_KEYS_SQL, customer=table(spark, sf_dir, "customer"))
    return keys.withColumn("origins", F.array("origin1", "origin2")).drop("origin1", "origin2")


def comparison_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CASES_SQL, orders=spread(table(spark, sf_dir, "orders")))


# Requests with hint points on half of them, and requests for the bulk lookup with all fields.
HINTED_SQL = """
SELECT req_id, address, CASE WHEN req_id % 2 = 0 THEN '' ELSE postal END AS postal, city, state,
  CASE WHEN req_id % 3 <> 0 THEN CAST(43 AS DOUBLE) + CAST((req_id * 53 + 5) % 9973 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS lat,
  CASE WHEN req_id % 3 <> 0 THEN CAST(-80 AS DOUBLE) + CAST((req_id * 71 + 3) % 9967 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS lon
FROM {requests}
"""
BULK_SQL = """
SELECT req_id, CASE WHEN req_id % 7 = 1 THEN '/other' WHEN req_id % 3 = 0 THEN '/api/combined' WHEN req_id % 3 = 1 THEN '/api' ELSE '/api/on' END AS path,
  CASE WHEN req_id % 5 < 2 THEN '' ELSE address END AS address, CASE WHEN req_id % 9 = 2 THEN 'much too long to be a postal code' ELSE postal END AS postal,
  city, state, 'Canada' AS country,
  CASE WHEN req_id % 5 = 1 THEN CAST(43 AS DOUBLE) + CAST((req_id * 53) % 9973 AS DOUBLE) / CAST(1000 AS DOUBLE) WHEN req_id % 13 = 0 THEN 91.5 END AS lat,
  CASE WHEN req_id % 5 = 1 THEN CAST(-80 AS DOUBLE) + CAST((req_id * 71) % 9967 AS DOUBLE) / CAST(1000 AS DOUBLE) WHEN req_id % 13 = 0 THEN -79.5 END AS lon,
  CASE WHEN req_id % 4 = 0 THEN 'municipality' END AS return_raw, CASE WHEN req_id % 6 = 1 THEN 'true' WHEN req_id % 6 = 3 THEN 'no' END AS include_raw,
  CASE WHEN req_id % 8 = 3 THEN 'postal_centroid' END AS method_raw
FROM {requests}
"""


def hinted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HINTED_SQL, requests=requests(spark, sf_dir))


def bulk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BULK_SQL, requests=requests(spark, sf_dir))
