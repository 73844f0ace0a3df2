"""Load queries: files written from the derived tables and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.operators.aggregates import recent_imports, store_stats, table_counts
from geoweave.operators.shapes import boundary_stats
from geoweave.operators.spatial import spatial_index
from geoweave.plans import oracle_parts as O
from geoweave.plans.registry import places, query
from geoweave.session import scratch_path
from geoweave.sources import addresses as A
from geoweave.sources import boundaries as B
from geoweave.sources import derived
from geoweave.sources.store import snapshot

_STORED = "round(lat, 6) AS lat, round(lon, 6) AS lon, province, city, civic_number, street_name, street_type, street_direction, unit"


def _csv(spark, sf_dir, which="true") -> str:
    """Addresses as a CSV file set with two spellings of headers and some faulty rows; ``which`` of them."""
    path = scratch_path(spark, "csv")
    a = derived.addresses(spark, sf_dir).where(which)
    k = F.col("id")
    a.select(
        F.when(k % 50 == 7, "n/a").otherwise(F.format_string("%.3f", "lat")).alias("Latitude"),
        F.format_string("%.3f", "lon").alias("Longitude"),
        F.when(k % 60 == 9, "XYZ").when(k % 2 == 0, F.when(F.col("province") == "QC", "24").otherwise("35")).otherwise("")
        .alias("Province or Territory Unique Identifier"),
        F.col("province").alias("Province"),
        F.when(k % 3 == 0, F.col("city")).otherwise("").alias("Processed City"),
        F.col("city").alias("City"),
        F.col("civic_number").alias("Civic Number"),
        F.col("street_name").alias("str_name"), F.col("street_type").alias("Street Type"),
        F.col("street_direction").alias("Street Direction"), F.col("unit").alias("Unit"),
        F.col("postal_code").alias("Postal Code"),
        F.concat("civic_number", F.lit(" \"Q\", "), "street_name").alias("Full Address"),
    ).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


_REASON = "CASE WHEN id % 50 = 7 THEN 'no coordinates' WHEN id % 60 = 9 THEN 'unknown province' END"


@query("address_csv_load", f"""
WITH addr_raw AS ({O.ADDR_RAW})
SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, province, city, civic_number, street_name, street_type, street_direction, unit, postal_code,
  civic_number || ' "Q", ' || street_name AS full_address FROM addr_raw WHERE {_REASON} IS NULL""")
def address_csv_load(spark, sf_dir):
    """IO1-IO3: accepted rows."""
    good, _ = A.normalize_rows(A.read_address_csv(spark, _csv(spark, sf_dir)))
    return good.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("address_csv_rejects", f"""
WITH addr_raw AS ({O.ADDR_RAW}), r AS (SELECT coalesce({_REASON}, CASE WHEN province <> 'ON' THEN 'other province' END) AS reject_reason FROM addr_raw)
SELECT reject_reason, count(*) AS rows FROM r WHERE reject_reason IS NOT NULL GROUP BY 1""")
def address_csv_rejects(spark, sf_dir):
    """IO3: rejected rows by reason, for a load of one province."""
    _, bad = A.normalize_rows(A.read_address_csv(spark, _csv(spark, sf_dir)), "ON")
    return bad.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"))


@query("province_import", f"""
WITH {O.ADDR}, {O.STREET}, {O.POSTAL}, {O.CITY}, kept AS (SELECT * FROM addr WHERE {_REASON} IS NULL)
SELECT province, count(*) AS address_count, count(DISTINCT city_key) AS cities, count(DISTINCT city_key || street_key) AS streets,
  count(DISTINCT nullif(postal_code, '')) AS postal_codes FROM kept GROUP BY province""")
def province_import(spark, sf_dir):
    """IO7-IO9, IO11, AG4: both provinces loaded, one of them replaced and then resumed."""
    path, root = _csv(spark, sf_dir), scratch_path(spark, "store")
    A.import_province(spark, path, root, "ON", "v1")
    A.import_province(spark, path, root, "QC", "v1")
    A.import_province(spark, path, root, "QC", "v2")
    A.import_province(spark, path, root, "ON", "v2", resume=True)
    read = snapshot(spark, root).read
    stats = store_stats(read("addresses"), read("imports"))
    per = lambda name, alias: read(name).groupBy("province").agg(F.count(F.lit(1)).alias(alias))
    return (
        stats.where("last_import IS NOT NULL")
        .join(per("city_centroids", "cities"), "province")
        .join(per("street_search", "streets"), "province")
        .join(per("postal_centroids", "postal_codes"), "province")
        .drop("last_import")
    )


_MEAN = "round(avg(lat) + 1e-11, 9) AS lat, round(avg(lon) + 1e-11, 9) AS lon, count(*) AS address_count"


def _content_sql(which: str) -> str:
    """The aggregates of the addresses that a load leaves."""
    return f"""
WITH {O.ADDR}, kept AS (SELECT * FROM addr WHERE {_REASON} IS NULL AND {which})
SELECT 'postal' AS kind, province, postal_code AS key, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS BIGINT) AS min_civic, CAST(NULL AS BIGINT) AS max_civic, {_MEAN}
FROM kept WHERE postal_code <> '' GROUP BY province, postal_code
UNION ALL SELECT 'city', province, city_key, max(city), NULL, NULL, {_MEAN} FROM kept GROUP BY province, city_key
UNION ALL SELECT 'street', province, city_key || '/' || street_key, NULL, min(civic_value), max(civic_value), {_MEAN}
FROM kept GROUP BY province, city_key, street_key"""


def _content(spark, root):
    """The stored aggregates, as one table."""
    stored = snapshot(spark, root)
    kinds = {
        "postal": (stored.read("postal_centroids"), F.col("postal_code")),
        "city": (stored.read("city_centroids"), F.col("city_key")),
        "street": (stored.read("street_ranges"), F.concat_ws("/", "city_key", "street_key")),
    }
    parts = []
    for kind, (rows, key) in kinds.items():
        has = lambda c, kind_of: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind_of).alias(c)
        parts.append(rows.select(
            F.lit(kind).alias("kind"), "province", key.alias("key"), has("city", "string"), has("min_civic", "bigint"),
            has("max_civic", "bigint"), places("lat").alias("lat"), places("lon").alias("lon"), "address_count",
        ))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("replaced_content", _content_sql("province = 'QC' AND id % 2 = 0"))
def replaced_content(spark, sf_dir):
    """IO7, AG1-AG3: what is stored after a province was replaced by half its file."""
    root = scratch_path(spark, "store")
    A.import_province(spark, _csv(spark, sf_dir), root, "QC", "v1")
    A.import_province(spark, _csv(spark, sf_dir, "id % 2 = 0"), root, "QC", "v2")
    return _content(spark, root)


@query("resumed_content", _content_sql("province = 'ON'"))
def resumed_content(spark, sf_dir):
    """IO8, IO9, AG1-AG3: what is stored after a load of half a file went on to the whole."""
    root = scratch_path(spark, "store")
    A.import_province(spark, _csv(spark, sf_dir, "id % 2 = 0"), root, "ON", "v1")
    A.import_province(spark, _csv(spark, sf_dir), root, "ON", "v2", resume=True)
    return _content(spark, root)


@query("import_log", f"""
WITH addr_raw AS ({O.ADDR_RAW}), kept AS (SELECT province, count(*) AS n FROM addr_raw WHERE {_REASON} IS NULL GROUP BY province)
SELECT province, 'v' || v AS source_version, n AS row_count FROM kept CROSS JOIN (VALUES (1), (2)) t(v)""")
def import_log(spark, sf_dir):
    """IO11, AG4: the newest import rows."""
    path, root = _csv(spark, sf_dir), scratch_path(spark, "store")
    for version in ("v1", "v2"):
        for province in ("ON", "QC"):
            A.import_province(spark, path, root, province, version)
    return recent_imports(snapshot(spark, root).read("imports")).select("province", "source_version", "row_count")


@query("table_counts", f"""
WITH {O.ADDR}, {O.STREET}, {O.POSTAL}, {O.CITY}
SELECT 'postal_centroids' AS table_name, count(*) AS rows FROM postal_c UNION ALL SELECT 'city_centroids', count(*) FROM city_c
UNION ALL SELECT 'street_ranges', count(*) FROM street_c""")
def table_counts_query(spark, sf_dir):
    """AG4."""
    from geoweave.plans.geocode_queries import store

    s = store(spark, sf_dir)
    return table_counts(postal_centroids=s.postal, city_centroids=s.cities, street_ranges=s.streets)


def _geojson(spark, sf_dir) -> str:
    """Parcels as FeatureCollection files of at most a few hundred features each, some faulty."""
    path = scratch_path(spark, "geojson")
    p = derived.parcels(spark, sf_dir)
    k = F.col("ordinal")
    polygon = F.to_json(F.col("geom")[0])
    multi = F.to_json("geom")
    single = F.size("geom") == 1
    feature = F.concat(
        F.lit('{"type":"'), F.when(k % 40 == 3, "Shape").otherwise("Feature"), F.lit('","properties":{'),
        F.when(k % 4 == 0, F.concat(F.lit('"FED_NUM":"'), k.cast("string"), F.lit('",'))).otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit('"local_District_nm":" Area '), k.cast("string"), F.lit(' "')))
        .when(k % 25 == 1, '"other":"x"')
        .otherwise(F.concat(F.lit('"NAME_EN":"Parcel '), k.cast("string"), F.lit('"'))),
        F.lit('},"geometry":'),
        F.when(k % 40 == 5, "null").otherwise(
            F.concat(
                F.lit('{"type":"'), F.when(k % 40 == 7, "Point").when(single, "Polygon").otherwise("MultiPolygon"),
                F.lit('","coordinates":'), F.when(k % 40 == 7, "[1.0,2.0]").when(single, polygon).otherwise(multi), F.lit("}"),
            )
        ),
        F.lit("}"),
    )
    files = p.select((k / 200).cast("int").alias("file"), k.alias("k"), feature.alias("f")).groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("k", "f"))).alias("fs")
    )
    files.select(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['),
            F.array_join(F.transform("fs", lambda s: s["f"]), ","), F.lit("]}"),
        ).alias("value"), "file",
    ).repartition("file").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


_BAD = "(ordinal % 40 = 3 OR ordinal % 40 = 5 OR ordinal % 40 = 7)"
_PNAME = "CASE WHEN ordinal % 5 = 0 THEN 'Area ' || ordinal WHEN ordinal % 25 = 1 THEN NULL ELSE 'Parcel ' || ordinal END"


@query("geojson_load", f"""
WITH verts AS ({O.PARCEL_VERTICES})
SELECT {_PNAME} AS name, 'ON' AS province, min(lon) AS min_x, max(lat) AS max_y, count(*) AS vertices
FROM verts WHERE NOT {_BAD} AND {_PNAME} IS NOT NULL GROUP BY ordinal""")
def geojson_load(spark, sf_dir):
    """IO4, IO5: accepted and named features."""
    good, _ = B.read_geojson(spark, _geojson(spark, sf_dir), "parcels")
    named, _ = B.normalize_boundaries(good, "on")
    return spatial_index(named).select(
        F.col("props")["ENGLISH_NAME"].alias("name"), F.col("props")["PROV_TERR"].alias("province"),
        "bbox.min_x", "bbox.max_y", F.size(F.flatten(F.flatten("geom"))).cast("bigint").alias("vertices"),
    )


@query("geojson_rejects", f"""
WITH c AS (SELECT c_custkey AS ordinal FROM customer)
SELECT CASE ordinal % 40 WHEN 3 THEN 'not a Feature' WHEN 5 THEN 'missing geometry' WHEN 7 THEN 'missing or unsupported coordinates' ELSE 'no name property' END AS reject_reason,
  count(*) AS features FROM c WHERE {_BAD} OR ({_PNAME} IS NULL) GROUP BY 1""")
def geojson_rejects(spark, sf_dir):
    """IO4, IO5: quarantined features by reason."""
    good, bad = B.read_geojson(spark, _geojson(spark, sf_dir), "parcels")
    _, unnamed = B.normalize_boundaries(good, "ON")
    return B.union_boundaries(bad.select("reject_reason"), unnamed.select("reject_reason")).groupBy(
        "reject_reason"
    ).agg(F.count(F.lit(1)).alias("features"))


@query("boundary_store", f"""
WITH verts AS ({O.PARCEL_VERTICES}), n AS (SELECT count(DISTINCT ordinal) AS n, count(DISTINCT CASE WHEN ordinal % 2 = 0 THEN ordinal END) AS even FROM verts)
SELECT 'a' AS dataset, even AS features FROM n UNION ALL SELECT 'b', n FROM n""")
def boundary_store(spark, sf_dir):
    """IO6, IO10, J13: two datasets stored, one of them replaced."""
    path = scratch_path(spark, "features")
    p = derived.parcels(spark, sf_dir).withColumn("props", F.create_map(F.lit("n"), F.col("ordinal").cast("string")))
    both = B.union_boundaries(p.withColumn("dataset", F.lit("a")), p.withColumn("dataset", F.lit("b")))
    B.write_features(both, path, ["a", "b"])
    B.write_features(p.where("ordinal % 2 = 0").withColumn("dataset", F.lit("a")), path)
    return boundary_stats(snapshot(spark, path).read("features")).select("dataset", "features")


@query("missing_datasets", """
SELECT dataset, path FROM (VALUES ('nbridings-2022', '/api/nb'), ('mbridings-2022', '/api/mb'), ('skridings-2022', '/api/sk'), ('nlridings-2022', '/api/nl'),
  ('peridings-2022', '/api/pe'), ('ntridings-2022', '/api/nt'), ('nuridings-2022', '/api/nu'), ('ytridings-2022', '/api/yt')) t(dataset, path)
WHERE EXISTS (SELECT 1 FROM nation)""")
def missing_datasets(spark, sf_dir):
    """IO12: registry entries that the derived boundaries do not cover."""
    stored = B.union_boundaries(
        derived.federal_districts(spark, sf_dir), derived.provincial_districts(spark, sf_dir)
    )
    return B.missing_datasets(spark, stored)
