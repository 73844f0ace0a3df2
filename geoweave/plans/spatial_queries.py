"""Spatial queries over points and boundaries derived from the inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions.geometry import haversine, planar_order, vertex_centroid
from geoweave.operators import shapes as SH
from geoweave.operators import spatial as S
from geoweave.plans import bulk_lookup as BL
from geoweave.plans import oracle_parts as O
from geoweave.plans.registry import query
from geoweave.sources import derived
from geoweave.sources.boundaries import feature_rows, union_boundaries

_PIP = f"""
WITH points AS ({O.POINTS}), verts AS ({O.VERTICES}),
{O.contains_ctes('points', 'verts', 'hit')},
first AS (SELECT pid, min(ordinal) AS ordinal FROM hit GROUP BY pid)"""


@query("pip_counts", f"""{_PIP}
SELECT n.n_name AS district, count(*) AS points
FROM first f JOIN nation n ON n.n_nationkey = f.ordinal GROUP BY n.n_name""")
def pip_counts(spark, sf_dir):
    """J1, J2, SP1-SP7: points per district."""
    federal = derived.federal_districts(spark, sf_dir)
    index = S.build_cell_index(federal)
    assigned = S.assign_points(derived.points(spark, sf_dir), index).where("ordinal IS NOT NULL")
    counts = assigned.groupBy("ordinal").agg(F.count(F.lit(1)).alias("points"))
    return S.with_district(counts, federal).select(
        F.col("props")["FED_NAME"].alias("district"), "points"
    )


@query("pip_first_match", f"""{_PIP}
SELECT p.pid, CAST(f.ordinal AS BIGINT) AS ordinal FROM points p LEFT JOIN first f USING (pid)""")
def pip_first_match(spark, sf_dir):
    """J1: the first boundary of every point."""
    index = S.build_cell_index(derived.federal_districts(spark, sf_dir))
    return S.assign_points(derived.points(spark, sf_dir), index).select("pid", "ordinal")


_POINTS = f"points AS ({O.POINTS})"
_PARCELS = f"verts AS ({O.PARCEL_VERTICES})"


def _parcels(spark, sf_dir):
    return derived.parcels(spark, sf_dir).withColumn("dataset", F.lit("parcels"))


@query("parcel_first_match", f"""
WITH {_POINTS}, {_PARCELS}, shifted AS (SELECT pid, lon + 80 AS lon, lat - 30 AS lat FROM points),
{O.contains_ctes('shifted', 'verts', 'hit')},
first AS (SELECT pid, min(ordinal) AS ordinal FROM hit GROUP BY pid)
SELECT p.pid, f.ordinal FROM points p LEFT JOIN first f USING (pid)""")
def parcel_first_match(spark, sf_dir):
    """J1 with as many boundaries as customers, joined on cells instead of broadcast."""
    index = S.build_cell_index(_parcels(spark, sf_dir))
    pts = derived.points(spark, sf_dir).withColumns({"lon": F.col("lon") + 80, "lat": F.col("lat") - 30})
    return S.assign_points(pts, index, broadcast=False).select("pid", "ordinal")


@query("box_candidates", f"""
WITH {_POINTS}, {_PARCELS}, shifted AS (SELECT pid, lon + 80 AS lon, lat - 30 AS lat FROM points),
b AS (SELECT ordinal, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM verts GROUP BY ordinal)
SELECT ordinal, count(*) AS points FROM shifted p JOIN b ON p.lon BETWEEN x0 AND x1 AND p.lat BETWEEN y0 AND y1 GROUP BY ordinal""")
def box_candidates(spark, sf_dir):
    """SP3, SP4."""
    pts = derived.points(spark, sf_dir).withColumns({"lon": F.col("lon") + 80, "lat": F.col("lat") - 30})
    pairs = SH.box_candidates(pts, _parcels(spark, sf_dir), 0.5)
    return pairs.groupBy("ordinal").agg(F.count(F.lit(1)).alias("points"))


@query("bounding_boxes", f"""
WITH {_PARCELS} SELECT ordinal, min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y FROM verts GROUP BY ordinal""")
def bounding_boxes(spark, sf_dir):
    """SP1."""
    return S.spatial_index(_parcels(spark, sf_dir)).select("ordinal", "bbox.*")


@query("overall_box", f"""
WITH {_PARCELS} SELECT 'parcels' AS dataset, min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y,
  count(DISTINCT ordinal) AS features FROM verts""")
def overall_box(spark, sf_dir):
    """SP2."""
    return S.overall_box(S.spatial_index(_parcels(spark, sf_dir)))


@query("vertex_centroid", f"""
WITH {_PARCELS},
c AS (SELECT ordinal, part, avg(lon) AS lon, avg(lat) AS lat, count(*) AS n FROM verts WHERE ring = 0 GROUP BY ordinal, part)
SELECT ordinal, round(arg_max(lon, (n, -part)), 9) AS lon, round(arg_max(lat, (n, -part)), 9) AS lat FROM c GROUP BY ordinal""")
def vertex_centroids(spark, sf_dir):
    """J8."""
    c = _parcels(spark, sf_dir).withColumn("c", vertex_centroid(F.col("geom")))
    return c.select("ordinal", F.round("c.lon", 9).alias("lon"), F.round("c.lat", 9).alias("lat"))


def _vertex_rows(df):
    return (
        df.select("ordinal", F.posexplode("geom").alias("part", "rings"))
        .select("ordinal", "part", F.posexplode("rings").alias("ring", "coords"))
        .select("ordinal", "part", F.posexplode("coords").alias("v", "c"))
        .select("ordinal", "part", "v", F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"))
    )


@query("decimated", f"""
WITH {_PARCELS}, n AS (SELECT *, count(*) OVER (PARTITION BY ordinal, part) AS n FROM verts),
k AS (SELECT * FROM n WHERE n <= 5 OR v % CAST(ceil(n / 5.0) AS INT) = 0 OR v = n - 1)
SELECT ordinal, part, CAST(row_number() OVER (PARTITION BY ordinal, part ORDER BY v) - 1 AS INT) AS v, lon, lat FROM k""")
def decimated(spark, sf_dir):
    """J10."""
    return _vertex_rows(SH.decimate_geometry(_parcels(spark, sf_dir), 5))


# For every two vertices of a ring, the vertex between them that is farthest from their segment; a span
# whose farthest vertex lies beyond the tolerance splits there, and the ends of all spans stay.
@query("simplified", f"""
WITH RECURSIVE {_PARCELS},
between AS (
  SELECT a.ordinal, a.part, a.v AS va, b.v AS vb, m.v AS vm, b.lon - a.lon AS dx, b.lat - a.lat AS dy, m.lon - a.lon AS ox, m.lat - a.lat AS oy
  FROM verts a JOIN verts b ON b.ordinal = a.ordinal AND b.part = a.part AND b.v > a.v + 1
  JOIN verts m ON m.ordinal = a.ordinal AND m.part = a.part AND m.v > a.v AND m.v < b.v),
along AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(1.0, greatest(0.0, (ox * dx + oy * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t FROM between),
far AS (
  SELECT ordinal, part, va, vb, vm, sqrt((ox - t * dx) * (ox - t * dx) + (oy - t * dy) * (oy - t * dy)) AS d,
    row_number() OVER (PARTITION BY ordinal, part, va, vb ORDER BY sqrt((ox - t * dx) * (ox - t * dx) + (oy - t * dy) * (oy - t * dy)) DESC, vm) AS n FROM along),
split AS (SELECT * FROM far WHERE n = 1 AND d > 0.25),
spans AS (
  SELECT ordinal, part, CAST(min(v) AS BIGINT) AS va, CAST(max(v) AS BIGINT) AS vb FROM verts GROUP BY ordinal, part
  UNION ALL
  SELECT s.ordinal, s.part, CAST(CASE WHEN side = 0 THEN s.va ELSE f.vm END AS BIGINT), CAST(CASE WHEN side = 0 THEN f.vm ELSE s.vb END AS BIGINT)
  FROM spans s JOIN split f ON f.ordinal = s.ordinal AND f.part = s.part AND f.va = s.va AND f.vb = s.vb CROSS JOIN (VALUES (0), (1)) t(side)),
kept AS (SELECT ordinal, part, va AS v FROM spans UNION SELECT ordinal, part, vb FROM spans)
SELECT ordinal, part, CAST(row_number() OVER (PARTITION BY ordinal, part ORDER BY v) - 1 AS INT) AS v, lon, lat FROM kept JOIN verts USING (ordinal, part, v)""")
def simplified(spark, sf_dir):
    """J11."""
    return _vertex_rows(SH.simplify_geometry(_parcels(spark, sf_dir), 0.25))


@query("boundary_page", f"""
WITH {_PARCELS}, b AS (SELECT ordinal, min(lon) AS min_x FROM verts GROUP BY ordinal)
SELECT 'parcels_' || ordinal AS id, min_x, (SELECT count(*) FROM b) AS total FROM b ORDER BY 'parcels_' || ordinal LIMIT 25 OFFSET 10""")
def boundary_page(spark, sf_dir):
    """J12, IO10: the page is the feature."""
    rows = feature_rows(_parcels(spark, sf_dir).withColumn("props", F.create_map(F.lit("X"), F.lit("y"))))
    return SH.boundary_page(rows, "parcels", 25, 10).select("id", "bbox.min_x", "total")


@query("distances", f"""
WITH addr_raw AS ({O.ADDR_RAW})
SELECT id, round({O.haversine('lon', 'lat', '-79.38', '43.65')}, 5) AS meters,
  round((lat - 43.65) * (lat - 43.65) + (lon + 79.38) * (lon + 79.38) * 0.53, 9) AS planar FROM addr_raw""")
def distances(spark, sf_dir):
    """J5, J6."""
    here = (F.lit(-79.38), F.lit(43.65))
    return derived.addresses(spark, sf_dir).select(
        "id", F.round(haversine(F.col("lon"), F.col("lat"), *here), 5).alias("meters"),
        F.round(planar_order(F.col("lon"), F.col("lat"), *here), 9).alias("planar"),
    )


_PATHS = "CASE n_regionkey WHEN 0 THEN 'ontarioridings-2022' WHEN 1 THEN 'quebecridings-2025' WHEN 2 THEN 'bcridings-2022' WHEN 3 THEN 'abridings-2022' ELSE 'nsridings-2022' END"


def two_level(points: str) -> str:
    return f"""
verts AS ({O.VERTICES}), shifted_verts AS (SELECT ordinal, part, ring, v, lon + 0.5 AS lon, lat + 0.5 AS lat FROM verts),
{O.contains_ctes(points, 'verts', 'hit1')}, {O.contains_ctes(points, 'shifted_verts', 'hit2')},
fed AS (SELECT h.pid, min(h.ordinal) AS ordinal FROM hit1 h GROUP BY h.pid),
fedn AS (SELECT f.pid, n.n_name AS district, {_PATHS} AS province_dataset, n.n_regionkey AS region FROM fed f JOIN nation n ON n.n_nationkey = f.ordinal),
prov AS (SELECT h.pid, min(h.ordinal) AS ordinal FROM hit2 h JOIN nation n ON n.n_nationkey = h.ordinal JOIN fedn ON fedn.pid = h.pid
  WHERE n.n_regionkey = fedn.region GROUP BY h.pid),
two AS (SELECT p.pid, fedn.district, fedn.province_dataset, 'P_' || n.n_name AS province_district
  FROM {points} p LEFT JOIN fedn USING (pid) LEFT JOIN prov USING (pid) LEFT JOIN nation n ON n.n_nationkey = prov.ordinal)"""


@query("two_level_lookup", f"WITH {_POINTS}, {two_level('points')} SELECT * FROM two")
def two_level_lookup(spark, sf_dir):
    """J3, TX23, TX24."""
    pts = derived.points(spark, sf_dir).withColumn("dataset", F.lit("federalridings-2024"))
    return BL.two_level_lookup(pts, boundaries(spark, sf_dir)).select(
        "pid", F.col("district_name").alias("district"), "province_dataset",
        F.col("province_name").alias("province_district"),
    )


def boundaries(spark, sf_dir):
    return BL.Boundaries(
        union_boundaries(derived.federal_districts(spark, sf_dir), derived.provincial_districts(spark, sf_dir))
    )
