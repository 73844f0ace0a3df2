"""Geometry as Column expressions.

A geometry is an ``array<array<array<array<double>>>>``: polygons, rings, vertices, [lon, lat]. A
Polygon is a MultiPolygon of one. The first ring of a polygon is its outline, the others are holes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions import vocab

GEOM_TYPE = "array<array<array<array<double>>>>"

# --- fixed values -----------------------------------------------------------------------------
EDGE_TOLERANCE = 1e-10
LON_WEIGHT = 0.53  # squared cosine of latitude 43, for planar ordering only


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """J5: great-circle distance in metres."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_dlat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_dlon), 2.0
    )
    return vocab.EARTH_RADIUS_METERS * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar_order(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """J6: squared planar distance, good for ordering only."""
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2) * LON_WEIGHT


def in_box(lon: Column, lat: Column, box: Column) -> Column:
    """SP3: inclusive on all sides."""
    return lon.between(box["min_x"], box["max_x"]) & lat.between(box["min_y"], box["max_y"])


def bounding_box(geom: Column) -> Column:
    """SP1: box over all rings; bad coordinates are skipped; null when none is valid."""
    coords = F.filter(
        F.flatten(F.flatten(geom)),
        lambda c: (F.size(c) >= 2)
        & c[0].isNotNull() & c[1].isNotNull() & ~F.isnan(c[0]) & ~F.isnan(c[1]),
    )
    xs = F.transform(coords, lambda c: c[0])
    ys = F.transform(coords, lambda c: c[1])
    return F.when(
        F.size(coords) > 0,
        F.struct(
            F.array_min(xs).alias("min_x"),
            F.array_min(ys).alias("min_y"),
            F.array_max(xs).alias("max_x"),
            F.array_max(ys).alias("max_y"),
        ),
    )


def vertex_centroid(geom: Column) -> Column:
    """J8: vertex mean of the outline with most vertices, the first one on ties; (0, 0) if none.

    The closing vertex counts like any other.
    """
    outlines = F.transform(geom, lambda p: p[0])
    biggest = F.array_max(F.transform(outlines, lambda r: F.size(r)))
    ring = F.filter(outlines, lambda r: F.size(r) == biggest)[0]

    def mean(axis: int) -> Column:
        total = F.aggregate(ring, F.lit(0.0), lambda acc, c: acc + c[axis])
        return F.coalesce(total / F.size(ring), F.lit(0.0))

    return F.struct(mean(0).alias("lon"), mean(1).alias("lat"))


def number(value: Column) -> Column:
    """A coordinate, null where it is not a number: its edges then cross nothing."""
    return F.nullif(value, F.lit(float("nan")))


def ring_edges(ring: Column) -> Column:
    """Edges of a ring, each vertex with the one before it; empty below three vertices."""
    n = F.size(ring)
    before = F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), n - 1))
    edges = F.zip_with(
        ring,
        before,
        lambda a, b: F.struct(
            number(a[0]).alias("x1"), number(a[1]).alias("y1"), number(b[0]).alias("x2"), number(b[1]).alias("y2")
        ),
    )
    return F.filter(edges, lambda e: n >= 3)


def edges_contain(edges: Column, px: Column, py: Column, more: Column | None = None) -> Column:
    """SP5: on an edge, or an odd number of edges to the right.

    An edge that does not reach the height of the point adds nothing to either test, so ``edges``
    may be any subset of the ring that keeps those that do; ``more`` stands for the number of edges
    to the right that are left out.
    """

    def on_edge(e: Column) -> Column:
        cross = (py - e["y1"]) * (e["x2"] - e["x1"]) - (px - e["x1"]) * (e["y2"] - e["y1"])
        return (
            px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
            & (F.abs(cross) < EDGE_TOLERANCE)
        )

    def crossed(e: Column) -> Column:
        at = F.try_divide(
            (e["x2"] - e["x1"]) * (py - e["y1"]), e["y2"] - e["y1"] + F.lit(EDGE_TOLERANCE)
        )
        return ((e["y1"] > py) != (e["y2"] > py)) & (px < at + e["x1"])

    right = F.size(F.filter(edges, crossed))
    return F.exists(edges, on_edge) | ((right if more is None else right + more) % 2 == 1)


def polygon_contains(rings: Column, px: Column, py: Column) -> Column:
    """SP6: inside the outline and in no hole; a point on the edge of a hole is outside."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return edges_contain(ring_edges(rings[0]), px, py) & ~F.exists(
        holes, lambda h: edges_contain(ring_edges(h), px, py)
    )


def geometry_contains(geom: Column, px: Column, py: Column) -> Column:
    """SP7: any polygon contains the point; false for a null geometry."""
    return F.coalesce(F.exists(geom, lambda p: polygon_contains(p, px, py)), F.lit(False))


def decimate(line: Column, max_vertices: int) -> Column:
    """J10: every k-th vertex so that about ``max_vertices`` are left; the last one is always kept."""
    n = F.size(line)
    step = F.ceil(n / F.lit(max_vertices)).cast("int")
    kept = F.filter(line, lambda p, i: (i % step == 0) | (i == n - 1))
    return F.when((n <= 2) | (n <= max_vertices), line).otherwise(kept)
