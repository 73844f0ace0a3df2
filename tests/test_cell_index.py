"""The cell index against the direct test, on rough shapes, and its size on a very detailed boundary."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoweave.functions.geometry import GEOM_TYPE, geometry_contains
from geoweave.operators import spatial as S

SCHEMA = f"dataset string, ordinal int, geom {GEOM_TYPE}"


def star(rnd, x, y, n, size):
    """A ring with in- and outward spikes, closed or not."""
    ring = []
    for i in range(n):
        r = size * rnd.choice([0.2, 0.5, 1.0]) * rnd.uniform(0.8, 1.2)
        ring.append([x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)])
    return ring + ring[:1] if rnd.random() < 0.7 else ring


def steps(rnd, x, y, n):
    """A ring on a lattice: level, upright and repeated edges, vertices on cell borders, crossing itself."""
    ring = [[x, y]]
    for _ in range(n):
        px, py = ring[-1]
        ring.append(rnd.choice([[px + rnd.randint(-3, 3) / 2, py], [px, py + rnd.randint(-3, 3) / 2], [px + 0.5, py + 0.5], [px, py]]))
    return ring


def flat(rnd, x, y):
    """Edges so flat that the tolerance of the crossing test moves their crossings far along."""
    ring = [[x, y]]
    for _ in range(8):
        ring.append([x + rnd.uniform(0, 3), ring[-1][1] + rnd.choice([-1, 1]) * rnd.choice([1e-11, 9.9e-11, 1.1e-10, 1e-9, 1e-7, 0.0])])
    return ring + [[x + 1.5, y + 2.0]]


def holed(rnd, ring):
    """A ring with vertices without coordinates."""
    return [[None, p[1]] if rnd.random() < 0.08 else [p[0], float("nan")] if rnd.random() < 0.08 else p for p in ring]


def shapes(rnd):
    rows = []
    for i in range(30):
        x, y = rnd.uniform(0, 10), rnd.uniform(0, 10)
        outer = star(rnd, x, y, rnd.randint(3, 60), rnd.uniform(0.3, 4))
        rows.append([[outer, star(rnd, x, y, 7, 0.3)], [steps(rnd, float(round(x)), float(round(y)), rnd.randint(2, 30))]])
        rows.append([[flat(rnd, x, y)], [holed(rnd, outer)]])
    return [("d", i, geom) for i, geom in enumerate(rows)]


@pytest.mark.parametrize("side", [None, 0.07])
def test_rough_shapes_against_the_direct_test(spark, side):
    rnd = random.Random(11)
    rows = shapes(rnd)
    features = spark.createDataFrame(rows, SCHEMA)
    vertices = [v for _, _, geom in rows for part in geom for ring in part for v in ring if None not in v and v[1] == v[1]]
    pts = [(rnd.uniform(-2, 13), rnd.uniform(-2, 13)) for _ in range(600)]
    pts += [(rnd.randint(-4, 26) / 2, rnd.randint(-4, 26) / 2) for _ in range(300)]
    pts += [(v[0] + rnd.choice([0, 0.3, -0.3]), v[1]) for v in rnd.sample(vertices, 300)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "pid int, lon double, lat double").cache()
    index = S.build_cell_index(features, side)
    # All boundaries that hold a point, not the first alone.
    rows = index.rows.withColumnsRenamed({"cx": "_cx", "cy": "_cy"})
    cell = lambda c: F.floor(F.col(c) / index.side)
    got = points.join(rows, (cell("lon") == F.col("_cx")) & (cell("lat") == F.col("_cy"))).where(
        F.col("rings").isNull() | S.rings_contain(F.col("rings"), F.col("lon"), F.col("lat")))
    boxed = S.spatial_index(features).where("true")
    in_cells = lambda c, lo, hi: cell(c).between(F.floor(F.col(f"bbox.{lo}") / index.side), F.floor(F.col(f"bbox.{hi}") / index.side))
    want = points.join(boxed, in_cells("lon", "min_x", "max_x") & in_cells("lat", "min_y", "max_y")).where(
        geometry_contains(F.col("geom"), F.col("lon"), F.col("lat")))
    pairs = lambda df: {(r.pid, r.ordinal) for r in df.select("pid", "ordinal").collect()}
    found, direct = pairs(got), pairs(want)
    assert len(direct) > 1000
    assert found == direct


def test_index_grows_with_the_edges(spark):
    """A boundary of very many vertices, all of whose edges cross the same few rows of cells."""
    n = 200_000
    ring = spark.range(n).select(
        F.array_sort(F.collect_list(F.struct("id", F.array(F.col("id") / n * 10, F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0)).alias("c")))).alias("s")
    ).select(F.concat(F.transform("s", lambda e: e["c"]), F.array(F.array(F.lit(10.0), F.lit(-1.0)), F.array(F.lit(0.0), F.lit(-1.0)))).alias("ring"))
    comb = ring.select(F.lit("d").alias("dataset"), F.lit(0).alias("ordinal"), F.array(F.array("ring")).alias("geom"))
    index = S.build_cell_index(comb, 0.25)
    # Four rows of cells high; a few more for cell borders. Edges left of a cell are in none of its rows.
    assert n < index.edges < 7 * n
    assert index.cells < 500
    pts = spark.createDataFrame([(0, 5.0, -0.5), (1, 5.0, 1.5), (2, 10.5, 0.0), (3, 9.999999, 0.0)], "pid int, lon double, lat double")
    got = {r.pid: r.ordinal for r in S.assign_points(pts, index).collect()}
    plain = pts.join(comb.drop("dataset"), F.lit(True)).select("pid", geometry_contains(F.col("geom"), F.col("lon"), F.col("lat")).alias("inside"))
    assert got == {r.pid: 0 if r.inside else None for r in plain.collect()}
    assert got[0] == 0 and got[1] is None


def test_rows_do_not_grow_with_the_width(spark):
    """A saw of vertical teeth: twice the teeth, twice the rows' edges."""
    def edges(teeth):
        ring = [[0.0, -1.0]]
        for i in range(teeth):
            ring += [[i * 1.0, 0.0], [i + 0.5, 3.0]]
        ring += [[float(teeth), -1.0]]
        return S.build_cell_index(spark.createDataFrame([("d", 0, [[ring]])], SCHEMA), 1.0).edges

    few, many = edges(200), edges(400)
    assert many < 2.2 * few


def test_stacked_boundaries_are_met_only_up_to_the_first_match(spark, monkeypatch):
    """400 boundaries over one place: a point meets few of them, but all where only the last holds it."""
    met = []

    def counted(*args):
        out = joined(*args)
        met.append(out.count())
        return out

    joined = S.salted_join
    monkeypatch.setattr(S, "salted_join", counted)
    ring = lambda x, w: [[[[x, 0.0], [x + w, 0.0], [x + w, 1.0], [x, 1.0], [x, 0.0]]]]
    rows = [("d", i, ring(0.0, 0.5 if i % 2 else 0.4)) for i in range(399)] + [("d", 399, ring(0.0, 1.0))]
    features = spark.createDataFrame(rows, "dataset string, ordinal bigint, geom array<array<array<array<double>>>>")
    points = [(i, 0.05 + 0.001 * (i % 300), 0.5) for i in range(300)] + [(300, 0.45, 0.5), (301, 0.9, 0.5), (301, 0.9, 0.5), (None, 2.0, 0.5), (303, None, 0.5)]
    pts = spark.createDataFrame(points, "pid bigint, lon double, lat double")
    got = S.assign_points(pts, S.build_cell_index(features, side=4.0), broadcast=False)
    want = [(p, None if x is None or x > 1 else 399 if x > 0.5 else 1 if x > 0.4 else 0) for p, x, _ in points]
    order = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.select("pid", "ordinal").collect()), key=order) == sorted(want, key=order)
    assert sum(met) <= len(points) + 3 * 400 // S.PACK


def test_boundaries_far_from_all_points_are_not_cut_up(spark, monkeypatch):
    """900 squares, points near one corner: only squares there are cut up, into cells for that many points."""
    kept = {}

    def counted(df, name):
        out = cut(df, name)
        kept[name] = out.count()
        return out

    cut = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", counted)
    ring = lambda x, y: [[[[x, y], [x + 1.0, y], [x + 1.0, y + 1.0], [x, y + 1.0], [x, y]]]]
    features = spark.createDataFrame([("d", 30 * i + j, ring(2.0 * i, 2.0 * j)) for i in range(30) for j in range(30)], SCHEMA)
    pts = [(0, 0.5, 0.5), (1, 1.5, 0.5), (2, 2.0, 2.5), (2, 2.5, 0.25), (None, 3.0, 3.0), (4, -50.0, 0.5), (5, None, 0.5)]
    points = spark.createDataFrame(pts, "pid int, lon double, lat double")
    index = S.build_cell_index(features)
    got = S.assign_points(points, index, broadcast=False).select("pid", "lon", "ordinal").collect()
    want = [(0, 0.5, 0), (1, 1.5, None), (2, 2.0, 31), (2, 2.5, 30), (None, 3.0, 31), (4, -50.0, None), (5, None, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert kept["boundaries"] == 900
    assert 0 < kept["cells"] < 2_000
    # The same index takes points elsewhere, and is whole where it is asked for.
    far = points.withColumns({"lon": F.col("lon") + 40, "lat": F.col("lat") + 40})
    assert sorted(map(str, (r.ordinal for r in S.assign_points(far, index, broadcast=False).collect()))) == sorted(map(str, [620, None, 651, 650, 651, None, None]))
    assert index.rows.select("ordinal").distinct().count() == 900
