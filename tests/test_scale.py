"""Forced skew paths, brute-force comparisons, stream restarts and plan checks."""

import random

from pyspark.sql import functions as F

from geoweave.functions.geometry import geometry_contains
from geoweave.operators import events as E
from geoweave.operators import skew
from geoweave.operators import spatial as S
from geoweave.operators.asof import neighbours
from geoweave.operators.nearest import nearest_address
from geoweave.operators.running import running
from geoweave.operators.shapes import _keep_far_vertices
from geoweave.plans.geocode_queries import store
from geoweave.sources import derived


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_join_keeps_every_row(spark):
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(
        spark.createDataFrame([(7, 1)], "k bigint, v bigint"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = skew.hot_keys(counts, ["k"], "n", rows_per_task=50)
    assert hot.count() == 1
    salted = skew.salted_join(left, right, ["k"], ["id"], "left", hot)
    plain = left.join(right, "k", "left")
    assert sorted(map(tuple, salted.select("k", "id", "v").collect()), key=str) == sorted(
        map(tuple, plain.select("k", "id", "v").collect()), key=str)


def test_point_in_polygon_against_direct_test(spark, sf_dir):
    parcels = derived.parcels(spark, sf_dir).withColumn("dataset", F.lit("p"))
    rnd = random.Random(5)
    pts = spark.createDataFrame(
        [(i, rnd.choice([rnd.uniform(0, 20), rnd.randrange(320) / 16]), rnd.choice([rnd.uniform(0, 20), rnd.randrange(320) / 16]))
         for i in range(1500)], "pid int, lon double, lat double")
    direct = {
        r.pid: r.o for r in pts.join(parcels, geometry_contains(F.col("geom"), F.col("lon"), F.col("lat")))
        .groupBy("pid").agg(F.min("ordinal").alias("o")).collect()}
    assert direct
    for side in (None, 0.3):
        index = S.build_cell_index(parcels, side)
        for broadcast in (True, False):
            got = {r.pid: r.ordinal for r in S.assign_points(pts, index, broadcast=broadcast).collect()}
            assert len(got) == 1500
            assert {k: v for k, v in got.items() if v is not None} == direct


def test_hole_edge_is_outside(spark):
    ring = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    f = spark.createDataFrame([("d", 0, [[ring(0.0, 10.0), ring(4.0, 6.0)]])], "dataset string, ordinal int, geom array<array<array<array<double>>>>")
    pts = spark.createDataFrame([(1, 0.0, 5.0), (2, 4.0, 5.0), (3, 5.0, 5.0), (4, 3.0, 5.0), (5, 11.0, 5.0)], "pid int, lon double, lat double")
    got = {r.pid: r.ordinal for r in S.assign_points(pts, S.build_cell_index(f)).collect()}
    assert got == {1: 0, 2: None, 3: None, 4: 0, 5: None}


def test_points_are_not_shuffled(spark, sf_dir):
    index = S.build_cell_index(derived.federal_districts(spark, sf_dir))
    assert index.fits_broadcast
    plan = plan_of(S.assign_points(derived.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pid"), F.col("value").alias("lon"), F.col("value").alias("lat")), index))
    assert "BroadcastHashJoin" in plan
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_nearest_against_brute_force(spark):
    rnd = random.Random(11)
    refs = [(i, round(rnd.gauss(-79, 0.05), 5), round(rnd.gauss(43, 0.05), 5)) for i in range(2000)]
    refs += [(5000 + i, -79.0, 43.0) for i in range(500)]  # very many at one place
    pts = [(i, round(rnd.uniform(-79.4, -78.6), 4), round(rnd.uniform(42.6, 43.4), 4)) for i in range(200)] + [(900, -79.0, 43.0)]
    r = spark.createDataFrame(refs, "id bigint, lon double, lat double")
    p = spark.createDataFrame(pts, "pid bigint, lon double, lat double")
    got = {x.pid: x.row.id if x.row else None for x in nearest_address(p, r, []).collect()}
    from math import atan2, cos, radians, sin, sqrt

    def dist(a, b):
        h = sin(radians(b[2] - a[2]) / 2) ** 2 + cos(radians(a[2])) * cos(radians(b[2])) * sin(radians(b[1] - a[1]) / 2) ** 2
        return round(6371000.0 * 2 * atan2(sqrt(h), sqrt(1 - h)), 6)

    for q in pts:
        want = None
        for w in (0.0025, 0.01, 0.05, 0.25):
            box = [x for x in refs if q[1] - w <= x[1] <= q[1] + w and q[2] - w <= x[2] <= q[2] + w]
            if box:
                want = min((dist(q, x), x[0]) for x in box)[1]
                break
        assert got[q[0]] == want


def test_neighbours(spark):
    rnd = random.Random(3)
    refs = {(k, rnd.randrange(5000)) for k in range(3) for _ in range(200)}
    probes = {(k, rnd.randrange(-100, 6000)) for k in range(4) for _ in range(150)}
    to = lambda rows: spark.createDataFrame(sorted(rows), "k int, v bigint")
    for r in neighbours(to(refs), to(probes), ["k"], 64).collect():
        mine = [v for k, v in refs if k == r.k]
        assert r.prev_v == max((v for v in mine if v <= r.v), default=None)
        assert r.next_v == min((v for v in mine if v > r.v), default=None)


def test_running_over_one_hot_key(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 7 % 1000).alias("t"), F.col("id").alias("i"), (F.col("id") % 5).alias("x"))
    got = running(df, ["k"], "t", "i", 50, sums={"s": F.col("x")}, maxima={"m": F.col("x")})
    rows = sorted((r.t, r.i, r.x, r.s, r.m) for r in got.collect())
    total, top = 0, None
    for _, _, x, s, m in rows:
        total, top = total + x, x if top is None else max(top, x)
        assert (s, m) == (total, top)


def test_anchored_windows_on_one_hot_key(spark):
    rnd = random.Random(9)
    times = sorted(rnd.randrange(4_000) for _ in range(1500)) + [20_000, 20_030, 20_061]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(times)], "event_id bigint, s bigint, key_id int").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), "key_id")
    got = {r.event_id: (r.opened_at, r.in_window) for r in E.anchored_windows(df, ["key_id"], 60).collect()}
    opened, n = None, 0
    for i, t in enumerate(times):
        if opened is None or t > opened + 60:
            opened, n = t, 0
        n += 1
        assert got[i] == (opened * 1_000_000, n)


def test_simplify_against_recursion():
    import numpy as np

    def segment(p, a, b):
        d = b - a
        t = 0.0 if not d.any() else min(1.0, max(0.0, float((p - a) @ d) / float(d @ d)))
        return float(np.linalg.norm(p - a - t * d))

    def recursive(line, tol):
        if len(line) <= 2:
            return [tuple(c) for c in line]
        far = max(range(1, len(line) - 1), key=lambda i: (segment(line[i], line[0], line[-1]), -i))
        if segment(line[far], line[0], line[-1]) <= tol:
            return [tuple(line[0]), tuple(line[-1])]
        return recursive(line[: far + 1], tol)[:-1] + recursive(line[far:], tol)

    rng = np.random.default_rng(4)
    for _ in range(20):
        line = rng.integers(0, 50, size=(30, 2)).astype(float)
        assert [tuple(c) for c in _keep_far_vertices(line, 5.0)] == recursive(line, 5.0)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(derived.request_log(spark, sf_dir).where("ok").select("key_id"))
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))]" in plan
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan


def test_no_nested_loops_in_the_cascade(spark, sf_dir):
    from geoweave.operators import geocode as G

    plan = plan_of(G.geocode(derived.requests(spark, sf_dir), store(spark, sf_dir), ["ON", "QC"]))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
