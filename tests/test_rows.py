"""Every input row comes back once: repeated, missing and empty keys, many hot keys, many files, emptied partitions."""

import json
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from geoweave.operators import events as E
from geoweave.operators import geocode as G
from geoweave.operators import skew
from geoweave.operators.compare import exact_percentiles
from geoweave.operators import spatial as S
from geoweave.plans.bulk_lookup import bulk_lookup
from geoweave.plans.geocode_queries import PROVINCES, store
from geoweave.plans.spatial_queries import boundaries
from geoweave.sources import addresses as A
from geoweave.sources import boundaries as B
from geoweave.sources.store import snapshot


@pytest.fixture(scope="module")
def addresses(spark, sf_dir):
    return store(spark, sf_dir)


def requests_with_gaps(spark):
    """Null and '' in every combination of the text fields, with repeated and missing ids."""
    blank = [None, ""]
    rows = [(1, a, "M5V 2T6", c, s) for a, c, s in product(blank, blank, blank)]
    rows += [(None, "9 NOWHERE ST", p, "Toronto", "ON") for p in blank] + [(2, "9 NOWHERE ST", None, "Toronto", "ON")] * 2
    rows += [(None, None, None, None, None), (3, "", "", "", "")]
    return spark.createDataFrame(rows, "req_id bigint, address string, postal string, city string, state string")


@pytest.mark.parametrize("run", [G.geocode, G.geocode_postal, G.geocode_mixed])
def test_one_result_per_request(spark, addresses, run):
    asked = requests_with_gaps(spark)
    got = run(asked, addresses, PROVINCES)
    assert Counter(r.req_id for r in got.collect()) == Counter(r.req_id for r in asked.collect())
    # Null and '' ask the same, so they get the same.
    answers = {(r.method, r.error_code) for r in got.where("req_id = 1").collect()}
    assert len(answers) == 1


def test_bulk_lookup_with_repeated_and_missing_ids(spark, sf_dir, addresses):
    fields = ["address", "postal", "city", "state", "country", "lat", "lon", "return_raw", "include_raw", "method_raw"]
    rows = [
        (i, "/api/combined", None, postal, None, "ON", None, lat, lon, "municipality", None, None)
        for i in (1, 1, None, None) for postal, lat, lon in ((None, 44.0, -79.0), ("M5V 2T6", None, None), ("", None, None))
    ]
    schema = "req_id bigint, path string, " + ", ".join(f"{f} {'double' if f in ('lat', 'lon') else 'string'}" for f in fields)
    asked = spark.createDataFrame(rows, schema)
    got = bulk_lookup(asked, addresses, boundaries(spark, sf_dir), PROVINCES).collect()
    assert Counter(r.req_id for r in got) == {1: 6, None: 6}
    assert len({(r.district, r.method, r.error) for r in got}) <= 4


def squares(spark, *corners):
    rows = [(i, [[[[x, y], [x + 1.0, y], [x + 1.0, y + 1.0], [x, y + 1.0], [x, y]]]]) for i, (x, y) in enumerate(corners)]
    return spark.createDataFrame(rows, "ordinal int, geom array<array<array<array<double>>>>").withColumn("dataset", F.lit("d"))


@pytest.mark.parametrize("broadcast", [True, False])
def test_points_come_back_once_whatever_their_id(spark, broadcast):
    index = S.build_cell_index(squares(spark, (0.0, 0.0), (3.0, 3.0)))
    rows = [("a", 0.5, 0.5), ("a", 3.5, 3.5), ("a", 9.0, 9.0), (None, 0.5, 0.5), (None, 3.2, 3.2), (None, None, 1.0)]
    points = spark.createDataFrame(rows, "pid string, lon double, lat double")
    got = S.assign_points(points, index, broadcast=broadcast).collect()
    want = Counter({("a", 0): 1, ("a", 1): 1, ("a", None): 1, (None, 0): 1, (None, 1): 1, (None, None): 1})
    assert Counter((r.pid, r.ordinal) for r in got) == want


def test_more_hot_keys_than_a_list_would_hold(spark):
    left = spark.range(9_000).select((F.col("id") % 3_000).alias("k"), "id")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = skew.hot_keys(counts, ["k"], "n", rows_per_task=2)
    assert hot.count() == 3_000
    right = spark.range(0, 3_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.salted_join(left, right, ["k"], ["id"], "left", hot)
    assert got.count() == 9_000 and got.where("v = 2 * k").count() == 4_500


def test_missing_keys_and_times_stay(spark):
    rows = [
        (1, "2024-01-01 00:00:00", 1, 1, False), (2, "2024-01-01 00:00:01", None, 1, False), (3, "2024-01-01 00:00:02", None, 1, False),
        (4, None, 1, 1, False), (5, None, None, None, False), (6, "2024-01-01 00:00:03", None, None, True),
    ]
    log = spark.createDataFrame(rows, "event_id bigint, ts string, key_id bigint, customer_id bigint, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    quota = {
        r["event_id"]: (r["count"], r["allowed"]) for r in E.daily_quota(log, 2).collect()
    }
    assert quota == {1: (1, True), 2: (1, True), 3: (2, True), 4: (1, True), 5: (1, True), 6: (2, False)}
    window = {r.event_id: (r.in_window, r.allowed) for r in E.rate_window(log, 1, seconds=60).collect()}
    assert window == {1: (1, True), 2: (1, True), 3: (2, False), 4: (None, None), 5: (None, None), 6: (3, False)}
    hits = {r.event_id: r.hit for r in E.ttl_hits(log, seconds=60).collect()}
    assert hits == {1: False, 2: False, 3: True, 4: None, 5: None, 6: True}
    alerts = {r.event_id: r.failure_count for r in E.failure_alerts(log, "key_id", 2).collect()}
    assert alerts == {1: 2, 2: 2, 3: 3}


def collection(x, name=None):
    ring = [[x, 0.0], [x + 1.0, 0.0], [x + 1.0, 1.0], [x, 1.0], [x, 0.0]]
    props = {} if name is None else {"FED_NUM": name}
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": props, "geometry": {"type": "Polygon", "coordinates": [ring]}}]})


def test_features_of_several_files(spark, tmp_path):
    for i, x in enumerate((0.0, 5.0, 9.0)):
        (tmp_path / f"part {i}.json").write_text(collection(x))
    features, bad = B.read_geojson(spark, str(tmp_path), "d")
    assert bad.count() == 0
    points = spark.createDataFrame([("x", 0.5, 0.5), ("y", 5.5, 0.5), ("z", 9.5, 0.5)], "pid string, lon double, lat double")
    got = S.with_district(S.assign_points(points, S.build_cell_index(features)), features).collect()
    assert len(got) == 3 and len({r.ordinal for r in got}) == 3
    both = B.union_boundaries(features, features)
    assert both.select("dataset", "ordinal").distinct().count() == 6
    assert B.feature_rows(both).select("id").distinct().count() == 6


def test_ids_that_meet(spark):
    rows = [(0, {"FED_NUM": "1"}), (1, {}), (2, {"FED_NUM": "1"}), (3, {})]
    features = squares(spark, *[(float(i), 0.0) for i in range(4)]).drop("ordinal").limit(1).select("geom", "dataset").crossJoin(
        spark.createDataFrame(rows, "ordinal int, props map<string, string>")
    )
    ids = [r.id for r in B.feature_rows(features).orderBy("ordinal").collect()]
    assert ids[0] == "d_1" and ids[3] == "d_3" and len(set(ids)) == 4


def write_csv(path, rows):
    head = "Latitude,Longitude,Province,City,Civic Number,str_name,Street Type,Street Direction,Unit,Postal Code,Full Address"
    path.write_text("\n".join([head, *[f"43.{i},-79.{i},{p},Toronto,{i},MAIN,ST,,,M5V 2T{i},x" for i, p in rows]]) + "\n")


def test_replacing_with_fewer_rows_and_with_none(spark, tmp_path):
    root, file = str(tmp_path / "store"), tmp_path / "a.csv"
    counts = []
    for rows in ([(1, "ON"), (2, "ON"), (3, "QC")], [(1, "ON"), (3, "QC")], [(3, "QC")]):
        write_csv(file, rows)
        A.import_province(spark, str(file), root, "QC", "v")
        log = A.import_province(spark, str(file), root, "ON", "v").first()
        names = ("addresses", "postal_centroids", "city_centroids", "street_ranges", "street_search")
        stored = [snapshot(spark, root).read(n, ["ON"]).count() for n in names]
        assert snapshot(spark, root).read("addresses").where("province = 'QC'").count() == 1
        counts.append((log.row_count, stored[0], stored[1], min(stored[2:])))
    assert counts == [(2, 2, 2, 1), (1, 1, 1, 1), (0, 0, 0, 0)]


def test_resuming_a_load_that_broke_off(spark, tmp_path):
    root, half, whole = str(tmp_path / "store"), tmp_path / "half.csv", tmp_path / "whole.csv"
    write_csv(half, [(1, "ON"), (2, "ON")])
    write_csv(whole, [(i, "ON") for i in range(1, 7)])
    A.import_province(spark, str(half), root, "ON", "v1")
    ids = {r.id for r in snapshot(spark, root).read("addresses").collect()}
    assert A.import_province(spark, str(whole), root, "ON", "v2", resume=True).first().row_count == 6
    assert ids < {r.id for r in snapshot(spark, root).read("addresses").collect()}
    assert A.import_province(spark, str(whole), root, "ON", "v3", resume=True).first().row_count == 6


def test_percentiles_where_far_values_stretch_the_range(spark):
    values = [float(i % 700) / 7 for i in range(3_000)] + [1e12, 1e9, -1e15]
    rows = spark.createDataFrame([("a", v) for v in values] + [(None, v) for v in values[:50]] + [("b", None)], "g string, v double")
    got = {(r.g, r.p): r.value for r in exact_percentiles(rows, ["g"], "v", [0.0, 0.5, 0.99, 1.0], buckets=16, at_once=5).collect()}
    want = {}
    for g, all_values in (("a", sorted(values)), (None, sorted(values[:50]))):
        n = len(all_values)
        want |= {(g, p): all_values[min(n - 1, int(n * p))] for p in (0.0, 0.5, 0.99, 1.0)}
    assert got == want
