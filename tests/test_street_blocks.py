"""The stored street index: same windows as the index without blocks, few blocks read, segments replaced alone."""

import random

import pytest
from pyspark.sql import functions as F

from geoweave.operators import street_blocks as T
from geoweave.operators import suggest as G
from geoweave.sources import addresses as A
from geoweave.sources.store import snapshot
from tests.test_rows import write_csv

STREET = ("province string, city_key string, street_key string, min_civic int, max_civic int, lat double, lon double, "
          "address_count long, city string, suggest_text string")
SEARCH = ("query_id long, q string, province string, bias_lat double, bias_lon double, "
          "box_min_lat double, box_max_lat double, box_min_lon double, box_max_lon double")
SHOWN = ["query_id", "rank", "doc_id", "in_range"]


def answers(queries, index, limit=50):
    found = G.search_streets(queries, index, limit).select(*SHOWN, F.round("score", 9).alias("score"))
    return sorted(map(tuple, found.collect()))


def streets(spark, rng, n, counts):
    names, types, towns = ["STONE", "STEEL", "ROCK", "ROCKY-HILL", "PARK"], ["ST", "AVE", "RD"], ["STOKE", "PARIS", "ROME"]
    rows = {}
    for i in range(n):
        province = rng.choice(["ON", "QC", "BC"])
        name, kind, town = f"{rng.choice(names)} {rng.choice(names)}{i % 7}", rng.choice(types), rng.choice(towns)
        key = (province, f"{town}|{province}", f"{name}|{kind}")
        rows[key] = (*key, 1, 99, 45 + rng.random(), -75 + rng.random(), rng.choice(counts), town,
                     f"{name} {kind} {town} {province}")
    return spark.createDataFrame(list(rows.values()), STREET)


@pytest.mark.parametrize("counts", [[1], [1, 2, 3], list(range(1, 5000))])
def test_windows_equal_those_without_blocks(spark, monkeypatch, counts):
    """Ties, words in any order, provinces, boxes and bias points, with blocks so small that every search goes on."""
    monkeypatch.setattr(T, "BLOCK", 4)
    rng = random.Random(7)
    rows = streets(spark, rng, 500, counts)
    asked = ["sto", "stone st", "7 rock", "park paris", "rocky-hill", "hill", "st rome", "rome st", "ste pa", "roc ave on", "zzz", "on"]
    queries = []
    for i, q in enumerate(asked * 2):
        bias = (45.5, -74.5) if i % 5 == 4 else (None, None)
        box = (45.2, 45.9, -74.9, -74.3) if i % 5 == 2 else (None,) * 4
        queries.append((i, q, rng.choice([None, None, "ON", "QC, BC"]), *bias, *box))
    queries = spark.createDataFrame(queries, SEARCH)
    whole = answers(queries, G.StreetIndex(rows))
    assert len({r[0] for r in whole}) > 15
    assert answers(queries, T.BlockIndex(*T.segments(rows))) == whole


def test_a_common_prefix_reads_few_blocks(spark, monkeypatch):
    """Of 40,000 streets that all match, and of as many again that match only by a later word."""
    n = F.col("id")
    rows = spark.range(80000).select(
        F.when(n % 2 == 0, "ON").otherwise("QC").alias("province"), F.lit("SAULT|X").alias("city_key"),
        F.concat(F.when(n < 40000, "SAND").otherwise("OAK"), n, F.lit("|ST")).alias("street_key"),
        F.lit(1).alias("min_civic"), F.lit(9).alias("max_civic"), F.lit(45.0).alias("lat"), F.lit(-75.0).alias("lon"),
        (n + 1).alias("address_count"), F.lit("SAULT").alias("city"),
        F.concat(F.when(n < 40000, "SAND").otherwise("OAK"), n, F.lit(" ST SAULT")).alias("suggest_text"),
    )
    read = []
    real = T.checked_streets
    monkeypatch.setattr(T, "checked_streets", lambda fetched, *rest: read.append(fetched.count()) or real(fetched, *rest))
    queries = spark.createDataFrame([(1, "san", None, *[None] * 6), (2, "sault", "ON", *[None] * 6)], SEARCH)
    got = answers(queries, T.BlockIndex(*T.segments(rows)))
    assert [r[2].split("\t")[1] for r in got if r[0] == 1][:2] == ["SAND39999|ST", "SAND39998|ST"]
    assert len(got) == 100
    # A block of each list of three: two provinces for the first search, one for the second.
    assert sum(read) <= 3 * 2 * T.BLOCK


def test_a_replaced_province_rewrites_its_segment_alone(spark, tmp_path):
    root = str(tmp_path / "store")
    old, new = tmp_path / "old.csv", tmp_path / "new.csv"
    write_csv(old, [(1, "ON"), (2, "ON"), (3, "QC")])
    write_csv(new, [(5, "ON")])
    for province in ("ON", "QC"):
        A.import_province(spark, str(old), root, province, "v1", search_index=True)
    before = snapshot(spark, root)
    A.import_province(spark, str(new), root, "ON", "v2")  # the index is there, so it follows
    after = snapshot(spark, root)
    for name in A.INDEX_TABLES:
        kept = [{r[2] for r in s.rows if r[0] == name and r[1] == "QC"} for s in (before, after)]
        gone = [{r[2] for r in s.rows if r[0] == name and r[1] == "ON"} for s in (before, after)]
        assert kept[0] == kept[1] and kept[0] and not gone[0] & gone[1]
    for shot in (before, after):
        index, plain = A.street_index(shot), G.StreetIndex(shot.read("street_search"))
        assert sorted(map(str, index.docs.collect())) == sorted(map(str, plain.docs.select(*index.docs.columns).collect()))
        assert sorted(map(str, index.frequency.collect())) == sorted(map(str, plain.frequency.collect()))
        assert (index.n_docs, index.avg_words) == (plain.n_docs, plain.avg_words)


def test_an_empty_index_and_no_searches(spark):
    none = streets(spark, random.Random(1), 1, [1]).limit(0)
    query = spark.createDataFrame([(1, "stone", None, *[None] * 6)], SEARCH)
    assert answers(query, T.BlockIndex(*T.segments(none))) == []
    one = streets(spark, random.Random(1), 1, [1])
    assert answers(query.limit(0), T.BlockIndex(*T.segments(one))) == []


def test_searches_of_one_text_share_its_matches(spark, monkeypatch):
    """Searches that differ in bias point alone look their text up once; rows of few streets, hot keys and shuffled joins change nothing."""
    rows = streets(spark, random.Random(3), 300, [1, 2, 3])
    asked = [(i, q, None, 45 + i / 50, -75 + i / 60, *(None,) * 4) for i in range(40) for q in ["sto", "stone st"][i % 2 :][:1]]
    queries = spark.createDataFrame(asked, SEARCH)
    index, looked, real = G.StreetIndex(rows), [], G.match_streets
    monkeypatch.setattr(G, "match_streets", lambda searches, *rest: looked.append(searches.count()) or real(searches, *rest))
    whole = answers(queries, index)
    assert looked == [2]
    assert len({r[0] for r in whole}) == 40 and max(r[1] for r in whole) == 50
    for name, value in (("STREETS_PER_ROW", 4), ("BROADCAST_MAX_ROWS", 0), ("QUERIES_PER_TASK", 1)):
        monkeypatch.setattr(G, name, value)
    assert answers(queries, index) == whole


def test_queries_that_share_an_id_are_ranked_together(spark):
    rows = streets(spark, random.Random(3), 300, [1, 2, 3])
    queries = spark.createDataFrame([(1, "stone st", None, *(None,) * 6), (1, "steel ave", None, *(None,) * 6)], SEARCH)
    found = G.search_streets(queries, G.StreetIndex(rows), 7).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 8))


def test_stored_searches_by_distance_share_matches(spark, monkeypatch):
    """Of the stored index too, the blocks of a word are read once for all bias points."""
    rows = streets(spark, random.Random(5), 300, [1, 2, 3])
    queries = spark.createDataFrame([(i, "stone st", None, 45 + i / 50, -75 + i / 60, *(None,) * 4) for i in range(20)], SEARCH)
    looked, real = [], G.match_streets
    monkeypatch.setattr(G, "match_streets", lambda searches, *rest: looked.append(searches.count()) or real(searches, *rest))
    stored = answers(queries, T.BlockIndex(*T.segments(rows)))
    assert looked == [1] and {r[0] for r in stored} == set(range(20))
