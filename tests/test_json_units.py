"""GeoJSON files read in byte ranges: same features, numbers and rejects wherever the ranges are cut."""

import json
import random

import pytest

from geoweave.sources import boundaries as B
from geoweave.sources.json_units import read_units

RING = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]


@pytest.fixture()
def cut_small(spark):
    """Byte ranges of 64 bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ["64", "0", "1"]):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def feature(name, **other):
    return {"type": "Feature", "properties": {"n": name, "extra": {"deep": [{"x": 1}]}}, "geometry": {"type": "Polygon", "coordinates": [RING]}} | other


ODD = ['a}b', 'c{"d":[', 'quote " and }', 'back\\slash\\', '\\"}', "é}ß{", "line\nbreak}", "", "]}", '"features":[{']


def collections(rng):
    items = [feature(name) for name in ODD] + [feature("x", type="Shape"), feature("y", geometry=None), None, 5,
                                               feature("z", geometry={"type": "Point", "coordinates": [1, 2]})]
    rng.shuffle(items)
    crs = {"type": "name", "properties": {"name": "urn}"}}
    links = [{"href": "}{"}, {"href": "features"}]
    orders = [
        {"type": "FeatureCollection", "crs": crs, "features": items, "bbox": [1, 2]},
        {"features": items, "links": links, "type": "FeatureCollection"},
        {"links": links, "bbox": [0, [{"a": {}}]], "crs": crs, "type": "FeatureCollection", "features": items},
        {"type": "FeatureCollection", "features": []},
        {"type": "Other", "features": items[:2]},
        {"type": "FeatureCollection", "name": "no list", "crs": crs},
        {"type": "FeatureCollection", "features": [None, *items, None]},
        feature("a file of one feature"),
    ]
    return [o for o in orders]


def plain(documents):
    """(good, bad) by whole-file parsing."""
    good, bad, first = [], [], 0
    for name, doc in sorted(documents.items()):
        items = doc.get("features")
        if not items:
            kind = doc.get("type")
            bad.append((name, None, "no features" if kind == "FeatureCollection" else "not a FeatureCollection"))
            continue
        for i, item in enumerate(items):
            item = item if isinstance(item, dict) else {}
            geometry = item.get("geometry") or {}
            if doc.get("type") != "FeatureCollection":
                bad.append((name, first + i, "not a FeatureCollection"))
            elif item.get("type") != "Feature":
                bad.append((name, first + i, "not a Feature"))
            elif not geometry:
                bad.append((name, first + i, "missing geometry"))
            elif geometry["type"] != "Polygon":
                bad.append((name, first + i, "missing or unsupported coordinates"))
            else:
                good.append((first + i, item["properties"]["n"]))
        first += len(items)
    return sorted(good), sorted(bad, key=str)


def loaded(spark, path):
    good, bad = B.read_geojson(spark, str(path), "d")
    return (
        sorted((r.ordinal, r.props["n"]) for r in good.collect()),
        sorted(((r.file.rsplit("/", 1)[1], r.ordinal, r.reject_reason) for r in bad.collect()), key=str),
    )


@pytest.mark.parametrize("seed,indent,ascii_only", [(1, None, True), (2, 1, False)])
def test_features_wherever_the_file_is_cut(spark, cut_small, tmp_path, seed, indent, ascii_only):
    documents = {f"f{i}.json": doc for i, doc in enumerate(collections(random.Random(seed)))}
    for name, doc in documents.items():
        end = "\n \n" if name == "f1.json" else ""
        (tmp_path / name).write_text(json.dumps(doc, indent=indent, ensure_ascii=ascii_only) + end, encoding="utf-8")
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 50
    assert loaded(spark, tmp_path) == plain(documents)


def test_broken_files_are_rejected_whole(spark, cut_small, tmp_path):
    text = json.dumps({"type": "FeatureCollection", "features": [feature("a"), feature("b")]})
    (tmp_path / "a.json").write_text(text[:-40])
    (tmp_path / "b.json").write_text("[1, 2]")
    (tmp_path / "c.json").write_text("no json at all")
    (tmp_path / "d.json").write_text(text)
    (tmp_path / "e.json").write_text("")
    good, bad = loaded(spark, tmp_path)
    assert good == [(0, "a"), (1, "b")]
    assert bad == [(f, None, "not a JSON object") for f in ("a.json", "b.json", "c.json")]


def test_one_file_is_read_by_several_tasks(spark, cut_small, tmp_path, monkeypatch):
    """Numbers stay those of the file also where its units are numbered in many slices."""
    monkeypatch.setattr(B, "UNIT_SLICE", 7)
    doc = {"type": "FeatureCollection", "features": [feature(f"n{i}") for i in range(300)]}
    (tmp_path / "one.json").write_text(json.dumps(doc))
    assert read_units(spark, str(tmp_path)).count() == 301
    good, bad = loaded(spark, tmp_path)
    assert good == [(i, f"n{i}") for i in range(300)] and not bad
