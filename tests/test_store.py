"""Versions of stored tables: all or nothing, whatever step of a load breaks off."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.sources import addresses as A
from geoweave.sources import boundaries as B
from geoweave.sources import store as S
from tests.test_rows import write_csv

NAMES = [*A.TABLES, "imports"]


def content(spark, root):
    shot = S.snapshot(spark, root)
    return {n: sorted(map(str, shot.read(n).collect())) for n in NAMES}


class Broken(Exception):
    pass


def breaking_at(monkeypatch, step):
    """The ``step``-th write of a load, or its publishing, fails after the files are written."""
    seen = []
    real_write, real_publish = S.Commit._write, S.Commit.publish

    def count():
        seen.append(1)
        if len(seen) == step:
            raise Broken

    def write(self, *args):
        done = real_write(self, *args)
        count()
        return done

    def publish(self):
        count()
        return real_publish(self)

    monkeypatch.setattr(S.Commit, "_write", write)
    monkeypatch.setattr(S.Commit, "publish", publish)
    return seen


def test_a_load_that_breaks_off_anywhere_changes_nothing(spark, tmp_path, monkeypatch):
    root, old, new = str(tmp_path / "store"), tmp_path / "old.csv", tmp_path / "new.csv"
    write_csv(old, [(1, "ON"), (2, "ON"), (3, "QC")])
    write_csv(new, [(2, "ON"), (4, "ON"), (5, "ON")])
    A.import_province(spark, str(old), root, "ON", "v1")
    A.import_province(spark, str(old), root, "QC", "v1")
    before = content(spark, root)
    for step in (1, 2, 4, 6, 7):
        with monkeypatch.context() as m:
            seen = breaking_at(m, step)
            with pytest.raises(Broken):
                A.import_province(spark, str(new), root, "ON", "v2", resume=step % 2 == 0)
            assert len(seen) == step
        assert content(spark, root) == before
    held = S.snapshot(spark, root).read("addresses")
    assert A.import_province(spark, str(new), root, "ON", "v2").first().row_count == 3
    after = content(spark, root)
    assert len(after["addresses"]) == 4 and len(after["imports"]) == 3
    # A reader of the former version still has it; the sweep takes what only old or broken loads left.
    assert sorted(map(str, held.collect())) == before["addresses"]
    assert S.sweep(spark, root, keep=2, orphan_hours=24) == ["manifest/version=000000000001"]
    gone = S.sweep(spark, root, keep=1, orphan_hours=0)
    assert "manifest/version=000000000002" in gone and len(gone) > 6
    assert content(spark, root) == after
    assert S.sweep(spark, root, keep=1, orphan_hours=0) == []


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    one, two = S.snapshot(spark, root).commit(), S.snapshot(spark, root).commit()
    one.replace("t", rows, "k", [])
    two.replace("t", rows.where("k = 'a'"), "k", ["a", "b"])
    one.publish()
    with pytest.raises(RuntimeError, match="another writer"):
        two.publish()
    assert S.snapshot(spark, root).values("t") == ["a", "b"]


def test_replace_append_and_emptied_tables(spark, tmp_path):
    root = str(tmp_path / "store")
    make = lambda rows: spark.createDataFrame(rows, "k string, v int")
    read = lambda *a: sorted((r.k, r.v) for r in S.snapshot(spark, root).read("t", *a).collect())
    steps = [
        (lambda c: c.replace("t", make([("a", 1), ("b/ c=%", 2), ("1", 7)]), "k", []), [("1", 7), ("a", 1), ("b/ c=%", 2)]),
        (lambda c: c.append("t", make([("a", 3), ("d", 4)]), "k"), [("1", 7), ("a", 1), ("a", 3), ("b/ c=%", 2), ("d", 4)]),
        (lambda c: c.replace("t", make([("a", 5)]), "k", ["d"]), [("1", 7), ("a", 5), ("b/ c=%", 2)]),
        (lambda c: c.replace("t", make([]), "k", ["a", "1", "b/ c=%"]), []),
    ]
    with pytest.raises(ValueError):
        S.snapshot(spark, root).read("t")
    for change, want in steps:
        work = S.snapshot(spark, root).commit()
        change(work)
        work.publish()
        assert read() == want
        assert read(["a"]) == [w for w in want if w[0] == "a"]
    assert S.snapshot(spark, root).read("t").dtypes == [("k", "string"), ("v", "int")]


def test_only_the_folders_of_a_value_are_read(spark, tmp_path):
    work = S.snapshot(spark, str(tmp_path / "s")).commit()
    work.replace("t", spark.range(100).select((F.col("id") % 5).cast("string").alias("k"), "id"), "k", [])
    files = work.publish().read("t", ["3"])
    plan = files._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part_key" in plan and files.count() == 20


def test_boundaries_are_replaced_in_one_step(spark, tmp_path, monkeypatch):
    square = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]
    make = lambda rows: spark.createDataFrame([(d, i, {"n": str(i)}, square) for d, i in rows], "dataset string, ordinal bigint, props map<string,string>, geom array<array<array<array<double>>>>")
    root = str(tmp_path / "features")
    ids = lambda: sorted(r.id for r in S.snapshot(spark, root).read("features").collect())
    B.write_features(make([("a", 1), ("a", 2), ("b", 1)]), root)
    with monkeypatch.context() as m:
        breaking_at(m, 2)
        with pytest.raises(Broken):
            B.write_features(make([("a", 9)]), root)
    assert ids() == ["a_1", "a_2", "b_1"]
    B.write_features(make([("a", 9)]), root, ["b"])
    assert ids() == ["a_9"]
    assert isinstance(S.snapshot(spark, root).read("features", ["b"]), DataFrame)


def text_rules(df: DataFrame) -> int:
    """How many pattern replacements the planned query holds."""
    spark, setting = df.sparkSession, "spark.sql.debug.maxToStringFields"
    former = spark.conf.get(setting, "25")
    spark.conf.set(setting, "1000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace(")
    finally:
        spark.conf.set(setting, former)


def test_parts_of_an_address_are_worked_out_once(spark):
    columns = [F.col("id").cast("double" if c in ("lat", "lon") else "string").alias(c) for c in A.CONTENT]
    rows = spark.range(3).repartition(2).select(*columns, F.lit(1).alias("copy_no"))
    assert text_rules(A.address_table(rows)) < 150
    raw = spark.range(3).repartition(2).select(
        *[F.col("id").cast("string").alias(c) for c in ("Latitude", "Longitude", "Province", "City")]
    )
    assert text_rules(A.normalize_rows(raw, "ON")[1].agg(F.count(F.lit(1)))) < 10
