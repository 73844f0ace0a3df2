"""Stored tables that change together: immutable data folders and one manifest per version.

A commit writes new folders of rows, which nobody reads yet, and last of all one small file, the manifest
of the next version, that names for every table and partition value the folders its rows are in. Readers
take the newest manifest, so they see all tables of a version or none of it, and a commit that breaks
off anywhere before its last step leaves the former version in force. One writer at a time is meant; of two
that start from one version, the second is refused.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# One row per table, value and folder, and one per table without a folder, which keeps the schema of an empty one.
MANIFEST = "name string, value string, folder string, schema string"
# Copy of the partition column that the folders are named by; the column itself stays in the files.
KEY = "part_key"


class Snapshot:
    """All tables of one version. What was read from it stays valid until the version is swept."""

    def __init__(self, spark: SparkSession, root: str, version: int, rows: list[tuple]):
        self.spark, self.root, self.version, self.rows = spark, root.rstrip("/"), version, rows

    def tables(self) -> list[str]:
        return sorted({r[0] for r in self.rows})

    def values(self, name: str) -> list[str]:
        return sorted({r[1] for r in self.rows if r[0] == name and r[2] is not None})

    def read(self, name: str, values: list[str] | None = None) -> DataFrame:
        """A table, or its rows of some partition values; other values' folders are not read."""
        own = [r for r in self.rows if r[0] == name]
        if not own:
            raise ValueError(f"no table {name} in {self.root}")
        folders = defaultdict(list)
        for _, value, folder, schema in own:
            if folder is not None and (values is None or value in values):
                folders[folder, schema].append(value)
        out = None
        for (folder, schema), found in folders.items():
            typed = StructType.fromJson(_json(schema)).add(KEY, StringType())
            rows = self.spark.read.schema(typed).parquet(f"{self.root}/{folder}").where(F.col(KEY).isin(found)).drop(KEY)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return self.spark.createDataFrame([], StructType.fromJson(_json(own[-1][3]))) if out is None else out

    def commit(self) -> Commit:
        return Commit(self)


class Commit(Snapshot):
    """The next version in the making: a snapshot that reads what it will hold, and is nowhere seen before ``publish``."""

    def __init__(self, base: Snapshot):
        super().__init__(base.spark, base.root, base.version + 1, list(base.rows))

    def _write(self, name: str, rows: DataFrame, column: str) -> tuple[list[str], str, str]:
        folder, schema = f"data/{name}/{uuid.uuid4().hex}", rows.schema.json()
        keyed = rows.withColumn(KEY, F.col(column).cast("string"))
        keyed.write.partitionBy(KEY).parquet(f"{self.root}/{folder}")
        typed = StructType.fromJson(_json(schema)).add(KEY, StringType())
        stored = self.spark.read.schema(typed).parquet(f"{self.root}/{folder}")
        return [r[0] for r in stored.select(KEY).distinct().collect()], folder, schema

    def replace(self, name: str, rows: DataFrame, column: str, values: list[str]) -> None:
        """``rows`` in place of the partitions of ``column`` they fall in and of ``values``, which may get no row."""
        written, folder, schema = self._write(name, rows, column)
        gone = {*written, *values, None}
        self.rows = [r for r in self.rows if r[0] != name or r[1] not in gone]
        self.rows += [(name, None, None, schema)] + [(name, v, folder, schema) for v in written]

    def append(self, name: str, rows: DataFrame, column: str) -> None:
        """``rows`` besides those that are there."""
        written, folder, schema = self._write(name, rows, column)
        self.rows = [r for r in self.rows if r[0] != name or r[1] is not None]
        self.rows += [(name, None, None, schema)] + [(name, v, folder, schema) for v in written]

    def publish(self) -> Snapshot:
        """Make this version the one that readers find: one file, moved into place when it is complete."""
        target = f"{self.root}/manifest/version={self.version:012d}"
        try:
            self.spark.createDataFrame(self.rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(target)
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise RuntimeError(f"version {self.version} of {self.root} was published by another writer: start again") from error
        return Snapshot(self.spark, self.root, self.version, self.rows)


def _json(schema: str) -> dict:
    import json

    return json.loads(schema)


def _versions(spark: SparkSession, root: str) -> list[int]:
    """All complete versions; only names of files are looked at."""
    try:
        files = spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifest").inputFiles()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted({int(re.search(r"/version=(\d+)/", f).group(1)) for f in files})


def _manifest(spark: SparkSession, root: str, version: int) -> list[tuple]:
    rows = spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifest/version={version:012d}").collect()
    return [tuple(r) for r in rows]


def snapshot(spark: SparkSession, root: str) -> Snapshot:
    """The newest version of the store at ``root``; a store without one is empty."""
    versions = _versions(spark, root)
    if not versions:
        return Snapshot(spark, root, 0, [])
    return Snapshot(spark, root, versions[-1], _manifest(spark, root, versions[-1]))


def sweep(spark: SparkSession, root: str, keep: int = 2, orphan_hours: float = 24.0) -> list[str]:
    """Delete all but the newest ``keep`` versions and the folders that only they name; return what went.

    Folders that no version names, left by commits that broke off, go once they are ``orphan_hours`` old;
    the time must exceed that of the longest import. Readers of a swept version lose it.
    """
    root = root.rstrip("/")
    versions = _versions(spark, root)
    old, live = versions[:-keep], versions[-keep:]
    used = {r[2] for v in live for r in _manifest(spark, root, v) if r[2]}
    former = {r[2] for v in old for r in _manifest(spark, root, v) if r[2]} - used
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = lambda name: hadoop.Path(f"{root}/{name}")
    files = path("data").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now = spark.sql("SELECT unix_millis(current_timestamp())").first()[0]
    gone = [f"manifest/version={v:012d}" for v in old] + sorted(former)
    tables = files.listStatus(path("data")) if files.exists(path("data")) else []
    for table in tables:
        for entry in files.listStatus(table.getPath()):
            name = f"data/{table.getPath().getName()}/{entry.getPath().getName()}"
            if name not in used | former and now - entry.getModificationTime() > orphan_hours * 3_600_000:
                gone.append(name)
    for name in gone:
        files.delete(path(name), True)
    return gone
