"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.session import BROADCAST_MAX_ROWS, configure, cut_lineage

# Rows of one Arrow batch handed to a Python task. Texts can be long, so batches are short.
BATCH_ROWS = 1_000
# Most bytes of a broadcast table whose rows are wide.
BROADCAST_MAX_BYTES = 64 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings these operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def take(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name.

    Other columns may have any name, also one that differs in case only or repeats.
    """
    found = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(found))])
    return plain.select(*[F.col(f"c{found.index(n)}").alias(n) for n in names])


def without(df: DataFrame, keys: DataFrame, names: list[str], also: dict | None = None) -> DataFrame:
    """Rows of ``df`` whose ``names`` are in no row of ``keys``; columns and their names are kept.

    ``keys`` is a written table: it is counted, broadcast when it is small and otherwise joined by a
    shuffle. Nulls count as equal. ``also`` names further columns of ``keys``, fixed-width strings,
    each with a function of the columns of ``df`` that gives the value to compare; it is
    evaluated only where ``names`` match.
    """
    found = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(found))])
    place = {n: F.col(f"c{found.index(n)}") for n in dict.fromkeys(found)}
    more = list(also or {})
    right = keys.select(*names, *more).toDF(*[f"q{i}" for i in range(len(names) + len(more))])
    condition = F.lit(True)
    for i, name in enumerate(names):
        condition = condition & place[name].eqNullSafe(F.col(f"q{i}"))
    for i, name in enumerate(more, len(names)):
        # Not an equality, so that it stays a condition on matched rows and no key of the join.
        condition = condition & F.contains(F.col(f"q{i}"), also[name](place))
    return plain.join(small(right), condition, "left_anti").toDF(*found)


def small(table: DataFrame, row_bytes: int = 0) -> DataFrame:
    """A written table, with the hint to broadcast it if its counted rows are few.

    ``row_bytes`` is the size of a row where rows are wide; their sum is then bounded as well.
    """
    most = min(BROADCAST_MAX_ROWS, BROADCAST_MAX_BYTES // row_bytes) if row_bytes else BROADCAST_MAX_ROWS
    return F.broadcast(table) if table.count() <= most else table


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back."""
    return cut_lineage(df, name)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
