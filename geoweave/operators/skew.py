"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.session import BROADCAST_MAX_ROWS, cut_lineage

# Rows of one key that a single task may take before the key is spread over several.
ROWS_PER_TASK = 1_000_000


def hot_keys(
    counts: DataFrame, keys: list[str], count: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame | None:
    """All keys that need spreading, with their salt counts: a written table, or None.

    ``counts`` has one row per key with its number of rows, as left by a grouping that combined
    before its shuffle. Which keys these are changes only how the work is spread, never the result.
    """
    hot = counts.where(F.col(count) > rows_per_task).select(
        *keys, F.ceil(F.col(count) / rows_per_task).cast("int").alias("_salts")
    )
    hot = cut_lineage(hot, "hot_keys")
    return None if hot.isEmpty() else hot


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: list[Column | str],
    how: str,
    hot: DataFrame | None,
) -> DataFrame:
    """Equi-join whose hot left keys (from ``hot_keys``) are spread over several tasks.

    ``right`` rows of a hot key are repeated once per salt; each left row takes exactly one salt,
    taken from ``spread_by`` (columns that tell rows of one key apart), so a retried task gives the
    same salts and every left row meets every matching right row once.
    """
    if hot is None:
        return left.join(right, keys, how)
    if hot.count() <= BROADCAST_MAX_ROWS:
        hot = F.broadcast(hot)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    salted_left = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int"))
        .drop("_salts")
    )
    salted_right = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, keys + ["_salt"], how).drop("_salt")


def spread_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[Column | str], how: str
) -> DataFrame:
    """``salted_join`` that counts the keys of ``left`` itself.

    The count reads ``left`` once more, so ``left`` should come from a written table.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return salted_join(left, right, keys, spread_by, how, hot_keys(counts, keys, "_rows"))
