"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.session import shared_dir

# Edges that a task of a round gets about, and the fewest tasks of a step that is cut down to these.
EDGES_PER_TASK, LEAST_TASKS = 50_000, 4


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (``src``, ``dst``, both long).

    Result: ``node``, ``component``; one row per node that has an edge to another one and is not
    itself the smallest of its component. Edges may repeat, run in either direction or be loops;
    an edge with a null end is no edge. A round joins every node with the smallest of its
    neighbours: an aggregation that combines before its shuffle, and an equi-join whose large keys
    can be split. Rounds are logarithmic in the longest chain. Every round is checkpointed. The steps of a round
    run in as many tasks as its counted edges ask for, if that is fewer than the session's partitions: every
    task of a shuffle leaves files of its own, which for few edges are more than the edges.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    now = (
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
        .checkpoint()
    )
    mark = _mark(now)
    while mark[0]:
        tasks = max(LEAST_TASKS, -(-mark[0] // EDGES_PER_TASK))
        few = tasks < int(spark.conf.get("spark.sql.shuffle.partitions"))

        def fitted(df: DataFrame, tasks: int = tasks, few: bool = few) -> DataFrame:
            return df.coalesce(tasks) if few else df

        now = fitted(now)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = fitted(fitted(joined).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = fitted(small).unionByName(fitted(lowest.withColumnRenamed("m", "v")))
        now = fitted(found.distinct()).checkpoint()
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them that changes with any of them."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links ``a[i]``-``b[i]`` join: one per node, to the smallest of its part."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
