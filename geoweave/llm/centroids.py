"""Centroid clustering of whole-number vectors by tables of squared differences."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import take, written

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
# Rows coded together, against one list of occurring values; at most 2^16, so that codes take two bytes.
BLOCK_ROWS = 8_192

_BLOCK = "ids array<bigint>, codes binary, sizes binary, occurring binary"


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v`` (array of bigint): floor(scale * x) of the vectors with ``dimensions`` finite components.

    Null vectors, vectors of another length and those with null, infinite or not-a-number components are left out.
    """
    value = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fit = (F.size("embedding") == dimensions) & F.forall(
        "embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x)
    )
    kept = take(vectors, "vec_id", "embedding").where(F.coalesce(fit, F.lit(False)))
    return kept.select("vec_id", value.alias("v"))


def first_centroids(rows: DataFrame, count: int = CENTROIDS, salt: str = "3") -> list[list[int]]:
    """The ``count`` vectors whose ``salt:vec_id`` has the smallest SHA-256 in hex, in that order.

    Vectors with one id are ordered by their components; those without an id come last. Fewer vectors
    give fewer centroids.
    """
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    return [list(r.v) for r in hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(count).collect()]


def coded_blocks(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Blocks of up to ``BLOCK_ROWS`` vectors: every component as a number in its dimension's list of occurring values.

    A block has its ids, ``occurring`` (the values of all dimensions, one list after the other), ``sizes``
    (of these lists) and ``codes`` (per dimension and row, the place in its list). Raises where a component
    is so large that squared distances might not fit 64 bits.
    """
    bound = math.isqrt(2**63 // dimensions) // 2 - 1

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(parts).combine_chunks()
        flat = part.column("v").combine_chunks().flatten().to_numpy()
        if flat.max() > bound or flat.min() < -bound:
            raise ValueError(f"a component is over {bound} in magnitude: distances would not fit 64 bits")
        matrix = flat.reshape(part.num_rows, dimensions)
        found = [np.unique(column, return_inverse=True) for column in matrix.T]
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays([0, part.num_rows], part.column("vec_id").combine_chunks()),
                pa.array([np.array([place for _, place in found], "<u2").tobytes()]),
                pa.array([np.array([len(values) for values, _ in found], "<i8").tobytes()]),
                pa.array([np.concatenate([values for values, _ in found]).astype("<i8").tobytes()]),
            ],
            ["ids", "codes", "sizes", "occurring"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                if size + part.num_rows > BLOCK_ROWS:
                    yield block(waiting)
                    waiting, size = [], 0
                waiting.append(part)
                size += part.num_rows
        if size:
            yield block(waiting)

    return rows.mapInArrow(run, _BLOCK)


class Block:
    """One row of ``coded_blocks``, unpacked."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.sizes = np.frombuffer(batch.column("sizes")[row].as_buffer(), "<i8")
        self.codes = np.frombuffer(batch.column("codes")[row].as_buffer(), "<u2").reshape(len(self.sizes), -1)
        self.occurring = np.frombuffer(batch.column("occurring")[row].as_buffer(), "<i8")
        self.starts = np.cumsum(self.sizes) - self.sizes

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row its nearest centroid, the first on ties, and the squared distance.

        The squared difference of every occurring value of a dimension and every centroid is tabulated
        once; a distance is the sum of the entries that a row's codes point at.
        """
        dimension = np.repeat(np.arange(len(self.sizes)), self.sizes)
        table = (self.occurring[:, None] - centroids.T[dimension]) ** 2
        distance = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        for start, size, code in zip(self.starts, self.sizes, self.codes, strict=True):
            distance += table[start : start + size].take(code, axis=0)
        best = distance.argmin(axis=1)
        return best, distance[np.arange(len(best)), best]

    def sums(self, best: np.ndarray, count: int) -> np.ndarray:
        """Per centroid the sum of each component over its rows; a block's sums are exact as doubles."""
        total = np.empty((count, len(self.codes)), np.int64)
        for d, (start, code) in enumerate(zip(self.starts, self.codes, strict=True)):
            total[:, d] = np.bincount(best, weights=self.occurring.take(start + code.astype(np.int64)), minlength=count)
        return total


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1), Block(batch, i)


def _totals(blocks: DataFrame, centroids: list[list[int]]) -> list[tuple[int, list[int]]]:
    """Count and componentwise sum of each centroid's vectors; a task sends one row per centroid."""
    where = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(where), np.int64), np.zeros(where.shape, np.int64)
        for _, block in _blocks(batches):
            best, _ = block.nearest(where)
            counts += np.bincount(best, minlength=len(where))
            sums += block.sums(best, len(where))
        yield pa.RecordBatch.from_pydict(
            {"cluster": pa.array(range(len(where)), pa.int32()), "n": counts, "sums": pa.array(list(sums), pa.list_(pa.int64()))}
        )

    parts = blocks.select("codes", "sizes", "occurring").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    wide = F.posexplode("sums").alias("d", "s")
    # Sums over all tasks may pass 64 bits.
    rows = parts.select("cluster", "n", wide).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = [(0, [0] * where.shape[1]) for _ in where]
    for row in rows:
        out[row.cluster] = (row.n, out[row.cluster][1])
        out[row.cluster][1][row.d] = int(row.s)
    return out


def fitted(blocks: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """``centroids`` after ``rounds`` rounds: each becomes the floor of its vectors' mean; empty ones stay."""
    for _ in range(rounds):
        totals = _totals(blocks, centroids)
        centroids = [[s // n for s in sums] if n else old for (n, sums), old in zip(totals, centroids, strict=True)]
    return centroids


def assigned(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id``, ``cluster`` and squared ``distance`` of every vector in ``blocks``."""
    where = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks(batches):
            best, distance = block.nearest(where)
            yield pa.RecordBatch.from_pydict({"vec_id": row.column("ids").flatten(), "cluster": best.astype("int32"), "distance": distance})

    return blocks.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(
    vectors: DataFrame, dimensions: int = DIMENSIONS, count: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """Clusters of ``vectors`` (``vec_id``, ``embedding``) after ``rounds`` rounds from ``count`` hashed starts.

    Vectors that ``whole_vectors`` leaves out (null, of another length, with null or non-finite
    components) have no row in the result. A distance is squared Euclidean; ties go to the smaller
    centroid number. Only ``count`` x ``dimensions`` sums and centroids pass through the driver.

    Result, one row per kept vector: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``,
    ``centroid_sha256``. Repeated rows and ids are vectors of their own; a null id is kept and never
    starts a centroid while others do. Fewer vectors than ``count`` give that many centroids; none give no
    rows. Components whose squared distances might pass 64 bits (over 2^27 at 64 dimensions) raise an error. Other columns are ignored.
    """
    rows = whole_vectors(vectors, dimensions, scale)
    start = first_centroids(rows, count)
    if not start:
        return rows.select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256"),
        ).where("false")
    blocks = written(coded_blocks(rows, dimensions), "vector_blocks")
    centroids = fitted(blocks, start, rounds)
    found = written(assigned(blocks, centroids), "vector_clusters")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()
    by_cluster = {r.cluster: r.i for r in inertia}
    names = {c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest() for c in by_cluster}

    def of_cluster(values: dict, kind: str):
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("cluster")).cast(kind)

    return found.select(
        "vec_id", "cluster", "distance", of_cluster(by_cluster, "bigint").alias("cluster_inertia"),
        F.lit(sum(by_cluster.values())).cast("bigint").alias("inertia"), of_cluster(names, "string").alias("centroid_sha256"),
    )
