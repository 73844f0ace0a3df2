"""Whole-boundary operators: simplification, pages and statistics (J10-J13, SP3, SP4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions.geometry import GEOM_TYPE, decimate, in_box
from geoweave.operators.skew import hot_keys, salted_join
from geoweave.operators.spatial import spatial_index


def box_candidates(points: DataFrame, features: DataFrame, side: float, pid: str = "pid") -> DataFrame:
    """SP3, SP4: (point, boundary) pairs whose box holds the point, by an equi-join on grid cells.

    A point lies in one cell and a boundary is listed once per cell its box touches, so a pair comes
    out once.
    """
    indexed = spatial_index(features)
    cell = lambda v: F.floor(v / F.lit(side))
    listed = indexed.select(
        "dataset", "ordinal", "bbox",
        F.explode(F.sequence(cell(F.col("bbox.min_y")), cell(F.col("bbox.max_y")))).alias("cy"),
    ).select(
        "dataset", "ordinal", "bbox", "cy",
        F.explode(F.sequence(cell(F.col("bbox.min_x")), cell(F.col("bbox.max_x")))).alias("cx"),
    )
    placed = points.withColumns({"cx": cell(F.col("lon")), "cy": cell(F.col("lat"))})
    counts = placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    pairs = salted_join(
        placed, listed, ["cx", "cy"], [pid], "inner", hot_keys(counts, ["cx", "cy"], "n")
    )
    return pairs.where(in_box(F.col("lon"), F.col("lat"), F.col("bbox"))).drop("cx", "cy", "bbox")


def decimate_geometry(features: DataFrame, max_vertices: int) -> DataFrame:
    """J10 on every ring."""
    return features.withColumn(
        "geom", F.transform("geom", lambda p: F.transform(p, lambda r: decimate(r, max_vertices)))
    )


def _keep_far_vertices(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with a stack: keep a vertex while it is farther than the tolerance."""
    keep = np.zeros(len(line), dtype=bool)
    keep[[0, -1]] = True
    spans = [(0, len(line) - 1)]
    while spans:
        first, last = spans.pop()
        if last - first < 2:
            continue
        a, b = line[first], line[last]
        inner = line[first + 1:last]
        # Distance to the segment, not to the endless line through it.
        direction, offset = b - a, inner - a
        square = float(direction @ direction)
        along = np.clip(offset @ direction / square, 0.0, 1.0) if square > 0 else np.zeros(len(inner))
        distance = np.linalg.norm(offset - along[:, None] * direction, axis=1)
        far = int(np.argmax(distance))
        if distance[far] > tolerance:
            middle = first + 1 + far
            keep[middle] = True
            spans += [(first, middle), (middle, last)]
    return line[keep]


def simplify_geometry(features: DataFrame, tolerance: float) -> DataFrame:
    """J11: Douglas-Peucker on every ring; the vertex a line is split at stays on both sides.

    Rings keep their order; each boundary is one row, handled in Arrow batches.
    """

    @F.pandas_udf(GEOM_TYPE)
    def simplify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for geoms in batches:
            yield geoms.map(
                lambda polygons: None if polygons is None else [
                    [
                        _keep_far_vertices(np.array([list(c) for c in ring]), tolerance).tolist()
                        if len(ring) > 2 else [list(c) for c in ring]
                        for ring in rings
                    ]
                    for rings in polygons
                ]
            )

    return features.withColumn("geom", simplify("geom"))


def boundary_page(rows: DataFrame, dataset: str, limit: int, offset: int) -> DataFrame:
    """J12: one page of a dataset's stored boundaries by id, with the total."""
    mine = rows.where(F.col("dataset") == dataset)
    total = mine.agg(F.count(F.lit(1)).alias("total"))
    return mine.orderBy("id").offset(offset).limit(limit).select("*", total.scalar().alias("total"))


def boundary_stats(rows: DataFrame) -> DataFrame:
    """J13: feature count and last sync per dataset."""
    return rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("features"), F.max("synced_at").alias("last_sync")
    )
