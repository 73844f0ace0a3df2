"""Points to boundaries: a grid index over the boundaries and an equi-join on the cell."""

from __future__ import annotations

import math
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions.geometry import EDGE_TOLERANCE, bounding_box, number
from geoweave.operators.skew import hot_keys, salted_join
from geoweave.session import BROADCAST_MAX_ROWS, cut_lineage

# Cells the grid aims for, whatever the extent of the boundaries.
MIN_CELLS, MAX_CELLS = 1_024, 2_000_000
# Cells are taken this much wider, in shares of their side, against rounding.
SLACK = 1e-6
# Largest index, in edges, that is broadcast, and most boundaries in one cell of a packed index.
BROADCAST_MAX_EDGES = 1_000_000
PACKED_MAX_PER_CELL = 1_000
MAX_BROADCAST_FEATURES = 50_000
# Boundaries of a cell that a point meets at a time, and how many times more per round.
PACK, PACK_GROWTH = 16, 4
# Points per cell of an index that is made for them.
POINTS_PER_CELL = 4
# An odd number, more than a ring has edges.
ON_EDGE = (1 << 30) + 1


def spatial_index(features: DataFrame) -> DataFrame:
    """SP2: features with their box; features without a valid coordinate are left out."""
    return features.withColumn("bbox", bounding_box(F.col("geom"))).where("bbox IS NOT NULL")


def overall_box(indexed: DataFrame) -> DataFrame:
    """SP2: one row per dataset with the box over all its features."""
    return indexed.groupBy("dataset").agg(
        F.min("bbox.min_x").alias("min_x"),
        F.min("bbox.min_y").alias("min_y"),
        F.max("bbox.max_x").alias("max_x"),
        F.max("bbox.max_y").alias("max_y"),
        F.count(F.lit(1)).alias("features"),
    )


class CellIndex:
    """Boundaries cut into grid cells.

    A row holds, for one boundary and one cell, the edges that enter the cell and, per ring, the parity of
    what lies to the right of it. Where no edge enters the cell the answer is the same for the
    whole cell, so the row is kept without rings (all inside) or dropped (all outside). The rows are
    made when they are first asked for.
    """

    def __init__(self, features: DataFrame, side: float | None = None, points: int = 0):
        """``features``: a written table of boundaries with their boxes; the cell size, if not given, follows from these and the number of points."""
        self._features, self._given = features, side
        x, y = F.col("bbox.max_x") - F.col("bbox.min_x"), F.col("bbox.max_y") - F.col("bbox.min_y")
        area, vertices, n, *box = features.agg(
            F.sum(x * y), F.sum(F.size(F.flatten(F.flatten("geom")))), F.count(F.lit(1)),
            F.min("bbox.min_x"), F.min("bbox.min_y"), F.max("bbox.max_x"), F.max("bbox.max_y"),
        ).first()
        self.box = tuple(box) if n else (0.0, 0.0, 0.0, 0.0)
        if side is None:
            # A few cells per small boundary, a few edges per cell of a detailed one.
            target = max(min(max(4 * n, (vertices or 1) // 16, MIN_CELLS), MAX_CELLS), points // POINTS_PER_CELL)
            widest = max(self.box[2] - self.box[0], self.box[3] - self.box[1], 1e-6)
            side = max(math.sqrt((area or 1.0) / target), widest / 4096)
        self.side = side

    def near(self, box: tuple, points: int) -> CellIndex:
        """An index for so many points of ``box``, of the boundaries whose boxes meet it; this one, if its rows are made."""
        if "rows" in self.__dict__:
            return self
        x0, y0, x1, y1 = box
        met = (F.col("bbox.min_x") <= x1) & (F.col("bbox.max_x") >= x0) & (F.col("bbox.min_y") <= y1) & (F.col("bbox.max_y") >= y0)
        return CellIndex(self._features.where(met), self._given, points)

    @cached_property
    def rows(self) -> DataFrame:
        """dataset, cx, cy, ordinal, rings (null = whole cell inside)."""
        return cut_lineage(_cell_rows(self._features, self.side), "cells")

    @cached_property
    def _sizes(self) -> tuple:
        edges = F.coalesce(F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r["edges"])), F.lit(0))
        per_cell = self.rows.groupBy("dataset", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.sum(edges).alias("e"))
        return tuple(v or 0 for v in per_cell.agg(F.count(F.lit(1)), F.sum("e"), F.max("n")).first())

    @property
    def cells(self) -> int:
        return self._sizes[0]

    @property
    def edges(self) -> int:
        return self._sizes[1]

    @property
    def most_per_cell(self) -> int:
        return self._sizes[2]

    @property
    def fits_broadcast(self) -> bool:
        return (
            self.cells <= BROADCAST_MAX_ROWS
            and self.edges <= BROADCAST_MAX_EDGES
            and self.most_per_cell <= PACKED_MAX_PER_CELL
        )


def _cell(value: Column, side: float) -> Column:
    return F.floor(value / F.lit(side))


def build_cell_index(features: DataFrame, side: float | None = None) -> CellIndex:
    """Cut boundaries (dataset, ordinal, geom) into cells; the cell size follows from their boxes."""
    indexed = spatial_index(features).select("dataset", "ordinal", "geom", "bbox")
    # Read for their sizes and cut up after that.
    return CellIndex(cut_lineage(indexed, "boundaries"), side)


def _edge(p: Column, q: Column, after: Column, before: Column, side: float) -> Column:
    """The edge from vertex ``p`` to ``q``, with what tells its columns of cells in a row.

    ``ok``: both ends have coordinates; ``whole``: so have the edges on either side. Between heights y and
    z the edge lies between ``xa + slope * (y - low)`` and ``xb + slope * (z - low)``; one that is not high
    enough is taken with its whole width. The tolerance in the crossing test moves a crossing along the
    edge, the further the flatter the edge, by ``pad`` at most.
    """
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    up = p["y"] <= q["y"]
    steep = F.abs(dy) >= side / 4
    start = F.when(up, p["x"]).otherwise(q["x"])
    moved = F.coalesce(F.try_divide(F.lit(2 * EDGE_TOLERANCE), F.abs(dy + EDGE_TOLERANCE)), F.lit(1e9))
    ok = p["x"].isNotNull() & p["y"].isNotNull() & q["x"].isNotNull() & q["y"].isNotNull()
    return F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"),
        F.least(p["y"], q["y"]).alias("low"), F.greatest(p["y"], q["y"]).alias("high"),
        F.when(steep, start).otherwise(F.least(p["x"], q["x"])).alias("xa"),
        F.when(steep, start).otherwise(F.greatest(p["x"], q["x"])).alias("xb"),
        F.when(steep, F.try_divide(dx, dy)).otherwise(0.0).alias("slope"),
        (F.when(dy == 0, 0.0).otherwise(F.abs(dx) * (moved + 1e-9)) + side * SLACK).alias("pad"),
        ok.alias("ok"),
        (ok & after["x"].isNotNull() & after["y"].isNotNull() & before["x"].isNotNull() & before["y"].isNotNull()).alias("whole"),
    )


def _edges(indexed: DataFrame, side: float) -> DataFrame:
    """Every edge of every ring with the edges before and after it, and the columns of cells of its boundary."""
    n = F.size("coords")
    vertices = F.transform("coords", lambda c: F.struct(number(F.get(c, 0)).alias("x"), number(F.get(c, 1)).alias("y")))

    def turned(by: int) -> Column:
        """The vertex so many places after each one."""
        first = F.lit(by) if by >= 0 else n + by
        return F.concat(F.slice("vs", first + 1, n - first), F.slice("vs", F.lit(1), first))

    key = ["dataset", "ordinal", "part", "ring", "lo_cx", "hi_cx"]
    # Edges are made of rows of vertices, as work on elements of arrays is not compiled.
    around = ["a2", "a1", "own", "b1", "b2", "b3"]
    a2, a1, own, b1, b2, b3 = (F.col(c) for c in around)
    return (
        indexed.select(
            "dataset", "ordinal", F.posexplode("geom").alias("part", "rings"),
            _cell(F.col("bbox.min_x"), side).alias("lo_cx"), _cell(F.col("bbox.max_x"), side).alias("hi_cx"),
        )
        .select("dataset", "ordinal", "part", F.posexplode("rings").alias("ring", "coords"), "lo_cx", "hi_cx")
        .where(n >= 3)
        .select(*key, "coords", vertices.alias("vs"))
        .select(*key, F.inline(F.arrays_zip(*[turned(2 - i).alias(c) for i, c in enumerate(around)])).alias(*around))
        .select(
            *key, _edge(a1, own, a2, b1, side).alias("after"), _edge(own, b1, a1, b2, side).alias("own"),
            _edge(b1, b2, own, b3, side).alias("before"),
        )
        .where("own.ok")
    )


def _columns(edge: Column, cy: Column, side: float) -> tuple[Column, Column]:
    """The first and last column of cells in which ``edge`` may decide a point of row ``cy``."""
    slack = side * SLACK
    one = edge["xa"] + edge["slope"] * (F.greatest(edge["low"], cy * side - slack) - edge["low"])
    two = edge["xb"] + edge["slope"] * (F.least(edge["high"], (cy + 1) * side + slack) - edge["low"])
    return _cell(F.least(one, two) - edge["pad"], side), _cell(F.greatest(one, two) + edge["pad"], side)


def _cell_rows(indexed: DataFrame, side: float) -> DataFrame:
    """The rows of a ``CellIndex``; their number grows with the edges and with the cells inside, not with their product.

    For a point of a cell, an edge right of the cell counts when one of its ends is above the point. Summed
    over the edges right of the cell, an end that two of them share cancels out. What is left:

    - ends above the whole row of cells, the same for every point of the cell: kept as the ring's parity,
      a running count over the row of the edges that cross its upper side;
    - ends within the row whose other edge enters the cell: kept as marks on that edge (``up1``, ``up2``).

    An edge next to a vertex without coordinates has no such partner and enters every cell on its left.
    """
    slack = side * SLACK
    key = ["dataset", "ordinal", "part", "ring"]
    after, own, before = F.col("after"), F.col("own"), F.col("before")
    over, under = lambda y: _cell(y - slack, side), lambda y: _cell(y + slack, side)
    cy, cx = F.col("cy"), F.col("cx")
    banded = _edges(indexed, side).withColumn("cy", F.explode(F.sequence(over(own["low"]), under(own["high"]))))
    first, last = _columns(own, cy, side)

    def right_of(neighbour: Column, y: Column) -> Column:
        """Before which column the neighbour at an end of height ``y`` in this row is right of the cell."""
        return F.when(neighbour["whole"] & (over(y) <= cy) & (under(y) >= cy), _columns(neighbour, cy, side)[0])

    rows = banded.select(
        *key, "cy", "lo_cx",
        F.when(own["whole"], F.greatest(first, "lo_cx")).otherwise(F.col("lo_cx")).alias("a"),
        F.least(last, "hi_cx").alias("b"),
        ((over(own["high"]) > cy) & (over(own["low"]) <= cy)).alias("crosses_top"),
        right_of(after, own["y1"]).alias("a1"), right_of(before, own["y2"]).alias("a2"),
        *[own[c].alias(c) for c in ("x1", "y1", "x2", "y2")],
    )
    # Read twice below.
    placed = cut_lineage(rows, "edges")

    def mark(n: int) -> Column:
        return F.coalesce(cx < F.col(f"a{n}"), F.lit(False))

    near = placed.where("a <= b").withColumn("cx", F.explode(F.sequence("a", "b"))).select(
        *key, "cx", "cy",
        F.struct("x1", "y1", "x2", "y2", mark(1).alias("up1"), mark(2).alias("up2")).alias("edge"), F.lit(0).alias("parity"),
    )
    tops = (
        placed.where("crosses_top").groupBy(*key, "cy", "lo_cx", "a").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    )
    along = Window.partitionBy(*key, "cy").orderBy(F.desc("a"))
    odd = (
        tops.withColumns({"at": F.row_number().over(along), "next_a": F.lead("a").over(along)})
        .where("at % 2 = 1")
        .withColumn("from", F.coalesce("next_a", "lo_cx"))
        .where("from < a")
        .select(*key, F.explode(F.sequence(F.col("from"), F.col("a") - 1)).alias("cx"), "cy", F.lit(1).alias("parity"))
    )
    # Dealt out once, for both groupings below.
    rings = (
        near.unionByName(odd, allowMissingColumns=True)
        .repartition("dataset", "cx", "cy", "ordinal")
        .groupBy(*key, "cx", "cy")
        .agg(F.collect_list("edge").alias("edges"), F.max("parity").alias("parity"))
    )
    entered = F.exists("rings", lambda r: F.size(r["edges"]) > 0)
    return (
        rings.groupBy("dataset", "cx", "cy", "ordinal")
        .agg(F.collect_list(F.struct("part", "ring", "edges", "parity")).alias("rings"))
        .withColumn("entered", entered)
        .where(F.col("entered") | rings_contain(F.col("rings"), F.lit(0.0), F.lit(0.0)))
        .select(
            "dataset", "cx", "cy", F.col("ordinal").cast("bigint").alias("ordinal"),
            F.when(F.col("entered"), F.col("rings")).alias("rings"),
        )
    )


def rings_contain(rings: Column, px: Column, py: Column) -> Column:
    """Containment over rings cut to one cell: some outline holds the point and none of its holes."""

    def holds(ring: Column) -> Column:
        """SP5 in one pass over the edges: the number of those to the right, or ON_EDGE."""

        def step(n: Column, e: Column) -> Column:
            x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
            passes = (y1 > py) != (y2 > py)
            cross = (py - y1) * (x2 - x1) - (px - x1) * (y2 - y1)
            on_edge = px.between(F.least(x1, x2), F.greatest(x1, x2)) & (F.abs(cross) < EDGE_TOLERANCE)
            at = F.try_divide((x2 - x1) * (py - y1), y2 - y1 + F.lit(EDGE_TOLERANCE))
            one = lambda c: F.when(c, 1).otherwise(0)
            marked = n + one(e["up1"] & (y1 > py)) + one(e["up2"] & (y2 > py))
            # At the height of its upper end an edge is reached but not passed.
            reached = passes | (py == F.greatest(y1, y2))
            return F.when(n >= ON_EDGE, n).when(reached, F.when(on_edge, ON_EDGE).otherwise(marked + one(passes & (px < at + x1)))).otherwise(marked)

        return F.aggregate(ring["edges"], ring["parity"], step) % 2 == 1

    def outline(o: Column) -> Column:
        in_hole = F.exists(rings, lambda h: (h["part"] == o["part"]) & (h["ring"] > 0) & holds(h))
        return (o["ring"] == 0) & holds(o) & ~in_hole

    return F.exists(rings, outline)


def _holds(candidate: Column, px: Column, py: Column) -> Column:
    return F.when(candidate["rings"].isNull(), F.lit(True)).otherwise(
        rings_contain(candidate["rings"], px, py)
    )


def _first_holding(candidates: Column, px: Column, py: Column) -> Column:
    """The first of ``candidates`` that holds the point; those after it are not looked at."""
    return F.aggregate(
        candidates, F.lit(None).cast("bigint"),
        lambda found, c: F.when(found.isNotNull(), found).when(_holds(c, px, py), c["ordinal"]),
    )


def _packs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The boundaries of every cell by ordinal, PACK to a row: ``keys``, ``level``, ``_c``.

    Level 0 has the first PACK of a cell, each level PACK_GROWTH times as many as the one before. What comes after a
    boundary that holds the whole cell is left out.
    """
    cell = Window.partitionBy(*keys)
    whole = F.min(F.when(F.col("rings").isNull(), F.col("ordinal"))).over(cell)
    placed = (
        rows.withColumn("_whole", whole).where("_whole IS NULL OR ordinal <= _whole")
        .withColumn("_pack", F.floor((F.row_number().over(cell.orderBy("ordinal")) - 1) / PACK))
    )
    # Packs before a level: 1 + PACK_GROWTH + ..., up to more than a table has rows.
    ends = [(PACK_GROWTH ** n - 1) // (PACK_GROWTH - 1) for n in range(1, 32)]
    level = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("_pack")))
    return cut_lineage(
        placed.groupBy(*keys, "_pack").agg(F.array_sort(F.collect_list(F.struct("ordinal", "rings"))).alias("_c"))
        .select(*keys, level.alias("level"), "_c"),
        "packs",
    )


def assign_points(
    points: DataFrame,
    index: CellIndex,
    pid: str = "pid",
    dataset: str | None = None,
    broadcast: bool | None = None,
) -> DataFrame:
    """J1/J2/J9: the first boundary, by ordinal, that holds each point; null when none does.

    ``points`` need ``lon`` and ``lat``; ``dataset`` names a column that selects the boundary set
    per point (all rows use the index's only set when it is None). Adds ``ordinal``.

    Every input row comes back once, whatever ``pid`` holds. A small index is packed to one row per
    cell and broadcast: points are neither shuffled nor multiplied. A large one is joined on the
    cell with hot cells spread over tasks: a point first meets the PACK lowest boundaries of its cell, and
    only if none of them holds it the next ones, so the work grows with what lies before the first
    match and not with all boundaries that overlap there.
    """
    broadcast = index.fits_broadcast if broadcast is None else broadcast
    keys = ["_cx", "_cy"] if dataset is None else ["_ds", "_cx", "_cy"]
    renamed = {"cx": "_cx", "cy": "_cy", "dataset": "_ds"}

    def placed(df: DataFrame, side: float) -> DataFrame:
        cells = {"_cx": _cell(F.col("lon"), side), "_cy": _cell(F.col("lat"), side)}
        return df.withColumns(cells if dataset is None else cells | {"_ds": F.col(dataset)})

    if broadcast:
        rows = index.rows.withColumnsRenamed(renamed)
        rows = rows if dataset is not None else rows.drop("_ds")
        packed = rows.groupBy(*keys).agg(
            F.collect_list(F.struct("ordinal", "rings")).alias("_c")
        )
        matching = F.filter("_c", lambda c: _holds(c, F.col("lon"), F.col("lat")))
        first = F.array_min(F.transform(matching, lambda c: c["ordinal"]))
        return (
            placed(points, index.side).join(F.broadcast(packed), keys, "left")
            .withColumn("ordinal", first)
            .drop(*keys, "_c")
        )

    # Beyond the overall box nothing can match: those points skip the join, and boundaries beyond the
    # box of the others are not cut up.
    x0, y0, x1, y1 = index.box
    inside = F.coalesce(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1), F.lit(False))
    columns = points.columns
    within = cut_lineage(points.where(inside).withColumn("_row", F.monotonically_increasing_id()), "points")
    n, *box = within.agg(F.count(F.lit(1)), F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    if n == 0:
        return points.withColumn("ordinal", F.lit(None).cast("bigint"))
    index = index.near(tuple(box), n)
    within, rows = placed(within, index.side), index.rows.withColumnsRenamed(renamed)
    rows = rows if dataset is not None else rows.drop("_ds")
    per_cell = within.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(per_cell, keys, "n")
    packs = _packs(rows.join(within.select(*keys).distinct(), keys, "left_semi"), keys)
    last = packs.agg(F.max("level")).first()[0] or 0
    found = []
    left = within.select("_row", *keys, F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    for level in range(last + 1):
        met = salted_join(left, packs.where(F.col("level") == level).drop("level"), keys, ["_row"], "inner", hot)
        hits = met.select("_row", _first_holding(F.col("_c"), F.col("_lon"), F.col("_lat")).alias("_hit")).where("_hit IS NOT NULL")
        found.append(cut_lineage(hits.groupBy("_row").agg(F.min("_hit").alias("_hit")), "hits"))
        if level < last:
            more = packs.where(F.col("level") == level + 1).select(*keys).distinct()
            left = cut_lineage(left.join(found[-1], "_row", "left_anti").join(more, keys, "left_semi"), "open_points")
            if left.isEmpty():
                break
    first = within.join(reduce(DataFrame.unionByName, found), "_row", "left").withColumn("ordinal", F.col("_hit"))
    outside = points.where(~inside).select(*columns, F.lit(None).cast("bigint").alias("ordinal"))
    return first.select(*columns, "ordinal").unionByName(outside)


def with_district(assigned: DataFrame, features: DataFrame, dataset: str | None = None) -> DataFrame:
    """Put the properties of the assigned boundary on each point.

    Properties come from the feature table, one row per boundary, so the join never multiplies. The
    table is broadcast while its counted size is small; beyond that it is a plain join.
    """
    props = features.select(
        F.col("dataset").alias("_ds"), F.col("ordinal").cast("bigint").alias("ordinal"), "props"
    )
    if features.count() <= MAX_BROADCAST_FEATURES:
        props = F.broadcast(props)
    if dataset is None:
        return assigned.join(props.drop("_ds"), "ordinal", "left")
    left = assigned.withColumn("_ds", F.col(dataset))
    return left.join(props, ["_ds", "ordinal"], "left").drop("_ds")
