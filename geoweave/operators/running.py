"""Running sums and maxima per key without gathering a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000  # microseconds


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: str,
    width: int,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    attach: DataFrame | None = None,
) -> DataFrame:
    """Add running sums and maxima over (order, tie) within each key, the row itself included.

    ``order`` is a bigint. Rows are cut into slices of ``width``: a window runs inside each slice
    and what earlier slices add up to comes from a summary with one row per key and slice. A key with
    a third of all rows is so spread over as many tasks as it has slices. ``attach`` (by some of the
    keys) is joined to the summary instead of the rows, so a hot key does not skew that join either.

    Null keys are keys like any other, and rows with a null ``order`` come before all others of their
    key. The summary reaches the rows as one more row of their slice, not by a join.
    """
    sums, maxima = sums or {}, maxima or {}
    by_slice = [*keys, "_slice"]
    sliced = df.withColumn("_slice", F.floor(F.col(order) / F.lit(width)))
    sliced = sliced.withColumns({f"_v_{n}": e for n, e in {**sums, **maxima}.items()})
    summary = sliced.groupBy(*by_slice).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxima],
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = summary.select(
        *by_slice,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_o_{n}") for n in maxima],
    )
    if attach is not None:
        offsets = offsets.join(attach, [k for k in keys if k in attach.columns], "left")
    inside = Window.partitionBy(*by_slice).orderBy("_kind", order, tie).rowsBetween(
        Window.unboundedPreceding, 0
    )
    given = [c for c in offsets.columns if c not in by_slice]
    return (
        sliced.withColumn("_kind", F.lit(1))
        .unionByName(offsets.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
        .withColumns(
            {f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}
            | {f"_i_{n}": F.max(f"_v_{n}").over(inside) for n in maxima}
            | {c: F.first(c).over(inside) for c in given}
        )
        .where("_kind = 1")
        .withColumns(
            {n: F.col(f"_o_{n}") + F.coalesce(F.col(f"_i_{n}"), F.lit(0)) for n in sums}
            | {n: F.greatest(f"_o_{n}", f"_i_{n}") for n in maxima}
        )
        .drop("_slice", "_kind", *[f"{p}{n}" for p in ("_v_", "_i_", "_o_") for n in {**sums, **maxima}])
    )
