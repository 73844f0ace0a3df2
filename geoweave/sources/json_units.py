"""Large JSON files of one root object, read by many tasks.

The text source cuts a file at closing braces, so byte ranges are read apart from each other. Whether
a piece starts inside a string, and how deep, follows from running counts: inside a byte range by a
window, over the ranges by a summary with one row each. Pieces are put together to units: everything
up to a closing brace that leaves at most the root object and one array of it open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoweave.session import cut_lineage

RANGE = ["file", "block"]


def _carried(pieces: DataFrame, what: dict[str, Column]) -> DataFrame:
    """Add for every column the sum of all earlier pieces of the file.

    A byte range has at most ``spark.sql.files.maxPartitionBytes``, a file few ranges.
    """
    inside = Window.partitionBy(*RANGE).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy(*RANGE).agg(*[F.sum(e).alias(f"_{n}") for n, e in what.items()])
    start = totals.select(*RANGE, *[F.coalesce(F.sum(f"_{n}").over(over), F.lit(0)).alias(f"_{n}") for n in what])
    added = {n: F.col(f"_{n}") + F.coalesce(F.sum(e).over(inside), F.lit(0)) for n, e in what.items()}
    return pieces.join(start, RANGE).withColumns(added).drop(*[f"_{n}" for n in what])


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """(file, unit, start, end, body): consecutive pieces of each file with the depth before and after.

    ``end`` is 2 after an object of an array of the root object, 1 after an object member of the root, 0 after
    the root; a last unit of another depth belongs to a broken file. A file that lacks only its last brace
    counts as whole; white space after the root is no unit. Objects deeper than that stay within their unit.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value"),
    )
    # An escaped sign is never a brace, so an escape cannot reach over a cut.
    plain = F.regexp_replace("value", r"\\.", "")
    quoted = raw.withColumn("quotes", F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit(""))))
    quoted = cut_lineage(_carried(quoted, {"quotes_before": F.col("quotes")}), "json_quotes")
    opens = F.when(F.col("quotes_before") % 2 == 1, F.lit('"')).otherwise("")
    in_string = (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    bare = F.regexp_replace(F.concat(opens, plain), '"[^"]*("|$)', "")
    count = lambda sign: F.length(bare) - F.length(F.replace(bare, F.lit(sign), F.lit("")))
    deep = quoted.select(
        *RANGE, "id", "value", in_string.alias("in_string"),
        (count("{") - count("}") - F.when(in_string, 0).otherwise(1)).alias("braces"),
        (count("[") - count("]")).alias("lists"),
    )
    deep = _carried(cut_lineage(deep, "json_depth"), {"in_braces": F.col("braces"), "in_lists": F.col("lists")})
    braces, lists = F.col("in_braces") + F.col("braces"), F.col("in_lists") + F.col("lists")
    start = F.col("in_braces") + F.col("in_lists")
    after_root = (start == 0) & (F.trim(F.translate("value", "\t\r\n", "")) == "")
    closes = F.when(~F.col("in_string") & (braces <= 1) & (lists <= 1), 1).otherwise(0)
    deep = deep.select(
        *RANGE, "id", "value", start.alias("start"), (braces + lists).alias("end"), closes.alias("closes")
    ).where(~after_root)
    counted = _carried(deep, {"unit": F.col("closes")})
    pieces = F.array_sort(F.collect_list(F.struct("block", "id", "value")))
    at = F.struct("block", "id")
    return counted.groupBy("file", "unit").agg(
        F.min_by("start", at).alias("start"),
        F.max_by("end", at).alias("end"),
        F.concat(F.array_join(F.transform(pieces, lambda p: p["value"]), "}"), F.lit("}")).alias("body"),
    )


# Key under which the items of an array appear that an earlier unit has opened.
GOING_ON = "~"


def as_object(start: Column, end: Column, body: Column) -> Column:
    """A unit as a JSON object of its own: opened and closed, items of an earlier array under GOING_ON."""
    text = F.regexp_replace(body, r"^[\s\uFEFF]+", "")
    unled = F.regexp_replace(text, r"^[\],\s]*", "")
    opened = (
        F.when(start == 0, text)
        .when((start == 2) & ~F.startswith(text, F.lit("]")), F.concat(F.lit(f'{{"{GOING_ON}":['), unled))
        .otherwise(F.concat(F.lit("{"), unled))
    )
    return F.concat(opened, F.when(end == 2, "]}").when(end == 1, "}").otherwise(""))


def goes_on(start: Column, body: Column) -> Column:
    """Whether a unit is one more object of the array that is open."""
    return (start == 2) & body.rlike(r"^\s*,\s*\{")
