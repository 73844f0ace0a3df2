"""Boundary files and the dataset registry (IO4-IO6, IO10, IO12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoweave.functions import text, vocab
from geoweave.functions.geometry import GEOM_TYPE, bounding_box, vertex_centroid
from geoweave.operators.running import running
from geoweave.session import cut_lineage
from geoweave.sources.json_units import GOING_ON, as_object, goes_on, read_units
from geoweave.sources.store import Snapshot, snapshot


def dataset_registry(spark: SparkSession) -> DataFrame:
    """One federal and thirteen provincial datasets; a fixed dimension of fourteen rows."""
    return spark.createDataFrame(
        vocab.DATASETS,
        "code string, dataset string, name string, year int, path string, "
        "aliases array<string>, status string",
    )


# Numbers that the features of one set may take.
SET_STRIDE = 1 << 50

# Geometry stays text until its type is known: coordinates nest to a different depth per type.
_FEATURE_JSON = (
    "type string, properties map<string, string>, geometry struct<type: string, coordinates: string>"
)
# So does an item until it is looked at by itself: an odd one does not spoil the others.
_UNIT_JSON = f"type string, features array<string>, `{GOING_ON}` array<string>"
# Units of a file that are numbered in one task.
UNIT_SLICE = 1 << 16


def parse_geometry(kind: Column, coordinates: Column) -> Column:
    """GeoJSON coordinates text to a MultiPolygon array; null for other types or broken text."""
    as_multi = F.from_json(coordinates, GEOM_TYPE)
    as_polygon = F.from_json(coordinates, "array<array<array<double>>>")
    return F.when(kind == "MultiPolygon", as_multi).when(
        (kind == "Polygon") & as_polygon.isNotNull(), F.array(as_polygon)
    )


def read_geojson(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """IO4: (features, rejects) of one or many FeatureCollection files.

    Every feature is checked, not a sample. Rejects carry a reason and never stop the load. A large file is
    read in byte ranges by many tasks; a feature is the unit that must fit one. ``ordinal`` numbers the
    features of all files, file after file in the order of their names. A file whose braces do not match is
    rejected as a whole; a file without content has no row.
    """
    units = read_units(spark, path).withColumns(
        {"going": goes_on(F.col("start"), F.col("body")), "text": as_object(F.col("start"), F.col("end"), F.col("body"))}
    )
    # The last key of a unit that opened an array tells whether that array is the features.
    keys = F.map_keys(F.from_json("text", "map<string,string>"))
    opened = F.when(~F.col("going") & (F.col("end") == 2), F.try_element_at(keys, F.lit(-1)))
    parsed = cut_lineage(
        units.withColumns({"json": F.from_json("text", _UNIT_JSON), "opened": F.nullif(opened, F.lit(GOING_ON))})
        .select(
            "file", "unit", "end", "going", "json.type", "opened",
            F.col("json.features").alias("features"), F.col(f"json.`{GOING_ON}`").alias("more"),
        ),
        "json_units",
    )
    size = F.greatest(F.size(F.coalesce("features", "more", F.array())), F.lit(0))
    opens = F.col("opened").isNotNull().cast("bigint")
    numbered = running(
        parsed, ["file"], "unit", "unit", UNIT_SLICE, sums={"upto": size.cast("bigint"), "arrays": opens},
    ).withColumns({"before": F.col("upto") - size, "arrays_before": F.col("arrays") - opens})
    # One row per file from here on.
    whole = parsed.groupBy("file").agg(
        F.max_by("end", "unit").alias("depth"),
        F.min_by("type", F.when(F.col("type").isNotNull() & ~F.col("going"), F.col("unit"))).alias("type"),
    ).select("file", F.when(F.col("depth") == 0, F.col("type")).alias("collection_type"))
    heads = numbered.where("features IS NOT NULL").groupBy("file").agg(
        F.min("unit").alias("head"), F.min_by("before", "unit").alias("skipped"),
        F.min_by("arrays", "unit").alias("array"),
    )
    files = whole.join(heads, "file", "left")
    ours = numbered.drop("type").join(files, "file").where(
        "collection_type IS NOT NULL AND (unit = head OR (unit > head AND arrays_before = array))"
    )
    items = ours.select(
        "file", "collection_type", (F.col("before") - F.col("skipped")).alias("_from"),
        F.posexplode(F.when(F.col("unit") == F.col("head"), F.col("features")).otherwise(F.col("more"))),
    ).withColumn("position", F.col("_from") + F.col("pos"))
    counts = files.join(items.groupBy("file").agg(F.count(F.lit(1)).alias("items")), "file", "left")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        "file", "collection_type", F.coalesce(F.sum("items").over(earlier), F.lit(0)).alias("first"), "items"
    )
    listed = items.join(firsts.select("file", "first"), "file").select(
        "file", "collection_type", (F.col("first") + F.col("position")).alias("ordinal"),
        F.from_json("col", _FEATURE_JSON).alias("col"),
    )
    exploded = listed.unionByName(
        firsts.where("items IS NULL").select("file", "collection_type"), allowMissingColumns=True
    ).select(
        "file",
        "collection_type",
        "ordinal",
        F.col("col.type").alias("feature_type"),
        F.col("col.properties").alias("props"),
        F.col("col.geometry.type").alias("geometry_type"),
        parse_geometry(F.col("col.geometry.type"), F.col("col.geometry.coordinates")).alias("geom"),
    )
    reason = (
        F.when(F.col("collection_type").isNull(), "not a JSON object")
        .when(F.col("collection_type") != "FeatureCollection", "not a FeatureCollection")
        .when(F.col("ordinal").isNull(), "no features")
        .when(~F.col("feature_type").eqNullSafe("Feature"), "not a Feature")
        .when(F.col("geometry_type").isNull(), "missing geometry")
        .when(F.col("geom").isNull(), "missing or unsupported coordinates")
    )
    checked = exploded.withColumn("reject_reason", reason).withColumn("dataset", F.lit(dataset))
    good = checked.where("reject_reason IS NULL").select("dataset", "ordinal", "props", "geom")
    bad = checked.where("reject_reason IS NOT NULL").select(
        "dataset", "file", "ordinal", "reject_reason"
    )
    return good, bad


def boundary_name(props: Column) -> Column:
    """IO5: name from the known fields in order, else from any key that looks like a name."""
    listed = text.first_present(props, vocab.BOUNDARY_NAME_FIELDS, trim_result=True)
    named = F.filter(
        F.map_entries(props),
        lambda e: F.upper(e["key"]).rlike("NAME|DIST") & (text.trim_ws(e["value"]) != ""),
    )
    return F.coalesce(listed, text.trim_ws(F.try_element_at(named, F.lit(1))["value"]))


def normalize_boundaries(features: DataFrame, province: Column | str) -> tuple[DataFrame, DataFrame]:
    """IO5: (features with only ENGLISH_NAME and PROV_TERR, features without a name)."""
    province = F.lit(province) if isinstance(province, str) else province
    named = features.withColumn("_name", boundary_name(F.col("props")))
    good = named.where("_name IS NOT NULL").withColumn(
        "props",
        F.create_map(F.lit("ENGLISH_NAME"), F.col("_name"), F.lit("PROV_TERR"), F.upper(province)),
    ).drop("_name")
    bad = named.where("_name IS NULL").drop("_name").withColumn(
        "reject_reason", F.lit("no name property")
    )
    return good, bad


def union_boundaries(*sets: DataFrame) -> DataFrame:
    """IO6: one table of several sets.

    Features of a dataset that an earlier set holds as well are numbered after those: SET_STRIDE
    numbers further for every such set. Other rows keep their number.
    """
    if any("dataset" not in s.columns or "ordinal" not in s.columns for s in sets):
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)
    held = reduce(
        DataFrame.unionByName,
        [s.select("dataset", F.lit(i).alias("_set")).distinct() for i, s in enumerate(sets)],
    )
    before = Window.partitionBy("dataset").orderBy("_set")
    shift = held.withColumn("_shift", (F.row_number().over(before) - 1).cast("bigint") * SET_STRIDE)
    numbered = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [s.withColumn("_set", F.lit(i)) for i, s in enumerate(sets)],
    )
    return (
        numbered.join(shift, ["dataset", "_set"], "left")
        .withColumn("ordinal", F.col("ordinal") + F.coalesce("_shift", F.lit(0)))
        .select(*[c for c in numbered.columns if c != "_set"])
    )


def feature_rows(features: DataFrame) -> DataFrame:
    """IO10: stored form with id, box and centroid.

    A feature without an id property takes its position. Where several features of a dataset come
    to the same id, all but the first add their position to it after a ``#``.
    """
    ids = [F.try_element_at("props", F.lit(f)) for f in vocab.BOUNDARY_ID_FIELDS]
    place = F.col("ordinal").cast("string")
    given = features.withColumn("_given", F.coalesce(*ids, place))
    firsts = given.groupBy("dataset", "_given").agg(F.min("ordinal").alias("_first"))
    again = F.col("_first") != F.col("ordinal")
    return (
        given.join(firsts, ["dataset", "_given"], "left")
        .withColumn("_id", F.when(again, F.concat_ws("#", "_given", place)).otherwise(F.col("_given")))
        .withColumn("bbox", bounding_box(F.col("geom")))
        .withColumn("centroid", vertex_centroid(F.col("geom")))
        .withColumn(
            "id", F.concat_ws("_", "dataset", "_id")
        )
        .select(*features.columns, "bbox", "centroid", "id")
    )


def write_features(features: DataFrame, root: str, datasets: list[str] | None = None) -> Snapshot:
    """IO10: replace the stored rows of the datasets at hand in one step; other datasets stay.

    ``datasets`` names those to replace, so that one without rows any more is emptied.
    """
    work = snapshot(features.sparkSession, root).commit()
    rows = feature_rows(features).withColumn("synced_at", F.current_timestamp())
    work.replace("features", rows, "dataset", datasets or [])
    return work.publish()


def missing_datasets(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """IO12: live registry entries without a stored dataset."""
    return (
        dataset_registry(spark)
        .where("status = 'live'")
        .join(stored.select("dataset").distinct(), "dataset", "left_anti")
        .select("dataset", "path")
    )
