"""Postal, city and street aggregates, search rows and store statistics (AG1-AG7, SG1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions import text


def postal_centroids(addr: DataFrame) -> DataFrame:
    """AG1: mean point per province and postal code; rows without a code are left out."""
    return (
        addr.where("postal_code <> ''")
        .groupBy("province", "postal_code")
        .agg(
            F.avg("lat").alias("lat"),
            F.avg("lon").alias("lon"),
            F.count(F.lit(1)).alias("address_count"),
        )
    )


def city_centroids(addr: DataFrame) -> DataFrame:
    """AG2: mean point per city; the display spelling is that of the row with the highest id."""
    return addr.groupBy("province", "city_key").agg(
        F.max_by("city", "id").alias("city"),
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.count(F.lit(1)).alias("address_count"),
    )


def street_ranges(addr: DataFrame) -> DataFrame:
    """AG3: mean point and civic range per street; numbers without leading digits do not count."""
    civic = text.leading_int(F.col("civic_number"))
    return addr.groupBy("province", "city_key", "street_key").agg(
        F.min(civic).alias("min_civic"),
        F.max(civic).alias("max_civic"),
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.count(F.lit(1)).alias("address_count"),
    )


def street_search_rows(ranges: DataFrame, cities: DataFrame) -> DataFrame:
    """SG1: streets with their city's spelling and the text that is searched."""
    names = cities.select("province", "city_key", "city")
    return ranges.join(names, ["province", "city_key"]).withColumn(
        "suggest_text",
        F.concat_ws(
            " ",
            F.replace(F.col("street_key"), F.lit("|"), F.lit(" ")),
            F.substring_index("city_key", "|", 1),
            F.col("province"),
        ),
    )


def store_stats(addr: DataFrame, imports: DataFrame) -> DataFrame:
    """AG4: address count and latest import per province."""
    counts = addr.groupBy("province").agg(F.count(F.lit(1)).alias("address_count"))
    latest = imports.groupBy("province").agg(F.max("finished_at").alias("last_import"))
    return counts.join(latest, "province", "left")


def recent_imports(imports: DataFrame, n: int = 20) -> DataFrame:
    """AG4: the newest import rows."""
    return imports.orderBy(F.desc("finished_at"), F.desc("province")).limit(n)


def table_counts(**tables: DataFrame) -> DataFrame:
    """AG4: one row per table with its row count."""
    frames = [
        t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, t in tables.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def stale_provinces(ranges: DataFrame, indexed: DataFrame, flag_missing: bool = False) -> DataFrame:
    """AG5: provinces whose street count differs from the indexed count.

    ``flag_missing`` also reports provinces that only one side has.
    """
    a = ranges.groupBy("province").agg(F.count(F.lit(1)).alias("streets"))
    b = indexed.groupBy("province").agg(F.count(F.lit(1)).alias("indexed"))
    joined = a.join(b, "province", "full" if flag_missing else "inner").na.fill(
        0, ["streets", "indexed"]
    )
    return joined.where("streets <> indexed")


def civic_units(addr: DataFrame) -> DataFrame:
    """AG6, AG7: per civic number of a street, its first row and the number of distinct units.

    Rows are first reduced to one per unit, which is a plain partial aggregation, so a tower with
    very many rows is combined before the shuffle. The first row is the one without a unit, then by
    the unit's number and text.
    """
    keys = ["province", "city_key", "street_key", "civic_number"]
    row = F.struct(
        "unit", "postal_code", "street_name", "street_type", "street_direction", "city", "lat",
        "lon", "id",
    )
    per_unit = addr.groupBy(*keys, "unit").agg(F.min_by(row, "id").alias("row"))
    order = F.struct(
        F.when(F.col("unit") == "", 0).otherwise(1),
        F.coalesce(text.leading_int(F.col("unit")), F.lit(0)),
        F.col("unit"),
    )
    return per_unit.groupBy(*keys).agg(
        F.min_by("row", order).alias("first"),
        F.min_by("row", F.col("unit")).alias("least"),
        F.count(text.empty_to_null(F.col("unit"))).alias("unit_total"),
    )
