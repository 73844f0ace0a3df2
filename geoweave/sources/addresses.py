"""Address files and the stored address tables (IO1-IO3, IO7-IO9, IO11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import text, vocab
from geoweave.operators.aggregates import (
    city_centroids, postal_centroids, street_ranges, street_search_rows,
)
from geoweave.operators.parse import pin, standardize_addresses, with_mailing
from geoweave.operators.street_blocks import BlockIndex, segments
from geoweave.sources.store import Commit, Snapshot, snapshot

_NUMBER = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
FIELDS = [f for f in vocab.ADDRESS_HEADERS if f not in ("lat", "lon", "province")]


def read_address_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """IO1: header row, quoted fields with doubled quotes, trimmed cells, blank lines skipped.

    One record per line, so a large file is read by many tasks.
    """
    raw = (
        spark.read.option("header", True)
        .option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    return raw if max_rows is None else raw.limit(max_rows)


def _first_filled(raw: DataFrame, names: list[str]) -> Column:
    """IO2: first non-empty of the columns that the file has."""
    present = {c for c in raw.columns}
    found = [text.empty_to_null(F.trim(f"`{n}`")) for n in names if n in present]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _leading_number(value: Column) -> Column:
    return text.empty_to_null(F.regexp_extract(value, _NUMBER, 1)).try_cast("double")


def normalize_rows(raw: DataFrame, province: str | None = None) -> tuple[DataFrame, DataFrame]:
    """IO2, IO3: (address rows, rejected rows with their reason)."""
    headers = vocab.ADDRESS_HEADERS
    # Pinned, one after the other: each step reads the one before several times.
    filled = pin(
        raw,
        {"_lat": _first_filled(raw, headers["lat"]), "_lon": _first_filled(raw, headers["lon"]),
         "_code": _first_filled(raw, headers["province"])},
    )
    checked = pin(
        filled,
        {"_lat": _leading_number(F.col("_lat")), "_lon": _leading_number(F.col("_lon")),
         "_code": F.coalesce(text.province_code(F.col("_code")), F.col("_code"))},
    )
    rows = checked.select(
        F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.col("_code").alias("province"),
        *[text.null_to_empty(_first_filled(raw, headers[f])).alias(f) for f in FIELDS],
    )
    reason = (
        F.when(F.col("lat").isNull() | F.col("lon").isNull(), "no coordinates")
        .when(F.coalesce(F.length("province"), F.lit(0)) != 2, "unknown province")
    )
    if province is not None:
        reason = reason.when(F.col("province") != province, "other province")
    judged = rows.withColumn("reject_reason", reason)
    return (
        judged.where("reject_reason IS NULL").drop("reject_reason"),
        judged.where("reject_reason IS NOT NULL"),
    )


CONTENT = ["province", "lat", "lon", *FIELDS]


def missing_rows(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """IO8: rows (with their copy number) that are not stored yet, whatever the order of the file.

    Equal rows are counted, not listed, so very many copies of one row meet in no task; only copies
    beyond the stored count come back.
    """
    counted = rows.groupBy(*CONTENT).agg(F.count(F.lit(1)).alias("copies"))
    if stored is None:
        have = counted.withColumn("stored", F.lit(0))
    else:
        # Stored rows keep the content they were read with in row_key.
        kept = stored.groupBy("row_key").agg(F.count(F.lit(1)).alias("stored"))
        have = counted.withColumn("row_key", row_key()).join(kept, "row_key", "left")
    gap = have.withColumn("stored", F.coalesce("stored", F.lit(0))).where("copies > stored")
    return gap.select(
        *CONTENT, F.explode(F.sequence(F.col("stored") + 1, F.col("copies"))).alias("copy_no")
    )


def row_key() -> Column:
    return F.md5(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in CONTENT]))


def address_table(rows: DataFrame) -> DataFrame:
    """Stored form: stable id, keys and mailing fields. ``rows`` come from ``missing_rows``."""
    keyed = rows.withColumn("row_key", row_key()).withColumn(
        "id", F.xxhash64("row_key", "copy_no")
    ).drop("copy_no")
    stored = with_mailing(standardize_addresses(keyed))
    return stored.select(
        *[c for c in stored.columns if c != "mailing"],
        F.col("mailing.line1").alias("mailing_line1"),
        F.col("mailing.line2").alias("mailing_line2"),
        F.col("mailing.municipality").alias("municipality"),
        F.col("mailing.province").alias("province_code"),
        F.col("mailing.postal_code").alias("mailing_postal_code"),
    )


TABLES = ["addresses", "postal_centroids", "city_centroids", "street_ranges", "street_search"]


INDEX_TABLES = ["street_docs", "street_heads", "street_blocks", "street_totals"]


def index_streets(work: Commit, streets: DataFrame, provinces: list[str]) -> None:
    """SG1: the index segments of ``provinces`` anew from their search rows; other segments stay as they are."""
    for name, rows in zip(INDEX_TABLES, segments(streets)):
        work.replace(name, rows, "province", provinces)


def street_index(shot: Snapshot) -> BlockIndex:
    """The stored street index of one version."""
    return BlockIndex(*[shot.read(name) for name in INDEX_TABLES])


def rebuild_aggregates(work: Commit, province: str, search_index: bool = False) -> None:
    """IO9: the three aggregates and the search rows of one province, from the addresses of ``work``.

    A province without addresses any more loses its rows. With ``search_index``, or where the store has a
    street index already, the province's segment of it follows.
    """
    addr = work.read("addresses", [province])
    work.replace("postal_centroids", postal_centroids(addr), "province", [province])
    work.replace("city_centroids", city_centroids(addr), "province", [province])
    work.replace("street_ranges", street_ranges(addr), "province", [province])
    streets = street_search_rows(work.read("street_ranges", [province]), work.read("city_centroids", [province]))
    work.replace("street_search", streets, "province", [province])
    if search_index or INDEX_TABLES[0] in work.tables():
        index_streets(work, work.read("street_search", [province]), [province])


def import_province(
    spark: SparkSession, csv_path: str, root: str, province: str, version: str,
    resume: bool = False, max_rows: int | None = None, search_index: bool = False,
) -> DataFrame:
    """IO7, IO8, IO11: load one province and return its import-log row.

    A plain load replaces the province's rows of every table, also with nothing when the file has no
    row of it; a resumed one adds the rows that are missing and rebuilds the aggregates. All tables and the
    log change in one step at the end: a load that breaks off before changes nothing.
    """
    good, bad = normalize_rows(read_address_csv(spark, csv_path, max_rows), province)
    work = snapshot(spark, root).commit()
    known = set(work.tables())
    if resume and "addresses" in known:
        fresh = address_table(missing_rows(good, work.read("addresses", [province])))
        work.append("addresses", fresh, "province")
    else:
        work.replace("addresses", address_table(missing_rows(good, None)), "province", [province])
    rebuild_aggregates(work, province, search_index)
    rejected = bad.agg(F.count(F.lit(1)).alias("n"))
    entry = work.read("addresses", [province]).agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(province).alias("province"),
        F.lit(csv_path).alias("source"),
        F.lit(version).alias("source_version"),
        "row_count",
        rejected.scalar().alias("rejected"),
        F.current_timestamp().alias("finished_at"),
    )
    earlier = [work.read("imports", [province])] if "imports" in known else []
    work.replace("imports", reduce(DataFrame.unionByName, [*earlier, entry]), "province", [province])
    done = work.publish()
    return done.read("imports", [province]).orderBy(F.desc("finished_at")).limit(1)
