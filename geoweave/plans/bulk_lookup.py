"""Bulk lookup of request tables: validate, geocode, assign districts, expand (GC20, GC21, J3, J4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.functions import rules, text, vocab
from geoweave.operators import geocode as G
from geoweave.operators.spatial import CellIndex, assign_points, build_cell_index, with_district
from geoweave.session import cut_lineage


class Boundaries:
    """All boundary datasets with one cell index over them."""

    def __init__(self, features: DataFrame):
        self.features = cut_lineage(features.select("dataset", "ordinal", "props", "geom"), "features")
        self.index: CellIndex = build_cell_index(self.features)

    def lookup(self, points: DataFrame, pid: str, dataset: str, prefix: str) -> DataFrame:
        """J1 in the dataset each row names: adds prefix_ordinal, prefix_props and prefix_name."""
        assigned = assign_points(points, self.index, pid=pid, dataset=dataset)
        named = with_district(assigned, self.features, dataset=dataset)
        return named.withColumn(
            f"{prefix}_name", rules.district_name(F.col("props"))
        ).withColumnsRenamed({"ordinal": f"{prefix}_ordinal", "props": f"{prefix}_props"})


def two_level_lookup(points: DataFrame, boundaries: Boundaries, pid: str = "pid",
                     want_province: Column | None = None) -> DataFrame:
    """J3: the federal district of each point and, by its province, the provincial one.

    Rows need ``dataset``, the set of the first lookup. A province without a dataset gives null.
    """
    first = boundaries.lookup(points, pid, "dataset", "district")
    path = rules.province_path(F.col("district_props"))
    wanted = path if want_province is None else F.when(want_province, path)
    paths = first.withColumn(
        "province_dataset", F.when(wanted.isNotNull(), rules.dataset_of_path(wanted))
    )
    return boundaries.lookup(paths, pid, "province_dataset", "province")


def bulk_lookup(
    requests: DataFrame,
    store: G.AddressStore,
    boundaries: Boundaries,
    provinces: list[str],
    req_id: str = "req_id",
) -> DataFrame:
    """GC20, J4: one result row per request; failures are an error text, never a failed job.

    ``requests`` has req_id, path and the query fields (address, postal, city, state, country, lat,
    lon, return_raw, include_raw, method_raw). There is no limit on the number of rows, and ``req_id``
    may repeat or be missing: rows are told apart by a number of their own.
    """
    c = F.col
    error = F.coalesce(
        rules.batch_row_error(c(req_id).cast("string"), c("path"), c("address"), c("postal"), c("lat"), c("lon")),
        rules.query_error(
            *[c(f) for f in ("address", "postal", "city", "state", "country", "lat", "lon",
                             "return_raw", "include_raw", "method_raw")]
        ),
    )
    federal_path = c("path").isin(vocab.FEDERAL_PATHS)
    judged = requests.withColumns(
        {
            "error": error,
            "dataset": rules.dataset_of_path(c("path")),
            "geocode_method": rules.geocode_method(c("method_raw")),
            "want_town": F.array_contains(rules.return_fields(c("return_raw")), "municipality"),
            "want_province": federal_path & rules.include_province_default(
                c("path"), rules.include_province_flag(c("include_raw")), c("return_raw").isNotNull()
            ),
        }
    )
    clean = judged.withColumns(
        {
            "address": text.sanitize(c("address"), 500),
            "postal": F.when(text.null_to_empty(c("postal")) != "", text.postal_code(c("postal"))),
            **{f: text.sanitize(c(f), 100) for f in ("city", "state", "country")},
        }
    )
    kept = [req_id, "address", "postal", "city", "state", "lat", "lon", "geocode_method", "dataset",
            "want_town", "want_province"]
    numbered = clean.where("error IS NULL").select(*kept, F.monotonically_increasing_id().alias("_rid"))
    valid = cut_lineage(numbered, "valid")
    located = cut_lineage(
        G.geocode_mixed(valid, store, provinces, req_id="_rid"), "located"
    )
    found = located.where("error_code IS NULL AND to_lon IS NOT NULL").drop("lon", "lat", "error_code")
    looked = two_level_lookup(
        found.withColumnsRenamed({"to_lon": "lon", "to_lat": "lat"}), boundaries, "_rid",
        want_province=c("want_province"),
    )
    # The town comes from the geocoded address; points given as coordinates are looked up backwards.
    bare = looked.where("want_town AND row IS NULL").select(
        "_rid", "lon", "lat", "address", "postal", "city", "state"
    )
    context = G.address_for_point(bare.withColumnRenamed("_rid", "row_no"), store, provinces, pid="row_no").select(
        F.col("row_no").alias("_rid"), F.col("row").alias("near_row")
    )
    whole = looked.join(context, "_rid", "left").withColumn("shown", F.coalesce("row", "near_row"))
    town = rules.municipality(
        G.row_mailing(c("shown"))["municipality"], c("shown.city"), c("city")
    )
    mailing = G.row_mailing(c("shown"))
    ok = whole.withColumn("municipality", F.when(c("want_town"), town)).select(
        req_id, "dataset", "lon", "lat",
        F.col("district_name").alias("district"),
        rules.with_municipality(c("district_props"), c("municipality")).alias("properties"),
        F.when(c("want_province"), c("province_dataset")).alias("province_dataset"),
        F.when(c("want_province"), c("province_name")).alias("province_district"),
        F.when(c("want_province"), c("province_props")).alias("province_properties"),
        "municipality", "method", "confidence",
        F.when(c("shown").isNotNull(), mailing["single_line"]).alias("normalized_address"),
        F.lit(None).cast("string").alias("error"),
    )
    failed = located.where("error_code IS NOT NULL OR to_lon IS NULL").select(
        req_id, "dataset", F.coalesce("error_code", F.lit("ADDRESS_NOT_FOUND")).alias("error")
    )
    invalid = clean.where("error IS NOT NULL").select(req_id, "dataset", "error")
    return ok.unionByName(failed.unionByName(invalid), allowMissingColumns=True)


def precompute_postal(codes: DataFrame, store: G.AddressStore, boundaries: Boundaries,
                      provinces: list[str]) -> DataFrame:
    """GC21: district of each postal code in every live dataset, by lookup key.

    The datasets are a fixed short list attached to each code.
    """
    live = [d for d in vocab.DATASETS if d[6] == "live"]
    targets = F.array(
        *[F.struct(F.lit(d[1]).alias("dataset"), F.lit(d[4]).alias("path")) for d in live]
    )
    asked = codes.select("postal").distinct().withColumns(
        {"req_id": F.col("postal"), **{c: F.lit(None).cast("string") for c in ("city", "state")}}
    )
    placed = G.geocode_postal(asked, store, provinces).where("error_code IS NULL").select(
        "postal", F.col("row.lon").alias("lon"), F.col("row.lat").alias("lat"),
        F.inline(targets),
    )
    none = F.lit(None).cast("string")
    keyed = placed.withColumn(
        "lookup_key",
        rules.lookup_key(F.col("path"), none, F.col("postal"), none, none, none,
                         F.lit(None).cast("double"), F.lit(None).cast("double")),
    )
    return boundaries.lookup(keyed, "lookup_key", "dataset", "district").select(
        "lookup_key", "postal", "dataset", "lon", "lat", "district_ordinal", "district_name",
        "district_props",
    )
