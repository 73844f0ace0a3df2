"""Choosing among stored answers of outside geocoders (GC15-GC18).

Nothing here calls a service: the answers are input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.functions import rules, text

MIN_SCORE = 0.5  # fixed value: an answer scored lower is not used


def candidate_score(address: Column, title: Column, qualifier: Column) -> Column:
    """GC15: civic number +20, each longer street word +5, interpolated +2, highway or route -10."""
    upper = F.upper(text.null_to_empty(title))
    civic = F.regexp_extract(text.trim_ws(text.null_to_empty(address)), "^([0-9]+)", 1)
    street = F.regexp_replace(
        text.complete_street_type(text.null_to_empty(address)), r"^[0-9]+\s*", ""
    )
    words = F.transform(F.split(street, r"\s+"), lambda w: text.search_token(w))
    hits = F.size(F.filter(words, lambda w: (F.length(w) > 2) & F.contains(upper, w)))
    return (
        F.when((civic != "") & F.contains(upper, civic), 20).otherwise(0)
        + hits * 5
        + F.when(qualifier == "INTERPOLATED_POSITION", 2).otherwise(0)
        - F.when(upper.contains("HIGHWAY") | upper.contains("ROUTE"), 10).otherwise(0)
    )


def select_candidates(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """GC15: one answer per request: the best regional one, else the first.

    ``candidates`` (req_id, pos, title, qualifier, score, lon, lat). The choice is one aggregation
    that combines before its shuffle.
    """
    asked = requests.select("req_id", "address", "city", "state")
    hinted = (text.null_to_empty(F.col("city")) != "") | (text.null_to_empty(F.col("state")) != "")
    regional = hinted & rules.region_match(F.col("title"), F.col("state"), F.col("city"))
    points = candidate_score(F.col("address"), F.col("title"), F.col("qualifier"))
    order = F.struct(
        F.when(regional, 0).otherwise(1), F.when(regional, -points).otherwise(0), F.col("pos")
    )
    picked = candidates.join(asked, "req_id").select(
        "req_id", F.struct("pos", "title", "qualifier", "score", "lon", "lat").alias("c"),
        order.alias("o"),
    )
    return picked.groupBy("req_id").agg(F.min_by("c", "o").alias("c")).select("req_id", "c.*")


def provider_precedence(
    requests: DataFrame, local: DataFrame, first: DataFrame, fallback: DataFrame
) -> DataFrame:
    """GC16: local result, else the first provider's usable answer, else the fallback's.

    Each table has (req_id, lon, lat); ``first`` also qualifier and score. An answer of the first
    provider is not usable when it is interpolated without a region hint or scored below 0.5.
    """
    def named(df: DataFrame, prefix: str, extra: tuple[str, ...] = ()) -> DataFrame:
        return df.select(
            "req_id", *[F.col(c).alias(f"{prefix}_{c}") for c in ("lon", "lat", *extra)]
        )

    joined = (
        requests.join(named(local, "l"), "req_id", "left")
        .join(named(first, "p", ("qualifier", "score")), "req_id", "left")
        .join(named(fallback, "f"), "req_id", "left")
    )
    hinted = (text.null_to_empty(F.col("city")) != "") | (text.null_to_empty(F.col("state")) != "")
    usable = (
        F.col("p_lon").isNotNull()
        & (~F.col("p_qualifier").eqNullSafe("INTERPOLATED_POSITION") | hinted)
        & (F.coalesce("p_score", F.lit(1.0)) >= MIN_SCORE)
    )
    source = (
        F.when(F.col("l_lon").isNotNull(), "local")
        .when(usable, "first")
        .when(F.col("f_lon").isNotNull(), "fallback")
    )
    return joined.withColumn("source", source).select(
        *requests.columns, "source",
        *[
            F.when(F.col("source") == "local", F.col(f"l_{c}"))
            .when(F.col("source") == "first", F.col(f"p_{c}"))
            .when(F.col("source") == "fallback", F.col(f"f_{c}")).alias(c)
            for c in ("lon", "lat")
        ],
    )


# Component names, each with the component types that fill it.
COMPONENT_TYPES = {
    name: [name]
    for name in (
        "street_number route subpremise locality administrative_area_level_1 "
        "administrative_area_level_2 administrative_area_level_3 administrative_area_level_4 "
        "administrative_area_level_5 country postal_code postal_code_suffix neighborhood "
        "sublocality sublocality_level_1 sublocality_level_2 sublocality_level_3 "
        "sublocality_level_4 sublocality_level_5 premise establishment point_of_interest park "
        "street_address intersection political colloquial_area ward"
    ).split()
} | {"neighborhood": ["neighborhood", "sublocality"]}

_RESULT_SCHEMA = (
    "address_components array<struct<long_name: string, short_name: string, types: array<string>>>, "
    "formatted_address string, place_id string, types array<string>, "
    "geometry struct<location: struct<lat: double, lng: double>, location_type: string, "
    "viewport: struct<northeast: struct<lat: double, lng: double>, southwest: struct<lat: double, lng: double>>, "
    "bounds: struct<northeast: struct<lat: double, lng: double>, southwest: struct<lat: double, lng: double>>>, "
    "plus_code map<string, string>"
)


def address_components(raw: Column, names: list[str] | None = None) -> Column:
    """GC17: struct of parts from a provider's result JSON.

    Each part is the long name, else the short name, of the first component of a wanted type.
    """
    result = F.from_json(raw, _RESULT_SCHEMA)
    wanted = {n: COMPONENT_TYPES[n] for n in names} if names else COMPONENT_TYPES

    def part(types: list[str]) -> Column:
        found = F.try_element_at(
            F.filter(
                result["address_components"],
                lambda c: F.arrays_overlap(c["types"], F.array(*[F.lit(t) for t in types])),
            ),
            F.lit(1),
        )
        return F.coalesce(
            text.empty_to_null(found["long_name"]), text.empty_to_null(found["short_name"])
        )

    parts = [part(types).alias(name) for name, types in wanted.items()]
    extra = [result[c].alias(c) for c in ("formatted_address", "place_id", "types", "plus_code")]
    boxes = [result["geometry"][c].alias(c) for c in ("viewport", "bounds")]
    any_part = F.coalesce(*[part(types) for types in wanted.values()], result["formatted_address"])
    return F.when(
        result["address_components"].isNotNull() & any_part.isNotNull(),
        F.struct(*parts, *extra, *boxes),
    )


# GC18: record shapes. Required paths must be present; number bounds are inclusive.
PROVIDER_SCHEMAS = {
    "geogratis": (
        "title string, qualifier string, type string, "
        "geometry struct<type: string, coordinates: array<double>>, bbox array<double>, "
        "score double, component map<string, string>",
        ["geometry.type", "geometry.coordinates"],
    ),
    "google": (_RESULT_SCHEMA, ["geometry.location.lat", "geometry.location.lng"]),
    "nominatim": ("place_id bigint, lat string, lon string, display_name string, importance double",
                  ["lat", "lon"]),
    "mapbox": ("id string, type string, place_type array<string>, relevance double, text string, "
               "place_name string, center array<double>", ["type", "center"]),
}


def validate_records(records: DataFrame, raw: str, provider: str) -> DataFrame:
    """GC18: add ``record`` and ``record_error`` to a table of raw provider JSON."""
    schema, required = PROVIDER_SCHEMAS[provider]
    parsed = records.withColumn(
        "record",
        F.from_json(
            raw, schema + ", _corrupt string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
        ),
    )
    error = F.when(
        F.col("record").isNull() | F.col("record._corrupt").isNotNull(), "malformed record"
    )
    for path in required:
        error = error.when(F.col(f"record.{path}").isNull(), f"missing {path}")
    if provider == "geogratis":
        error = error.when(~F.coalesce(F.col("record.score"), F.lit(0.0)).between(0, 1), "score out of range")
    if provider == "mapbox":
        error = error.when(F.size("record.center") != 2, "center is not a pair")
    return parsed.withColumn("record_error", error)
