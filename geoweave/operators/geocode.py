"""The geocoding cascade over whole request tables (GC1-GC14, GC19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.functions import text, vocab
from geoweave.functions.geometry import haversine
from geoweave.functions.mailing import mailing_address
from geoweave.operators.aggregates import city_centroids, postal_centroids, street_ranges
from geoweave.operators.asof import neighbours
from geoweave.operators.nearest import nearest_address
from geoweave.operators.parse import parse_requests, street_readings
from geoweave.operators.skew import hot_keys, salted_join, spread_join
from geoweave.session import BROADCAST_MAX_ROWS, cut_lineage

ADDRESS_FIELDS = [
    "id", "province", "civic_number", "street_name", "street_type", "street_direction", "unit",
    "postal_code", "city", "lat", "lon",
]
_ROW_TYPE = (
    "struct<id: bigint, province: string, civic_number: string, street_name: string, "
    "street_type: string, street_direction: string, unit: string, postal_code: string, "
    "city: string, lat: double, lon: double>"
)

# Order of the steps; an error of an earlier step stops the later ones.
EARLY, EXACT, STREET, POSTAL, CITY, NEAREST = range(6)


def address_row(**given: Column) -> Column:
    """An address struct with '' for the text fields that are not given."""
    fields = []
    for name in ADDRESS_FIELDS:
        default = F.lit(0) if name == "id" else F.lit("")
        fields.append(given.get(name, default).alias(name))
    return F.struct(*fields).cast(_ROW_TYPE)


def stored_row() -> Column:
    return F.struct(*ADDRESS_FIELDS).cast(_ROW_TYPE)


class AddressStore:
    """Standardised addresses with the lookup tables the cascade joins to.

    Each table is reduced to one row per join key by an aggregation that combines before its
    shuffle, so very many rows with one key (a tower, copies of a file) never meet in a join.
    """

    def __init__(self, addr: DataFrame):
        self.addr = addr
        self.spark = addr.sparkSession
        self._parts: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._parts:
            self._parts[name] = make()
        return self._parts[name]

    @property
    def postal(self) -> DataFrame:
        return self._once("postal", lambda: postal_centroids(self.addr))

    @property
    def cities(self) -> DataFrame:
        return self._once("cities", lambda: cut_lineage(city_centroids(self.addr), "cities"))

    @property
    def streets(self) -> DataFrame:
        return self._once("streets", lambda: cut_lineage(street_ranges(self.addr), "street_ranges"))

    @property
    def small_streets(self) -> DataFrame:
        """Street keys, broadcast while their counted number is small; a plain join beyond that."""

        def make() -> DataFrame:
            keys = self.streets.select("city_key", "street_key").distinct()
            return F.broadcast(keys) if keys.count() <= BROADCAST_MAX_ROWS else keys

        return self._once("small_streets", make)

    @property
    def small_cities(self) -> DataFrame:
        """City keys, broadcast while their counted number is small; a plain join beyond that."""

        def make() -> DataFrame:
            keys = self.cities.select("city_key").distinct()
            return F.broadcast(keys) if keys.count() <= BROADCAST_MAX_ROWS else keys

        return self._once("small_cities", make)

    @property
    def by_search_key(self) -> DataFrame:
        """(search_key, unit_key): first address and the spread of cities; unit_key '' is any unit."""

        def make() -> DataFrame:
            units = F.when(
                F.col("unit_key") != "", F.array(F.lit(""), F.col("unit_key"))
            ).otherwise(F.array(F.lit("")))
            has_unit = F.when(F.col("unit") == "", 0).otherwise(1)
            return (
                self.addr.withColumn("want_unit", F.explode(units))
                .groupBy("search_key", "want_unit")
                .agg(
                    F.min_by(stored_row(), F.struct(has_unit, "id")).alias("row"),
                    F.min(F.struct(has_unit.alias("u"), "id")).alias("row_order"),
                    F.min("city").alias("city_min"),
                    F.max("city").alias("city_max"),
                )
            )

        return self._once("by_search_key", make)

    @property
    def by_civic(self) -> DataFrame:
        """(city_key, street_key, civic, unit): first address; unit '' is any unit."""

        def make() -> DataFrame:
            units = F.when(
                F.col("unit_key") != "", F.array(F.lit(""), F.col("unit_key"))
            ).otherwise(F.array(F.lit("")))
            return (
                self.addr.withColumn("want_unit", F.explode(units))
                .groupBy("city_key", "street_key", F.col("civic_number").alias("civic"), "want_unit")
                .agg(F.min_by(stored_row(), "id").alias("row"))
            )

        return self._once("by_civic", make)

    @property
    def by_civic_value(self) -> DataFrame:
        """(city_key, street_key, v): first address per civic value; no leading digits means 0."""
        value = F.coalesce(text.leading_int(F.col("civic_number")), F.lit(0)).cast("bigint")
        return self._once(
            "by_civic_value",
            lambda: self.addr.groupBy("city_key", "street_key", value.alias("v")).agg(
                F.min_by(stored_row(), "id").alias("row")
            ),
        )


REQUEST_FIELDS = ["address", "postal", "city", "state", "lat", "lon"]


def distinct_queries(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with qid, distinct queries by qid): equal requests are geocoded once."""
    have = dict(requests.dtypes)
    filled = requests.withColumns(
        {c: F.lit(None).cast("double") for c in ("lat", "lon") if c not in have}
        | {c: F.lit(None).cast("string") for c in ("address", "postal", "city", "state") if c not in have}
    )
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REQUEST_FIELDS]
    keyed = filled.withColumn("qid", F.md5(F.concat_ws("\u0001", *as_text)))
    # A null text and an empty one ask the same, so the id alone is the key.
    return keyed, keyed.groupBy("qid").agg(
        *[F.min(c).alias(c) for c in REQUEST_FIELDS], F.count(F.lit(1)).alias("copies")
    )


def parse_queries(queries: DataFrame, provinces: list[str]) -> DataFrame:
    """Parsed queries with the readings, the province of their keys and an early error, if any."""
    parsed = parse_requests(queries)
    has_street = (F.col("x_name") != "") | (F.col("x_civic") != "")
    has_context = (
        (F.col("q_city") != "") | F.col("q_province").isNotNull() | F.col("q_postal").isNotNull()
    )
    error = F.when(has_street & ~has_context, "AMBIGUOUS_LOCATION").when(
        F.col("q_province").isNotNull() & ~F.col("q_province").isin(provinces),
        "PROVINCE_NOT_LOADED",
    )
    return parsed.withColumns(
        {
            "early_error": error,
            "key_province": F.coalesce("q_province", F.lit(provinces[0])),
            "readings": street_readings(),
        }
    ).drop("r_name", "r_type", "r_direction", "r_civic", "r_unit")


def city_spellings(queries: DataFrame, store: AddressStore) -> DataFrame:
    """(query columns, city_rank, city_token, city_key): spellings that exist in the store.

    A query has up to two dozen spellings; the short list of stored cities drops nearly all of them
    before anything is shuffled.
    """
    spellings = text.city_candidates(F.col("q_city"), F.col("key_province"))
    spellings = F.when(F.size(spellings) > 0, spellings).otherwise(F.array(F.lit("")))
    return (
        queries.select("*", F.posexplode(spellings).alias("city_rank", "city_token"))
        .withColumn("city_key", F.concat_ws("|", "city_token", "key_province"))
        .join(store.small_cities, "city_key", "left_semi")
    )


def exact_hits(spelled: DataFrame, store: AddressStore) -> DataFrame:
    """GC1, GC2: (qid, step, method, row, error_code) of queries with an exact address.

    Best by spelling and reading, then an address without unit, then id. When only another spelling
    of the city matched and the matches span several cities the location is ambiguous.
    """
    civic = text.search_token(F.col("x_civic"))
    name, kind, direction = (F.col(f"reading.{c}") for c in ("name", "type", "direction"))
    keyed = (
        spelled.select(
            "qid", "city_rank", F.col("q_unit").alias("want_unit"),
            F.posexplode("readings").alias("reading_rank", "reading"),
            "x_civic", "city_token", "city_key", "key_province",
        )
        # Readings of streets that are not stored go before anything is written.
        .withColumn("street_key", F.concat_ws("|", *[text.empty_to_null(c) for c in (name, kind, direction)]))
        .join(store.small_streets, ["city_key", "street_key"], "left_semi")
        .select(
            "qid", "city_rank", "want_unit", "reading_rank",
            F.concat_ws("|", civic, name, kind, direction, "city_token", "key_province").alias("search_key"),
        )
    )
    # Written: the join below counts its left side before it reads it.
    hits = spread_join(
        cut_lineage(keyed, "search_keys"), store.by_search_key, ["search_key", "want_unit"],
        ["qid", "city_rank"], "inner",
    )
    best = hits.groupBy("qid").agg(
        F.min_by(
            F.struct("row", "city_rank"), F.struct("city_rank", "reading_rank", "row_order")
        ).alias("best"),
        F.min("city_min").alias("city_min"),
        F.max("city_max").alias("city_max"),
    )
    ambiguous = (F.col("best.city_rank") > 0) & (F.col("city_min") != F.col("city_max"))
    return best.select(
        "qid",
        F.lit(EXACT).alias("step"),
        F.lit("exact").alias("method"),
        F.when(~ambiguous, F.col("best.row")).alias("row"),
        F.lit(None).cast("double").alias("distance"),
        F.when(ambiguous, "AMBIGUOUS_LOCATION").alias("error_code"),
    )


def street_hits(spelled: DataFrame, store: AddressStore) -> DataFrame:
    """GC3, GC4: street matches of queries with a city and a street name.

    With a civic number: the equal number (and unit), else the nearest number on the best street.
    Without one: the mean point of the best street. A unit that is not found ends the step.
    """
    kinds = F.when(F.col("x_type") != "", F.array("x_type")).otherwise(
        text.literal_array(vocab.DEFAULT_STREET_TYPES)
    )
    key = F.concat_ws(
        "|",
        F.col("x_name"),
        text.empty_to_null(F.col("kind")),
        text.empty_to_null(F.col("x_direction")),
    )
    tried = (
        spelled.where("q_city <> '' AND x_name <> ''")
        .select(
            "qid", "city_key", "city_rank", "x_name", "x_direction", "x_civic", "q_city", "q_unit",
            "q_postal", "q_civic", F.posexplode(kinds).alias("type_rank", "kind"),
        )
        .withColumn("street_key", key)
        .withColumn("rank", F.struct("city_rank", "type_rank"))
        # Both joins below are on stored streets: the others go before anything is written.
        .join(store.small_streets, ["city_key", "street_key"], "left_semi")
    )
    tried = cut_lineage(tried, "streets_tried")
    numbered = F.col("q_civic.numeric").isNotNull()

    # Equal civic number, on any of the streets tried.
    civic_tried = tried.where(numbered).select(
        "qid", "rank", "city_key", "street_key", F.col("q_civic.raw").alias("civic"),
        F.col("q_unit").alias("want_unit"),
    )
    equal = (
        spread_join(
            civic_tried, store.by_civic, ["city_key", "street_key", "civic", "want_unit"],
            ["qid", "rank"], "inner",
        )
        .groupBy("qid")
        .agg(F.min_by("row", F.struct("rank", "row.id")).alias("row"))
        .withColumn("order", F.lit(0))
    )

    # Best street that exists, for the two fallbacks.
    streets = store.streets.select("city_key", "street_key", "lat", "lon", "province")
    best_street = (
        spread_join(
            tried.where(~(numbered & (F.col("q_unit") != ""))), streets,
            ["city_key", "street_key"], ["qid", "city_rank"], "inner",
        )
        .groupBy("qid")
        .agg(
            F.min_by(
                F.struct(
                    "city_key", "street_key", "lat", "lon", "province", "x_name", "kind",
                    "x_direction", "x_civic", "q_city", "q_postal", "q_civic",
                ),
                "rank",
            ).alias("s")
        )
        .select("qid", "s.*")
    )
    wanted = best_street.where(numbered).select(
        "qid", "city_key", "street_key", F.col("q_civic.numeric").alias("v")
    )
    # A civic value asked on a street is looked up once, however many queries ask for it.
    asked = wanted.select("city_key", "street_key", "v").distinct()
    around = neighbours(store.by_civic_value, asked, ["city_key", "street_key"], 256)
    sides = around.select(
        "city_key", "street_key", "v",
        F.explode(F.array_compact(F.array("prev_v", "next_v"))).alias("at"),
    )
    values = store.by_civic_value.withColumnRenamed("v", "at")
    closest = (
        sides.join(values, ["city_key", "street_key", "at"])
        .groupBy("city_key", "street_key", "v")
        .agg(F.min_by("row", F.struct(F.abs(F.col("at") - F.col("v")), F.col("row.id"))).alias("row"))
    )
    nearest = wanted.join(closest, ["city_key", "street_key", "v"]).select(
        "qid", "row", F.lit(1).alias("order")
    )
    middle = best_street.where(~numbered | F.col("q_civic").isNull()).select(
        "qid",
        address_row(
            province=F.col("province"), civic_number=F.col("x_civic"), street_name=F.col("x_name"),
            street_type=F.coalesce(
                F.try_element_at(F.split("street_key", r"\|"), F.lit(2)), F.lit("")
            ),
            street_direction=F.col("x_direction"),
            postal_code=F.coalesce("q_postal", F.lit("")), city=F.col("q_city"),
            lat=F.col("lat"), lon=F.col("lon"),
        ).alias("row"),
        F.lit(2).alias("order"),
    )
    return (
        equal.unionByName(nearest).unionByName(middle)
        .groupBy("qid").agg(F.min_by("row", "order").alias("row"))
        .select(
            "qid", F.lit(STREET).alias("step"), F.lit("street_interpolated").alias("method"), "row",
            F.lit(None).cast("double").alias("distance"),
            F.lit(None).cast("string").alias("error_code"),
        )
    )


def postal_hits(queries: DataFrame, store: AddressStore, provinces: list[str],
                max_hint_meters: float = vocab.MAX_POSTAL_HINT_METERS) -> DataFrame:
    """GC5: centroid of the postal code, near the hint point when there is one."""
    wanted = queries.where("q_postal IS NOT NULL").select(
        "qid", F.col("q_postal").alias("postal_code"), "q_province", "q_city",
        F.col("lat").alias("hint_lat"), F.col("lon").alias("hint_lon"),
    )
    centroids = (
        store.postal.where(F.col("province").isin(provinces))
        .groupBy("postal_code")
        # A code has a row per province, so this array has at most one entry per loaded province.
        .agg(F.array_sort(F.collect_list(F.struct("province", "lat", "lon"))).alias("options"))
    )
    pick = F.filter(
        "options",
        lambda o: F.col("q_province").isNull() | (o["province"] == F.col("q_province")),
    )
    found = (
        spread_join(wanted, centroids, ["postal_code"], ["qid"], "inner")
        .withColumn("c", F.try_element_at(pick, F.lit(1)))
        .where("c IS NOT NULL")
    )
    near = F.col("hint_lat").isNull() | F.col("hint_lon").isNull() | (
        haversine(F.col("hint_lon"), F.col("hint_lat"), F.col("c.lon"), F.col("c.lat"))
        <= max_hint_meters
    )
    return found.where(near).select(
        "qid", F.lit(POSTAL).alias("step"), F.lit("postal_centroid").alias("method"),
        address_row(
            province=F.col("c.province"), postal_code=F.col("postal_code"), city=F.col("q_city"),
            lat=F.col("c.lat"), lon=F.col("c.lon"),
        ).alias("row"),
        F.lit(None).cast("double").alias("distance"),
        F.lit(None).cast("string").alias("error_code"),
    )


def city_hits(queries: DataFrame, store: AddressStore, provinces: list[str]) -> DataFrame:
    """GC7: first stored spelling of the city, by province in the given order, then by spelling."""
    listed = text.literal_array(provinces)
    tried = (
        queries.where("q_city <> ''")
        .select(
            "qid", "q_city", "q_postal",
            F.posexplode(
                F.when(F.col("q_province").isNotNull(), F.array("q_province")).otherwise(listed)
            ).alias("province_rank", "try_province"),
        )
        .select(
            "*",
            F.posexplode(text.city_candidates(F.col("q_city"), F.col("try_province"))).alias(
                "city_rank", "token"
            ),
        )
        .withColumn("city_key", F.concat_ws("|", "token", "try_province"))
        .join(store.small_cities, "city_key", "left_semi")
    )
    best = (
        tried.join(store.cities, "city_key")
        .groupBy("qid")
        .agg(
            F.min_by(
                F.struct("province", "city", "lat", "lon", "q_postal"),
                F.struct("province_rank", "city_rank"),
            ).alias("c")
        )
    )
    return best.select(
        "qid", F.lit(CITY).alias("step"), F.lit("city_centroid").alias("method"),
        address_row(
            province=F.col("c.province"), city=F.col("c.city"),
            postal_code=F.coalesce("c.q_postal", F.lit("")), lat=F.col("c.lat"), lon=F.col("c.lon"),
        ).alias("row"),
        F.lit(None).cast("double").alias("distance"),
        F.lit(None).cast("string").alias("error_code"),
    )


def cities_by_token(names: DataFrame, store: AddressStore) -> DataFrame:
    """GC7: cities of any province with the token; several make the name ambiguous.

    ``names`` has one row per ``q_city`` token.
    """
    by_token = store.cities.groupBy(F.substring_index("city_key", "|", 1).alias("q_city")).agg(
        F.count(F.lit(1)).alias("matches"),
        F.min_by(F.struct("province", "city", "lat", "lon"), "province").alias("c"),
    )
    one = F.col("matches") == 1
    return names.join(by_token, "q_city", "left").select(
        "q_city", F.coalesce("matches", F.lit(0)).alias("matches"),
        *[F.when(one, F.col(f"c.{f}")).alias(f) for f in ("province", "city", "lat", "lon")],
        F.when(F.col("matches") > 1, "AMBIGUOUS_LOCATION")
        .when(F.col("matches").isNull(), "ADDRESS_NOT_FOUND").alias("error_code"),
    )


def nearest_hits(queries: DataFrame, store: AddressStore, provinces: list[str]) -> DataFrame:
    """GC9: address nearest to the hint point, within the query's province, city and postal code.

    The bounds become one group key. An address takes every combination of bounds it satisfies, and
    only combinations some query asks for are searched.
    """
    single = len(provinces) == 1
    city_bound = F.when(
        (F.col("q_city") != "") & (F.col("q_province").isNotNull() | F.lit(single)),
        F.concat_ws("|", "q_city", F.coalesce("q_province", F.lit(provinces[0]))),
    )

    def group(province: Column, city: Column, postal: Column) -> Column:
        return F.concat_ws("\u0001", *[F.coalesce(c, F.lit("*")) for c in (province, city, postal)])

    # A city key already holds the province.
    bounded = queries.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        "qid", "lon", "lat",
        group(
            F.when(city_bound.isNull(), F.col("q_province")), city_bound, F.col("q_postal")
        ).alias("grp"),
    )
    none = F.lit(None).cast("string")
    combos = F.array(
        *[
            group(p, c, z)
            for z in (none, F.col("postal_code"))
            for p, c in (
                (none, none), (F.col("province"), none), (none, F.col("city_key"))
            )
        ]
    )
    payload = [f for f in ADDRESS_FIELDS if f not in ("id", "lat", "lon")]
    refs = store.addr.where(F.col("lat").isNotNull()).select(
        "*", F.col("lat").alias("row_lat"), F.col("lon").alias("row_lon")
    )
    located = nearest_address(bounded, refs, payload + ["row_lat", "row_lon"], pid="qid", groups=combos).where("row IS NOT NULL")
    fields = {f: F.col(f"row.{f}") for f in payload + ["id"]}
    return located.select(
        "qid", F.lit(NEAREST).alias("step"), F.lit("nearest_neighbor").alias("method"),
        address_row(**fields, lat=F.col("row.row_lat"), lon=F.col("row.row_lon")).alias("row"),
        "distance", F.lit(None).cast("string").alias("error_code"),
    )


def confidence(method: Column, distance: Column) -> Column:
    """GC11."""
    pairs = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in vocab.CONFIDENCE.items())
    fixed = F.expr(f"map({pairs})")
    nearest = F.least(
        F.lit(vocab.CONFIDENCE["nearest_neighbor"]),
        F.greatest(F.lit(0.3), 1 - distance / 10000),
    )
    return F.when((method == "nearest_neighbor") & distance.isNotNull(), nearest).otherwise(
        F.try_element_at(fixed, method)
    )


MATCHED_FIELDS = {
    "exact": "civic,street,city,province",
    "street_interpolated": "street,city",
    "postal_centroid": "postal",
    "city_centroid": "city,province",
    "nearest_neighbor": "nearest_neighbor",
}


def finish(hits: DataFrame, min_confidence: float) -> DataFrame:
    """VA10: confidence, its gate, and the result fields."""
    scored = hits.withColumn("confidence", confidence(F.col("method"), F.col("distance")))
    low = F.col("error_code").isNull() & (F.col("confidence") < min_confidence)
    code = F.when(low, "LOW_CONFIDENCE_GEOCODE").otherwise(F.col("error_code"))
    fields = text.literal_map(MATCHED_FIELDS)
    ok = F.col("error_code").isNull()
    return scored.withColumn("error_code", code).select(
        "qid",
        F.when(ok, F.col("method")).alias("method"),
        F.when(ok, F.col("confidence")).alias("confidence"),
        F.when(ok, F.col("distance")).alias("distance"),
        F.when(ok, F.split(F.element_at(fields, F.col("method")), ",")).alias("matched_fields"),
        F.when(ok, F.col("row")).alias("row"),
        "error_code",
    )


def geocode_queries(
    queries: DataFrame,
    store: AddressStore,
    provinces: list[str],
    min_confidence: float = vocab.MIN_CONFIDENCE,
    hints: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """GC10: one result per distinct query (qid); the first successful step wins.

    Also returns the queries that very many requests share, for the join back to the requests.
    """
    parsed = cut_lineage(parse_queries(queries, provinces), "queries")
    hot = hot_keys(parsed, ["qid"], "copies")
    early = parsed.where("early_error IS NOT NULL").select(
        "qid", F.lit(EARLY).alias("step"), F.lit(None).cast("string").alias("method"),
        F.lit(None).cast(_ROW_TYPE).alias("row"), F.lit(None).cast("double").alias("distance"),
        F.col("early_error").alias("error_code"),
    )
    valid = parsed.where("early_error IS NULL").drop("early_error")
    exact = cut_lineage(exact_hits(city_spellings(valid, store), store), "exact")
    # The later steps only see what the exact step left over.
    rest = cut_lineage(valid.join(exact.select("qid"), "qid", "left_anti"), "rest")
    hits = early.unionByName(exact)
    found = cut_lineage(
        street_hits(city_spellings(rest, store), store).unionByName(
            postal_hits(rest, store, provinces)
        ),
        "street_postal",
    )
    hits = hits.unionByName(found)
    # So do the city and nearest steps, which cost most, with what street and postal code left.
    rest = cut_lineage(rest.join(found.select("qid").distinct(), "qid", "left_anti"), "rest")
    if vocab.CONFIDENCE["city_centroid"] >= min_confidence:  # GC8: else never kept
        hits = hits.unionByName(city_hits(rest, store, provinces))
    if hints:
        hits = hits.unionByName(nearest_hits(rest, store, provinces))
    first = hits.groupBy("qid").agg(
        F.min_by(F.struct("method", "row", "distance", "error_code"), "step").alias("h")
    ).select("qid", "h.*")
    missing = parsed.select("qid").join(first, "qid", "left_anti").select(
        "qid", F.lit(None).cast("string").alias("method"), F.lit(None).cast(_ROW_TYPE).alias("row"),
        F.lit(None).cast("double").alias("distance"),
        F.lit("ADDRESS_NOT_FOUND").alias("error_code"),
    )
    return finish(first.unionByName(missing), min_confidence), hot


RESULT_FIELDS = ["method", "confidence", "distance", "matched_fields", "row", "error_code"]


def geocode(
    requests: DataFrame,
    store: AddressStore,
    provinces: list[str],
    min_confidence: float = vocab.MIN_CONFIDENCE,
    req_id: str = "req_id",
    hints: bool | None = None,
) -> DataFrame:
    """GC10 for a request table: result columns on every request, errors in ``error_code``."""
    hints = ("lat" in requests.columns) if hints is None else hints
    keyed, queries = distinct_queries(requests)
    results, hot = geocode_queries(queries, store, provinces, min_confidence, hints)
    keyed = keyed.select("qid", *requests.columns)
    return salted_join(keyed, results, ["qid"], [req_id], "left", hot).drop("qid")


def geocode_postal(
    requests: DataFrame,
    store: AddressStore,
    provinces: list[str],
    min_confidence: float = vocab.MIN_CONFIDENCE,
    req_id: str = "req_id",
) -> DataFrame:
    """GC6, GC13: postal-only mode; each distinct code, city and state is looked up once."""
    keep = requests.columns
    masked = {"address": F.lit(None).cast("string"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")}
    _, queries = distinct_queries(requests.withColumns(masked))
    # The id of a request is that of its query without the fields this mode ignores.
    keyed = distinct_queries(
        requests.withColumns({f"_{c}": F.col(c) for c in masked if c in keep}).withColumns(masked)
    )[0].withColumns({c: F.col(f"_{c}") for c in masked if c in keep})
    parsed = parse_queries(queries, provinces)
    no_code = F.coalesce(F.col("postal"), F.lit("")) == ""
    error = (
        F.when(no_code, "INVALID_QUERY")
        .when(
            F.col("q_province").isNotNull() & ~F.col("q_province").isin(provinces),
            "PROVINCE_NOT_LOADED",
        )
        .when(F.col("q_postal").isNull(), "INVALID_QUERY")
    )
    judged = cut_lineage(
        parsed.withColumn("early_error", error).select(
            "qid", "copies", "q_postal", "q_province", "q_city", "lat", "lon", "early_error"
        ),
        "postal_queries",
    )
    hot = hot_keys(judged, ["qid"], "copies")
    hits = postal_hits(judged.where("early_error IS NULL"), store, provinces)
    results = judged.select("qid", "early_error").join(hits.drop("error_code"), "qid", "left").select(
        "qid", "method", "row", "distance",
        F.coalesce(
            "early_error", F.when(F.col("row").isNull(), "ADDRESS_NOT_FOUND")
        ).alias("error_code"),
    )
    kept = keyed.select("qid", *keep)
    return salted_join(
        kept, finish(results, min_confidence), ["qid"], [req_id], "left", hot
    ).drop("qid")


def reverse_geocode(
    points: DataFrame,
    store: AddressStore,
    min_confidence: float = vocab.MIN_CONFIDENCE,
    pid: str = "pid",
    max_meters: float = vocab.MAX_REVERSE_METERS,
) -> DataFrame:
    """GC12: nearest address of each point with the distance limit and the confidence gate."""
    payload = [f for f in ADDRESS_FIELDS if f not in ("id", "lat", "lon")]
    refs = store.addr.select(
        "id", "lon", "lat", *payload, F.col("lat").alias("row_lat"), F.col("lon").alias("row_lon")
    )
    found = nearest_address(points, refs, payload + ["row_lat", "row_lon"], pid=pid)
    conf = confidence(F.lit("nearest_neighbor"), F.col("distance"))
    error = F.when(
        F.col("row").isNull() | (F.col("distance") > max_meters), "NO_NEARBY_ADDRESS"
    ).when(conf < min_confidence, "LOW_CONFIDENCE_GEOCODE")
    fields = {f: F.col(f"row.{f}") for f in payload + ["id"]}
    row = address_row(**fields, lat=F.col("row.row_lat"), lon=F.col("row.row_lon"))
    return (
        found.withColumns({"error_code": error, "confidence": conf, "_row": row})
        .withColumns(
            {
                "row": F.when(F.col("error_code").isNull(), F.col("_row")),
                "confidence": F.when(F.col("error_code").isNull(), F.col("confidence")),
                "method": F.when(F.col("error_code").isNull(), "nearest_neighbor"),
                "matched_fields": F.when(F.col("error_code").isNull(), F.array(F.lit("reverse"))),
            }
        )
        .drop("_row")
    )


def row_mailing(row: Column) -> Column:
    """Mailing fields of a result row."""
    return mailing_address(
        row["civic_number"], row["street_name"], row["street_type"], row["street_direction"],
        row["unit"], row["city"], row["province"], row["postal_code"],
    )


def address_for_point(
    points: DataFrame, store: AddressStore, provinces: list[str], pid: str = "pid"
) -> DataFrame:
    """GC19: reverse geocode first, then forward geocode of the query fields that came along.

    Rows are told apart by a number of their own, so ``pid`` may repeat or be missing.
    """
    numbered = cut_lineage(points.withColumn("_rid", F.monotonically_increasing_id()), "asked")
    back = reverse_geocode(numbered, store, pid="_rid")
    again = back.where("error_code IS NOT NULL").select("_rid", "address", "postal", "city", "state")
    asks = F.coalesce(F.concat_ws("", "address", "postal", "city"), F.lit("")) != ""
    forward = geocode(again.where(asks), store, provinces, req_id="_rid", hints=False).where(
        "error_code IS NULL"
    ).select("_rid", F.col("row").alias("fwd"))
    return back.join(forward, "_rid", "left").select(
        *[c for c in points.columns], F.coalesce("row", "fwd").alias("row"),
        F.when(F.col("row").isNotNull(), "reverse").when(F.col("fwd").isNotNull(), "forward")
        .alias("address_source"),
    )


def geocode_mixed(
    requests: DataFrame,
    store: AddressStore,
    provinces: list[str],
    min_confidence: float = vocab.MIN_CONFIDENCE,
    req_id: str = "req_id",
) -> DataFrame:
    """GC14: coordinates pass through, postal-only rows use GC6, all others GC10.

    Adds ``to_lon``, ``to_lat`` and the result fields.
    """
    have = dict(requests.dtypes)
    full = requests.withColumns(
        {c: F.lit(None).cast("double") for c in ("lat", "lon") if c not in have}
        | {c: F.lit(None).cast("string") for c in ("geocode_method",) if c not in have}
    )
    given = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    present = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    postal_only = ~given & (
        (present("postal") & ~present("address"))
        | (F.coalesce(F.col("geocode_method"), F.lit("")) == "postal_centroid")
    )
    columns = full.columns
    passed = full.where(given).select(
        *columns, F.lit("exact").alias("method"), F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("double").alias("distance"),
        F.lit(None).cast("array<string>").alias("matched_fields"),
        F.lit(None).cast(_ROW_TYPE).alias("row"), F.lit(None).cast("string").alias("error_code"),
    )
    by_postal = geocode_postal(full.where(postal_only), store, provinces, min_confidence, req_id)
    by_cascade = geocode(
        full.where(~given & ~postal_only), store, provinces, min_confidence, req_id, hints=False
    )
    merged = passed.unionByName(by_postal).unionByName(by_cascade)
    return merged.withColumns(
        {
            "to_lon": F.coalesce(F.when(given, F.col("lon")), F.col("row.lon")),
            "to_lat": F.coalesce(F.when(given, F.col("lat")), F.col("row.lat")),
        }
    )
