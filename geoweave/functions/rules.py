"""Validation rules, flags and keys of a request, as Column expressions (VA, TX20, TX21, TX24, TX25).

A failing rule gives a message in an error column; no row ever fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions import text, vocab


def _blank(value: Column) -> Column:
    return text.trim_ws(text.null_to_empty(value)) == ""


def coordinate_error(lat: Column, lon: Column) -> Column:
    """VA1: message of the first rule that fails, null when none does."""
    return (
        F.when(lat.isNull() & lon.isNull(), F.lit(None).cast("string"))
        .when(lat.isNull() | lon.isNull(), vocab.MSG_COORD_PAIR)
        # NaN compares greater than any number here, so it is looked at first.
        .when(F.isnan(lat) | F.isnan(lon), vocab.MSG_COORD_FINITE)
        .when((lat < -90) | (lat > 90), vocab.MSG_LAT_RANGE)
        .when((lon < -180) | (lon > 180), vocab.MSG_LON_RANGE)
    )


def postal_error(postal: Column) -> Column:
    filled = text.null_to_empty(postal) != ""
    return F.when(filled & text.postal_code(postal).isNull(), vocab.MSG_POSTAL)


def return_fields(raw: Column) -> Column:
    """VA4: distinct non-empty entries of the ``return`` list."""
    parts = F.transform(F.split(text.null_to_empty(raw), ","), lambda p: text.trim_ws(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def return_error(raw: Column) -> Column:
    unknown = F.try_element_at(
        F.filter(return_fields(raw), lambda p: p != "municipality"), F.lit(1)
    )
    before, after = vocab.MSG_RETURN.split("{}")
    return F.concat(F.lit(before), unknown, F.lit(after))


def include_province_flag(raw: Column) -> Column:
    """VA4: true, false, or null when not given or not understood."""
    word = F.lower(text.trim_ws(raw))
    return F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)


def include_province_error(raw: Column) -> Column:
    return F.when(~_blank(raw) & include_province_flag(raw).isNull(), vocab.MSG_INCLUDE_PROVINCE)


def geocode_method(raw: Column) -> Column:
    """VA4: 'auto' when not given, null when not allowed."""
    word = F.lower(text.trim_ws(raw))
    return F.when(text.null_to_empty(raw) == "", "auto").when(
        word.isin("auto", "postal_centroid"), word
    )


def geocode_method_error(raw: Column) -> Column:
    return F.when(geocode_method(raw).isNull(), vocab.MSG_GEOCODE_METHOD)


def include_province_default(path: Column, flag: Column, return_given: Column) -> Column:
    """VA5: the flag wins; a ``return`` list switches the default off; else the combined path."""
    return F.coalesce(flag, F.when(return_given, F.lit(False)).otherwise(path == "/api/combined"))


def query_error(
    address: Column, postal: Column, city: Column, state: Column, country: Column,
    lat: Column, lon: Column, return_raw: Column, include_raw: Column, method_raw: Column,
) -> Column:
    """VA2: message of the first rule a query fails."""
    any_text = [
        text.sanitize(address, 500), text.empty_to_null(text.null_to_empty(postal)),
        text.sanitize(city, 100), text.sanitize(state, 100), text.sanitize(country, 100),
    ]
    nothing = F.coalesce(*any_text).isNull() & (lat.isNull() | lon.isNull())
    return F.coalesce(
        postal_error(postal),
        coordinate_error(lat, lon),
        return_error(return_raw),
        include_province_error(include_raw),
        geocode_method_error(method_raw),
        F.when(nothing, vocab.MSG_NO_LOCATION),
    )


def batch_row_error(rid: Column, path: Column, address: Column, postal: Column, lat: Column,
                    lon: Column) -> Column:
    """VA3: stricter than VA2, a city alone is not enough."""
    located = (
        (lat.isNotNull() & lon.isNotNull())
        | (text.null_to_empty(postal) != "")
        | (text.null_to_empty(address) != "")
    )
    return (
        F.when(text.null_to_empty(rid) == "", "id must not be empty")
        .when(~text.null_to_empty(path).startswith("/api"), "pathname must start with /api")
        .when(~located, vocab.MSG_BATCH_QUERY)
    )


def query_class(address: Column, postal: Column, lat: Column, lon: Column) -> Column:
    """VA6: coordinates, postal, address or mixed."""
    return (
        F.when(lat.isNotNull() & lon.isNotNull(), "coordinates")
        .when(text.null_to_empty(postal) != "", "postal")
        .when(text.null_to_empty(address) != "", "address")
        .otherwise("mixed")
    )


def is_postal_only(address: Column, postal: Column) -> Column:
    return (text.null_to_empty(postal) != "") & (text.null_to_empty(address) == "")


def wants_postal_centroid(postal: Column, method: Column) -> Column:
    return (text.null_to_empty(postal) != "") & method.eqNullSafe("postal_centroid")


def dataset_of_path(path: Column) -> Column:
    """Dataset of a lookup path; unknown paths fall back to the federal set."""
    by_path = text.literal_map({d[4]: d[1] for d in vocab.DATASETS})
    return F.coalesce(F.try_element_at(by_path, path), F.lit(vocab.FEDERAL_DATASET))


def pin_error(path: Column, pinned: Column) -> Column:
    """VA7: a pinned vintage must be the dataset served on the path, by id or year."""
    dataset = dataset_of_path(path)
    years = text.literal_map({d[1]: str(d[3]) for d in vocab.DATASETS})
    served = (pinned == F.concat(dataset, F.lit(".geojson"))) | (
        pinned == F.element_at(years, dataset)
    )
    return F.when((text.null_to_empty(pinned) != "") & ~served, "DATASET_UNAVAILABLE")


def region_match(label: Column, state: Column, city: Column) -> Column:
    """VA8: the label names the requested province (any of its forms) and city."""
    has_state = text.null_to_empty(state) != ""
    has_city = text.null_to_empty(city) != ""
    upper = F.upper(text.null_to_empty(label))
    code = F.coalesce(text.province_code(state), F.upper(text.trim_ws(state)))
    names = text.literal_map(vocab.PROVINCE_DISPLAY_NAME)
    name = F.try_element_at(names, code)
    city_token = text.search_token(city)
    tokens = F.filter(
        F.array(code, F.upper(name), text.search_token(name), text.search_token(state), city_token),
        lambda t: t.isNotNull() & ((F.length(t) > 2) | t.rlike("^[A-Z]{2}$")),
    )
    in_label = F.exists(tokens, lambda t: F.contains(upper, t))
    state_ok = ~has_state | (F.size(tokens) == 0) | in_label
    city_ok = ~has_city | ((city_token != "") & F.contains(upper, city_token))
    return (upper != "") & state_ok & city_ok


def origin_allowed(origin: Column, patterns: Column) -> Column:
    """VA11: some pattern equals the origin, or has its scheme and port and a '*.' suffix host."""
    shape = r"^([a-z][a-z0-9+.-]*)://([^/:]+)(?::([0-9]+))?$"

    def clean(value: Column) -> Column:
        return F.regexp_replace(F.lower(text.trim_ws(value)), "/+$", "")

    mine = clean(origin)

    def matches(raw: Column) -> Column:
        p = clean(raw)
        same_frame = (
            p.rlike(shape) & mine.rlike(shape)
            & (F.regexp_extract(p, shape, 1) == F.regexp_extract(mine, shape, 1))
            & (F.regexp_extract(p, shape, 3) == F.regexp_extract(mine, shape, 3))
        )
        host, my_host = F.regexp_extract(p, shape, 2), F.regexp_extract(mine, shape, 2)
        same_host = F.when(
            host.startswith("*."), F.endswith(my_host, F.substring(host, 2, 1 << 30))
        ).otherwise(host == my_host)
        return (raw != "") & ((raw == "*") | (p == mine) | (same_frame & same_host))

    return (text.null_to_empty(origin) != "") & F.exists(patterns, matches)


# --- keys -------------------------------------------------------------------------------------


def _squeezed(value: Column) -> Column:
    return text.empty_to_null(
        F.regexp_replace(text.trim_ws(F.lower(value)), f"{text.WS}+", " ")
    )


def lookup_key(
    path: Column, address: Column, postal: Column, city: Column, state: Column, country: Column,
    lat: Column, lon: Column,
) -> Column:
    """TX20: dataset, kind, value and path; keys over 512 characters are hashed."""
    point = F.concat_ws(",", text.js_number(lon, 5), text.js_number(lat, 5))
    places = [_squeezed(c) for c in (city, state, country)]
    kind = query_class(address, postal, lat, lon)
    kind = F.when(kind == "mixed", "query").when(kind == "coordinates", "coordinate").otherwise(kind)
    value = (
        F.when(kind == "coordinate", point)
        .when(kind == "postal", F.regexp_replace(F.lower(postal), f"{text.WS}+", ""))
        .when(kind == "address", F.concat_ws(" ", _squeezed(address), *places))
        .otherwise(
            F.coalesce(text.empty_to_null(F.concat_ws(" ", *places)), F.lit("unknown"))
        )
    )
    dataset = dataset_of_path(path)
    key = F.concat_ws(":", F.lit("lookup:v2"), dataset, kind, value, path)
    short = F.concat_ws(
        ":", F.lit("lookup"), dataset, kind, F.lit("hash"), F.abs(F.xxhash64(key)).cast("string"),
        path,
    )
    return F.when(F.length(key) > 512, short).otherwise(key)


def geocode_key(provider: Column, address: Column, postal: Column, city: Column, state: Column,
                country: Column) -> Column:
    """TX21: normalised query fields of one provider."""
    low = [text.trim_ws(F.lower(c)) for c in (address, postal, city, state, country)]
    low[1] = F.regexp_replace(low[1], f"{text.WS}+", "")
    fields = F.to_json(
        F.struct(*[c.alias(n) for c, n in zip(low, ("address", "postal", "city", "state", "country"))])
    )
    return F.concat_ws(":", F.lit("geocoding:v2"), provider, fields)


def reverse_key(lat: Column, lon: Column) -> Column:
    """TX21."""
    return F.concat(
        F.lit("reverse:google:"), F.concat_ws(",", text.js_number(lat, 5), text.js_number(lon, 5))
    )


def search_cache_key(
    q: Column, provinces: Column, limit: Column, bias_lat: Column, bias_lon: Column,
    box: Column | None = None,
) -> Column:
    """TX21: folded text, sorted provinces, limit, bias to 0.01 degree, box to 4 places."""
    bias = F.when(
        bias_lat.isNotNull() & bias_lon.isNotNull(),
        F.concat_ws(
            ",",
            *[F.format_string("%.2f", text.round_half_up(v, 2)) for v in (bias_lat, bias_lon)],
        ),
    ).otherwise("")
    corners = F.lit("")
    if box is not None:
        sides = [box[k] for k in ("min_lat", "min_lon", "max_lat", "max_lon")]
        corners = F.when(
            box.isNotNull(), F.concat_ws(",", *[F.format_string("%.4f", s) for s in sides])
        ).otherwise("")
    return F.concat_ws(
        ":", F.lit("suggest:v1"), text.search_token(q), F.array_join(F.array_sort(provinces), ","),
        limit.cast("string"), F.lit(""), F.lit(""), bias, corners,
    )


# --- lookup results ---------------------------------------------------------------------------


def province_path(props: Column) -> Column:
    """TX24: provincial lookup path from the properties of a federal district."""
    raw = F.coalesce(
        F.try_element_at(props, F.lit("PROV_TERR")), F.try_element_at(props, F.lit("PROV_CODE"))
    )
    paths = {
        alias: d[4] for d in vocab.DATASETS for alias in d[5]
    }
    by_alias = text.literal_map(paths)
    return F.try_element_at(by_alias, text.fold_accents(text.trim_ws(raw)))


def district_name(props: Column) -> Column:
    """TX23."""
    return text.first_present(props, vocab.DISTRICT_DISPLAY_FIELDS)


def municipality(mailing_town: Column, locality: Column, query_city: Column) -> Column:
    """TX25."""
    return F.coalesce(*[text.empty_to_null(c) for c in (mailing_town, locality, query_city)])


def with_municipality(props: Column, town: Column) -> Column:
    """TX25: the town joins the properties when both are present."""
    added = F.map_from_entries(
        F.array_append(
            F.filter(F.map_entries(props), lambda e: e["key"] != "MUNICIPALITY"),
            F.struct(F.lit("MUNICIPALITY").alias("key"), town.alias("value")),
        )
    )
    return F.when(props.isNotNull() & town.isNotNull(), added).otherwise(props)
