"""Text normalisation as native Column expressions.

Everything here compiles into the surrounding projection: no Python runs per row. Longer parses that
use one value several times are written as a chain of named columns (see ``operators/parse.py``) so
that an expression is computed once instead of being repeated inside itself.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions import vocab

# Every white-space character, not only the ASCII ones that \s covers.
WS = r"[\s\p{Z}\x{FEFF}]"

# "To the end" as a length for substring.
_REST = 1 << 30


def _folding_pairs() -> tuple[str, str]:
    """Accented letters and their base letters, from the Unicode decomposition of each code point."""
    accented, base = [], []
    for code in range(0xC0, 0x2000):
        char = chr(code)
        decomposed = unicodedata.normalize("NFD", char)
        stripped = "".join(c for c in decomposed if not unicodedata.category(c).startswith("M"))
        if stripped != char and len(stripped) == 1:
            accented.append(char)
            base.append(stripped)
    return "".join(accented), "".join(base)


_ACCENTED, _BASE = _folding_pairs()


def empty_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def null_to_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def trim_ws(value: Column) -> Column:
    return F.regexp_replace(value, f"^{WS}+|{WS}+$", "")


def fold_accents(value: Column) -> Column:
    """TX1: drop accents, upper-case. Plain ASCII, told by its byte length, only needs the case."""
    folded = F.upper(F.regexp_replace(F.translate(value, _ACCENTED, _BASE), r"\p{M}", ""))
    return F.when(F.octet_length(value) == F.length(value), F.upper(value)).otherwise(folded)


def search_token(value: Column) -> Column:
    """TX2: folded text of letters, digits, space, slash and hyphen; '' for null.

    Most values are clean tokens once they are in upper case; one check spares them the rest.
    """
    upper = F.upper(value)
    folded = F.upper(F.regexp_replace(F.translate(value, _ACCENTED, _BASE), r"\p{M}", ""))
    kept = F.regexp_replace(folded, r"[^A-Z0-9\s\p{Z}\x{FEFF}/-]", "")
    cleaned = F.trim(F.regexp_replace(kept, f"{WS}+", " "))
    return F.when(upper.rlike("^[A-Z0-9/-]+(?: [A-Z0-9/-]+)*$"), upper).otherwise(
        null_to_empty(cleaned)
    )


def quoted(values) -> str:
    """Values as SQL string literals. One SQL text is far quicker to build than many literals."""
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def literal_map(mapping: dict[str, str]) -> Column:
    return F.expr(f"map({quoted(part for item in mapping.items() for part in item)})")


def literal_array(values) -> Column:
    return F.expr(f"array({quoted(values)})")


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(mapping), key)


def province_code(value: Column) -> Column:
    """TX3: two-letter code from a name, an abbreviation or a statistical number; null if unknown."""
    cleaned = trim_ws(value)
    return F.when(
        cleaned.rlike(r"^[0-9]+$"), _lookup(vocab.PROVINCE_BY_NUMBER, cleaned)
    ).otherwise(_lookup(vocab.PROVINCE_BY_NAME, fold_accents(cleaned)))


# Identity entries add nothing to coalesce(map[key], key), so the lookup keeps only real changes.
_TYPE_CHANGES = {k: v for k, v in vocab.STREET_TYPE_CANONICAL.items() if k != v}
_DIRECTION_CHANGES = {k: v for k, v in vocab.STREET_DIRECTION.items() if k != v}


def canonical_type(token: Column) -> Column:
    """Canonical form of a token that is already a search token."""
    return F.coalesce(_lookup(_TYPE_CHANGES, token), token)


def canonical_direction(token: Column) -> Column:
    return F.coalesce(_lookup(_DIRECTION_CHANGES, token), token)


def street_type(value: Column) -> Column:
    """TX4."""
    return canonical_type(search_token(value))


def street_direction(value: Column) -> Column:
    """TX5."""
    return canonical_direction(search_token(value))


_IS_TYPE = {t: t for t in vocab.STREET_TYPE_VALUES}


def is_street_type(column: str) -> Column:
    """Whether a named column holds a known street type."""
    return F.expr(f"{column} IN ({quoted(vocab.STREET_TYPE_TOKENS)})")


def is_direction(column: str) -> Column:
    return F.expr(f"{column} IN ({quoted(vocab.STREET_DIRECTION)})")


def is_canadian_postal(value: Column) -> Column:
    packed = F.upper(F.regexp_replace(value, f"{WS}+", ""))
    return packed.rlike(r"^[A-Z][0-9][A-Z][0-9][A-Z][0-9]$")


def postal_code(value: Column) -> Column:
    """TX6: 'A1A 1A1' form, or any other text of at most 20 characters; null when invalid or empty."""
    packed = F.upper(F.regexp_replace(value, f"{WS}+", ""))
    cleaned = F.upper(F.regexp_replace(trim_ws(value), f"{WS}+", " "))
    return (
        F.when(value.rlike(r"^[A-Z][0-9][A-Z] [0-9][A-Z][0-9]$"), value)
        .when(
            packed.rlike(r"^[A-Z][0-9][A-Z][0-9][A-Z][0-9]$"),
            F.concat_ws(" ", F.substring(packed, 1, 3), F.substring(packed, 4, 3)),
        )
        .when((F.length(cleaned) > 0) & (F.length(cleaned) <= 20), cleaned)
    )


def civic_parts(value: Column) -> Column:
    """TX7: struct(raw, numeric, suffix); null for null or '' input."""
    raw = F.upper(trim_ws(value))
    pattern = r"^([0-9]+)(?:\s+[0-9]+/[0-9]+)?([A-Z]?)$"
    matches = raw.rlike(pattern)
    return F.when(
        value != "",
        F.struct(
            raw.alias("raw"),
            F.when(matches, F.regexp_extract(raw, pattern, 1).try_cast("bigint")).alias("numeric"),
            F.when(matches, F.regexp_extract(raw, pattern, 2)).otherwise("").alias("suffix"),
        ),
    )


def leading_int(value: Column) -> Column:
    """Digits at the start of a text as a number; null when there are none."""
    return empty_to_null(F.regexp_extract(value, r"^[0-9]+", 0)).try_cast("bigint")


def complete_street_type(address: Column) -> Column:
    """TX10: add 'Ave' to a civic address without any recognised street type."""
    cleaned = trim_ws(address)
    words = "|".join(vocab.COMPLETION_STOP_WORDS)
    needs = ~cleaned.rlike(rf"(?i)\b(?:{words})\b") & cleaned.rlike(r"^[0-9]+\s+\S")
    return F.when(needs, F.concat(cleaned, F.lit(" Ave"))).otherwise(cleaned)


def city_key(city: Column, province: Column) -> Column:
    """TX11."""
    return F.concat_ws("|", search_token(city), province)


def street_key(name: Column, kind: Column, direction: Column) -> Column:
    """TX11: non-empty parts joined by '|'."""
    return F.concat_ws(
        "|",
        empty_to_null(search_token(name)),
        empty_to_null(street_type(kind)),
        empty_to_null(street_direction(direction)),
    )


def search_key(civic, name, kind, direction, city, province) -> Column:
    """TX11: all six parts joined by '|', empty ones kept."""
    return F.concat_ws(
        "|",
        search_token(civic),
        search_token(name),
        street_type(kind),
        street_direction(direction),
        search_token(city),
        null_to_empty(province),
    )


def street_key_parts(key: Column) -> Column:
    """TX12: struct(name, type, direction), classified from the end by value sets."""
    parts = F.filter(F.split(key, r"\|"), lambda p: p != "")
    n = F.size(parts)
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    has_dir = (n > 1) & F.array_contains(literal_array(vocab.STREET_DIRECTION_VALUES), last)
    type_at = F.when(has_dir, F.lit(-2)).otherwise(F.lit(-1))
    maybe_type = F.coalesce(F.try_element_at(parts, type_at), F.lit(""))
    left = n - F.when(has_dir, 1).otherwise(0)
    has_type = (left > 1) & _lookup(_IS_TYPE, maybe_type).isNotNull()
    name_len = left - F.when(has_type, 1).otherwise(0)
    return F.struct(
        F.array_join(F.slice(parts, F.lit(1), F.greatest(name_len, F.lit(0))), " ").alias("name"),
        F.when(has_type, maybe_type).otherwise("").alias("type"),
        F.when(has_dir, last).otherwise("").alias("direction"),
    )


def title_case(value: Column) -> Column:
    """Lower case, then a capital after the start, white space, '/' and '-'."""
    marked = F.regexp_replace(F.lower(value), r"([\s/-])", "$1\u0001")
    parts = F.split(marked, "\u0001")
    # initcap would also lower the rest, which is lower already.
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, _REST))),
        "",
    )


def street_label(key: Column) -> Column:
    """TX13: display label of a street key."""
    parts = street_key_parts(key)
    return F.concat_ws(
        " ",
        empty_to_null(title_case(parts["name"])),
        empty_to_null(title_case(parts["type"])),
        empty_to_null(parts["direction"]),
    )


def normalize_unit(value: Column) -> Column:
    """TX15: without a leading '#', as a search token."""
    return search_token(F.regexp_replace(null_to_empty(value), r"^#", ""))


def city_candidates(city: Column, province: Column) -> Column:
    """TX16: ordered, distinct spellings of a city worth trying; empty array without a city.

    ``city`` must be a search token. Own spelling first, then aliases, then the administrative
    prefixes added, then the prefixes stripped together with the aliases of what is left.
    """
    no_cities = F.expr("CAST(array() AS array<string>)")
    entries = ", ".join(
        f"{quoted([key])}, array({quoted(names)})" for key, names in vocab.CITY_ALIASES.items()
    )
    alias_map = F.expr(f"map({entries})")

    def aliases(token: Column) -> Column:
        key = F.concat_ws("|", token, null_to_empty(province))
        return F.coalesce(F.try_element_at(alias_map, key), no_cities)

    added = F.transform(
        literal_array(vocab.ADMIN_PREFIXES), lambda p: F.concat(p, F.lit(" "), city)
    )
    # What is left of the name without a prefix it starts with, and the aliases of that.
    stripping = F.filter(
        literal_array(vocab.ADMIN_PREFIXES), lambda p: F.startswith(city, F.concat(p, F.lit(" ")))
    )
    stripped = F.flatten(
        F.transform(
            stripping,
            lambda p: F.concat(
                F.array(F.trim(F.substring(city, F.length(p) + 2, F.length(city)))),
                aliases(F.trim(F.substring(city, F.length(p) + 2, F.length(city)))),
            ),
        )
    )
    found = F.array_distinct(F.concat(F.array(city), aliases(city), added, stripped))
    return F.when(city != "", F.filter(found, lambda c: c != "")).otherwise(no_cities)


def sanitize(value: Column, limit: int = 1000) -> Column:
    """TX18: control characters removed, trimmed, cut to a length; null when nothing is left."""
    cleaned = trim_ws(F.regexp_replace(value, r"[\x00-\x1F\x7F]", ""))
    return empty_to_null(F.substring(cleaned, 1, limit))


def comparison_name(value: Column) -> Column:
    """TX22: district name as compared between providers."""
    dashed = F.regexp_replace(null_to_empty(value), "-", "—")
    return F.lower(F.trim(F.regexp_replace(dashed, f"{WS}+", " ")))


def first_present(props: Column, fields: list[str], trim_result: bool = False) -> Column:
    """First property with visible text, in order of ``fields`` (TX23, IO5)."""
    picks = [F.try_element_at(props, F.lit(f)) for f in fields]
    picks = [F.when(trim_ws(p) != "", trim_ws(p) if trim_result else p) for p in picks]
    return F.coalesce(*picks)


def round_half_up(value: Column, digits: int) -> Column:
    """Round with ties toward positive infinity."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def js_number(value: Column, digits: int) -> Column:
    """Shortest decimal text of a coordinate rounded to ``digits`` places: 45.5, 45, -0.00001."""
    rounded = round_half_up(value, digits)
    text = F.format_string(f"%.{digits}f", rounded)
    short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", "0").otherwise(short)

