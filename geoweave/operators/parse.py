"""Address standardisation and free-form address parsing over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.functions import text
from geoweave.functions.mailing import mailing_lines, mailing_parts, mailing_street

PARSED = ["civic", "name", "type", "direction", "unit"]


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns as the output of a one-row generator.

    A filter on such a column is checked after it is computed. Without this the optimizer would
    rewrite the filter in terms of the raw text and repeat every step of the parse inside it.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(
        *kept, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()])))
    )


# The word before a unit.
_UNIT = "UNIT"


def _first(value: Column) -> Column:
    """The first word."""
    return F.substring_index(value, " ", 1)


def _after(value: Column, word: Column) -> Column:
    """What follows the word a text begins with."""
    return F.ltrim(F.substr(value, F.length(word) + 1))


def _last(value: Column) -> Column:
    return F.substring_index(value, " ", -1)


def _before(value: Column, word: Column) -> Column:
    """What comes before the word a text ends with."""
    return F.rtrim(F.left(value, F.length(value) - F.length(word)))


def _is_unit(word: Column) -> Column:
    return F.upper(word) == _UNIT


def _number(word: Column) -> Column:
    return word.rlike("^[0-9]+$")


def _unit_at_end(rest: Column) -> tuple[Column, Column]:
    """``..., Unit 5``, ``..., Unit #5`` or ``..., Unit # 5``: a comma, the unit word and one word."""
    word = _last(rest)
    ahead = _before(rest, word)
    marked = _last(ahead) == "#"
    head = F.when(marked, _before(ahead, F.lit("#"))).otherwise(ahead)
    name = F.when(~marked & F.startswith(word, F.lit("#")) & (F.length(word) > 1), F.substr(word, F.lit(2))).otherwise(word)
    street = F.rtrim(F.left(head, F.length(head) - len(_UNIT)))
    found = F.endswith(F.upper(head), F.lit(_UNIT)) & F.endswith(street, F.lit(",")) & (F.length(street) > 1)
    return F.when(found, F.rtrim(name, F.lit(",;"))), F.left(street, F.length(street) - 1)


def _unit_after_street(rest: Column) -> tuple[Column, Column]:
    """``123 Main St UNIT 5``"""
    word = _last(rest)
    head = _before(rest, word)
    street = _before(head, _last(head))
    return F.when(_is_unit(_last(head)) & (street != ""), word), street


def _unit_ahead(rest: Column) -> tuple[Column, Column]:
    """``Unit 5, 123 Main St``"""
    rest_of = _after(rest, _first(rest))
    word = _first(rest_of)
    street = _after(rest_of, word)
    street = F.when(F.startswith(street, F.lit(", ")), F.ltrim(F.substr(street, F.lit(2)))).otherwise(street)
    return F.when(_is_unit(_first(rest)) & (street != ""), F.rtrim(word, F.lit(",;"))), street


def _unit_inside(rest: Column) -> tuple[Column, Column]:
    """``105 Unit 2 Main St``"""
    civic = _first(rest)
    second = _after(rest, civic)
    third = _after(second, _first(second))
    word = _first(third)
    street = _after(third, word)
    found = _number(civic) & _is_unit(_first(second)) & (street != "")
    return F.when(found, word), F.concat_ws(" ", civic, street)


def _unit_with_dash(rest: Column) -> tuple[Column, Column]:
    """``5-123 Main St``"""
    word = _first(rest)
    street = _after(rest, word)
    unit, civic = F.substring_index(word, "-", 1), F.substring_index(word, "-", -1)
    found = _number(unit) & _number(civic) & (word == F.concat_ws("-", unit, civic)) & (street != "")
    return F.when(found, unit), F.concat_ws(" ", civic, street)


# In this order, each on what the one before left.
_UNIT_RULES = [_unit_at_end, _unit_after_street, _unit_ahead, _unit_inside, _unit_with_dash]


def parse_address(df: DataFrame, address: str, prefix: str) -> DataFrame:
    """TX8, TX9: add ``prefix`` + civic, name, type, direction and unit ('' where absent).

    Written as a chain of named columns: each step reads the one before it several times, and naming
    it keeps the plan linear. The whole chain stays in one stage next to the scan.
    """
    rest, unit = f"{prefix}_rest", f"{prefix}unit"
    blanks = F.translate(text.null_to_empty(F.col(address)), "\t\n\u000b\f\r", "     ")
    out = df.withColumn(rest, text.trim_ws(blanks)).withColumn(unit, F.lit(""))
    for rule in _UNIT_RULES:
        found, left = rule(F.col(rest))
        out = out.withColumns({f"{prefix}_u": found, f"{prefix}_k": F.trim(left)})
        # A unit that is only punctuation is empty, but taken out.
        matched = F.col(f"{prefix}_u").isNotNull()
        out = out.withColumns(
            {
                rest: F.when(matched, F.col(f"{prefix}_k")).otherwise(F.col(rest)),
                unit: F.when(matched, F.col(f"{prefix}_u")).otherwise(F.col(unit)),
            }
        )
    # The civic number is the first word, with a fraction if one follows that is not the last word.
    out = out.withColumns({f"{prefix}_u": _first(F.col(rest)), f"{prefix}_k": _after(F.col(rest), _first(F.col(rest)))})
    first, more = F.col(f"{prefix}_u"), F.col(f"{prefix}_k")
    fraction = _first(more)
    beyond = _after(more, fraction)
    civic = first.rlike("^[0-9]+[A-Za-z]?$") & (more != "")
    halved = fraction.rlike("^[0-9]+/[0-9]+$") & (beyond != "")
    out = out.withColumns(
        {
            f"{prefix}civic": F.when(civic & halved, _before(F.col(rest), beyond)).when(civic, first).otherwise(""),
            f"{prefix}_tail": F.when(civic & halved, beyond).when(civic, more).otherwise(""),
        }
    )
    out = out.withColumns(
        {
            f"{prefix}_tokens": F.split(f"{prefix}_tail", r"\s+"),
            f"{prefix}_has": F.col(f"{prefix}civic") != "",
        }
    )
    tokens, has = F.col(f"{prefix}_tokens"), F.col(f"{prefix}_has")
    n = F.size(tokens)
    out = out.withColumns(
        {
            f"{prefix}_n": n,
            f"{prefix}_last": F.upper(F.element_at(tokens, -1)),
            f"{prefix}_second": F.when(n > 1, F.upper(F.try_element_at(tokens, F.lit(-2)))).otherwise(""),
        }
    )
    n, last, second = F.col(f"{prefix}_n"), F.col(f"{prefix}_last"), F.col(f"{prefix}_second")
    ends_in_dir = has & text.is_direction(f"{prefix}_last")
    ends_in_type = has & (
        text.is_street_type(f"{prefix}_last") | text.is_street_type(f"{prefix}_second")
    )

    def head(drop: int) -> Column:
        return F.array_join(F.slice(tokens, F.lit(1), F.greatest(n - drop, F.lit(0))), " ")

    name = (
        F.when(~has, F.col(rest))
        .when(ends_in_dir, F.when(n > 2, head(2)).otherwise(tokens[0]))
        .when(ends_in_type, head(1))
        .otherwise(F.col(f"{prefix}_tail"))
    )
    kind = F.when(ends_in_dir, F.when(n > 2, text.street_type(second)).otherwise("")).when(
        ends_in_type, text.street_type(last)
    ).otherwise("")
    direction = F.when(ends_in_dir, text.street_direction(last)).otherwise("")
    scratch = [f"{prefix}_{c}" for c in ("rest", "u", "k", "tail", "tokens", "has", "n", "last", "second")]
    parts = {
        f"{prefix}civic": F.col(f"{prefix}civic"), f"{prefix}name": name, f"{prefix}type": kind,
        f"{prefix}direction": direction, unit: F.col(unit),
    }
    return pin(out, parts).drop(*scratch)


def parse_requests(df: DataFrame) -> DataFrame:
    """Request fields (address, postal, city, state) to search tokens, plus both readings' parts.

    ``x_`` columns read the address after street-type completion (TX10), ``r_`` columns as typed.
    """
    staged = df.withColumns(
        {
            "_full": text.complete_street_type(F.col("address")),
            "q_city": text.search_token(F.col("city")),
            "q_province": text.province_code(F.col("state")),
            "q_postal": text.postal_code(F.col("postal")),
        }
    )
    parsed = parse_address(parse_address(staged, "_full", "x_"), "address", "r_")
    tokens = {f"{p}name": text.search_token(F.col(f"{p}name")) for p in ("x_", "r_")}
    queried = {c: F.col(c) for c in ("q_city", "q_province", "q_postal")}
    extra = {
        "q_unit": text.normalize_unit(F.col("x_unit")),
        "q_civic": text.civic_parts(F.col("x_civic")),
    }
    return pin(parsed, tokens | queried | extra).drop("_full")


def street_readings() -> Column:
    """TX17: distinct readings of the parsed address, most literal first.

    The completed text, the text as typed, its name and type as one name, then each of these
    without a leading THE.
    """

    def reading(name: Column, kind: Column, direction: Column) -> Column:
        return F.struct(name.alias("name"), kind.alias("type"), direction.alias("direction"))

    x = reading(F.col("x_name"), F.col("x_type"), F.col("x_direction"))
    r = reading(F.col("r_name"), F.col("r_type"), F.col("r_direction"))
    joined = reading(
        F.concat_ws(" ", F.col("r_name"), F.col("r_type")), F.lit(""), F.col("r_direction")
    )
    both = (F.col("r_name") != "") & (F.col("r_type") != "")
    listed = F.when(both, F.array(x, r, joined)).otherwise(F.array(x, r))
    bare = F.transform(
        F.filter(listed, lambda s: s["name"].startswith("THE ")),
        lambda s: reading(F.substring(s["name"], 5, 1 << 30), s["type"], s["direction"]),
    )
    return F.array_distinct(F.concat(listed, bare))


def standardize_addresses(df: DataFrame) -> DataFrame:
    """Keys and mailing fields of an address table, in one projection.

    Input columns: id, civic_number, street_name, street_type, street_direction, unit, postal_code,
    city, province, lat, lon. Missing texts are '' in the output, as keys are built from them.
    """
    texts = ["civic_number", "street_name", "street_type", "street_direction", "unit", "city"]
    clean = df.withColumns({c: text.null_to_empty(F.col(c)) for c in texts})
    # Pinned: the keys read each of these several times.
    tokens = pin(
        clean,
        {
            "_civic": text.search_token(F.col("civic_number")),
            "_name": text.search_token(F.col("street_name")),
            "_type": text.street_type(F.col("street_type")),
            "_dir": text.street_direction(F.col("street_direction")),
            "_city": text.search_token(F.col("city")),
            "_postal": text.null_to_empty(text.postal_code(F.col("postal_code"))),
            "_unit": text.normalize_unit(F.col("unit")),
        },
    )
    present = [text.empty_to_null(F.col(c)) for c in ("_name", "_type", "_dir")]
    return tokens.withColumns(
        {
            "postal_code": F.col("_postal"),
            "unit_key": F.col("_unit"),
            "city_key": F.concat_ws("|", "_city", "province"),
            "street_key": F.concat_ws("|", *present),
            "search_key": F.concat_ws("|", "_civic", "_name", "_type", "_dir", "_city", "province"),
        }
    ).drop("_civic", "_name", "_type", "_dir", "_city", "_postal", "_unit")


def with_mailing(df: DataFrame) -> DataFrame:
    """Stored address rows with their mailing fields.

    Every field reads the same few parts, so these are pinned, and after them the lines made of them.
    """
    made = mailing_parts(
        F.col("civic_number"), F.col("street_name"), F.col("street_type"),
        F.col("street_direction"), F.col("unit"), F.col("city"), F.col("province"),
        F.col("postal_code"),
    )
    parts = {n: F.col(f"_m_{n}") for n in made}
    staged = pin(df, {f"_m_{n}": e for n, e in made.items()})
    joined = mailing_street(parts)
    lines = {n: F.col(f"_m_{n}") for n in joined}
    staged = pin(staged, {f"_m_{n}": e for n, e in joined.items()})
    scratch = [f"_m_{n}" for n in (*parts, *lines)]
    return staged.withColumn("mailing", mailing_lines(parts, lines)).drop(*scratch)
