"""Mailing lines (TX14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions import text

_COUNTRY = "CANADA"


def _present(value: Column) -> Column:
    return text.empty_to_null(value)


def mailing_parts(
    civic: Column, name: Column, kind: Column, direction: Column, unit: Column,
    city: Column, province: Column, postal: Column,
) -> dict[str, Column]:
    """What the mailing fields are put together from."""
    return {
        "civic": _present(text.fold_accents(civic)),
        "name": _present(text.fold_accents(name)),
        "kind": F.regexp_replace(text.fold_accents(text.null_to_empty(kind)), "[^A-Z]", ""),
        "direction": _present(text.street_direction(direction)),
        "unit": F.when(unit != "", text.trim_ws(text.fold_accents(unit))),
        "town": text.null_to_empty(text.fold_accents(city)),
        "code": F.coalesce(
            text.province_code(province), text.fold_accents(text.null_to_empty(province))
        ),
        "zip": text.postal_code(postal),
    }


def mailing_street(parts: dict[str, Column]) -> dict[str, Column]:
    """The street's line and the unit's."""
    type_token, unit_text = parts["kind"], parts["unit"]
    street = F.concat_ws(
        " ",
        parts["civic"],
        parts["name"],
        # "AV" keeps its short form on mailing lines.
        _present(F.when(type_token == "AV", type_token).otherwise(text.canonical_type(type_token))),
        parts["direction"],
    )
    unit_line = F.when(
        unit_text.isNotNull(),
        F.when(unit_text.rlike("^(UNIT|APT|SUITE|#)"), unit_text).otherwise(
            F.concat(F.lit("UNIT "), unit_text)
        ),
    )
    return {"street": F.trim(F.regexp_replace(street, f"{text.WS}+", " ")), "unit_line": unit_line}


def mailing_lines(parts: dict[str, Column], lines: dict[str, Column]) -> Column:
    """Struct of mailing fields; a unit takes the first line and moves the street to the second."""
    street, unit_line = lines["street"], lines["unit_line"]
    town, code, zip_code = parts["town"], parts["code"], parts["zip"]
    line1 = F.coalesce(unit_line, street)
    line2 = F.when(unit_line.isNotNull(), _present(street))
    last_line = F.concat_ws("  ", _present(town), _present(code), zip_code)
    single = F.concat_ws(
        ", ",
        _present(line1), line2, _present(F.trim(F.concat(town, F.lit(" "), code))), zip_code,
        F.lit(_COUNTRY),
    )
    return F.struct(
        line1.alias("line1"),
        line2.alias("line2"),
        town.alias("municipality"),
        code.alias("province"),
        zip_code.alias("postal_code"),
        F.lit(_COUNTRY).alias("country"),
        F.trim(F.regexp_replace(single, f"{text.WS}+", " ")).alias("single_line"),
        F.concat_ws(
            "\n", _present(line1), line2, _present(last_line), F.lit(_COUNTRY)
        ).alias("multi_line"),
    )


def mailing_address(
    civic: Column, name: Column, kind: Column, direction: Column, unit: Column,
    city: Column, province: Column, postal: Column,
) -> Column:
    """``mailing_lines`` of address columns, as one expression."""
    parts = mailing_parts(civic, name, kind, direction, unit, city, province, postal)
    return mailing_lines(parts, mailing_street(parts))
