"""Golden parses, labels, mailing lines and city spellings."""

import pytest
from pyspark.sql import functions as F

from geoweave.functions import rules, text
from geoweave.functions.mailing import mailing_address
from geoweave.operators.parse import parse_address, parse_requests, street_readings

# Addresses with the parts they must split into.
PARSES = [
    ("123 Main St", "123", "Main", "ST", "", ""),
    ("901-560 Birchmount Rd", "560", "Birchmount", "RD", "", "901"),
    ("Unit 1205, 123 Main St", "123", "Main", "ST", "", "1205"),
    ("105 Unit 2 Broadview Ave", "105", "Broadview", "AVE", "", "2"),
    ("90 Edgewood Ave, Unit # 132", "90", "Edgewood", "AVE", "", "132"),
    ("312 Unit 4 Dundas St E", "312", "Dundas", "ST", "E", "4"),
    ("1 Leeds Ct", "1", "Leeds", "CT", "", ""),
    ("4749 Riverside Drive", "4749", "Riverside", "DR", "", ""),
    ("1570 Traxler Court", "1570", "Traxler", "CRT", "", ""),
    ("100 Queen Mall W", "100", "Queen", "MALL", "W", ""),
    ("12 1/2 King Street", "12 1/2", "King", "ST", "", ""),
    ("5 Park Somewhere", "5", "Park", "SOMEWHERE", "", ""),  # second-last word is a type
    ("7 W", "7", "W", "", "W", ""),
    ("7 Main W", "7", "Main", "", "W", ""),
    ("Main Street", "", "Main Street", "", "", ""),
    ("", "", "", "", "", ""),
]


def test_parse_address(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PARSES)], "i int, address string")
    rows = parse_address(df, "address", "p_").orderBy("i").collect()
    got = [(r.p_civic, r.p_name, r.p_type, r.p_direction, r.p_unit) for r in rows]
    assert got == [p[1:] for p in PARSES]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "value,token",
    [("Montréal", "MONTREAL"), ("  Saint-Paul   Est ", "SAINT-PAUL EST"), ("Œuvre Łódź", "UVRE ODZ"),
     ("A B", "A B"), ("St. John's", "ST JOHNS"), ("", ""), (None, "")],
)
def test_search_token(spark, value, token):
    assert one(spark, text.search_token(F.lit(value).cast("string"))) == token


@pytest.mark.parametrize(
    "value,code",
    [("Ontario", "ON"), ("QC", "QC"), ("35", "ON"), ("québec", "QC"), ("99", None), ("Narnia", None)],
)
def test_province(spark, value, code):
    assert one(spark, text.province_code(F.lit(value))) == code


@pytest.mark.parametrize(
    "value,code",
    [("M5V2T6", "M5V 2T6"), (" m5v 2t6 ", "M5V 2T6"), ("90210", "90210"), ("x" * 21, None), ("  ", None)],
)
def test_postal(spark, value, code):
    assert one(spark, text.postal_code(F.lit(value))) == code


@pytest.mark.parametrize(
    "key,parts,label",
    [
        ("MAIN|ST|N", ("MAIN", "ST", "N"), "Main St N"),
        ("MAIN|N", ("MAIN", "", "N"), "Main N"),
        ("ST", ("ST", "", ""), "St"),
        ("OLD KINGSTON|RD|E", ("OLD KINGSTON", "RD", "E"), "Old Kingston Rd E"),
        ("STE-CATHERINE|RUE", ("STE-CATHERINE", "RUE", ""), "Ste-Catherine Rue"),
        ("", ("", "", ""), ""),
    ],
)
def test_street_key(spark, key, parts, label):
    assert tuple(one(spark, text.street_key_parts(F.lit(key)))) == parts
    assert one(spark, text.street_label(F.lit(key))) == label


def test_completion(spark):
    assert one(spark, text.complete_street_type(F.lit("757 Victoria Park"))) == "757 Victoria Park Ave"
    assert one(spark, text.complete_street_type(F.lit("1 St Clair West"))) == "1 St Clair West"
    assert one(spark, text.complete_street_type(F.lit("Main"))) == "Main"


def test_city_candidates(spark):
    got = lambda c, p: one(spark, text.city_candidates(text.search_token(F.lit(c)), F.lit(p).cast("string")))
    toronto = got("Toronto", "ON")
    assert toronto[:7] == ["TORONTO", "FORMER TORONTO", "SCARBOROUGH", "NORTH YORK", "ETOBICOKE", "YORK", "EAST YORK"]
    assert "CITY OF HAMILTON" in got("Hamilton", "ON")
    assert "QUEBEC CITY" in got("Québec", "QC")
    assert {"TORONTO", "SCARBOROUGH"} <= set(got("City of Toronto", "ON"))
    assert "SCARBOROUGH" not in got("Toronto", "QC")
    assert got("  ", "ON") == []


def test_mailing(spark):
    L = F.lit
    m = one(spark, mailing_address(L("123"), L("Main"), L("ST"), L(""), L(""), L("Toronto"), L("ON"), L("M5V2T6")))
    assert (m.line1, m.line2, m.municipality, m.province, m.postal_code) == ("123 MAIN ST", None, "TORONTO", "ON", "M5V 2T6")
    assert m.multi_line == "123 MAIN ST\nTORONTO  ON  M5V 2T6\nCANADA"
    assert m.single_line == "123 MAIN ST, TORONTO ON, M5V 2T6, CANADA"
    u = one(spark, mailing_address(L("123"), L("Main"), L("AVENUE"), L(""), L("1205"), L("Toronto"), L("Ontario"), L("")))
    assert (u.line1, u.line2, u.province) == ("UNIT 1205", "123 MAIN AVE", "ON")


def test_readings_order(spark):
    df = spark.createDataFrame([("399 The West Mall", "", "Toronto", "ON")], "address string, postal string, city string, state string")
    got = [tuple(r) for r in parse_requests(df).select(street_readings().alias("r")).first().r]
    assert got == [
        ("THE WEST MALL", "AVE", ""), ("THE WEST", "MALL", ""), ("THE WEST MALL", "", ""),
        ("WEST MALL", "AVE", ""), ("WEST", "MALL", ""), ("WEST MALL", "", ""),
    ]


def test_municipality_of_a_result(spark):
    """TX25: mailing town, then the address's city, then the asked one; empty counts as missing, and the town joins the properties."""
    rows = [
        ("OTTAWA", "Nepean", "Kanata", {"NAME": "a"}),
        ("", "Nepean", "Kanata", {"NAME": "a", "MUNICIPALITY": "old"}),
        (None, None, "Kanata", {}),
        (None, "", None, {"MUNICIPALITY": "old"}),
        ("OTTAWA", None, None, None),
    ]
    df = spark.createDataFrame(rows, "mailing string, locality string, city string, props map<string, string>")
    town = rules.municipality(F.col("mailing"), F.col("locality"), F.col("city"))
    got = df.select(town.alias("town"), rules.with_municipality(F.col("props"), town).alias("props")).collect()
    assert [r.town for r in got] == ["OTTAWA", "Nepean", "Kanata", None, "OTTAWA"]
    assert [r.props for r in got] == [
        {"NAME": "a", "MUNICIPALITY": "OTTAWA"}, {"NAME": "a", "MUNICIPALITY": "Nepean"}, {"MUNICIPALITY": "Kanata"},
        {"MUNICIPALITY": "old"}, None,
    ]
