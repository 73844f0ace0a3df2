"""Acceptance cases of the cascade over small address files."""

import pytest
from pyspark.sql import functions as F

from geoweave.operators import geocode as G
from geoweave.operators.parse import standardize_addresses
from geoweave.sources import addresses as A

# Address rows (civic, name, type, direction, unit, postal, city, province, lat, lon).
MAIN_ROWS = [
    ("123", "MAIN", "ST", "", "", "M5V 2T6", "Toronto", "ON", 43.6532, -79.3832),
    ("123", "MAIN", "ST", "", "1205", "M5V 2T6", "Toronto", "ON", 43.6533, -79.3833),
    ("456", "KING", "ST", "W", "", "M5H 1A1", "Toronto", "ON", 43.6489, -79.3817),
    ("123", "MAIN", "ST", "", "", "K1A 0A1", "Ottawa", "ON", 45.4215, -75.6972),
    ("350", "SAINT-PAUL", "RUE", "E", "", "H2Y 1H2", "Montréal", "QC", 45.5088, -73.554),
    ("757", "VICTORIA PARK", "AVE", "", "", "M4C 1N2", "Toronto", "ON", 43.692101, -79.288688),
    ("560", "BIRCHMOUNT", "RD", "", "901", "M1K 1E8", "Toronto", "ON", 43.709, -79.264),
    ("100", "GEORGIA", "ST", "W", "", "V6B 1A1", "Vancouver", "BC", 49.2838, -123.1187),
]
ALIAS_ROWS = [
    ("100", "QUEEN", "ST", "W", "", "M5H 2N2", "FORMER TORONTO", "ON", 43.65282, -79.38363),
    ("757", "VICTORIA PARK", "AVE", "", "", "M4C 5N8", "SCARBOROUGH", "ON", 43.692101, -79.288688),
    ("500", "COLLIDE", "ST", "", "", "M1B 1A1", "SCARBOROUGH", "ON", 43.77, -79.25),
    ("500", "COLLIDE", "ST", "", "", "M2B 1A1", "NORTH YORK", "ON", 43.78, -79.41),
    ("71", "MAIN", "ST", "E", "", "L8N 1E7", "CITY OF HAMILTON", "ON", 43.25636, -79.8674),
    ("1", "LEEDS", "CT", "", "", "P1L 1A1", "TOWN OF BRACEBRIDGE", "ON", 45.03127, -79.31732),
    ("399", "WEST", "MALL", "", "", "M9C 2Y2", "ETOBICOKE", "ON", 43.63116, -79.55726),
    ("4", "RAVINE PARK", "", "", "", "N3Y 1A1", "NORFOLK", "ON", 42.84, -80.3),
    ("3", "WOODSTOCK", "AV", "", "", "N3Y 2A1", "NORFOLK", "ON", 42.85, -80.31),
]
ALL_PROVINCES = ["AB", "BC", "MB", "NB", "NS", "NT", "ON", "PE", "QC", "SK"]
COLUMNS = "civic_number string, street_name string, street_type string, street_direction string, unit string, postal_code string, city string, province string, lat double, lon double, id bigint"

# (rows, address, postal, city, state) -> (method, lat) or error code.
CASES = [
    ("main", "123 Main St", None, "Toronto", "ON", "exact", 43.6532),
    ("main", None, "M5V2T6", None, "ON", "postal_centroid", None),
    ("main", "350 Saint-Paul RUE E", None, "Montréal", "QC", "exact", 45.5088),
    ("main", "123 Main St", None, "Ottawa", "ON", "exact", 45.4215),
    ("main", "Main Street", None, None, None, "AMBIGUOUS_LOCATION", None),
    ("main", None, None, "Toronto", "ON", "ADDRESS_NOT_FOUND", None),
    ("main", None, "V6B1A1", None, "BC", "postal_centroid", 49.2838),
    ("main", None, "A1C1A1", None, "NL", "PROVINCE_NOT_LOADED", None),
    ("main", "Unit 1205, 123 Main St", None, "Toronto", "ON", "exact", 43.6533),
    ("main", "757 Victoria Park", None, "Toronto", "ON", "exact", 43.692101),
    ("main", "901-560 Birchmount Rd", None, "Toronto", "ON", "exact", 43.709),
    ("main", "757 Victoria Park Ave", "M5V2T6", "Toronto", "ON", "exact", 43.692101),
    ("main", "999 Nonexistent Blvd", None, "Toronto", "ON", "ADDRESS_NOT_FOUND", None),
    ("main", "450 King St W", None, "Toronto", "ON", "street_interpolated", 43.6489),
    ("alias", "100 Queen St W", None, "Toronto", "ON", "exact", 43.65282),
    ("alias", "71 Main St E", None, "Hamilton", "ON", "exact", 43.25636),
    ("alias", "500 Collide St", None, "Toronto", "ON", "AMBIGUOUS_LOCATION", None),
    ("alias", "500 Collide St", None, "Scarborough", "ON", "exact", 43.77),
    ("alias", "1 Leeds Ct", None, "Bracebridge", "ON", "exact", 45.03127),
    ("alias", "399 The West Mall", None, "Toronto", "ON", "exact", 43.63116),
    ("alias", "4 Ravine Park", None, "Norfolk", "ON", "exact", 42.84),
    ("alias", "3 Woodstock Ave", None, "Norfolk", "ON", "exact", 42.85),
    ("alias", "99999 Nowhere St", None, "Toronto", "ON", "ADDRESS_NOT_FOUND", None),
]


def make_store(spark, rows):
    df = spark.createDataFrame([r + (i + 1,) for i, r in enumerate(rows)], COLUMNS)
    return G.AddressStore(standardize_addresses(df))


@pytest.mark.parametrize("rows,table", [("main", MAIN_ROWS), ("alias", ALIAS_ROWS)])
def test_cascade(spark, rows, table):
    cases = [(i,) + c[1:5] for i, c in enumerate(CASES) if c[0] == rows]
    reqs = spark.createDataFrame(cases, "req_id int, address string, postal string, city string, state string")
    results = {r.req_id: r for r in G.geocode(reqs, make_store(spark, table), ALL_PROVINCES).collect()}
    assert len(results) == len(cases)
    for i, case in enumerate(CASES):
        if case[0] != rows:
            continue
        got, want, lat = results[i], case[5], case[6]
        assert (got.error_code or got.method) == want, case
        if lat is not None:
            assert got.row.lat == pytest.approx(lat, abs=1e-9), case


def test_reverse(spark):
    pts = spark.createDataFrame([(1, -79.3832, 43.6532), (2, 0.0, 0.0)], "pid int, lon double, lat double")
    got = {r.pid: r for r in G.reverse_geocode(pts, make_store(spark, MAIN_ROWS)).collect()}
    assert got[1].row.lat == pytest.approx(43.6532) and got[1].method == "nearest_neighbor"
    assert got[2].error_code == "NO_NEARBY_ADDRESS"


def test_csv_file(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text(
        "latitude,longitude,street_no,str_name_pcs,str_type_pcs,city_pcs,pruid,full_addr\n"
        '43.88570,-79.01632, 56 ,RUMBELLOW,CRESCENT,AJAX,35,"56 ""R"" CRESCENT, AJAX"\n\n'
        "x,1,1,A,ST,B,35,\n1,2,1,A,ST,B,Nowhere,\n"
    )
    good, bad = A.normalize_rows(A.read_address_csv(spark, str(file)))
    row = good.collect()
    assert len(row) == 1
    assert (row[0].province, row[0].civic_number, row[0].street_type, row[0].full_address) == (
        "ON", "56", "CRESCENT", '56 "R" CRESCENT, AJAX')
    assert sorted(r.reject_reason for r in bad.collect()) == ["no coordinates", "unknown province"]


def test_cascade_with_every_repeated_key_salted(spark, sf_dir, monkeypatch):
    """The same results when each key with more than one row counts as hot."""
    from geoweave.operators import skew
    from geoweave.plans.geocode_queries import PROVINCES, store
    from geoweave.sources import derived

    flat = lambda df: sorted(
        (r.req_id, r.method, r.error_code, r.row.id if r.row else None) for r in df.collect()
    )
    addresses, reqs = store(spark, sf_dir), derived.requests(spark, sf_dir)
    reqs = reqs.unionByName(reqs.withColumn("req_id", F.col("req_id") + 1_000_000))
    plain = flat(G.geocode(reqs, addresses, PROVINCES))
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (1,))
    assert flat(G.geocode(reqs, addresses, PROVINCES)) == plain
