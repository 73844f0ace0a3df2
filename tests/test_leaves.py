"""Results become addresses, with labels made once per street, civic number and unit."""

from geoweave.operators import suggest as G

ADDR = ("id long, province string, city_key string, street_key string, civic_number string, unit string, postal_code string, "
        "street_name string, street_type string, street_direction string, city string, lat double, lon double")
RANKED = ("query_id long, rank int, province string, city_key string, street_key string, city string, lat double, lon double, "
          "address_count long, search_text string, distance double, score double, civic int, unit string, in_range boolean")


def test_labels_are_made_before_results_are_joined(spark):
    place = ("ON", "PARIS|ON")
    addr = spark.createDataFrame(
        [(1, *place, "ROCK HILL|ST", "7", "", "", "Rock hill", "ST", "", "Paris", 1.0, 2.0),
         (2, *place, "ROCK HILL|ST", "9", "A", "", "Rock-hill", "ST", "", "Paris", 3.0, 4.0),
         (3, *place, "ROCK HILL|ST", "9", "B", "", "ROCK/HILL", "ST", "", "Paris", 5.0, 6.0)], ADDR)
    street = (*place, "ROCK HILL|ST", "Paris", 8.0, 9.0, 3, "rock", None, 0.5)
    ranked = spark.createDataFrame(
        [(1, 1, *street, None, "", False), (2, 1, *street, 7, "", True), (3, 1, *street, 8, "", True),
         (4, 1, *street, 9, "", True), (5, 1, *street, 9, "B", True)], RANKED)
    found = G.resolve_leaves(ranked, addr)
    assert [(r.query_id, r.kind, r.main_text) for r in found.orderBy("query_id").collect()] == [
        (1, "street", "Rock Hill St"), (2, "premise", "7 Rock Hill St"), (3, "ranged", "8 Rock Hill St"),
        (4, "building", "9 Rock-Hill St"), (5, "premise", "B-9 Rock/Hill St"),
    ]
    shown = found.select("query_id", "main_text")
    above = shown._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "lower(" not in above
