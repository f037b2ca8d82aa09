"""Scans by outlines and by towns, on a few trips along a meridian and across."""

from tripspark.operators import scan_modes

EDGE = "alat double, alng double, blat double, blng double"


def ring(key, s, n, w, e):
    at = [(s, w), (s, e), (n, e), (n, w), (s, w)]
    return [(key, *a, *b) for a, b in zip(at, at[1:])]


def test_outlines_first(spark):
    trips = spark.createDataFrame([(1, 0, -20.0, -44.0, -20.1, -44.0), (1, 1, -20.1, -44.0, -21.0, -44.0), (1, 2, -21.0, -44.0, -21.5, -43.5), (2, 0, -30.0, -50.0, -30.1, -50.0)], f"trip_id int, chunk int, {EDGE}")
    # area 10 is crossed by chunk 0 of trip 1; area 11 meets chunk 2's bounds but not its line
    rings = spark.createDataFrame([*ring(10, -20.05, -19.9, -44.1, -43.9), *ring(11, -21.1, -21.02, -43.6, -43.52)], f"area_id int, {EDGE}")
    places = spark.createDataFrame([(20, "city", -20.09, -44.0), (21, "village", -20.5, -44.001), (22, "village", -20.6, -44.01), (23, "town", -20.7, -44.01), (24, "city", -21.25, -43.75), (25, "hamlet", -20.5, -44.0), (26, "city", None, -44.0), (27, "city", -30.05, -50.02), (28, None, -20.5, -44.0)],
        "place_id int, kind string, lat double, lng double")
    got = sorted(tuple(r) for r in scan_modes.scan_outlines(trips, rings, places).collect())
    assert got == [(1, "admin", 10), (1, "place", 20), (1, "place", 21), (1, "place", 23), (2, "place", 27)]  # 20 by chunk 1, 24 only by chunk 2
    assert scan_modes.scan_outlines(trips.limit(0), rings, places).collect() == []
    assert {r["city_id"] for r in scan_modes.scan_outlines(trips, rings.limit(0), places).collect()} == {20, 21, 23, 24, 27}


def test_towns_take_what_their_municipality_says(spark):
    trips = spark.createDataFrame([(1, 0, -20.0, -44.0, -20.1, -44.0), (1, 1, -20.1, -44.0, -21.0, -44.0)], f"trip_id int, chunk int, {EDGE}")
    text = "label string, city string, region string, country_code string, country string"
    places = spark.createDataFrame(
        [(1, "city", None, -20.05, -44.03, "Água", "Água", "", "", None), (2, "village", None, -20.5, -44.02, "X", "X", "", "", ""), (3, "village", None, -20.5, -44.009, "Vila", "Vila", "MG", "", ""), (4, "town", 1_200_000, -20.9, -44.05, "Big", None, None, None, None),
         (5, "village", None, None, None, "Ring", "Ring", "", "", ""), (6, "village", None, -20.3, -44.001, "Só", "Só", "", "", "")], f"place_id int, kind string, population long, lat double, lng double, {text}")
    rings = spark.createDataFrame(ring(5, -20.4, -20.2, -44.1, -43.9), f"place_id int, {EDGE}")
    towns = spark.createDataFrame(
        [(9, "AGUA", "Minas", "BR", "Brasil", -20.2, -19.9, -44.2, -43.8), (8, "agua", "Bahia", "BR", "Brasil", -20.15, -20.12, -44.2, -43.8), (7, "Vila", "Goiás", "BR", "Brasil", -20.6, -20.4, -44.1, -43.9), (6, "so", "Far", "BR", "Brasil", -25.0, -24.0, -44.1, -43.9), (5, "Ring", None, "BR", "Brasil", -20.4, -20.2, -44.1, -43.9)],
        "area_id int, name string, region string, country_code string, country string, s double, n double, w double, e double")
    got = {r["place_id"]: tuple(r)[2:] for r in scan_modes.scan_towns(trips, places, rings, towns).collect()}
    assert got == {
        1: ("radius", "Água, Minas, Brasil", "Água", "Minas", "BR", "Brasil"), 3: ("radius", "Vila, MG, Brasil", "Vila", "MG", "BR", "Brasil"), 4: ("radius", "Big", None, "", "", ""),
        5: ("boundary", "Ring, Brasil", "Ring", "", "BR", "Brasil"), 6: ("radius", "Só", "Só", "", "", "")}
