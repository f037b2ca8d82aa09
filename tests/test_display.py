"""Display strings, references abroad, and the operators that go through pieces in turn."""

import pytest
from pyspark.sql import functions as F

from tripspark.functions import display as D
from tripspark.operators import places, roads

CASES = [
    ("RN 40", "AR", "INT:AR:RN:40"), ("Ruta 007", "UY", "INT:UY:RU:7"), ("RN 40", "", ""), ("PY-02", "", "INT:PY:PY:2"), ("PE-1N", "", "INT:PE:PE:1N"), ("PE1N", "", ""), ("F 4", "", "INT:BO:F:4"),
    ("E35", "AR", "INT:EC:E:35"), ("BR-153", "AR", ""), ("45", "CO", "INT:CO:RN:45"), ("45", "AR", ""), ("CA-1", "GT", "INT:GT:CA:1"), ("CA-1", "AR", ""), ("int:ar:rn:0040", "", "INT:AR:RN:40"), (None, "AR", ""), ("Troncal 5", "", "INT:VE:T:5"),
]


def test_references_abroad(spark):
    df = spark.createDataFrame(CASES, "raw string, hint string, want string").withColumn("got", D.international_ref(F.col("raw"), F.col("hint")))
    assert [(r["raw"], r["hint"], r["got"]) for r in df.collect()] == CASES


def test_display_strings(spark):
    r = spark.range(1).select(
        D.format_date(F.lit("2024-03-09")), D.format_date(F.lit(None).cast("string")), D.format_distance(F.lit(1234567.0)), D.format_distance(F.lit(999.4)), D.format_duration(F.lit(3720.0)), D.format_duration(F.lit(3600.0)),
        D.format_duration(F.lit(59.0)), D.mode_label(F.lit("a-pe")), D.mode_label(F.lit("x")), D.destination_category(F.lit("tourism"), F.lit("hotel")), D.destination_category(F.lit("natural"), F.lit("x"))).first()
    assert list(r) == ["09/03/2024", "Sem data", "1.235 km", "999 m", "1 h 2 min", "1 h", "1 min", "A pé", "Outro", "Hotel", "Local natural"]


@pytest.mark.parametrize("row,want", [
    (("Bauru", "São Paulo", "BR", "", ""), "Bauru, SP"), (("Bauru, X", "sp", "", "Brasil", ""), "Bauru, SP"), (("Salta", "Salta", "AR", "", ""), "Salta"), (("Austin", "tx", "US", "", ""), "Austin, TX"), ((None, None, None, None, "A, B, C"), "A, B")])
def test_place_labels(spark, row, want):
    df = spark.createDataFrame([row], "city string, region string, code string, country string, label string")
    assert df.select(D.compact_place_label(*[F.col(c) for c in df.columns])).first()[0] == want


def test_tags(spark):
    df = spark.createDataFrame([({"ISO3166-2": "BR-SP"},), ({"addr:state": "Salta", "addr:country": "ar"},), ({},)], "t map<string,string>")
    assert [tuple(r["x"]) for r in df.select(D.tags_region(F.col("t")).alias("x")).collect()] == [("SP", "", "BR"), ("Salta", "", "AR"), ("", "", "")]


def coords(*points):
    return [{"lat": a, "lng": b} for a, b in points]


def test_groups_of_stored_pieces(spark):
    rows = [(1, "A", 1, coords((0.0, 0.0), (0.0, 0.1))), (1, "A", 2, coords((0.0, 0.25), (0.0, 0.15))), (1, "A", 3, coords((0.0, 1.0), (0.0, 1.3))), (1, "B", 1, coords((0.0, 0.0), (0.0, 0.1))), (2, "A", 1, None)]
    got = roads.road_groups_from_segments(spark.createDataFrame(rows, "trip_id long, label string, ord int, coords array<struct<lat:double,lng:double>>"))
    assert sorted((r["trip_id"], r["label"], r["group_no"], round(r["road_km"], 1)) for r in got.collect()) == [(1, "A", 0, 22.2), (1, "A", 1, 33.4)]


def test_points_in_order_and_waypoints_kept(spark):
    p = spark.createDataFrame([(1, "via", 1, 0.5), (1, "stop", 2, 0.5), (1, "stop", 3, 0.1)], "trip_id long, kind string, ord int, progress double")
    assert [(r["kind"], r["ord"]) for r in roads.order_route_points(p).orderBy("pos").collect()] == [("stop", 3), ("stop", 2), ("via", 1)]
    c = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.6), (1, 2, 0.4), (1, 3, 1.0)], "trip_id long, ord int, progress double")
    w = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.7), (1, 9, -0.5)], "trip_id long, waypoint_id int, progress double")
    assert {r["waypoint_id"]: r["after_ord"] for r in roads.preserve_waypoints(c, w).collect()} == {7: 0, 8: 2, 9: None}


def test_destinations_and_passing(spark):
    q = spark.createDataFrame([(1, "parque lage")], "query_id long, query string")
    p = spark.createDataFrame([(1, 10, 1, "Parque Lage Norte", "PT", False), (1, 11, 2, "Parque Lage", "AR", False), (1, 12, 3, "Lago", "BR", True), (1, 13, 4, "Praia", "BR", False), (1, 14, 5, "parque do lage", "BR", False)], "query_id long, poi_id long, ord int, name string, country string, category_hit boolean")
    assert [r["poi_id"] for r in places.match_destinations(q, p).orderBy("pos").collect()] == [11, 12, 14, 10]
    t = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0)], "trip_id long, alat double, alng double, blat double, blng double")
    m = spark.createDataFrame([(1, 5, 0.02, 0.5), (1, 6, 0.1, 0.5)], "trip_id long, place_id long, lat double, lng double")
    assert [r["place_id"] for r in places.route_passes(t, m).collect()] == [5]
