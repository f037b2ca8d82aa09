"""Findings of round 3: what must hold for tables larger than the fixtures."""

import random
import re

from pyspark.sql import functions as F

from tripspark.functions.geo import haversine
from tripspark.operators import coverage, places, scan


def plan(df):
    return df._jdf.queryExecution().toString()


def test_nearest_in_growing_circles(spark):
    rng = random.Random(1)
    p = [(i, rng.uniform(-20.5, -19.5), rng.uniform(-49.5, -48.5)) for i in range(60)] + [(60, 10.0, 10.0), (61, None, 1.0), (0, -20.0, -49.0)]
    q = [(i, rng.uniform(-20.5, -19.5), rng.uniform(-49.5, -49.0)) for i in range(80)] + [(900, -20.0, -48.7), (901, -20.0, -48.7)]
    points, towns = spark.createDataFrame(p, "point_id long, lat double, lng double"), spark.createDataFrame(q, "place_id long, lat double, lng double")
    pairs = points.crossJoin(towns.select("place_id", F.col("lat").alias("y"), F.col("lng").alias("x"))).withColumn("km", haversine(F.col("lat"), F.col("lng"), F.col("y"), F.col("x")))
    want = {}
    for r in pairs.filter("km <= 35").collect():
        want[r["point_id"]] = min(want.get(r["point_id"], (99, 0)), (r["km"], r["place_id"]))
    got = places.nearest(points, towns, 35.0)
    assert "Join" not in plan(got)  # its rounds are done: nothing is left to broadcast
    rows = got.collect()
    assert len(rows) == len(p) and {r["point_id"]: (r["km"], r["place_id"]) for r in rows if r["km"] is not None} == want


def test_cells_of_places_are_not_broadcast(spark):
    trips = spark.createDataFrame([(1, -20.0, -49.0, -20.01, -49.0)], "trip_id long, alat double, alng double, blat double, blng double")
    towns = spark.createDataFrame([(7, -20.0, -49.01, 5.0), (8, -21.0, -49.0, 5.0)], "place_id long, lat double, lng double, radius_km double")
    got = places.crossed_cities(trips, towns)
    assert "BroadcastHashJoin" not in plan(got) and [r["place_id"] for r in got.collect()] == [7]


def test_destinations_that_a_condition_tells(spark):
    s = spark.createDataFrame([(1, 10, 5, 51), (1, 9, 5, 52), (1, 8, 5, 53), (2, 7, 4, 51)], "user_id long, trip_id long, trip_date long, place_id long").union(spark.createDataFrame([(1, 3, 5, 52)], "user_id long, trip_id long, trip_date long, place_id long"))
    got = places.crossed_not_destination(s, F.expr("place_id % 50 = user_id % 50"))
    assert sorted(map(tuple, got.collect())) == [(1, 52, 3), (1, 53, 8), (2, 51, 7)]
    table = s.filter("place_id % 50 = user_id % 50")
    assert sorted(map(tuple, places.crossed_not_destination(s, table).collect())) == [(1, 52, 3), (1, 53, 8), (2, 51, 7)]


def test_passes_of_a_group_meet_by_cell(spark):
    trips = spark.createDataFrame([(i, i % 3, -20.0 + i, -49.0, -19.98 + i, -49.0) for i in range(30)], "trip_id long, of long, alat double, alng double, blat double, blng double")
    towns = spark.createDataFrame([(i, i % 3, -20.0 + i, -49.0 + 0.01 * (i % 4)) for i in range(30)], "place_id long, of long, lat double, lng double")
    got = places.route_passes(trips, towns, on="of")
    assert "cx" in plan(got) and sorted(map(tuple, got.collect())) == [(i, i) for i in range(30) if i % 4 < 3]


def test_the_strict_match_is_compiled(spark, capsys):
    """Java runs methods of over 8000 bytes without compiling them, some ten times slower."""
    roads = spark.createDataFrame([(1, 0, i, i * 0.009, 0.0, (i + 1) * 0.009, 0.0) for i in range(9)], "road_id long, line_id long, seq int, alat double, alng double, blat double, blng double")
    trips = roads.select(F.col("road_id").alias("user_id"), *coverage.ENDS)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = coverage.covered_edges(roads, trips, ["user_id"], *coverage.STRICT)
        got.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert len(sizes) > 2 and max(sizes) < 8000 and "BroadcastHashJoin" not in plan(got) and got.count() == 9
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_places_squeeze_is_worked_out_before_its_pairs(spark):
    v = spark.createDataFrame([(1, 0, -20.0, -49.0), (1, 1, -20.01, -49.0)], "trip_id long, seq int, lat double, lng double")
    said = spark.createDataFrame([(1, "BR", True, 0)], "trip_id long, code string, said boolean, pos int")
    towns = spark.createDataFrame([(7, -20.0, -49.01, "BR", False, 5, "PPL"), (8, -21.0, -49.0, "BR", False, 5, "PPL")], "place_id long, lat double, lng double, country_code string, capital boolean, population long, feature_code string")
    found, _ = scan.scan_cities(spark.createDataFrame([(1, "carro")], "trip_id long, mode string"), v, said, towns)
    assert "squeeze" in plan(found) and [(r["place_id"], r["ord"]) for r in found.collect()] == [(7, 1)]
