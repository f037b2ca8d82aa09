"""Findings of round 4: what must hold for tables larger than the fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from tripspark.functions.geo import point_edge_km
from tripspark.operators import coverage, places


def above_the_join(df):
    """What is done with pairs after the join that makes them."""
    return df._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]


def routes_of(spark, monkeypatch, few):
    monkeypatch.setattr(coverage, "ROUTES_AT_ONCE", 3)
    if not few:
        monkeypatch.setattr(coverage, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(coverage, "small", lambda df: df)
    specs = spark.createDataFrame([(i, i % 2 == 0, 1.0 if i < 9 else 0.0, 10.0) for i in range(10)], "route_id long, is_long boolean, min_km double, total_km double")
    runs = spark.createDataFrame([(1, 3, 2.0), (1, 3, 0.5), (1, 4, 9.0), (2, 99, 5.0), (None, 5, 5.0)] + [(3, i, 0.25) for i in range(10)], "user_id long, route_id int, km double")
    return runs, specs


@pytest.mark.parametrize("few", [True, False])
def test_pairs_of_users_and_routes_are_not_dealt(spark, monkeypatch, few):
    """users x routes rows may leave Spark, but none of them is joined, shuffled or sorted on the way."""
    runs, specs = routes_of(spark, monkeypatch, few)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    try:
        got = coverage.route_achievement(runs, specs)
        logical = got._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftOuter" not in logical
        rows = {(r["user_id"], r["route_id"]): tuple(r)[2:] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got.count() == len(rows) == 40 and got.schema["route_id"].dataType.simpleString() == "bigint"
    assert rows[1, 3] == (2.0, 2.5, 25.0, True, True) and rows[1, 4] == (9.0, 9.0, 90.0, True, True) and rows[3, 8] == (0.25, 0.25, 2.5, False, False)
    assert {rows[u, r] for u in (1, 2, None) for r in range(9) if (u, r) not in ((1, 3), (1, 4))} == {(0.0, 0.0, 0.0, False, False)}
    assert rows[2, 9] == (0.0, 0.0, 0.0, True, True) and rows[3, 9] == (0.25, 0.25, 2.5, True, True)


def test_users_are_spread_by_the_rows_made_of_them(spark):
    """A few kilobytes of users become millions of rows: they must not be put together in one partition."""
    specs = spark.range(3000).selectExpr("id as route_id", "false as is_long", "1.0D as min_km", "10.0D as total_km")
    runs = spark.range(200).selectExpr("id as user_id", "id as route_id", "2.0D as km")
    got = coverage.route_achievement(runs, specs).select("user_id", F.spark_partition_id().alias("part")).groupBy("part").agg(F.count_distinct("user_id").alias("n"), F.count("*").alias("rows")).collect()
    assert sum(r["rows"] for r in got) == 600_000 and len([r for r in got if r["rows"] > 3000]) >= 20


def test_medals_of_untouched_routes(spark, monkeypatch):
    runs, specs = routes_of(spark, monkeypatch, True)
    specs = specs.withColumns({"complete_percent": F.lit(None).cast("double"), "alternative_km": F.lit(None).cast("double"), "both": F.lit(True)})
    got = coverage.route_medals(runs.withColumn("variant", F.lit("official")), specs, untouched=True)
    assert "LeftOuter" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r["user_id"], r["route_id"]): (r["traveled_km"], r["medal"]) for r in got.collect()}
    assert len(rows) == got.count() == 40 and rows[1, 3] == (2.5, "gold") and rows[1, 4] == (9.0, "gold") and rows[2, 5] == (0.0, None) and rows[None, 5] == (0.0, None)


def trips_and_towns(spark):
    rng = random.Random(4)
    e = []
    for trip in range(40):
        lat, lng = rng.uniform(-20.3, -19.7), rng.choice([rng.uniform(-49.4, -48.6), rng.uniform(199.8, 200.3)])
        for seq in range(rng.randint(1, 6)):
            to = lat + rng.uniform(-0.05, 0.05), lng + rng.uniform(-0.05, 0.05)
            e.append((trip, trip % 3, trip * 7 % 10, lat, lng, *to))
            lat, lng = to
    e += [(90, 1, 0, -89.2, 10.0, -89.21, 10.1), (91, 1, 0, None, 1.0, 1.0, 1.0), (92, 1, 0, -20.0, -49.5, -20.0, -48.0), (93, None, None, -20.0, -49.0, -20.0, -49.0)]
    trips = spark.createDataFrame(e, "trip_id long, user_id long, trip_date int, alat double, alng double, blat double, blng double")
    t = [(i, rng.uniform(-20.5, -19.5), rng.choice([rng.uniform(-49.6, -48.4), rng.uniform(199.6, 200.5)]), rng.choice([0.5, 1.2, 6.0, 12.0, 13.0, 40.0, 200.0])) for i in range(150)]
    t += [(900, -20.0, -49.0, 0.0), (901, -20.0, -49.0, None), (902, None, -49.0, 5.0), (903, -89.2, 12.0, 8.0), (904, -20.0, -48.0, -1.0)]
    return trips, spark.createDataFrame(t, "place_id long, lat double, lng double, radius_km double")


def all_pairs(trips, towns):
    km = point_edge_km(F.col("lat"), F.col("lng"), *[F.col(c) for c in coverage.ENDS])
    return trips.join(F.broadcast(towns)).withColumn("km", km).filter("km <= radius_km")


@pytest.mark.parametrize("crowded", [False, True])
def test_crossed_cities_are_grouped_where_they_are_made(spark, monkeypatch, crowded):
    if crowded:
        monkeypatch.setattr(places, "TILE_EDGES", 5)
    trips, towns = trips_and_towns(spark)
    got = places.crossed_cities(trips, towns)
    assert "Aggregate" in above_the_join(got) and "Exchange" not in above_the_join(got)
    rows = {(r["trip_id"], r["place_id"]): round(r["km"], 9) for r in got.collect()}
    want = {(r["trip_id"], r["place_id"]): round(r["km"], 9) for r in all_pairs(trips, towns).groupBy("trip_id", "place_id").agg(F.min("km").alias("km")).collect()}
    assert rows == want and got.count() == len(want) > 500 and {k for k in want if k[0] == 90} == {(90, 903)} and (93, 900) in want
    nothing = places.crossed_cities(trips, towns.filter("place_id > 1000")), places.crossed_cities(trips.filter("trip_id > 1000"), towns)
    assert [x.count() for x in nothing] == [0, 0]
    pieces = trips.withColumn("trip_id", F.struct("trip_id", "user_id"))
    assert places.crossed_cities(pieces, towns, trips).count() == len(want)


@pytest.mark.parametrize("crowded", [False, True])
def test_first_crossings_are_grouped_where_they_are_made(spark, monkeypatch, crowded):
    if crowded:
        monkeypatch.setattr(places, "TILE_EDGES", 5)
    trips, towns = trips_and_towns(spark)
    visited = F.expr("place_id % 5 = user_id")
    got = places.first_crossings(trips, towns, visited)
    assert "Aggregate" in above_the_join(got) and "Exchange" not in above_the_join(got)
    want = places.crossed_not_destination(all_pairs(trips, towns), visited)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100
    table = towns.selectExpr("place_id", "place_id % 5 as user_id")
    assert sorted(map(str, places.first_crossings(trips, towns, table).collect())) == sorted(map(str, want.collect()))
