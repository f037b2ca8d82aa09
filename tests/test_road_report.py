"""The road report of all users."""

import os

import pytest

from pyspark.sql import functions as F

from tripspark import plans
from tripspark.operators import marts, places
from tripspark.plans import fixtures as fx

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_every_user_is_in_the_report(spark):
    users = fx.conquests(fx.Tables(spark, DATA)).select("user_id").distinct().count()
    assert plans.QUERIES["q_road_report_all"](spark, DATA).select("user_id").distinct().count() == users


def test_an_end_of_many_runs_is_looked_for_once(spark, monkeypatch):
    runs = spark.createDataFrame([(u, r, 0, 1, 3.0, 1.0 * r, 0.0, 1.0 * r + 0.5, 0.0) for u in range(40) for r in range(2)], "user_id long, road_id long, line_id long, run_no int, km double, alat double, alng double, blat double, blng double")
    towns = spark.createDataFrame([(7, 0.01, 0.0), (8, 1.49, 0.0)], "place_id long, lat double, lng double")
    asked, nearest = [], places.nearest
    monkeypatch.setattr(places, "nearest", lambda points, *rest: (asked.append(points.count()), nearest(points, *rest))[1])
    progress = runs.select("user_id", "road_id", F.lit(1.0).alias("traveled_km"), F.lit(2.0).alias("total_km"), F.lit(50.0).alias("percent"))
    got = marts.road_report(progress, runs, towns, runs.select("user_id", "road_id"))
    assert asked == [4] and sorted({(r["road_id"], r["start_place"], r["end_place"]) for r in got.collect()}) == [(0, 7, None), (1, None, 8)] and got.count() == 80
