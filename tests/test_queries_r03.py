"""Findings of round 3: results where tables have longitudes past 180 degrees, and jobs that are whole."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tripspark import plans
from tripspark.operators import lines, places, regions


def test_points_past_180_degrees_stay(spark):
    v = spark.createDataFrame([(1, 0, -20.0, 179.0), (1, 1, -20.0, 181.0), (1, 2, 95.0, 181.0), (1, 3, -20.0, None)], "line_id long, seq long, lat double, lng double")
    assert [r["lng"] for r in lines.clean_points(v, ["line_id"], unwrapped=True).orderBy("seq").collect()] == [179.0, 181.0]
    assert lines.clean_points(v, ["line_id"]).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_bands_have_no_longitude(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(places, "is_small", lambda df: False)
    p = spark.createDataFrame([(1, -20.0, 500.0), (2, -20.5, 0.5), (3, 40.0, 0.0), (4, None, None)], "point_id long, lat double, lng double")
    r = spark.createDataFrame([(2, "band", -21.0, -19.0, None, None), (1, "box", -21.0, -20.2, 0.0, 1.0)], "priority int, code string, s double, n double, w double, e double")
    assert sorted(map(tuple, places.point_country(p, r).collect())) == [(1, "band"), (2, "box"), (3, None), (4, None)]


def test_boxes_without_an_eastern_end(spark):
    p = spark.createDataFrame([(1, -20.0, 700.0), (2, -20.0, -48.9), (3, -20.0, -49.0), (4, -31.0, 0.0), (5, -20.0, None)], "point_id long, lat double, lng double")
    b = spark.createDataFrame([(1, "AR", -30.0, False, 0.0, -48.9, None), (2, "UY", -21.0, False, 0.0, -50.0, -49.0)], "priority int, code string, s double, open boolean, n double, w double, e double")
    assert sorted(map(tuple, regions.points_in_boxes(p, b).collect())) == [(1, 1, "AR"), (2, 1, "AR"), (3, 2, "UY")]


def test_steps_of_long_lines(spark):
    n = 60000
    v = spark.range(n).select(F.lit(1).alias("line_id"), F.col("id").alias("seq"), (F.col("id") * 7919 % 18000 / 1e5).alias("lat"), (F.col("id") * 104729 % 200000000 / 1e5).alias("lng"))
    e = lines.encode_lines(v, ["line_id"])
    back = lines.decode_lines(e, ["line_id"])  # by copying its steps for each character a line of this length took minutes
    want = v.select("seq", F.col("lat").alias("y"), F.col("lng").alias("x"))
    assert back.join(want, "seq").filter("abs(lat - y) < 1e-9 and abs(lng - x) < 1e-9").count() == n
    bad = spark.createDataFrame([("_p~iF~ps|U",), ("_p~iF",), ("_p~iF~ps|",), ("_p iF~ps|U",), ("",), (None,), ("_p~iF~ps|U\n",)], "e string")
    assert [r[0] for r in bad.select(lines.polyline_deltas(F.col("e"))).collect()] == [[3850000, -12020000], None, None, None, None, None, None]


def test_every_user_has_every_route(spark):
    sf = "/root/testdata/sf0.001"
    got = plans.QUERIES["q_route_achievement"](spark, sf)
    users = duckdb.sql(f"SELECT count(DISTINCT o_custkey) FROM '{sf}/orders.parquet' WHERE substr(o_orderpriority, 1, 1) < '4'").fetchone()[0]
    assert got.count() == users * spark.read.parquet(f"{sf}/supplier.parquet").count()


def test_weights_are_plain_roots():
    import math
    import random

    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        lat, lng = np.array([rng.uniform(-21, -19) for _ in range(3)]), np.array([rng.uniform(0, 120) for _ in range(3)])
        c = math.cos(math.radians((0.0 + lat[0] + lat[1] + lat[2]) / 3))
        x, y = [v * 111320.0 * c for v in lng.tolist()], [v * 110540.0 for v in lat.tolist()]
        dx, dy, px, py = x[2] - x[0], y[2] - y[0], x[1] - x[0], y[1] - y[0]
        t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy)))
        assert lines._weights(lat, lng, 0.0)[1] == math.sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2)


def test_rows_are_dealt_by_their_number(spark):
    from tripspark.operators import sizes

    df = spark.range(100)
    assert sizes.dealt(df, 250_000 * 50, "id").rdd.getNumPartitions() == 50
    assert sizes.dealt(df, 1, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_labels_are_parsed_once(spark):
    from tripspark.operators import roads

    r = spark.range(50).select((F.col("id") % 9).alias("user_id"), F.concat(F.lit("BR-"), (F.col("id") % 4).cast("string")).alias("label"), F.lit(1).alias("first_at"))
    out = roads.rank_road_achievements(r)
    logical = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in logical and out.count() == 50
