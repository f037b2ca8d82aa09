"""Points in regions against plain ray casting."""

import random

import pytest
from pyspark.sql import functions as F

from tripspark.functions import regions as outlines
from tripspark.operators import regions as reg


def in_ring(lat, lng, ring):
    inside = False
    for k, (y, x) in enumerate(ring):
        v, u = ring[k - 1]
        if (y > lat) != (v > lat) and lng < (u - x) * (lat - y) / (v - y) + x:
            inside = not inside
    return inside


def country(lat, lng):
    for code, shape in outlines.OUTLINES:
        if isinstance(shape, list):
            if in_ring(lat, lng, shape):
                return code
            continue
        s, n, w, e = shape
        if e is None:
            e = next(x for low, x in outlines.EASTERN_STEPS if low is None or lat > low)
        if s <= lat <= n and w <= lng <= e:
            return code
    return None


def test_countries_against_plain_tests(spark):
    rng = random.Random(2)
    spots = [(rng.uniform(-60, 85), rng.uniform(-175, -30)) for _ in range(3000)]
    spots += [(rng.uniform(-36, -29), rng.uniform(-60, -52)) for _ in range(1000)]
    for _, shape in outlines.OUTLINES:  # vertices, corners, and places on the steps of the limit
        spots += shape if isinstance(shape, list) else [(a, b) for a in shape[:2] for b in shape[2:] if b is not None]
    spots += [(lat + d, e + g) for lat, e in outlines.EASTERN_STEPS[:-1] for d in (0.0, -1e-9, 1e-9) for g in (-0.01, 0.0, 0.3, 0.9)]
    data = [(i, *p) for i, p in enumerate(spots)] + [(-1, None, 3.0), (-2, None, None)]
    got = {r["point_id"]: r["code"] for r in reg.point_region(spark.createDataFrame(data, "point_id long, lat double, lng double"), *reg.outline_tables(spark)).collect()}
    assert len(got) == len(data) and got[-1] is got[-2] is None
    assert {i: got[i] for i in range(len(spots))} == {i: country(*p) for i, p in enumerate(spots)}
    assert len(set(got.values())) > 20


@pytest.mark.parametrize("cell", [0.37, 1.0, 30.0])
def test_rings_against_ray_casting(spark, cell):
    rng = random.Random(7)
    rings = []
    for k in range(6):  # stars, which are not convex, one with level and upright edges
        ring = [(rng.uniform(0.3, 3) * (1 if i % 2 else 0.3) * y + k, rng.uniform(1, 3) * x) for i, (y, x) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)))]
        rings.append((k, f"r{k}", ring))
    rings.append((9, "comb", [(0, 0), (0, 6), (4, 6), (4, 5), (1, 5), (1, 4), (4, 4), (4, 3), (1, 3), (1, 2), (4, 2), (4, 0)]))
    table = spark.createDataFrame([(p, c, [(float(y), float(x)) for y, x in r]) for p, c, r in rings], "priority int, code string, ring array<struct<lat:double,lng:double>>")
    spots = [(i, rng.uniform(-4, 9), rng.uniform(-4, 7)) for i in range(1500)] + [(2000 + i, rng.randint(-1, 5) * 1.0, rng.randint(-1, 7) * 1.0) for i in range(200)]
    got = reg.points_in_rings(spark.createDataFrame(spots, "point_id long, lat double, lng double"), table, cell)
    want = sorted((i, p) for i, y, x in spots for p, _, r in rings if in_ring(y, x, r))
    assert sorted((r["point_id"], r["priority"]) for r in got.collect()) == want and len(want) > 300


def test_inside_cells_need_no_test(spark):
    cover = reg.cell_cover(reg.ring_edges(reg.outline_tables(spark)[1]))
    n = {r["edge"]: r["n"] for r in cover.groupBy("edge").agg(F.count("*").alias("n")).collect()}
    assert n[False] > n[True] and cover.groupBy("priority", "cx", "cy").count().filter("count > 1").count() == 0


def test_badges_take_the_country_they_stand_in(spark):
    rows = [(1, "INT:AR:RN:9", -33.0, -56.0), (2, "INT:UY:RU:14", -38.0, -62.0), (3, "int:uy:rn:7b", -33.0, -56.0), (4, "BR-153", -33.0, -56.0), (5, "INT:AR:RN:9", None, None), (6, "INT:AR:RN:9", -10.0, -50.0), (7, "INT:UY:RU", -33.0, -56.0)]
    got = {r["point_id"]: r["label"] for r in reg.reclassify_badges(spark.createDataFrame(rows, "point_id long, label string, lat double, lng double"), *reg.outline_tables(spark)).collect()}
    assert got == {1: "INT:UY:RU:9", 2: "INT:AR:RN:14", 3: "INT:UY:RU:7B", 4: "BR-153", 5: "INT:AR:RN:9", 6: "INT:AR:RN:9", 7: "INT:UY:RU"}
