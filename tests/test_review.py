"""Trips reviewed against roads: a later review equals one from nothing, and leaves pairs that have not changed alone."""

import random

from pyspark.sql import functions as F

from tripspark.operators import coverage as cov
from tripspark.operators.review import review_trips, signatures, stored, written

ROAD = "road_id long, line_id long, seq int, alat double, alng double, blat double, blng double"
TRIP = "trip_id long, seq int, alat double, alng double, blat double, blng double"


def line(lng, first, last, key):
    return [(*key, i, i * 0.009, lng, (i + 1) * 0.009, lng) for i in range(first, last)]


def tables(spark, roads, trips):
    """roads, trips: id -> (longitude, first edge, last edge)."""
    r = [x for k, v in roads.items() for x in line(*v, (k, 0))]
    t = [(k, i, *e) for k, (lng, a, b) in trips.items() for _, i, *e in line(lng, a, b, (k,))]
    return spark.createDataFrame(r, ROAD), spark.createDataFrame(t, TRIP)


def plain(roads, trips):
    """Edges of a road that a trip on the same meridian shares, if two or more (two edges are over 2 km)."""
    out = {}
    for r, (x, a, b) in roads.items():
        for t, (y, c, d) in trips.items():
            n = min(b, d) - max(a, c)
            if abs(x - y) < 0.0007 and n * 1.0008 >= 2:
                out[r, t] = (max(a, c), min(b, d) - 1)
    return out


def runs(review):
    return {(r["road_id"], r["trip_id"]): (r["first_seq"], r["last_seq"]) for r in review.runs.collect()}


def test_incremental_equals_full(spark, tmp_path):
    rng = random.Random(8)
    roads = {k: (k * 0.03, 0, 20) for k in range(12)}
    trips = {k: (rng.randrange(12) * 0.03 + rng.choice([0, 0.0005, 0.002]), a := rng.randrange(18), a + rng.randint(1, 8)) for k in range(80)}
    before = written(review_trips(*tables(spark, roads, trips)), str(tmp_path / "r0"))
    assert runs(before) == plain(roads, trips) and len(plain(roads, trips)) > 20
    for step in range(3):
        for k in rng.sample(sorted(trips), 6):  # moved, gone and new trips; longer, gone and new roads
            trips[k] = (rng.randrange(14) * 0.03, 2, 9)
        for k in rng.sample(sorted(trips), 4):
            del trips[k]
        trips[1000 + step] = (0.06, 0, 20)
        roads[20 + step] = ((12 + step) * 0.03, 0, 20)
        roads[2] = (roads[2][0], step, 20 + step)
        roads.pop(5 + step)
        own = tables(spark, roads, trips)
        after = written(review_trips(*own, before), str(tmp_path / f"r{step + 1}"))
        assert runs(after) == plain(roads, trips)
        known = {(r["road_id"], r["trip_id"]) for r in before.conquests.collect()}
        assert {(r["road_id"], r["trip_id"]) for r in after.added.collect()} == set(plain(roads, trips)) - known
        before = stored(spark, str(tmp_path / f"r{step + 1}"))


def test_unchanged_pairs_are_not_matched_again(spark, tmp_path):
    roads, trips = {1: (0.0, 0, 20), 2: (0.03, 0, 20)}, {1: (0.0, 0, 10), 2: (0.03, 0, 10), 3: (0.0, 3, 9)}
    before = review_trips(*tables(spark, roads, trips))
    before = before._replace(runs=before.runs.withColumn("km", F.lit(-1.0)))  # a stored run shows where it comes back
    trips[2] = (0.03, 4, 10)
    got = {(r["road_id"], r["trip_id"]): r["km"] for r in review_trips(*tables(spark, roads, trips), before).runs.collect()}
    assert got[1, 1] == got[1, 3] == -1.0 and got[2, 2] > 5
    same = review_trips(*tables(spark, roads, trips), review_trips(*tables(spark, roads, trips)))
    assert same.added.count() == 0


def test_given_conquests_stay(spark):
    roads, trips = {1: (0.0, 0, 20)}, {1: (0.0, 0, 10), 2: (9.0, 0, 10)}
    given = spark.createDataFrame([(1, 2), (1, 1), (1, 1)], "road_id long, trip_id long")
    got = {(r["road_id"], r["trip_id"]): (r["n_runs"], r["given"]) for r in review_trips(*tables(spark, roads, trips), None, given).conquests.collect()}
    assert got == {(1, 1): (1, True), (1, 2): (None, True)}
    none = spark.createDataFrame([], ROAD), spark.createDataFrame([], TRIP)
    assert all(t.count() == 0 for t in review_trips(*none, review_trips(*none)))


def test_signatures_tell_geometry_not_order(spark):
    a = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0, 4.0), (1, 1, 3.0, 4.0, 5.0, 6.0)], TRIP)
    sign = lambda t: signatures(t, "trip_id", ["seq"]).first()["signature"]
    assert sign(a) == sign(a.orderBy(F.desc("seq")).repartition(2)) and sign(a) != sign(a.withColumn("seq", 1 - F.col("seq"))) and sign(a) != sign(a.limit(1).union(a.limit(1)))


def test_covered_edges_agree_with_corridor_coverage(spark):
    rng = random.Random(4)
    loop = [(0.0, 0.0), (0.009, 0.0), (0.018, 0.0), (0.018, 0.009), (0.009, 0.009), (0.009, 0.0), (0.009, 0.0), (0.0, 0.009)]
    roads = [(1, 0, i, *p, *q) for i, (p, q) in enumerate(zip(loop, loop[1:]))] + line(0.02, 0, 9, (2, 0))
    trips = [(rng.randrange(5), 0, *(p := rng.choice(loop)), p[0] + rng.uniform(-0.02, 0.02), p[1] + rng.choice([0.0, 0.001, 0.01])) for _ in range(60)]
    r = spark.createDataFrame(roads, ROAD)
    t = spark.createDataFrame(trips, TRIP).withColumn("user_id", F.col("trip_id") % 3)
    full, alone = cov.corridor_coverage(r, t), cov.covered_edges(r, t, ["user_id"])
    key = ["user_id", "road_id", "line_id"]
    pick = lambda c: sorted(map(tuple, cov.covered_runs(c, key).select(*key, "first_seq", "last_seq", "n_edges").collect()))
    assert pick(full) == pick(alone) and len(pick(full)) > 3


def test_runs_are_worked_out_once(spark):
    own = tables(spark, {1: (0.0, 0, 20)}, {1: (0.0, 0, 10)})
    first = review_trips(*own)
    for r in (first, review_trips(*own, first)):
        plans = [t._jdf.queryExecution().toString() for t in r]
        assert not any("cx#" in p or "l_squeeze" in p for p in plans) and runs(r) == {(1, 1): (0, 9)}
