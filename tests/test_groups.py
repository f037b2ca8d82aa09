"""Groups of routes and cities, places in groups that are cut into ranges, snapshots, queues."""

import random

from pyspark.sql import functions as F

from tripspark.operators import groups, marts
from tripspark.operators.sync import route_signature


def test_positions_of_one_large_group(spark):
    r = random.Random(5)
    made = [(("x" if r.random() < 0.9 else None), r.choice([None, *range(40)]), i) for i in range(3000)]
    rows = spark.createDataFrame(made, "g string, a int, id int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = groups.positions(rows, ["g"], ["a", "id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for g in ("x", None):
        want = sorted((x for x in made if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [(p["g"], p["a"], p["id"]) for p in sorted((p for p in got if p["g"] == g), key=lambda p: p["pos"])] == want
        assert sorted(p["pos"] for p in got if p["g"] == g) == list(range(1, len(want) + 1))
    assert groups.positions(rows.limit(0), ["g"], ["a"]).collect() == []


def test_route_kinds_and_states(spark):
    cases = [
        (1, ["BR-116"], "São Paulo", None, "br", ["SP"]), (2, ["INT:UY:RU:9"], None, None, "international", []), (3, [], "Patagônia, ARGENTINA", "", "international", []), (4, None, None, "Rota internacional", "international", []),
        (5, ["LMG-808", None], "", "", "state", ["MG"]), (6, ["sp-300", "MG-50"], "", "", "state", ["MG", "SP"]), (7, [], "Mato Grosso do Sul", "", "state", ["MS", "MT"]), (8, [], "Paraná", "", "state", ["PR"]),
        (9, ["BR 116"], "serra (RS)", "", "state", ["RS"]), (10, None, None, None, "state", []),
    ]
    t = spark.createDataFrame([c[:4] for c in cases], "route_id int, road_refs array<string>, region string, category string")
    got = t.select("route_id", groups.route_kind(*[F.col(c) for c in ("road_refs", "region", "category")]), groups.route_states(F.col("road_refs"), F.col("region"))).collect()
    assert sorted((tuple(r) for r in got)) == [(c[0], c[4], c[5]) for c in cases]


def test_groups_of_routes(spark):
    made = [(1, "Rota 10", None, None, "", ["SP-1"]), (2, "Rota 9", None, None, "", ["SP-2"]), (3, "Estrada Real 2", None, None, "", ["SP-3"]), (4, "A", None, None, "", ["MG-1"]), (5, "B", None, None, "", []), (6, "C", None, None, "", ["MG-1", "SP-1"]), (7, "D", None, None, "", ["BR-1"])]
    got = groups.group_routes(spark.createDataFrame(made, "route_id int, name string, family string, category string, region string, road_refs array<string>")).collect()
    assert sorted((r["kind"], r["group_pos"], r["pos"], r["group_key"], r["route_id"]) for r in got) == [
        ("br", 1, 1, "BR", 7), ("state", 1, 1, "SP", 3), ("state", 1, 2, "SP", 2), ("state", 1, 3, "SP", 1), ("state", 2, 1, "INTERSTATE", 6), ("state", 3, 1, "MG", 4), ("state", 4, 1, "REGIONAL", 5)]


def test_countries_come_by_name(spark):
    made = [("u", x, "", "", c) for c in ("Peru", "Chile", "Argentina") for x in ("Z 10", "Z 9", "Á")]
    cities = spark.createDataFrame(made, "user_id string, city string, region string, country_code string, country string").withColumn("label", F.lit(""))
    got = groups.ordered_city_groups(cities).orderBy("group_pos", "pos").collect()
    assert [(r["country"], r["city"]) for r in got] == [(c, x) for c in ("Argentina", "Chile", "Peru") for x in ("Á", "Z 9", "Z 10")]
    assert [r["group_key"] for r in marts.group_cities(cities).orderBy("pos").collect()] == sorted({r["group_key"] for r in got})


def test_snapshot_fills_coordinates(spark):
    won = spark.createDataFrame(
        [("u", 2, "second", 5, 0, "Alfa", "Alfa", 1.0, 1.0), ("u", 1, "first", 5, 0, " ALFA ", None, None, 7.0), ("u", 1, "first", 5, 1, None, "Beta", None, None), ("u", 1, "first", 5, 2, "", "", 1.0, 1.0), ("u", 0, "gone", 1, 0, "Beta", "Beta", 9.0, 9.0), ("v", 1, "first", 5, 3, "Gama", None, None, None)],
        "user_id string, trip_id int, trip_name string, trip_date int, pos int, label string, city string, lat double, lng double")
    places = spark.createDataFrame([(1, 2, "alfa", None, None, None, 3.0, 3.0), (1, 3, "alfa", None, None, None, 4.0, 4.0), (1, 0, "Beta, SP", "beta", "SP", None, 5.0, None), (1, 1, "", "Beta", "", None, 6.0, 6.0), (2, 0, "gama", "", "", "", 8.0, 8.0)],
        "trip_id int, pos int, label string, city string, region string, country string, lat double, lng double")
    got = groups.city_snapshot(won, places, spark.createDataFrame([("u", 0)], "user_id string, trip_id int")).orderBy("user_id", "item_key").collect()
    assert [tuple(r) for r in got] == [("u", "alfa", " ALFA ", 3.0, 7.0, 1, "first", 5), ("u", "beta", "Beta", 5.0, None, 1, "first", 5), ("v", "gama", "Gama", None, None, 1, "first", 5)]


def test_queue(spark):
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "road_id int")
    catalog = spark.createDataFrame([(1, True), (2, False), (3, None), (3, True), (9, True)], "road_id int, validated boolean")
    got = groups.audit_queue(one(1, 2, 2, 3, 4), catalog, one(1, 2, 9, 8)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "dropped", "complete"), (2, "kept", "pending"), (4, "added", "pending"), (8, "dropped", "orphan"), (9, "dropped", "orphan")]


def test_signature_of_points(spark):
    t = spark.createDataFrame([(1, "ab", [1], [1, 2]), (2, None, [1], [1, 2]), (3, None, None, [1, 2]), (4, None, None, [1, 3]), (5, None, None, None)], "id int, line string, coords array<int>, points array<int>")
    shape = lambda *more: [r[0] for r in t.orderBy("id").select(route_signature("v2", F.col("line"), F.col("coords"), [F.lit("")], *more)).collect()]
    with_points, without = shape(F.col("points")), shape()
    assert [x.split("|")[1].rsplit(":", 1)[0] for x in with_points] == ["poly:2", "geo:1", "pts:2", "pts:2", "none"] and len(set(with_points)) == 5
    assert without[:2] == with_points[:2] and [x.split("|")[1] for x in without[2:]] == ["none"] * 3
