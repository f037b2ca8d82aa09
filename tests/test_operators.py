"""Operators on small literal rows, with the numbers that the rules give."""

import math

from pyspark.sql import functions as F

from tripspark.functions import text as X
from tripspark.functions.geo import bearing_difference
from tripspark.operators import coverage as cov
from tripspark.operators import graph, lines, marts, match, places, roads, sync


def edges_of(spark, name, owner, points, more=""):
    v = spark.createDataFrame([(owner, i, a, b) for i, (a, b) in enumerate(points)], f"{name} long, seq int, lat double, lng double")
    return cov.edges(v, [name])


def test_parallel_lane_is_covered_and_perpendicular_is_not(spark):
    road = edges_of(spark, "road_id", 1, [(-20 + i * 0.009, -49.0) for i in range(5)]).withColumn("line_id", F.lit(0))
    beside = edges_of(spark, "user_id", 1, [(-20 + i * 0.009, -48.9985) for i in range(3)])
    far = edges_of(spark, "user_id", 2, [(-20 + i * 0.009, -48.997) for i in range(5)])
    across = edges_of(spark, "user_id", 3, [(-19.9955, -49.005), (-19.9955, -48.995)])
    for cell in (0.012, 0.003):  # the grid only finds candidates
        got = cov.road_progress(cov.corridor_coverage(road, beside.union(far).union(across), cell=cell)).collect()
        by_user = {r["user_id"]: r for r in got}
        assert by_user[1]["covered_edges"] == 2 and by_user[1]["raw_percent"] == 50.0
        assert all(by_user[u]["covered_edges"] == 0 for u in by_user if u != 1)


def test_reversed_trip_covers_as_much_and_a_near_whole_road_counts_as_whole(spark):
    road = edges_of(spark, "road_id", 1, [(-20 + i * 0.009, -49.0) for i in range(101)]).withColumn("line_id", F.lit(0))
    trip = edges_of(spark, "user_id", 1, [(-20 + i * 0.009, -49.0) for i in range(99, -1, -1)])
    r = cov.road_progress(cov.corridor_coverage(road, trip)).first()
    assert r["covered_edges"] == 99 and r["end_to_end"] and r["percent"] == 100.0 and r["raw_percent"] == 99.0


def test_bearing_difference_is_undirected(spark):
    got = spark.range(1).select(bearing_difference(F.lit(10.0), F.lit(190.0)), bearing_difference(F.lit(0.0), F.lit(90.0)), bearing_difference(F.lit(350.0), F.lit(10.0))).first()
    assert [round(x, 6) for x in got] == [0.0, 90.0, 20.0]


def test_crossing_needs_a_shared_point_or_an_angle(spark):
    route = edges_of(spark, "route_id", 1, [(0.0, 0.0), (0.0, 0.01)])
    cross, near, parallel = ([(-0.005, 0.005), (0.005, 0.005)], [(0.0003, 0.005), (0.01, 0.005)], [(0.0003, 0.0), (0.0003, 0.01)])
    trips = edges_of(spark, "trip_id", 1, cross).union(edges_of(spark, "trip_id", 2, near)).union(edges_of(spark, "trip_id", 3, parallel))
    assert sorted(r["trip_id"] for r in cov.line_crossing(route, trips).collect()) == [1, 2]


def test_road_groups_need_more_than_twenty_kilometres_and_bridge_short_gaps(spark):
    s = spark.createDataFrame([(1, 1, "A", 15.0), (1, 2, "", 10.0), (1, 3, "A", 15.0), (1, 4, "B", 20.0), (1, 5, "C", 30.0), (1, 6, "A", 25.0)], "trip_id long, step_no int, label string, km double")
    got = {(r["label"], r["first_step"]): r["road_km"] for r in roads.road_groups(s).collect()}
    assert got == {("A", 1): 30.0, ("C", 5): 30.0, ("A", 6): 25.0}


def test_polylines(spark):
    v = spark.createDataFrame([(1, 0, 38.5, -120.2), (1, 1, 40.7, -120.95), (1, 2, 43.252, -126.453)], "line_id long, seq int, lat double, lng double")
    encoded = lines.encode_lines(v, ["line_id"])
    assert encoded.first()["encoded"] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    bad = spark.createDataFrame([(2, "_p~iF~ps|U_"), (3, ""), (4, None), (5, "_p~iF")], "line_id long, encoded string")
    assert lines.decode_lines(bad, ["line_id"]).count() == 0
    assert [(r["lat"], r["lng"]) for r in lines.decode_lines(encoded, ["line_id"]).orderBy("seq").collect()] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


def coords(points):
    return [{"lat": a, "lng": b} for a, b in points]


def test_simplify_thin_and_cut(spark):
    kind = "line_id long, coords array<struct<lat:double,lng:double>>"
    zigzag = [(0.0, 0.0), (0.00001, 0.01), (0.0, 0.02), (0.01, 0.03), (0.0, 0.04)]
    df = spark.createDataFrame([(1, coords(zigzag)), (2, None), (3, coords(zigzag[:1]))], kind)
    got = {r["line_id"]: [(p["lat"], p["lng"]) for p in r["coords"]] for r in lines.simplify_lines(df, 15).collect()}
    assert got[1] == [(0.0, 0.0), (0.0, 0.02), (0.01, 0.03), (0.0, 0.04)] and got[2] == [] and got[3] == [(0.0, 0.0)]
    row = spark.createDataFrame([(1, coords([(0.0, i * 0.001) for i in range(11)]))], kind)
    assert [round(p["lng"], 3) for p in lines.thin_by_spacing(row, 0.35).first()["coords"]] == [0.0, 0.004, 0.008, 0.01]
    v = spark.createDataFrame([(1, i, 0.0, i * 0.1) for i in range(11)], "line_id long, seq int, lat double, lng double")
    cut = lines.chunk_by_km(v, ["line_id"], 60).collect()
    assert {r["chunk"] for r in cut} == {0, 1} and len(cut) == 12


def test_great_circle_and_rings(spark):
    stops = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 90.0), (1, 2, 0.0, 90.5)], "trip_id long, seq int, lat double, lng double")
    route = lines.great_circle_route(stops, ["trip_id"])
    assert route.count() == 161
    km = lines.line_metrics(route, ["trip_id"]).first()["km"]
    assert abs(km - 6371.0088 * math.radians(90.5)) < 1e-3
    m = spark.createDataFrame([(7, 1, "outer", coords([(0.0, 0.0), (0.0, 1.0)])), (7, 2, "", coords([(1.0, 1.0), (0.0, 1.0)])), (7, 3, "outer", coords([(1.0, 1.0), (0.0, 0.0)])), (7, 4, "inner", coords([(5.0, 5.0), (6.0, 6.0)]))], "relation_id long, member int, role string, coords array<struct<lat:double,lng:double>>")
    ring = lines.stitch_rings(m).collect()
    assert len(ring) == 1 and len(ring[0]["coords"]) == 4


def test_unique_cities_is_greedy(spark):
    kind = "trip_id long, ord int, city string, region string, country_code string, osm_type string, osm_id long, lat double, lng double"
    rows = [(1, 1, "Águas", "SP", "BR", None, None, 0.0, 0.0), (1, 2, "aguas", "MG", "BR", None, None, 0.0, 0.0), (1, 3, "Aguas", None, "BR", None, None, 0.0, 0.1), (1, 4, "Aguas", None, "BR", None, None, 5.0, 5.0), (2, 1, "Aguas", "SP", "BR", None, None, None, None)]
    got = places.unique_cities(spark.createDataFrame(rows, kind))
    assert sorted((r["trip_id"], r["ord"]) for r in got.collect()) == [(1, 1), (1, 2), (1, 4), (2, 1)]


def test_reconcile_cases(spark):
    local = spark.createDataFrame([(1, "a", 10), (2, "a", 10), (3, "a", 20), (4, "a", 10), (5, "a", 10), (6, "a", 9)], "trip_id long, content string, updated_at long")
    remote = spark.createDataFrame([(1, "a", 5, None), (2, "b", 20, None), (3, "b", 10, None), (4, "a", 5, 10), (6, "b", 9, None), (7, "b", 3, None), (8, "b", 3, None)], "trip_id long, content string, updated_at long, deleted_at long")
    tombs = spark.createDataFrame([(7, 4), (8, 2), (9, 1)], "trip_id long, deleted_at long")
    got = {r["trip_id"]: r["action"] for r in sync.reconcile(local, remote, tombs, ["trip_id"]).collect()}
    assert got == {1: "keep", 2: "download", 3: "upload", 4: "drop", 5: "upload", 6: "upload", 7: "delete_remote", 8: "download", 9: "delete_remote"}


def test_upsert_is_idempotent(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "id long, content string, updated_at long")
    change = spark.createDataFrame([(2, "c", 9), (3, "d", 1), (3, "e", 2)], "id long, content string, updated_at long")
    once = sync.upsert(table, change, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sync.upsert(once, change, ["id"]).collect())) == [(1, "a", 10), (2, "b", 10), (3, "e", 2)]


def test_road_text(spark):
    rows = [("BR–153",), ("spa 75/300",), ("INT:AR:RN:40",), ("Rua 7",), (None,)]
    got = [r["p"] for r in spark.createDataFrame(rows, "s string").select(X.parse_road_code(F.col("s")).alias("p")).collect()]
    assert (got[0]["network"], got[0]["number"], got[0]["federal"]) == ("BR", "153", True)
    assert (got[1]["network"], got[1]["number"], got[1]["parent_state"]) == ("SPA", "75/300", "SP")
    assert got[2]["international"] and got[3] is None and got[4] is None
    one = spark.createDataFrame([("BR-153; SP 425, AMG-1010", "425")], "a string, b string").select(
        X.canonical_keys([F.col("a")], F.lit(None).cast("string")).alias("k"), X.canonical_keys([F.col("b")], F.lit("BR:SP")).alias("bare"),
        X.is_highway_ref(F.col("a")).alias("h"), X.is_highway_ref(F.lit("sp 300")).alias("i"), X.is_highway_ref(F.lit("Ruta 9")).alias("r")).first()
    assert one["k"] == ["BR|AMG|1010", "BR|BR|153", "BR|SP|425"] and one["bare"] == ["BR|SP|425"] and one["i"] and one["r"] and not one["h"]


def test_states_and_groups(spark):
    rows = [("Estado de São Paulo", None, "", "Brasil"), ("BR-MG", None, "BR", ""), (None, "Porto Alegre, RS", "BRA", ""), ("x", "y", "ARG", ""), ("", "", "", ""), ("", "", "", "Terra Nova")]
    df = spark.createDataFrame(rows, "region string, label string, code string, country string")
    got = [r[0] for r in df.select(marts.city_group(*[F.col(c) for c in ("region", "label", "code", "country")])).collect()]
    assert got == ["BR-SP", "BR-MG", "BR-RS", "COUNTRY-AR", "BR-OUTROS", "COUNTRY-terra-nova"]


def brute_score(name, query):
    import unicodedata

    fold = lambda s: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in "".join(ch for ch in unicodedata.normalize("NFD", s) if not unicodedata.combining(ch)).lower()).split())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    n, q = fold(name), fold(query)
    nc, qc, words, k = n.replace(" ", ""), q.replace(" ", ""), n.split(), len(q.split())
    if not q or not n:
        return None
    for score, ok in ((0, n == q), (2, n.startswith(q)), (3, n.endswith(" " + q)), (4, f" {q} " in f" {n} "), (5, q in n), (7, qc in nc)):
        if ok:
            return float(score)
    if not any(q.split()[0][:2] in w for w in words):
        return None
    parts = ["".join(words[s : s + size]) for s in range(len(words)) for size in range(max(1, k - 1), k + 2) if s + size <= len(words)] + [nc]
    best = min((d / max(len(p), len(qc)) for p in parts if (d := distance(p, qc)) <= 4), default=1)
    return 20 + best * 50 if best <= 0.34 else None


def test_fuzzy_scores_and_matches(spark):
    names = ["São Paulo", "São Paulo de Olivença", "Santos", "Campinas", "Campina Grande", "Ribeirão Preto", "Buenos Aires", "Rio Preto"]
    asked = ["sao paulo", "Sao Paolo", "campinas", "preto", "Ribeirao", "buenosaires", "xyz", "", "Capinas", "Olivenca"]
    df = spark.createDataFrame([(n, q) for n in names for q in asked], "n string, q string").withColumn("s", X.fuzzy_score(F.col("n"), F.col("q")))
    for r in df.collect():
        want = brute_score(r["n"], r["q"])
        assert (r["s"] is None) == (want is None) and (want is None or abs(r["s"] - want) < 1e-9), r
    p = spark.createDataFrame([(i, n, "", "AR" if n == "Buenos Aires" else "BR") for i, n in enumerate(names)], "place_id long, name string, admin string, country string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {}
    for r in match.match_places(q, p).collect():
        got.setdefault(r["query_id"], []).append((r["pos"], r["place_id"]))
    assert sorted(got[0]) == [(1, 0), (2, 1)] and [x for _, x in sorted(got[5])] == [6] and 6 not in got and 7 not in got
    assert {x for _, x in got[8]} >= {3}


def test_shortest_paths(spark):
    v = spark.createDataFrame([(1, i, 0.0, i * 0.01) for i in range(5)] + [(2, 0, 0.0, 0.0), (2, 1, 0.02, 0.02), (2, 2, 0.0, 0.04)] + [(3, 0, 5.0, 5.0), (3, 1, 5.0, 5.01)], "line_id long, seq int, lat double, lng double")
    node = lambda a, b: f"{a:.5f},{b:.5f}"
    pairs = spark.createDataFrame([(1, node(0, 0), node(0, 0.04)), (2, node(0, 0), node(5, 5)), (3, node(0, 0), node(0, 0))], "pair_id long, source string, target string")
    got = {r["pair_id"]: r for r in graph.shortest_paths(graph.graph_edges(v, ["line_id"]), pairs).collect()}
    assert abs(got[1]["km"] - 6371.0088 * math.radians(0.04)) < 1e-6 and got[1]["n_edges"] == 4 and got[2]["km"] is None and got[3]["km"] == 0.0


def test_nearest_airport_prefers_the_own_town(spark):
    p = spark.createDataFrame([(1, "Campinas", "BR", -22.9, -47.06), (2, "Nowhere", "BR", -10.0, -40.0), (3, "Near", "BR", -22.95, -47.0), (4, "Near", " ", -22.95, -47.0), (5, "Near", "AR", -22.95, -47.0), (6, "Sao Paulo", None, 10.0, 10.0), (7, None, "br", -22.95, -47.0)], "place_id long, city string, country string, lat double, lng double")
    a = spark.createDataFrame([("VCP", 1, "Campinas", "BR", -23.0, -47.13), ("CPQ", 3, "Campinas", "BR", -22.86, -47.1), ("GRU", 1, "São Paulo", "BR", -23.43, -46.47)], "iata string, kind_rank int, town string, country string, alat double, alng double")
    got = {r["place_id"]: r["iata"] for r in places.nearest_airport(p, a).collect()}
    assert got == {1: "VCP", 3: "CPQ", 4: "CPQ", 6: "GRU", 7: "CPQ"}


def test_long_lists_of_boxes_give_what_short_ones_give(spark, monkeypatch):
    t = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0), (3, None, None, None, None)], "trip_id long, s double, w double, n double, e double")
    r = spark.createDataFrame([(1, 0.99, 0.5, 3.5, 3.0), (2, 1.01, 1.01, 2.0, 2.0), (3, None, None, None, None)], "route_id long, s double, w double, n double, e double")
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 9.0, 9.0), (3, 1.5, 1.5)], "point_id long, lat double, lng double")
    boxes = spark.createDataFrame([(2, "B", 0.0, 0.0, 2.0, 2.0), (1, "A", 1.0, 1.0, 3.0, 3.0)], "priority int, code string, s double, w double, n double, e double")
    short = [sorted(map(tuple, cov.bbox_prefilter(t, r).collect())), sorted(map(tuple, places.point_country(p, boxes).collect()))]
    assert short[0] == [(1, 1), (1, 2), (1, 3), (2, 3), (3, 1), (3, 2), (3, 3)] and short[1] == [(1, "B"), (2, None), (3, "A")]
    monkeypatch.setattr(cov, "is_small", lambda df: False)
    monkeypatch.setattr(places, "is_small", lambda df: False)
    assert short == [sorted(map(tuple, cov.bbox_prefilter(t, r).collect())), sorted(map(tuple, places.point_country(p, boxes).collect()))]


def test_numbers_in_names_sort_by_value(spark):
    names = ["Rota 10", "Rota 2", "Rota", "Rota b", "Rota 002 a", "Rota 123456789012345678901234567890"]
    got = marts.family_priority_sort(spark.createDataFrame([(n, None, None) for n in names], "name string, family string, category string")).orderBy("pos")
    assert [r["name"] for r in got.collect()] == ["Rota", "Rota 2", "Rota 002 a", "Rota 10", "Rota 123456789012345678901234567890", "Rota b"]


def test_route_medals(spark):
    specs = [(1, False, None, None, 10.0, 8.0, True), (2, True, None, None, 10.0, 10.0, True), (3, False, None, 3.0, 10.0, None, True), (4, True, 50.0, 1.0, 10.0, 10.0, False), (5, False, None, None, 10.0, 9.0, True)]
    s = spark.createDataFrame(specs, "route_id long, is_long boolean, complete_percent double, min_km double, total_km double, alternative_km double, both boolean")
    runs = [(1, "official", 1.0), (1, "alternative", 2.0), (2, "official", 8.0), (2, "official", 5.0), (2, "alternative", 9.0), (3, "alternative", 9.0), (3, "official", 2.0), (4, "official", 4.0), (4, "alternative", 9.0)]
    r = spark.createDataFrame([(7, *x) for x in runs], "user_id long, route_id long, variant string, km double")
    got = {x["route_id"]: x for x in cov.route_medals(r, s).collect()}
    assert {k: (v["medal"], v["discovered"], v["complete"]) for k, v in got.items()} == {1: ("silver", True, True), 2: ("gold", True, True), 3: (None, False, False), 4: (None, True, False)}
    assert got[2]["traveled_km"] == 10.0 and got[2]["percent"] == 100.0 and got[2]["longest_km"] == 8.0 and got[2]["alternative_percent"] == 90.0
    whole = {x["route_id"]: x for x in cov.route_medals(r, s, untouched=True).collect()}
    assert {k: v for k, v in whole.items() if k != 5} == got and (whole[5]["percent"], whole[5]["medal"], whole[5]["discovered"]) == (0.0, None, False)


def test_sources_of_a_road_in_any_order(spark):
    from tripspark.sources.roads import union_road_sources

    line = lambda road, source, n, points: [(road, source, n, i, *p) for i, p in enumerate(points)]
    a, b = [(0.0, 0.0), (0.0, 1.0)], [(2.0, 2.0), (2.0, 3.0)]
    v = spark.createDataFrame(line(1, "ways", 1, a[::-1]) + line(1, "relations", 9, a) + line(1, "ways", 2, b) + line(1, "ways", 3, b) + line(1, "ways", 4, a[:1]) + line(2, "ways", 1, a) + line(3, "ways", 1, a) + line(3, "relations", 1, b), "road_id long, source string, line_id long, seq int, lat double, lng double")
    answers = [(1, "relations", True), (1, "ways", False), (1, "ways", True), (2, "ways", True), (2, "relations", None), (3, "relations", True), (4, "ways", False)]
    told = spark.createDataFrame(answers, "road_id long, source string, ok boolean")
    lines, state = union_road_sources(v, told)
    assert sorted(map(tuple, lines.collect())) == [(1, "relations", 9), (1, "ways", 2), (2, "ways", 1), (3, "relations", 1)]
    assert sorted(map(tuple, state.collect())) == [(1, ["relations", "ways"], 2, False), (2, ["ways"], 1, True), (3, ["relations"], 1, True), (4, [], 0, True)]
    again, later = union_road_sources(v, told.union(told).union(spark.createDataFrame([(3, "ways", True)], told.schema)))
    assert sorted(map(tuple, later.filter("road_id = 3").collect())) == [(3, ["relations", "ways"], 2, False)] and again.filter("road_id = 1").count() == 2


def test_progress_of_covered_edges_is_that_of_all_edges(spark):
    import random

    r = random.Random(3)
    walk = lambda n: [(r.uniform(0, 0.002) + i * 0.004, r.uniform(0, 0.004)) for i in range(n)]
    road = [(k, 0, i, *a, *b) for k in range(6) for p in [walk(25)] for i, (a, b) in enumerate(zip(p, p[1:]))] + [(1, 0, 99, 0.0, 0.0, 0.0, 0.0)]
    trip = [(u, *a, *b) for u in range(8) for p in [walk(r.randint(3, 25))] for a, b in zip(p, p[1:])]
    roads = spark.createDataFrame(road, "road_id long, line_id int, seq int, alat double, alng double, blat double, blng double")
    trips = spark.createDataFrame(trip, "user_id long, alat double, alng double, blat double, blng double")
    key = lambda df: sorted((x["user_id"], x["road_id"], x["total_edges"], x["covered_edges"], round(x["traveled_km"], 9), round(x["percent"], 9), x["end_to_end"]) for x in df.collect())
    whole = cov.corridor_coverage(roads, trips)
    some = cov.covered_edges(roads, trips, ["user_id"])
    want = key(cov.road_progress(whole).filter("covered_edges > 0"))
    assert key(cov.progress_of(some, roads)) == want and len({w[3] for w in want}) > 3
    by, runs = ["user_id", "road_id", "line_id"], lambda df: sorted((x["user_id"], x["road_id"], x["first_seq"], x["last_seq"], x["n_edges"]) for x in df.collect())
    assert runs(cov.covered_runs(some, by)) == runs(cov.covered_runs(whole, by))
