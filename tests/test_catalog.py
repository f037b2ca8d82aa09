"""Curated routes: weights against plain simplifying, budgets, sources, files."""

import json
import math
import random

from pyspark.sql import functions as F

from tripspark.operators import catalog, lines


def simplified(points, tolerance):
    """Ramer-Douglas-Peucker by recursion, in the plane at the mean latitude."""
    scale = math.cos(math.radians(sum(p[0] for p in points) / len(points)))
    flat = [(p[1] * 111320 * scale, p[0] * 110540) for p in points]

    def off(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    def inner(a, b):
        if b - a < 2:
            return []
        d = [off(flat[i], flat[a], flat[b]) for i in range(a + 1, b)]
        at = a + 1 + d.index(max(d))
        return [*inner(a, at), at, *inner(at, b)] if max(d) > tolerance else []

    return [0, *inner(0, len(points) - 1), len(points) - 1]


def walk(seed, n):
    r, at, out = random.Random(seed), [-20.0, -44.0], []
    for _ in range(n):
        at = [at[0] + r.uniform(-0.002, 0.003), at[1] + r.uniform(-0.002, 0.003)]
        out.append(tuple(at))
    return out


LINE = "route_id string, role string, line_no int, seq int, lat double, lng double"


def rows_of(route, role, line, points):
    return [(route, role, line, i, *p) for i, p in enumerate(points)]


def test_weights_hold_every_tolerance(spark):
    made = {1: walk(1, 400), 2: walk(2, 37), 3: [(-20.0, -44.0)] * 5, 4: walk(4, 2), 5: walk(5, 1), 6: [*walk(6, 30), walk(6, 30)[0]]}
    v = spark.createDataFrame([(k, i, *p) for k, ps in made.items() for i, p in enumerate(ps)] + [(1, 900, None, 1.0)], "line_id int, seq int, lat double, lng double")
    got = lines.vertex_weights(v, ["line_id"], 20.0).collect()
    assert {r["line_id"] for r in got} == {1, 2, 3, 4, 6} and {r["n_source"] for r in got if r["line_id"] == 1} == {400}
    for k in (1, 2, 3, 4, 6):
        for t in (20.0, 55.0, 150.0, 600.0, 1e7):
            assert sorted(r["seq"] for r in got if r["line_id"] == k and r["weight"] > t) == simplified(made[k], t), (k, t)
    low = lines.vertex_weights(v.limit(0), ["line_id"]).collect()
    assert low == []


def test_catalog_under_a_budget(spark, tmp_path):
    made = [*rows_of("a", "official", 1, walk(1, 300)), *rows_of("a", "official", 0, walk(2, 200)), *rows_of("a", "alternative", 0, walk(3, 90)), *rows_of("b", "official", 0, walk(4, 500)),
            *rows_of("c", "alternative", 0, walk(5, 9)), *rows_of("d", "official", 0, walk(6, 1)), *rows_of("off", "official", 0, walk(7, 50)), *rows_of("z", "official", 0, walk(8, 600))]
    v = spark.createDataFrame(made, LINE)
    box = "struct<s:double,w:double,n:double,e:double>"
    given = [("a", "x", None, 12.5, None, None), ("b", "x", False, None, None, (-21.0, -45.0, -19.0, -43.0)), ("c", "x", None, None, None, None), ("d", "y", None, None, None, None), ("off", "x", True, 1.0, None, None), ("z", None, None, 3.0, 4.0, None)]
    routes = spark.createDataFrame(given, f"route_id string, country string, disabled boolean, total_km double, alternate_km double, bounds {box}")
    ladder = (40.0, 120.0, 400.0)
    sizes = {}
    for t in ladder:
        docs, _ = catalog.curated_catalog(routes, v, "country", 10**9, (t,))
        sizes[t] = {r["route_id"]: (r["bytes"], r["points"]) for r in docs.collect()}
    whole = {t: sizes[t]["a"][0] + sizes[t]["b"][0] for t in ladder}
    assert whole[40.0] > whole[120.0] > whole[400.0]
    docs, without = catalog.curated_catalog(routes, v, "country", whole[120.0], ladder)
    got = {r["route_id"]: r for r in docs.collect()}
    assert sorted(r["route_id"] for r in without.collect()) == ["c", "d"] and sorted(got) == ["a", "b", "z"]
    assert [got[x]["tolerance_m"] for x in "ab"] == [120.0, 120.0] and all(r["fits"] for r in got.values())
    assert {x: (got[x]["bytes"], got[x]["points"]) for x in "ab"} == {x: sizes[120.0][x] for x in "ab"}
    a = json.loads(got["a"]["document"])
    kept = [simplified(p, 120.0) for p in (walk(2, 200), walk(1, 300), walk(3, 90))]
    assert got["a"]["source_points"] == 590 and got["a"]["points"] == sum(map(len, kept)) and got["a"]["bytes"] == len(got["a"]["document"].encode())
    assert (len(a["encodedLines"]), len(a["alternateEncodedLines"]), a["totalKm"], a["alternateTotalKm"]) == (2, 1, 12.5, None)
    points = [walk(s, n)[i] for (s, n), k in zip(((2, 200), (1, 300), (3, 90)), kept) for i in k]
    assert a["bounds"] == [[round(min(p[i] for p in points), 5) for i in (0, 1)], [round(max(p[i] for p in points), 5) for i in (0, 1)]]
    assert json.loads(got["b"]["document"])["bounds"] == [[-21.0, -45.0], [-19.0, -43.0]]
    first = spark.createDataFrame([(a["encodedLines"][0],)], "encoded string")
    assert [(r["lat"], r["lng"]) for r in lines.decode_lines(first, [], "encoded").orderBy("seq").collect()] == [(round(walk(2, 200)[i][0], 5), round(walk(2, 200)[i][1], 5)) for i in kept[0]]
    none, _ = catalog.curated_catalog(routes, v, "country", 10, ladder)
    assert {(r["route_id"], r["tolerance_m"], r["fits"]) for r in none.collect()} == {(x, 400.0, False) for x in "abz"}
    assert {r["route_id"]: r["points"] for r in catalog.curated_catalog(routes, v, None, 10**9, (0.0,), 100)[0].collect()} == {"a": 290, "b": 100, "z": 100}
    catalog.write_curated(docs, str(tmp_path / "out"))
    back = catalog.read_curated(spark, str(tmp_path / "out"), ["x"])
    assert {r["id"]: r["encodedLines"] for r in back.collect()} == {x: got[x]["encoded_lines"] for x in "ab"}
    assert "bundle" in back._jdf.queryExecution().toString().split("PartitionFilters:")[1].split("]")[0]
    sums = [r for r in spark.read.json(str(tmp_path / "out/manifest")).collect() if r["route_id"] is None]
    assert sorted((r["bundle"] or "", r["n_routes"], r["bytes"]) for r in sums) == [("", 1, got["z"]["bytes"]), ("x", 2, whole[120.0])]


def test_route_geometry(spark):
    far = lambda s, n=5: walk(s, n)
    made = [("a", "official", "road-catalog", 0, far(1, 1)), ("a", "official", "routed-waypoints", 1, far(2)), ("a", "official", "routed-waypoints", 0, far(3)), ("a", "alternative", "road-catalog", 0, far(4)),
            ("b", "official", "road-catalog", 0, far(5)), ("b", "official", "named-roads", 0, far(6)), ("c", "alternative", "road-catalog", 0, far(7)), ("d", "official", "guess", 0, far(8))]
    v = spark.createDataFrame([(r, role, s, k, i, *p) for r, role, s, k, ps in made for i, p in enumerate(ps)], "route_id string, role string, source string, line_no int, seq int, lat double, lng double")
    got = {r["route_id"]: r for r in catalog.route_geometry(v).collect()}
    assert {k: (r["source"], len(r["encoded_lines"]), len(r["alternate_lines"])) for k, r in got.items()} == {"a": ("routed-waypoints", 2, 1), "b": ("road-catalog", 1, 0)}
    assert got["b"]["alternate_km"] is None and got["a"]["total_km"] > 0 and got["a"]["bounds"]["s"] == min(p[0] for s in (2, 3, 4) for p in far(s))


def test_merge_route_lines(spark):
    parts = [(1, 0, 0, 1.0, 1.0), (1, 0, 1, 2.0, 2.0), (1, 1, 0, 2.0, 2.0), (1, 1, 1, 2.0, 2.0), (1, 1, 2, 3.0, 3.0), (1, 3, 0, 3.0, 3.1), (2, 0, 0, 1.0, 1.0), (2, 1, 0, 1.0, 1.0)]
    v = spark.createDataFrame(parts, "trip_id int, part int, seq int, lat double, lng double")
    got = lines.merge_route_lines(v, ["trip_id"]).orderBy("seq").collect()
    assert [(r["trip_id"], r["seq"], r["lat"], r["lng"]) for r in got] == [(1, 0, 1.0, 1.0), (1, 1, 2.0, 2.0), (1, 2, 2.0, 2.0), (1, 3, 3.0, 3.0), (1, 4, 3.0, 3.1)]
