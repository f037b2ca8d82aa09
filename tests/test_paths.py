"""Chains and shortest paths against Dijkstra on small graphs."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tripspark.operators import graph


def dijkstra(edges, source):
    out, best, heap = {}, {}, [(0.0, 0, source)]
    for a, b, km in edges:
        if km is not None and a != b:
            out.setdefault(a, []).append((b, km))
    while heap:
        km, n, node = heapq.heappop(heap)
        if node in best:
            continue
        best[node] = (km, n)
        for b, more in out.get(node, []):
            heapq.heappush(heap, (km + more, n + 1, b))
    return best


def roads(seed):
    """Chains between junctions both ways, a ring of its own, one-way edges, parallel and null edges, and a dead end."""
    r, edges, fresh = random.Random(seed), [], iter(range(1000, 100000))
    for _ in range(14):
        a, b = r.sample(range(8), 2)
        stops = [a, *[next(fresh) for _ in range(r.choice([0, 1, 2, 5, 19]))], b]
        for x, y in zip(stops, stops[1:]):
            km = float(r.randint(1, 5))
            edges += [(x, y, km), (y, x, km)]
    for x, y in [(50, 51), (51, 52), (52, 53), (53, 50)]:
        edges += [(x, y, 1.0), (y, x, 1.0)]
    edges += [(0, 60, 1.0), (60, 0, 1.0), (3, 61, 1.0), (61, 62, 2.0), (62, 5, 0.0), (1, 1, 1.0), (0, 4, None), (0, 1, 90.0), (0, 1, 80.0)]
    return edges


@pytest.mark.parametrize("seed", range(2))
def test_paths_are_those_of_dijkstra(spark, seed):
    edges, r = roads(seed), random.Random(seed + 100)
    nodes = sorted({x for e in edges for x in e[:2]})
    asked = [(i, r.choice(nodes), r.choice(nodes)) for i in range(12)] + [(90, 0, 51), (91, 7, 7), (92, None, 1), (93, 1, None), (94, 123456789, 0), (95, 51, 53)]
    g = spark.createDataFrame(edges, "src long, dst long, km double")
    pairs = spark.createDataFrame(asked, "pair_id long, source long, target long")
    got = {x["pair_id"]: (x["km"], x["n_edges"]) for x in graph.shortest_paths(g, pairs).collect()}
    want = {i: dijkstra(edges, a).get(b, (None, None)) if a is not None else (None, None) for i, a, b in asked}
    assert got == want
    steps, least = {}, {}
    for a, b, km in edges:
        if km is not None:
            least[a, b] = min(km, least.get((a, b), km))
    for x in graph.shortest_path_edges(g, pairs).collect():
        steps.setdefault(x["pair_id"], []).append((x["seq"], x["src"], x["dst"], x["km"]))
    for i, a, b in asked:
        km, n = want[i]
        path = sorted(steps.get(i, []))
        assert [p[0] for p in path] == list(range(1, (n or 0) + 1))
        if path:
            assert (path[0][1], path[-1][2]) == (a, b) and all(p[2] == q[1] for p, q in zip(path, path[1:]))
            assert sum(p[3] for p in path) == km and all(least[p[1], p[2]] == p[3] for p in path)


def test_rounds_follow_junctions_not_vertices(spark, monkeypatch):
    n = 300
    line = [(i, i + 1, 1.0) for i in range(n)] + [(i + 1, i, 1.0) for i in range(n)]
    written = []
    keep = graph.Rounds.write
    monkeypatch.setattr(graph.Rounds, "write", lambda self, name, df: (written.append(name), keep(self, name, df))[1])
    pairs = spark.createDataFrame([(1, 0, n)], "pair_id long, source long, target long")
    assert graph.shortest_paths(spark.createDataFrame(line, "src long, dst long, km double"), pairs).first()["km"] == n
    assert written.count("view") <= 10 and written.count("known") <= 3


def test_an_empty_graph_has_no_paths(spark):
    g = spark.createDataFrame([], "src long, dst long, km double")
    pairs = spark.createDataFrame([(1, 2, 3), (2, 3, 3)], "pair_id long, source long, target long")
    assert sorted(map(tuple, graph.shortest_paths(g, pairs).collect())) == [(1, None, None), (2, 0.0, 0)]
    assert graph.shortest_path_edges(g, pairs).count() == 0 and graph.shortest_paths(g, pairs.limit(0)).count() == 0


def test_cost_of_ways(spark):
    rows = spark.createDataFrame([("track",), ("primary",), ("steps",), ("",), (None,)], "h string")
    assert [r["c"] for r in rows.select(graph.edge_cost(F.lit(2.0), F.col("h")).alias("c")).collect()] == [2.1, 2.0, None, None, None]
