"""Components against union-find."""

import random

from tripspark.llm.components import components


def test_random_graphs(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200, 205), (201, 205), (202, 205)] + [(300, 301), (302, 301)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    want = sorted((x, find(x)) for x in root if find(x) != x)
    assert sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
