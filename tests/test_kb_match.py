"""Knowledge-base items of cities against all pairs."""

import random

from tripspark.operators import match


def test_kb_match_finds_every_scored_pair(spark):
    rng = random.Random(5)
    names = ["Campinas", "Municipio de Campinas", "Nova Campinas", "amp", "Santos", "Porto Santos", "Rio", "Rio Claro", "Itu", ""]
    cities = [(k, n or "Xis", rng.choice(["SP", "RJ", None]), "BR", *((-22.9, -47.1) if k % 3 else (None, None))) for k, n in enumerate(names * 2)]
    items = [(100 + k, rng.choice(names), rng.random() < 0.6, rng.random() < 0.2, rng.choice(["SP", "RJ", None]), rng.choice(["BR", "AR"]), *((-22.9, -47.1) if k % 2 else (None, None)), rng.random() < 0.8) for k in range(40)]
    c = spark.createDataFrame(cities, "city_id long, name string, region string, country string, lat double, lng double")
    i = spark.createDataFrame(items, "item_id long, title string, is_town boolean, is_noise boolean, region string, country string, lat double, lng double, has_flag boolean")
    want = {}
    for k, name, region, country, *_ in cities:
        n, found = name.lower(), []
        for item, title, town, noise, r, own, _, _, flag in items:
            m = title.lower()
            s = (14 if n == m else 5 if n in m or m in n else -8) + 4 * town - 14 * noise + 7 * (region is not None and region == r) + 3 * (country == own)
            found += [(-s, item, flag)] if s >= 5 else []
        found = [(item, -s) for s, item, flag in sorted(found)[:5] if flag]
        if found:
            want[k] = found[0]
    assert {r["city_id"]: (r["item_id"], r["score"]) for r in match.kb_match(c, i).collect()} == want


def test_kb_match_inside_names_and_without_coordinates(spark):
    c = spark.createDataFrame([(1, "Campinas", "SP", "BR", -22.9, -47.1), (2, "Xis", "RJ", "BR", -22.9, -43.2)], "city_id long, name string, region string, country string, lat double, lng double")
    i = spark.createDataFrame([(7, "Municipio de Campinas", True, False, "SP", "BR", None, None, True), (8, "Outra", True, False, "RJ", "BR", -22.9, -43.2, True)], "item_id long, title string, is_town boolean, is_noise boolean, region string, country string, lat double, lng double, has_flag boolean")
    assert sorted(tuple(r) for r in match.kb_match(c, i).collect()) == [(1, 7, 19), (2, 8, 6)]
