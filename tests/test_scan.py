"""Countries of trips, what is found in their catalogs, and the state of a scan."""

from tripspark.operators import scan


def tables(spark):
    trips = [(1, "carro"), (2, "carro"), (3, "aviao"), (4, "moto"), (5, None), (6, "carro"), (7, "carro")]
    lines = {1: [(-20.8, -49.45), (-20.8, -49.25)], 2: [(-20.8, -49.4), (-20.8, -49.3)], 3: [(-20.8, -49.4), (-20.8, -49.3)], 4: [(-20.8, -49.4)], 5: [(5.0, 5.0), (5.0, 5.2)], 6: [(5.0, 5.0), (5.0, 5.2)], 7: [(65.0, 10.0), (65.0, 10.1)]}
    ends = [(1, 0, "BR"), (1, 1, "br"), (2, 0, None), (2, 1, ""), (5, 0, "UY"), (6, 0, "US"), (6, 1, "AR"), (7, 0, "UY")]
    boxes = [(1, "AR", 4.0, False, 6.0, 4.0, 6.0), (2, "BR", -30.0, False, 0.0, -60.0, -40.0)]
    places = [
        (10, -20.83, -49.35, "BR", False, 9_000_000, "PPL"), (11, -20.85, -49.35, "BR", False, 9_000_000, "PPL"), (12, -20.88, -49.35, "BR", True, 0, None), (13, -20.8, -49.35, "AR", True, 9_000_000, "PPLC"),
        (20, 5.01, 5.1, "AR", None, 5_000, "PPL"), (21, 5.03, 5.1, "AR", None, 5_000, "PPL"), (22, 5.03, 5.1, "AR", None, None, "PPLC"), (23, None, None, "AR", None, None, None),
        (30, 65.0, 10.24, "UY", None, 6_000_000, "PPL"), (31, 65.0, 10.26, "UY", None, 6_000_000, "PPL")]  # 31 is within 12 km of the line, but beyond its bounds
    df = spark.createDataFrame
    return (
        df(trips, "trip_id long, mode string"), df([(t, i, *p) for t, ps in lines.items() for i, p in enumerate(ps)], "trip_id long, seq int, lat double, lng double"), df(ends, "trip_id long, ord int, country_code string"),
        df(boxes, "priority int, code string, s double, open boolean, n double, w double, e double"), df([], "priority int, code string, ring array<struct<lat:double,lng:double>>"),
        df(places, "place_id long, lat double, lng double, country_code string, capital boolean, population long, feature_code string"))


def test_scan(spark):
    trips, vertices, ends, boxes, rings, places = tables(spark)
    countries = scan.trip_countries(vertices, ends, boxes, rings)
    assert sorted((r["trip_id"], r["code"], r["said"]) for r in countries.collect()) == [(1, "BR", True), (5, "AR", False), (5, "UY", True), (6, "AR", True), (6, "US", True), (7, "UY", True)]
    found, state = scan.scan_cities(trips, vertices, countries, places)
    assert sorted((r["trip_id"], r["ord"], r["place_id"]) for r in found.collect()) == [(1, 1, 10), (1, 2, 12), (2, 1, 10), (2, 2, 12), (5, 1, 20), (5, 2, 22), (6, 1, 20), (6, 2, 22), (7, 1, 30)]
    assert {r["trip_id"]: (r["source"], r["complete"]) for r in state.collect()} == {
        1: ("local-br", True), 2: ("local-br+partial", False), 3: ("flight", True), 4: ("no-route", True), 5: ("local-uy+local-ar", True), 6: ("local-ar+partial", False), 7: ("local-uy", True)}
    _, without = scan.scan_cities(trips, vertices, countries, places.filter("country_code <> 'BR'"))
    assert {r["trip_id"]: (r["source"], r["complete"]) for r in without.filter("trip_id < 3").collect()} == {1: ("pending", False), 2: ("pending", False)}


def test_a_long_line_is_sampled_and_its_last_vertex_counts(spark):
    _, _, _, boxes, rings, _ = tables(spark)
    def codes(i, n):
        v = spark.createDataFrame([(1, k, *(((5.0, 5.0)) if k == i else (50.0, 50.0))) for k in range(n)], "trip_id long, seq int, lat double, lng double")
        return [r["code"] for r in scan.trip_countries(v, spark.createDataFrame([], "trip_id long, ord int, country_code string"), boxes, rings).collect()]
    assert codes(400, 1000) == ["AR"] and codes(401, 1000) == [] and codes(999, 1000) == ["AR"] and codes(7, 399) == ["AR"]


def test_catalogs_that_no_trip_asks_are_not_read(spark, tmp_path):
    trips, vertices, ends, boxes, rings, places = tables(spark)
    places.write.partitionBy("country_code").parquet(f"file://{tmp_path}/places")
    stored = spark.read.parquet(f"file://{tmp_path}/places")
    only = trips.filter("trip_id = 1")
    found, _ = scan.scan_cities(only, vertices, scan.trip_countries(vertices, ends, boxes, rings), stored)
    assert sorted(r["place_id"] for r in found.collect()) == [10, 12]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
