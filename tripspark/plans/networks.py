"""Registered queries over networks of roads and over places that are told apart in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.functions.geo import haversine
from tripspark.operators import coverage, graph, places, scan
from tripspark.plans import fixtures as fx
from tripspark.plans.fixtures import Tables, using
from tripspark.plans.queries import MERIDIAN, RADIUS, big, km6, query
from tripspark.sources.roads import union_road_sources

NETWORK = """road AS (SELECT CAST(s_suppkey AS BIGINT) AS r FROM supplier),
way AS (SELECT r * 100 + i AS a, r * 100 + i + 1 AS b, CAST(1 + (r * 31 + i * 17) % 9 AS DOUBLE) AS km FROM road, unnest(range(0, 20)) AS t(i)
  UNION ALL SELECT r * 100 + i, (r + 1) * 100 + i, CAST(1 + r % 5 AS DOUBLE) FROM (SELECT r, unnest([r * 7 % 21, (r * 13 + 5) % 21]) AS i FROM road WHERE r % 4 < 3)),
edge AS (SELECT a AS src, b AS dst, km FROM way UNION ALL SELECT b, a, km FROM way),
ask AS (SELECT r AS pair_id, r * 100 AS source, (r - r % 4 + (r * 5 + 1) % 4) * 100 + 20 AS target FROM road),
walk AS (SELECT pair_id, target, source AS node, CAST(0 AS DOUBLE) AS km, CAST(0 AS BIGINT) AS n_edges, [source] AS seen FROM ask
  UNION ALL SELECT pair_id, target, dst, w.km + e.km, n_edges + 1, list_append(seen, dst) FROM walk w JOIN edge e ON src = node WHERE node <> target AND NOT list_contains(seen, dst)),
best AS (SELECT pair_id, min(struct_pack(km := km, n := n_edges)) AS b FROM walk WHERE node = target GROUP BY ALL)"""


def network(t: Tables) -> DataFrame:
    """Four suppliers' roads side by side, each joined to the next at two places; edges both ways."""
    r = F.col("r")
    road = t.supplier.select(F.col("s_suppkey").cast("long").alias("r"))
    along = road.select("r", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select((r * 100 + F.col("i")).alias("src"), (r * 100 + F.col("i") + 1).alias("dst"), (1 + (r * 31 + F.col("i") * 17) % 9).cast("double").alias("km"))
    across = road.filter("r % 4 < 3").select("r", F.explode(F.array(r * 7 % 21, (r * 13 + 5) % 21)).alias("i")).select((r * 100 + F.col("i")).alias("src"), ((r + 1) * 100 + F.col("i")).alias("dst"), (1 + r % 5).cast("double").alias("km"))
    one_way = along.union(across)
    return one_way.union(one_way.select("dst", "src", "km"))


def asked(t: Tables) -> DataFrame:
    """From each road's start to the end of a road of its four."""
    k = F.col("s_suppkey").cast("long")
    return t.supplier.select(k.alias("pair_id"), (k * 100).alias("source"), ((k - k % 4 + (k * 5 + 1) % 4) * 100 + 20).alias("target"))


@query(f"WITH RECURSIVE {NETWORK} SELECT pair_id, b.km AS km, b.n AS n_edges FROM ask LEFT JOIN best USING (pair_id)")
def q_shortest_paths(t: Tables) -> DataFrame:
    return graph.shortest_paths(network(t), asked(t))


@query(f"WITH RECURSIVE {NETWORK} SELECT pair_id, b.km AS km, b.n AS n_edges, source AS first_node, target AS last_node FROM ask JOIN best USING (pair_id) WHERE source <> target")
def q_path_edges(t: Tables) -> DataFrame:
    """What the edges of each path add up to, and where the first and the last of them are."""
    e = graph.shortest_path_edges(network(t), asked(t))
    ends = [F.min_by("src", "seq").alias("first_node"), F.max_by("dst", "seq").alias("last_node")]
    return e.groupBy("pair_id").agg(F.sum("km").alias("km"), F.max("seq").alias("n_edges"), *ends).select("pair_id", "km", *big("n_edges"), "first_node", "last_node")


CITIES = """city AS (SELECT place_id // 40 AS trip_id, CAST(place_id AS INTEGER) AS ord, 'c' || (place_id % 3) AS city, CASE place_id % 4 WHEN 0 THEN 'SP' WHEN 1 THEN 'MG' ELSE '' END AS region,
  CASE WHEN place_id % 5 = 0 THEN '' ELSE 'BR' END AS country, CASE WHEN place_id % 7 = 0 THEN place_id % 6 END AS osm_id, lat, lng FROM places),
turn AS (SELECT *, row_number() OVER (PARTITION BY trip_id, city ORDER BY ord) AS n FROM city),
fold AS (SELECT trip_id, city, 1 AS n, [struct_pack(ord := ord, region := region, country := country, osm_id := osm_id, lat := lat, lng := lng)] AS kept FROM turn WHERE n = 1
  UNION ALL SELECT f.trip_id, f.city, f.n + 1, CASE WHEN len(list_filter(f.kept, lambda k: CASE WHEN k.osm_id IS NOT NULL AND t.osm_id IS NOT NULL THEN k.osm_id = t.osm_id
      WHEN k.region <> '' AND t.region <> '' AND k.region <> t.region THEN false WHEN k.country <> '' AND t.country <> '' AND k.country <> t.country THEN false WHEN k.region <> '' AND t.region <> '' THEN true
      ELSE 2 * 6371.0088 * asin(sqrt(power(sin(radians(t.lat - k.lat) / 2), 2) + cos(radians(k.lat)) * cos(radians(t.lat)) * power(sin(radians(t.lng - k.lng) / 2), 2))) <= 25 END)) = 0
    THEN list_append(f.kept, struct_pack(ord := t.ord, region := t.region, country := t.country, osm_id := t.osm_id, lat := t.lat, lng := t.lng)) ELSE f.kept END
  FROM fold f JOIN turn t ON t.trip_id = f.trip_id AND t.city = f.city AND t.n = f.n + 1),
whole AS (SELECT trip_id, city, arg_max(kept, n) AS kept FROM fold GROUP BY ALL)"""


@query("WITH RECURSIVE " + using("places", more=CITIES).removeprefix("WITH ") + "SELECT trip_id, city, unnest(kept).ord AS ord FROM whole")
def q_unique_cities(t: Tables) -> DataFrame:
    """Places by trip, some with regions or ids, without those that are the same as one kept before."""
    k = F.col("place_id")
    p = fx.places(t).select(
        F.floor(k / 40).alias("trip_id"), k.cast("int").alias("ord"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("city"), F.when(k % 4 == 0, "SP").when(k % 4 == 1, "MG").alias("region"),
        F.when(k % 5 > 0, "BR").alias("country_code"), F.lit("node").alias("osm_type"), F.when(k % 7 == 0, k % 6).alias("osm_id"), "lat", "lng")
    return places.unique_cities(p).select("trip_id", "ord", "city")


def road_answers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Lines of roads from relations, and from ways, which have most of them the other way round and some a little beside; and what arrived."""
    v, r = fx.road_vertices(t), F.col("road_id")
    relations = v.filter("road_id % 5 <> 0").select("road_id", F.lit("relations").alias("source"), F.lit(1).alias("line_id"), "seq", "lat", "lng")
    way = v.filter("road_id % 3 <> 0").select("road_id", F.lit("ways").alias("source"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("line_id"), "seq", "lat", "lng")
    way = way.filter("line_id < 3 or seq = 0").withColumn("seq", -F.col("seq")).withColumn("lng", F.when((F.col("line_id") == 2) & (r % 7 == 0), F.col("lng") + 0.001).otherwise(F.col("lng")))
    road = t.supplier.select(F.col("s_suppkey").cast("long").alias("road_id"))
    answers = [road.select("road_id", F.lit("relations").alias("source"), (r % 11 != 0).alias("ok")), road.select("road_id", F.lit("ways").alias("source"), F.lit(False).alias("ok")), road.select("road_id", F.lit("ways").alias("source"), (r % 13 != 0).alias("ok"))]
    return relations.unionByName(way), answers[0].union(answers[1]).union(answers[2])


SOURCES = """r AS (SELECT CAST(s_suppkey AS BIGINT) AS road_id FROM supplier), s AS (SELECT *, road_id % 11 <> 0 AS rel, road_id % 13 <> 0 AS way FROM r),
line AS (SELECT *, rel AND road_id % 5 <> 0 AS whole, way AND road_id % 3 <> 0 AS ways FROM s)"""


@query(f"""WITH {SOURCES} SELECT road_id, CASE WHEN rel AND way THEN 'relations,ways' WHEN rel THEN 'relations' WHEN way THEN 'ways' ELSE '' END AS arrived,
CAST(CASE WHEN whole OR ways THEN 1 ELSE 0 END + CASE WHEN ways AND road_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_lines, NOT (rel AND way) AS partial FROM line""")
def q_road_source_state(t: Tables) -> DataFrame:
    _, state = union_road_sources(*road_answers(t))
    return state.withColumn("arrived", F.array_join("arrived", ",")).select("road_id", "arrived", *big("n_lines"), "partial")


@query(f"""WITH {SOURCES} SELECT road_id, 'relations' AS source, CAST(1 AS BIGINT) AS line_id FROM line WHERE whole UNION ALL SELECT road_id, 'ways', 1 FROM line WHERE ways AND NOT whole
UNION ALL SELECT road_id, 'ways', 2 FROM line WHERE ways AND road_id % 7 = 0""")
def q_union_road_sources(t: Tables) -> DataFrame:
    lines, _ = union_road_sources(*road_answers(t))
    return lines.select("road_id", "source", *big("line_id"))


@query(using("trip_edges") + f""", run AS (SELECT user_id, road_id, trip_id, {MERIDIAN.format('max(blat) - min(alat)')} AS km FROM trip_edges GROUP BY ALL),
d AS (SELECT user_id, road_id AS route_id, coalesce(sum(CASE WHEN trip_id % 3 < 2 THEN km END), 0) AS t, coalesce(max(CASE WHEN trip_id % 3 < 2 THEN km END), 0) AS l, coalesce(sum(CASE WHEN trip_id % 3 = 2 THEN km END), 0) AS bt, coalesce(max(CASE WHEN trip_id % 3 = 2 THEN km END), 0) AS al FROM run GROUP BY ALL),
p AS (SELECT *, least(t, 8) / 8 * 100 AS percent, CASE WHEN route_id % 4 = 0 THEN 0 ELSE least(bt, 9) / 9 * 100 END AS apercent FROM d),
w AS (SELECT *, CASE WHEN route_id % 3 = 0 THEN percent >= 85 ELSE l >= 4 END AS won, route_id % 4 > 0 AND CASE WHEN route_id % 3 = 0 THEN apercent >= 85 ELSE al >= 4 END AS awon FROM p)
SELECT user_id, route_id, round(percent, 4) AS percent, round(apercent, 4) AS alternative_percent, round(l, 6) AS longest_km, l >= 4 OR route_id % 4 > 0 AND al >= 4 AS discovered,
CASE WHEN won THEN 'gold' WHEN awon AND route_id % 5 > 0 THEN 'silver' END AS medal FROM w""")
def q_route_medals(t: Tables) -> DataFrame:
    """Medals for routes with official and alternative lines, for all users and routes that a trip has touched."""
    e = fx.trip_edges(t)
    runs = e.groupBy("user_id", "trip_id", F.col("road_id").alias("route_id")).agg(F.sum(haversine(*[F.col(c) for c in coverage.ENDS])).alias("km")).withColumn("variant", F.when(F.col("trip_id") % 3 < 2, "official").otherwise("alternative"))
    k = F.col("road_id")
    routes = fx.road_edges(t).select("road_id").distinct().unionByName(e.select("road_id").distinct()).distinct()
    specs = routes.select(k.alias("route_id"), (k % 3 == 0).alias("is_long"), F.lit(None).cast("double").alias("complete_percent"), F.lit(4.0).alias("min_km"), F.lit(8.0).alias("total_km"), F.when(k % 4 > 0, 9.0).alias("alternative_km"), (k % 5 > 0).alias("both"))
    m = coverage.route_medals(runs, specs)
    return m.select("user_id", "route_id", F.round("percent", 4).alias("percent"), F.round("alternative_percent", 4).alias("alternative_percent"), km6("longest_km"), "discovered", "medal")


#: Two regions that roads pass, besides their own country; eastwards they have no end, as each road lies east of the one before.
REGIONS = [(1, "AR", -30.0, False, 0.0, -48.9, None), (2, "UY", -19.9, False, 0.0, -60.0, None)]
SCAN = f"""v AS (SELECT trip_id, alat AS lat, alng AS lng FROM trip_edges UNION SELECT trip_id, blat, blng FROM trip_edges), own AS (SELECT DISTINCT trip_id, user_id FROM trip_edges WHERE trip_id % 10 > 0),
said AS (SELECT trip_id, CASE user_id % 4 WHEN 0 THEN 'BR' WHEN 1 THEN 'AR' ELSE 'US' END AS code FROM own WHERE user_id % 4 <> 2),
passed AS (SELECT DISTINCT trip_id, CASE WHEN lng >= -48.9 THEN 'AR' ELSE 'UY' END AS code FROM v WHERE lng >= -48.9 OR lat >= -19.9), code AS (SELECT * FROM said UNION SELECT * FROM passed),
asked AS (SELECT trip_id, code FROM code JOIN own USING (trip_id) WHERE code IN ('BR', 'AR', 'UY') UNION SELECT trip_id, 'BR' FROM own WHERE trip_id NOT IN (SELECT trip_id FROM code)),
spot AS (SELECT *, CASE WHEN place_id % 4 < 2 THEN CASE WHEN place_id % 9 = 0 THEN 10 ELSE 4 END ELSE {RADIUS} END AS radius, CASE WHEN place_id % 4 < 2 THEN 'BR' WHEN place_id % 4 = 2 THEN 'AR' ELSE 'UY' END AS code FROM places),
met AS (SELECT trip_id, place_id, radius, sqrt(power((lng - alng) * 111.32 * greatest(0.01, cos(radians(lat))), 2) + power((lat - greatest(alat, least(blat, lat))) * 111.32, 2)) AS km
  FROM trip_edges JOIN asked USING (trip_id) JOIN spot USING (code) WHERE lat BETWEEN alat - 0.15 AND blat + 0.15 AND lng BETWEEN alng - 0.15 AND alng + 0.15)"""


def city_scan(t: Tables) -> tuple[DataFrame, DataFrame]:
    e, k, u = fx.trip_edges(t), F.col("place_id"), F.col("user_id") % 4
    last = e.groupBy("trip_id").agg(F.max_by(F.struct((F.col("seq") + 1).alias("seq"), F.col("blat").alias("lat"), F.col("blng").alias("lng")), "seq").alias("b")).select("trip_id", "b.*")
    vertices = e.select("trip_id", "seq", F.col("alat").alias("lat"), F.col("alng").alias("lng")).union(last)
    ends = e.select("trip_id", "user_id").distinct().select("trip_id", F.lit(0).alias("ord"), F.when(u == 0, "BR").when(u == 1, "ar").when(u == 3, "US").alias("country_code"))
    trips = e.select("trip_id").distinct().withColumn("mode", F.when(F.col("trip_id") % 10 == 0, "aviao").otherwise("carro"))
    boxes = t.spark.createDataFrame(REGIONS, "priority int, code string, s double, open boolean, n double, w double, e double")
    rings = t.spark.createDataFrame([], "priority int, code string, ring array<struct<lat:double,lng:double>>")
    spots = fx.places(t).withColumns({"country_code": F.when(k % 4 < 2, "BR").when(k % 4 == 2, "AR").otherwise("UY"), "capital": k % 9 == 0})
    return scan.scan_cities(trips, vertices, scan.trip_countries(vertices, ends, boxes, rings), spots)


@query(using("trip_edges", "places", more=SCAN) + "SELECT trip_id, place_id, round(min(km), 6) AS km FROM met WHERE km <= radius GROUP BY ALL")
def q_scan_cities(t: Tables) -> DataFrame:
    """Cities that road trips come near to, in the countries that their ends name or their lines pass."""
    found, _ = city_scan(t)
    return found.select("trip_id", "place_id", km6("km"))


@query(using("trip_edges", "places", more=SCAN) + """SELECT t.trip_id, CASE WHEN user_id IS NULL THEN 'flight' ELSE coalesce(p.parts, '') || CASE WHEN user_id % 4 < 2 THEN '' WHEN p.parts IS NULL THEN 'pending' ELSE '+partial' END END AS source,
user_id IS NULL OR user_id % 4 < 2 AS complete FROM (SELECT DISTINCT trip_id FROM trip_edges) t LEFT JOIN own USING (trip_id)
LEFT JOIN (SELECT trip_id, string_agg('local-' || lower(a.code), '+' ORDER BY CASE WHEN a.code = 'BR' THEN 0 WHEN s.code IS NOT NULL THEN 1 ELSE 2 END, a.place) AS parts
  FROM (SELECT trip_id, code, CASE WHEN code = 'AR' THEN 0 ELSE 1 END AS place FROM asked) a LEFT JOIN said s USING (trip_id, code) GROUP BY trip_id) p USING (trip_id)""")
def q_scan_state(t: Tables) -> DataFrame:
    """Which catalogs a trip's scan has asked, and whether they are all it needs."""
    return city_scan(t)[1]
