"""Further registered queries: catalogs, reports, display, sync views, search results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripspark.functions import display as D
from tripspark.operators import coverage as cov
from tripspark.operators import graph, lines, marts, match, places, roads, sync
from tripspark.operators.rounds import Rounds
from tripspark.operators.sizes import dealt
from tripspark.plans import fixtures as fx
from tripspark.plans.fixtures import using
from tripspark.plans.queries import HITS, MERIDIAN, big, covered, km6, query


@query(using("trips") + """SELECT trip_id, CASE mode WHEN 'carro' THEN 'Carro' WHEN 'moto' THEN 'Moto' WHEN 'bicicleta' THEN 'Bicicleta' ELSE 'Avião' END AS mode, strftime(trip_date, '%d/%m/%Y') AS day,
CASE WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN (m // 60) || ' h' ELSE (m // 60) || ' h ' || (m % 60) || ' min' END AS duration
FROM (SELECT *, trip_id % 5000 AS m FROM trips)""")
def q_display(t):
    return fx.trips(t).select("trip_id", D.mode_label(F.col("mode")).alias("mode"), D.format_date(F.date_format("trip_date", "yyyy-MM-dd")).alias("day"), D.format_duration((F.col("trip_id") % 5000 * 60).cast("double")).alias("duration"))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS id, CASE s_suppkey % 4 WHEN 0 THEN 'INT:AR:RN:' || n WHEN 1 THEN 'INT:PY:PY:' || n WHEN 2 THEN '' ELSE 'INT:UY:RU:' || n END AS ref FROM (SELECT *, s_suppkey % 900 + 1 AS n FROM supplier)""")
def q_references_abroad(t):
    k = F.col("s_suppkey")
    n = (k % 900 + 1).cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("ruta nacional  00"), n)).when(k % 4 == 1, F.concat(F.lit("py"), n)).when(k % 4 == 2, F.concat(F.lit("BR "), n)).otherwise(F.concat(F.lit("Ruta "), n))
    return t.supplier.select(k.cast("long").alias("id"), D.international_ref(raw, F.when(k % 4 == 3, "UY").otherwise("AR")).alias("ref"))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'city ' || s_suppkey || ', SP' WHEN s_suppkey % 3 = 1 THEN 'city ' || s_suppkey || ', TX' ELSE 'a, b' END AS label,
CASE s_suppkey % 4 WHEN 0 THEN 'Hotel' WHEN 1 THEN 'Destino' WHEN 2 THEN 'Local natural' ELSE 'Local' END AS category FROM supplier""")
def q_place_labels(t):
    k = F.col("s_suppkey")
    city = F.when(k % 3 < 2, F.concat(F.lit("city "), k.cast("string")))
    label = D.compact_place_label(city, F.when(k % 3 == 0, "São Paulo").otherwise("tx"), F.when(k % 3 == 0, "BR").otherwise("US"), F.lit(""), F.lit("a, b , c"))
    key, value = F.when(k % 4 == 2, "natural").when(k % 4 < 2, "tourism").otherwise("shop"), F.when(k % 4 == 0, "hotel").otherwise("x")
    return t.supplier.select(k.cast("long").alias("id"), label.alias("label"), D.destination_category(key, value).alias("category"))


SEGMENTS = "seg AS (SELECT trip_id, step_no, label, sum(km) OVER (PARTITION BY trip_id ORDER BY step_no) - km AS start_km, km FROM steps)"


@query(using("steps", more=SEGMENTS) + """, g AS (SELECT *, start_km - lag(start_km + km) OVER (PARTITION BY trip_id, label ORDER BY step_no) AS gap FROM seg WHERE label <> ''),
p AS (SELECT *, sum(CASE WHEN gap < 0.15 THEN 0 ELSE 1 END) OVER (PARTITION BY trip_id, label ORDER BY step_no) AS piece FROM g)
SELECT trip_id, label, CAST(piece AS BIGINT) AS piece, CAST(min(step_no) AS BIGINT) AS first_step, CAST(max(step_no) AS BIGINT) AS last_step, sum(km) AS km FROM p GROUP BY ALL""")
def q_merge_segments(t):
    before = F.coalesce(F.sum("km").over(Window.partitionBy("trip_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = fx.steps(t).withColumn("start_km", before).filter("label <> ''")
    return roads.merge_step_segments(s).select("trip_id", "label", *big("piece", "first_step", "last_step"), "km")


@query(using("conquests") + """, c AS (SELECT user_id AS query_id, place_id AS item_id, min(CAST(place_id % 4 AS DOUBLE)) AS score FROM conquests WHERE place_id % 2 = 0 GROUP BY ALL), p AS (SELECT user_id AS query_id, place_id AS item_id, CAST(place_id % 5 AS DOUBLE) AS score FROM conquests WHERE place_id % 2 = 1 GROUP BY ALL),
b AS (SELECT query_id, 'city' AS kind, item_id, score, CASE WHEN score = 0 THEN 0 ELSE 2 END AS r FROM c UNION ALL SELECT query_id, 'poi', item_id, score, CASE WHEN score = 0 OR item_id % 7 = 0 THEN 1 ELSE 3 END FROM p)
SELECT query_id, kind, item_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, score, kind, item_id) AS pos FROM b) WHERE pos <= 12""")
def q_merge_results(t):
    c = fx.conquests(t).select(F.col("user_id").alias("query_id"), F.col("place_id").alias("item_id"))
    cities = c.filter("item_id % 2 = 0").withColumn("score", (F.col("item_id") % 4).cast("double"))
    pois = c.filter("item_id % 2 = 1").withColumn("score", (F.col("item_id") % 5).cast("double")).withColumn("category_hit", F.col("item_id") % 7 == 0)
    return match.merge_results(cities, pois, rows=t.lineitem.count()).select("query_id", "kind", "item_id", *big("pos"))


@query("""SELECT kind, group_key, n_routes, row_number() OVER (PARTITION BY kind ORDER BY n_routes DESC, group_key) AS pos FROM (
SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'international' WHEN s_suppkey % 3 = 1 THEN 'state' ELSE 'br' END AS kind, CASE WHEN s_suppkey % 5 = 0 THEN 'international' WHEN s_suppkey % 3 = 1 THEN 'S' || (s_suppkey % 7) WHEN s_suppkey % 3 = 2 THEN 'interstate' ELSE 'regional' END AS group_key, count(*) AS n_routes FROM supplier GROUP BY ALL)""")
def q_iconic_groups(t):
    k = F.col("s_suppkey")
    own = F.concat(F.lit("S"), (k % 7).cast("string"))
    states = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(own)).otherwise(F.array(own, F.lit("T")))
    s = t.supplier.select(k.alias("route_id"), F.when(k % 5 == 0, 2).otherwise(1).alias("n_countries"), states.alias("states"))
    return marts.iconic_groups(s).select("kind", "group_key", *big("n_routes", "pos"))


@query(using("trip_edges", "places") + """SELECT DISTINCT trip_id, place_id FROM trip_edges JOIN places ON place_id % 97 = trip_id % 97
WHERE sqrt(power((lng - alng) * 111.32 * greatest(0.01, cos(radians(lat))), 2) + power((lat - greatest(alat, least(blat, lat))) * 111.32, 2)) <= 3""")
def q_route_passes(t):
    e, p = fx.trip_edges(t).withColumn("of", F.col("trip_id") % 97), fx.places(t).withColumn("of", F.col("place_id") % 97)
    return places.route_passes(e, p, on="of")


@query(using("road_vertices") + f"SELECT road_id, count(*) AS n_points, round({MERIDIAN.format('max(lat) - min(lat)')}, 5) AS km FROM (SELECT road_id, lat FROM road_vertices WHERE seq IN (0, 10, 20) UNION ALL SELECT road_id, NULL FROM road_vertices, unnest(range(0, 158)) WHERE seq = 0) GROUP BY ALL")
def q_great_circle(t):
    stops = fx.road_vertices(t).filter("seq % 10 = 0").withColumn("seq", (F.col("seq") / 10).cast("int"))
    stops = dealt(stops, 2 * 81 * t.supplier.count(), "road_id")  # a row becomes 81 where it lies
    m = lines.line_metrics(lines.great_circle_route(stops, ["road_id"]), ["road_id"])
    return m.select("road_id", *big("n_points"), F.round("km", 5).alias("km"))


@query(using("road_vertices") + """, r AS (SELECT printf('%.5f,%.5f', lat, lng) AS node, road_id, seq FROM road_vertices),
e AS (SELECT a.node AS src, b.node AS dst FROM r a JOIN r b ON a.road_id = b.road_id AND b.seq = a.seq + 1) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e""")
def q_graph_edges(t):
    return graph.graph_edges(fx.road_vertices(t), ["road_id"]).select("src", "dst")


@query(using("road_edges", "trip_edges", "places", "conquests", more=HITS) + f""", s AS (SELECT *, seq - row_number() OVER (PARTITION BY user_id, road_id ORDER BY seq) AS g FROM h WHERE hit = 1),
runs AS (SELECT user_id, road_id, min(seq) AS a, max(seq) AS b, count(*) AS n FROM s GROUP BY user_id, road_id, g), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, road_id ORDER BY n DESC, a) AS r FROM runs) WHERE r = 1),
c AS (SELECT DISTINCT user_id, place_id AS road_id FROM conquests), tot AS (SELECT user_id, road_id, sum(hit) AS n FROM h GROUP BY ALL HAVING sum(hit) > 0)
SELECT user_id, road_id, round(tot.n * {MERIDIAN.format('0.009')}, 4) AS traveled_km, CAST(round(tot.n * 5.0, 4) AS DOUBLE) AS percent, best.n IS NOT NULL AS has_run FROM c LEFT JOIN tot USING (user_id, road_id) LEFT JOIN best USING (user_id, road_id)""")
def q_road_report_all(t):
    """The report of all users."""
    # written once, as progress and the ends of runs both come from it
    runs = Rounds(t.spark, "report").write("runs", cov.covered_runs(covered(t), ["user_id", "road_id", "line_id"]))
    p = cov.progress_of(runs, fx.road_edges(t))
    e = fx.road_edges(t)
    first, last = e.select("road_id", "line_id", F.col("seq").alias("first_seq"), "alat", "alng"), e.select("road_id", "line_id", F.col("seq").alias("last_seq"), "blat", "blng")
    runs = runs.join(first, ["road_id", "line_id", "first_seq"]).join(last, ["road_id", "line_id", "last_seq"])
    c = fx.conquests(t).select("user_id", F.col("place_id").alias("road_id")).distinct()
    out = marts.road_report(p, runs, fx.places(t), c)
    return out.select("user_id", "road_id", F.round("traveled_km", 4).alias("traveled_km"), F.round("percent", 4).alias("percent"), F.col("start_place").isNotNull().alias("has_run"))


@query(using("rem") + "SELECT trip_id, content FROM rem WHERE trip_id % 10 = 3 AND deleted_at IS NULL")
def q_visible_rows(t):
    rows = fx.remote(t).withColumn("user_id", F.col("trip_id") % 10)
    cached = rows.select(F.concat(F.lit("cache|"), F.col("trip_id").cast("string")).alias("trip_id"), "content", "updated_at", "deleted_at", "user_id")
    both = rows.withColumn("trip_id", F.col("trip_id").cast("string")).unionByName(cached)
    return sync.visible_rows(both, 3).select(F.col("trip_id").cast("long").alias("trip_id"), "content")


@query(using("trips") + "SELECT trip_id FROM trips WHERE trip_id % 2 = 0 AND trip_date > DATE '1998-06-01' - INTERVAL 30 DAY")
def q_fresh_entries(t):
    c = fx.trips(t).select("trip_id", F.when(F.col("trip_id") % 2 == 0, "v2").otherwise("v1").alias("version"), F.col("trip_date").cast("timestamp").alias("saved_at"))
    return sync.fresh_entries(c, "v2", F.lit("1998-06-01 00:00:00").cast("timestamp")).select("trip_id")


@query(using("places") + "SELECT country AS route_id, arg_min(place_id, (population % 5, place_id)) AS source FROM places WHERE population % 7 >= 2 GROUP BY ALL")
def q_pick_geometry(t):
    c = fx.places(t).select(F.col("country").alias("route_id"), F.col("place_id").alias("source"), (F.col("population") % 5).alias("priority"), (F.col("population") % 7).alias("n_points"))
    return graph.pick_geometry(c).select("route_id", "source")


@query(using("steps") + "SELECT trip_id, step_no AS ord, row_number() OVER (PARTITION BY trip_id ORDER BY floor(km / 10), CASE WHEN label <> '' THEN 0 ELSE 1 END, step_no) AS pos FROM steps")
def q_order_points(t):
    p = fx.steps(t).select("trip_id", F.col("step_no").alias("ord"), F.floor(F.col("km") / 10).cast("double").alias("progress"), F.when(F.col("label") != "", "stop").otherwise("via").alias("kind"))
    return roads.order_route_points(p).select("trip_id", *big("ord", "pos"))


@query(using("places") + "SELECT count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS points_before, CAST(sum(least(n, 5)) AS BIGINT) AS points_after, count(CASE WHEN n > 5 THEN 1 END) AS n_compacted FROM (SELECT place_id % 211 AS l, count(*) AS n FROM places GROUP BY ALL)")
def q_compaction_stats(t):
    v = fx.places(t).select((F.col("place_id") % 211).alias("line_id"), F.col("place_id").alias("seq"), "lat", "lng")
    size = lambda d: d.groupBy("line_id").agg(F.count("*").alias("n_points"))
    return marts.compaction_stats(size(v), size(lines.sample_evenly(v, ["line_id"], 5))).select(*big("n_lines", "points_before", "points_after", "n_compacted"))


@query()
def q_simplify_lines(t):
    """Lines through places, simplified at 1000 m: a fold that SQL has no form for; tests hold it."""
    v = fx.places(t).select((F.col("place_id") % 100).alias("line_id"), F.struct("place_id", "lat", "lng").alias("p"))
    ordered = v.groupBy("line_id").agg(F.array_sort(F.collect_list("p")).alias("ps")).select("line_id", F.transform("ps", lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))).alias("coords"))
    return lines.simplify_lines(ordered, 1000.0).select("line_id", F.size("coords").alias("n_points"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, '{"price":' || o_custkey || CASE WHEN o_custkey % 2 = 0 THEN ',"note":"' || o_orderstatus || '"' ELSE '' END || '}' AS start, '[{"stop":' || o_custkey || '}]' AS legs FROM orders""")
def q_strip_for_cloud(t):
    nested = t.orders.select(
        F.col("o_orderkey").alias("trip_id"), F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderkey").cast("string")).alias("id"), F.lit(True).alias("visible"),
        F.struct(F.col("o_custkey").alias("price"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("note"), F.col("o_orderpriority").alias("media")).alias("start"),
        F.array(F.struct(F.col("o_custkey").alias("stop"), F.array("o_orderpriority").alias("photos"))).alias("legs"),
    )
    return sync.strip_for_cloud(nested).select("id", F.to_json("start").alias("start"), F.to_json("legs").alias("legs"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS trip_id, 'v2|' || CASE o_orderkey % 3 WHEN 0 THEN 'poly:' || length(o_orderpriority) || ':' || sha256(o_orderpriority)
WHEN 1 THEN 'geo:2:' || sha256('[' || o_custkey || ',' || (o_custkey + 1) || ']') ELSE 'none' END || '|' || CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS signature FROM orders""")
def q_route_signature(t):
    k = F.col("o_orderkey") % 3
    coordinates = F.when(k == 1, F.array(F.col("o_custkey"), F.col("o_custkey") + 1))
    updated = [F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).otherwise(""), F.col("o_orderpriority")]
    return t.orders.select(F.col("o_orderkey").cast("long").alias("trip_id"), sync.route_signature("v2", F.when(k == 0, F.col("o_orderpriority")), coordinates, updated).alias("signature"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS trip_id, CASE WHEN o_orderkey % 4 = 3 THEN 'BR-' || o_custkey WHEN o_orderkey % 3 = 0 THEN 'INT:UY:RU:' || o_custkey
WHEN o_orderkey % 3 = 1 THEN 'INT:AR:RN:' || o_custkey ELSE 'int:ar:rn:' || o_custkey END AS label FROM orders""")
def q_reclassify_label(t):
    k, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    label = F.when(k % 4 == 3, F.concat(F.lit(" BR-"), n)).otherwise(F.concat(F.lit("int:ar:rn:"), n))
    return t.orders.select(k.cast("long").alias("trip_id"), D.reclassify_label(label, F.when(k % 3 == 0, "UY").when(k % 3 == 1, "AR")).alias("label"))


ROUTES = "CASE p_partkey % 5 WHEN 0 THEN 'Estrada Real ' WHEN 1 THEN 'Caminho ' WHEN 2 THEN 'Estrada-Parque ' ELSE '' END || p_name"


@query(f"""SELECT route_id, priority, row_number() OVER (PARTITION BY brand, priority ORDER BY lower(replace(name, '-', ' ')), route_id) AS pos FROM (SELECT CAST(p_partkey AS BIGINT) AS route_id, p_brand AS brand, {ROUTES} || ' ' AS name,
CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 3 END AS priority FROM part)""")
def q_family_priority(t):
    k = F.col("p_partkey") % 5
    start = F.when(k == 0, "Estrada Real ").when(k == 1, "Caminho ").when(k == 2, "Estrada-Parque ").otherwise("")
    routes = t.part.select(F.col("p_partkey").cast("long").alias("route_id"), F.col("p_brand").alias("brand"), F.concat(start, "p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("family"), F.when(k == 3, "Rota histórica").alias("category"))
    return marts.family_priority_sort(routes.withColumn("p", marts.family_priority(F.col("name"), F.col("family"), F.col("category"))), ["brand", "p"]).select("route_id", "priority", "pos")
