"""Registered queries of curated routes, of routes put together from parts, and of groups."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.functions import text as X
from tripspark.functions.geo import DEGREE_KM
from tripspark.operators import catalog, groups, lines, scan_modes
from tripspark.operators.sizes import dealt
from tripspark.plans import fixtures as fx
from tripspark.plans.fixtures import Tables, using
from tripspark.plans.queries import STATE_LIST, areas, query

#: Places in a line, tolerances, vertices of a line and bytes of a bundle in the query of curated routes.
IN_LINE, LADDER, MOST, BYTES = 50, (500.0, 3000.0, 9000.0, 30000.0), 24, 1200


def curated_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Routes of two lines of 50 places each, some disabled; four routes make a bundle."""
    line, k = F.floor(F.col("place_id") / IN_LINE), F.col("route_id")
    v = fx.places(t).select(F.floor(line / 2).alias("route_id"), F.when(line % 3 == 0, "alternative").otherwise("official").alias("role"), line.alias("line_no"), F.col("place_id").alias("seq"), "lat", "lng")
    routes = v.select("route_id").distinct().select(
        "route_id", (k % 7 == 3).alias("disabled"), F.when(k % 3 > 0, k + 0.5).alias("total_km"), F.lit(None).cast("double").alias("alternate_km"), F.floor(k / 4).alias("bundle_no"),
        F.when(k % 5 == 4, F.struct(F.lit(-21.5).alias("s"), F.lit(-49.5).alias("w"), F.lit(-19.5).alias("n"), F.lit(-28.5).alias("e"))).alias("bounds"))
    return routes, v


def _steps(c: str) -> str:
    """An integer step as polyline characters."""
    z = f"(CASE WHEN {c} < 0 THEN -2 * {c} - 1 ELSE 2 * {c} END)"
    n = f"(CASE WHEN {z} < 32 THEN 1 WHEN {z} < 1024 THEN 2 WHEN {z} < 32768 THEN 3 WHEN {z} < 1048576 THEN 4 WHEN {z} < 33554432 THEN 5 ELSE 6 END)"
    return f"array_to_string([chr(CAST((({z} >> (5 * k)) & 31) + CASE WHEN k < {n} - 1 THEN 95 ELSE 63 END AS INTEGER)) for k in range(0, {n})], '')"


CURATED = using("places").replace("WITH ", "WITH RECURSIVE ", 1) + f""", v AS (SELECT place_id // {IN_LINE} AS line, place_id AS seq, lat, lng, lng * 111320e0 * cos(radians(avg(lat) OVER w)) AS x, lat * 110540e0 AS y, count(*) OVER w AS n FROM places WINDOW w AS (PARTITION BY place_id // {IN_LINE})),
piece(line, a, b, weight, seq) AS (SELECT line, min(seq), max(seq), CAST('inf' AS DOUBLE), CAST(NULL AS BIGINT) FROM v WHERE n >= 2 GROUP BY line
  UNION ALL SELECT line, CASE k WHEN 0 THEN a ELSE m END, CASE k WHEN 0 THEN m ELSE b END, weight, CASE k WHEN 0 THEN m END FROM
    (SELECT line, a, b, arg_max(seq, (d, -seq)) AS m, least(weight, max(d)) AS weight FROM
      (SELECT *, sqrt(power(px - t * dx, 2) + power(py - t * dy, 2)) AS d FROM (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) END AS t FROM
        (SELECT g.line, g.a, g.b, g.weight, c.seq, q.x - p.x AS dx, q.y - p.y AS dy, c.x - p.x AS px, c.y - p.y AS py FROM piece g JOIN v p ON p.line = g.line AND p.seq = g.a JOIN v q ON q.line = g.line AND q.seq = g.b
          JOIN v c ON c.line = g.line AND c.seq > g.a AND c.seq < g.b))) GROUP BY line, a, b, weight), (VALUES (0), (1)) AS two(k) WHERE weight > {LADDER[0]}e0),
weighed AS (SELECT line, seq, weight FROM piece WHERE seq IS NOT NULL UNION ALL SELECT line, unnest([a, b]), weight FROM piece WHERE isinf(weight)),
held AS (SELECT line, tol, seq, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY line, tol) AS n FROM weighed, (VALUES {", ".join(f"({x}e0)" for x in LADDER)}) AS r(tol) WHERE weight > tol WINDOW w AS (PARTITION BY line, tol ORDER BY seq)),
even AS (SELECT h.line, h.tol, h.seq FROM held h WHERE n <= {MOST} OR i IN (SELECT CAST(floor(k * (h.n - 1) / {MOST - 1}.0 + 0.5) AS BIGINT) FROM unnest(range(0, {MOST})) AS r(k))),
step AS (SELECT e.line, e.tol, e.seq, v.n, v.lat, v.lng, CAST(round(v.lat * 1e5) AS BIGINT) - coalesce(lag(CAST(round(v.lat * 1e5) AS BIGINT)) OVER w, 0) AS dy, CAST(round(v.lng * 1e5) AS BIGINT) - coalesce(lag(CAST(round(v.lng * 1e5) AS BIGINT)) OVER w, 0) AS dx
  FROM even e JOIN v USING (line, seq) WINDOW w AS (PARTITION BY e.line, e.tol ORDER BY e.seq)),
enc AS (SELECT line, tol, any_value(n) AS n_source, count(*) AS n_points, min(lat) AS s, min(lng) AS w, max(lat) AS n, max(lng) AS e, string_agg({_steps('dy')} || {_steps('dx')}, '' ORDER BY seq) AS encoded FROM step GROUP BY ALL),
doc AS (SELECT line // 2 AS route_id, tol, coalesce(list(encoded ORDER BY line) FILTER (line % 3 <> 0), []) AS official, coalesce(list(encoded ORDER BY line) FILTER (line % 3 = 0), []) AS alternative, sum(n_source) AS source_points, sum(n_points) AS points,
  min(s) AS s, min(w) AS w, max(n) AS n, max(e) AS e FROM enc WHERE (line // 2) % 7 <> 3 GROUP BY ALL HAVING count(*) FILTER (line % 3 <> 0) > 0),
boxed AS (SELECT * REPLACE (CASE WHEN route_id % 5 = 4 THEN -21.5e0 ELSE s END AS s, CASE WHEN route_id % 5 = 4 THEN -49.5e0 ELSE w END AS w, CASE WHEN route_id % 5 = 4 THEN -19.5e0 ELSE n END AS n, CASE WHEN route_id % 5 = 4 THEN -28.5e0 ELSE e END AS e),
  CASE WHEN route_id % 3 > 0 THEN route_id + 0.5e0 END AS total_km FROM doc),
sized AS (SELECT *, strlen(CAST(to_json({{precision: 5, id: route_id, encodedLines: official, alternateEncodedLines: alternative, totalKm: total_km, alternateTotalKm: NULL, bounds: [[s, w], [n, e]]}}) AS VARCHAR)) AS bytes FROM boxed),
sums AS (SELECT route_id // 4 AS bundle, tol, sum(bytes) AS bytes FROM sized GROUP BY ALL),
choice AS (SELECT bundle, coalesce(min(tol) FILTER (bytes <= {BYTES}), max(tol)) AS tol, count(*) FILTER (bytes <= {BYTES}) > 0 AS fits FROM sums GROUP BY ALL)
SELECT route_id, bundle, tol AS tolerance_m, fits, array_to_string(official, ' ') AS encoded_lines, array_to_string(alternative, ' ') AS alternate_lines, total_km, s, w, n, e, CAST(source_points AS BIGINT) AS source_points, CAST(points AS BIGINT) AS points, CAST(bytes AS BIGINT) AS bytes
FROM sized JOIN choice USING (tol) WHERE bundle = route_id // 4"""


@query(CURATED)
def q_curated_catalog(t: Tables) -> DataFrame:
    """Documents of curated routes, each bundle at the least tolerance that meets its bytes."""
    docs, _ = catalog.curated_catalog(*curated_inputs(t), "bundle_no", BYTES, LADDER, MOST)
    return docs.select("route_id", "bundle", "tolerance_m", "fits", F.array_join("encoded_lines", " ").alias("encoded_lines"), F.array_join("alternate_lines", " ").alias("alternate_lines"), "total_km", "bounds.*", "source_points", "points", "bytes")


PARTS = """, part AS (SELECT trip_id, seq AS part, 0 AS seq, CASE WHEN (trip_id + seq) % 3 = 0 THEN alng ELSE alat END AS lat, alng AS lng FROM trip_edges UNION ALL SELECT trip_id, seq, 1, blat, blng FROM trip_edges),
u AS (SELECT *, lag(part) OVER w AS p, lag(lat) OVER w AS y, lag(lng) OVER w AS x FROM part WINDOW w AS (PARTITION BY trip_id ORDER BY part, seq))
SELECT trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY part, seq) - 1 AS seq, lat, lng FROM u WHERE p IS NULL OR p = part OR y <> lat OR x <> lng"""


@query(using("trip_edges") + PARTS)
def q_merge_route_lines(t: Tables) -> DataFrame:
    """Trips whose parts are their edges, some of which do not begin where the one before ends."""
    e = fx.trip_edges(t)
    apart = (F.col("trip_id") + F.col("seq")) % 3 == 0
    ends = F.array(F.struct(F.lit(0).alias("seq"), F.when(apart, F.col("alng")).otherwise(F.col("alat")).alias("lat"), F.col("alng").alias("lng")), F.struct(F.lit(1).alias("seq"), F.col("blat").alias("lat"), F.col("blng").alias("lng")))
    v = e.select("trip_id", F.col("seq").alias("part"), F.explode(ends).alias("p")).select("trip_id", "part", "p.*")
    return lines.merge_route_lines(v, ["trip_id"]).select("trip_id", F.col("seq").cast("long").alias("seq"), "lat", "lng")


GROUPS = """r AS (SELECT CAST(p_partkey AS BIGINT) AS k, CASE p_partkey % 5 WHEN 0 THEN 'estrada real ' WHEN 1 THEN 'caminho ' WHEN 2 THEN 'estrada parque ' ELSE '' END || lower(p_name) AS name, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 3 END AS priority,
  CASE WHEN p_partkey % 6 = 1 OR p_partkey % 8 = 7 THEN 'international' WHEN p_partkey % 6 = 0 THEN 'br' ELSE 'state' END AS kind,
  list_sort(list_distinct(list_concat(CASE p_partkey % 6 WHEN 2 THEN ['SP'] WHEN 4 THEN ['MG'] WHEN 5 THEN ['MG', 'SP'] ELSE [] END, CASE WHEN p_partkey % 4 = 1 THEN ['BA'] WHEN p_partkey % 4 = 2 THEN ['SP'] WHEN p_partkey % 8 = 3 THEN ['GO'] ELSE [] END))) AS states FROM part),
g AS (SELECT *, CASE WHEN kind <> 'state' THEN upper(kind) WHEN len(states) = 1 THEN states[1] WHEN len(states) > 1 THEN 'INTERSTATE' ELSE 'REGIONAL' END AS group_key FROM r),
z AS (SELECT kind, group_key, row_number() OVER (PARTITION BY kind ORDER BY n DESC, CASE group_key WHEN 'SP' THEN 'sao paulo' WHEN 'MG' THEN 'minas gerais' WHEN 'BA' THEN 'bahia' WHEN 'GO' THEN 'goias' WHEN 'INTERSTATE' THEN 'interestaduais' WHEN 'REGIONAL' THEN 'regionais' ELSE group_key END) AS group_pos FROM (SELECT kind, group_key, count(*) AS n FROM g GROUP BY ALL))"""


@query(f"WITH {GROUPS} SELECT k AS route_id, kind, group_key, group_pos, row_number() OVER (PARTITION BY kind, group_key ORDER BY priority, name, k) AS pos FROM g JOIN z USING (kind, group_key)")
def q_route_groups(t: Tables) -> DataFrame:
    """Routes by kind and state, of their references and regions."""
    k = F.col("p_partkey")
    refs = lambda *x: F.array(*[F.lit(i) for i in x])
    road = F.when(k % 6 == 0, refs("SP-1", "br-116")).when(k % 6 == 1, refs("INT:AR:RN:3")).when(k % 6 == 2, F.array(F.concat(F.lit("sp-"), (k % 300).cast("string")))).when(k % 6 == 4, refs("LMG-808", "XX-1")).when(k % 6 == 5, refs("SP-10", "MG-20"))
    region = F.when(k % 4 == 1, "Sertão da Bahia").when(k % 4 == 2, "Serra / São Paulo").when(k % 8 == 7, "Patagônia, Argentina").when(k % 8 == 3, "GO")
    name = F.concat(F.when(k % 5 == 0, "Estrada Real ").when(k % 5 == 1, "Caminho ").when(k % 5 == 2, "Estrada-Parque ").otherwise(""), F.col("p_name"), F.lit(" "), k.cast("string"))
    routes = t.part.select(k.cast("long").alias("route_id"), name.alias("name"), F.lit(None).cast("string").alias("family"), F.when(k % 5 == 3, "Rota histórica").alias("category"), region.alias("region"), road.alias("road_refs"))
    out = groups.group_routes(routes)
    return out.select("route_id", "kind", "group_key", F.col("group_pos").cast("long").alias("group_pos"), F.col("pos").cast("long").alias("pos"))


_PLAIN = "[" + ", ".join("'" + unicodedata.normalize("NFD", n).encode("ascii", "ignore").decode().lower() + "'" for n in X.STATES.values()) + "]"


@query(f"""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS city_id, c_mktsegment AS user_id, n_nationkey % 3 > 0 AS abroad, CASE n_nationkey % 3 WHEN 0 THEN 'BR-' || ({STATE_LIST})[CAST(c_custkey % 27 + 1 AS BIGINT)] WHEN 1 THEN 'COUNTRY-PE' ELSE 'COUNTRY-' || regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') END AS group_key,
  CASE WHEN n_nationkey % 3 = 0 THEN ({_PLAIN})[CAST(c_custkey % 27 + 1 AS BIGINT)] END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT city_id, user_id, group_key, dense_rank() OVER (PARTITION BY user_id ORDER BY abroad, coalesce(state, lower(replace(group_key, '-', ' ')))) AS group_pos, row_number() OVER (PARTITION BY user_id, group_key ORDER BY city_id) AS pos FROM c""")
def q_ordered_city_groups(t: Tables) -> DataFrame:
    """Cities whose names end in numbers, by state and country."""
    at = (F.col("c_custkey") % 27 + 1).cast("int")
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    cities = c.select(
        F.col("c_custkey").cast("long").alias("city_id"), F.col("c_mktsegment").alias("user_id"), F.concat(F.lit("Cidade "), F.col("c_custkey").cast("string")).alias("city"), F.lit("").alias("label"), F.lit("").alias("country_code"),
        F.element_at(F.array(*[F.lit(n) for n in X.STATES.values()]), at).alias("region"), F.when(F.col("n_nationkey") % 3 == 0, "Brasil").when(F.col("n_nationkey") % 3 == 1, "Perú").otherwise(F.col("n_name")).alias("country"))
    return groups.ordered_city_groups(cities).select("city_id", "user_id", "group_key", F.col("group_pos").cast("long").alias("group_pos"), F.col("pos").cast("long").alias("pos"))


@query(using("conquests") + """, w AS (SELECT user_id, 'city ' || place_id % 50 AS item_key, min((trip_date, trip_id, place_id)) AS f FROM conquests WHERE trip_id % 7 <> 0 GROUP BY ALL),
o AS (SELECT trip_id, place_id % 50 AS c, min(place_id) AS p FROM conquests GROUP BY ALL)
SELECT user_id, item_key, CASE WHEN f[3] % 3 > 0 THEN CAST(f[3] AS DOUBLE) ELSE p / 4e0 END AS lat, CAST(f[3] AS DOUBLE) / 2 AS lng, f[2] AS trip_id, 'Trip ' || f[2] AS trip_name FROM w JOIN o ON o.trip_id = f[2] AND c = f[3] % 50""")
def q_city_snapshot(t: Tables) -> DataFrame:
    """First conquests of cities, a third of which take their latitude from a place of the trip."""
    n, p = t.lineitem.count(), F.col("place_id")
    c = fx.conquests(t).drop("item")
    city = F.concat(F.lit("City "), (p % 50).cast("string"))
    won = dealt(c, n, "user_id").select("user_id", "trip_id", F.concat(F.lit("Trip "), F.col("trip_id").cast("string")).alias("trip_name"), "trip_date", p.alias("pos"), F.when(p % 2 == 0, city).otherwise("").alias("label"), city.alias("city"), F.when(p % 3 > 0, p.cast("double")).alias("lat"), (p / F.lit(2.0)).alias("lng"))
    none = F.lit(None).cast("string")
    places = c.select("trip_id", p.alias("pos"), F.when(p % 4 == 1, F.upper(city)).alias("label"), F.when(p % 4 != 1, city).alias("city"), none.alias("region"), none.alias("country"), (p / F.lit(4.0)).alias("lat"), F.lit(0.0).alias("lng")).distinct()
    return groups.city_snapshot(won, places, dealt(c.filter("trip_id % 7 = 0").select("user_id", "trip_id"), n, "user_id").distinct()).select("user_id", "item_key", "lat", "lng", "trip_id", "trip_name")


@query(using("conquests") + f"""SELECT user_id, count(DISTINCT CASE WHEN s_nationkey % 3 < 2 THEN place_id % 27 END) AS n_states, count(DISTINCT CASE WHEN s_nationkey % 3 > 0 THEN s_nationkey END) + max(CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE 0 END) AS n_countries FROM conquests JOIN supplier ON s_suppkey = place_id GROUP BY ALL""")
def q_profile_places(t: Tables) -> DataFrame:
    k, nation = F.col("place_id"), F.col("s_nationkey")
    c = fx.conquests(t).join(t.supplier, F.col("s_suppkey") == k)
    region = F.element_at(F.array(*[F.lit(n) for n in X.STATES.values()]), (k % 27 + 1).cast("int"))
    places = c.select("user_id", F.when(k % 2 == 0, F.upper(region)).otherwise(region).alias("region"), F.when(nation % 3 == 0, "br").when(nation % 3 == 2, nation.cast("string")).otherwise("").alias("country_code"), F.when(nation % 3 == 1, F.concat(F.lit("Brasil "), nation.cast("string"))).otherwise("x").alias("country"))
    return groups.profile_places(places).select("user_id", F.col("n_states").cast("long").alias("n_states"), F.col("n_countries").cast("long").alias("n_countries"))


@query(using("conquests") + """, c AS (SELECT DISTINCT place_id AS road_id FROM conquests WHERE trip_id % 4 <> 0), q AS (SELECT CAST(s_suppkey * 3 AS BIGINT) AS road_id FROM supplier),
j AS (SELECT coalesce(c.road_id, q.road_id) AS road_id, c.road_id IS NOT NULL AS won, q.road_id IS NOT NULL AS waits FROM c FULL JOIN q ON c.road_id = q.road_id)
SELECT road_id, CASE WHEN NOT won OR road_id % 4 = 2 THEN 'dropped' WHEN waits THEN 'kept' ELSE 'added' END AS action, CASE WHEN NOT won THEN 'orphan' WHEN road_id % 4 = 2 THEN 'complete' ELSE 'pending' END AS reason FROM j WHERE NOT won OR waits OR road_id % 4 <> 2""")
def q_audit_queue(t: Tables) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    catalog = t.supplier.filter(k % 4 != 3).select(k.alias("road_id"), (k % 4 == 2).alias("validated"))
    return groups.audit_queue(fx.conquests(t).filter("trip_id % 4 <> 0").select(F.col("place_id").alias("road_id")), catalog, t.supplier.select((k * 3).alias("road_id")))


AREAS = "a AS (SELECT CAST(n_nationkey AS BIGINT) AS area_id, (n_nationkey * 600 - 1999870) / 1e5 AS s, (n_nationkey * 600 - 1998530) / 1e5 AS n, (n_nationkey * 4000 - 4900510) / 1e5 AS w, (n_nationkey * 4000 - 4896730) / 1e5 AS e FROM nation)"


@query(using("trip_edges", "places", more=f"""{AREAS}, c AS (SELECT *, seq // 3 AS chunk FROM trip_edges), hit AS (SELECT DISTINCT trip_id, chunk, area_id FROM c JOIN a ON alng BETWEEN w AND e AND blat >= s AND alat <= n),
bare AS (SELECT * FROM c ANTI JOIN hit USING (trip_id, chunk)), p AS (SELECT place_id, lat, lng, CASE feature_code WHEN 'PPLC' THEN 2.5e0 WHEN 'PPLA' THEN 1.5e0 ELSE 0.75e0 END AS radius FROM places WHERE feature_code <> 'PPLX')""")
    + f"""SELECT DISTINCT trip_id, 'admin' AS via, area_id AS city_id FROM hit UNION ALL SELECT DISTINCT trip_id, 'place', place_id FROM bare JOIN p ON lng BETWEEN alng - 0.1 AND alng + 0.1
WHERE {DEGREE_KM!r} * sqrt(power((lng - alng) * cos(radians(lat)), 2) + power(lat - greatest(alat, least(blat, lat)), 2)) <= radius""")
def q_scan_outlines(t: Tables) -> DataFrame:
    """Municipalities that trips cross, and places near the chunks that meet none."""
    kind = F.when(F.col("feature_code") == "PPLC", "city").when(F.col("feature_code") == "PPLA", "town").when(F.col("feature_code") == "PPL", "village")
    return scan_modes.scan_outlines(fx.trip_edges(t).withColumn("chunk", F.floor(F.col("seq") / 3)), areas(t), fx.places(t).withColumn("kind", kind))
