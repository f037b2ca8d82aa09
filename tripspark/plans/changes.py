"""Registered queries over tables that change, and over regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark import streaming
from tripspark.functions import regions as outlines
from tripspark.operators import regions, review
from tripspark.operators.sizes import PART_ROWS
from tripspark.plans import fixtures as fx
from tripspark.plans.fixtures import Tables, using
from tripspark.plans.queries import MERIDIAN, km6, query
from tripspark.sources.shared import new_path

def _matched(trips: str, roads: str) -> str:
    """Trips drive along a road's edges, edge for edge; those 0 degrees beside it match them, and two edges are over 2 km."""
    return f"SELECT t.road_id, t.trip_id, count(*) AS n FROM {trips} t JOIN {roads} r ON r.road_id = t.road_id AND r.seq = t.user_id % 11 + t.seq WHERE t.user_id % 5 = 0 GROUP BY ALL HAVING count(*) >= 2"


@query(using("road_edges", "trip_edges", more=f"""t0 AS (SELECT * FROM trip_edges WHERE trip_id % 5 <> 0 AND (trip_id % 7 <> 0 OR seq <= 1)), t1 AS (SELECT * FROM trip_edges WHERE trip_id % 11 <> 0),
r0 AS (SELECT * FROM road_edges WHERE road_id % 3 <> 0 OR seq < 12), m0 AS ({_matched('t0', 'r0')}), m1 AS ({_matched('t1', 'road_edges')})""") + f"""
SELECT m1.road_id, m1.trip_id, round(m1.n * {MERIDIAN.format('0.009')}, 6) AS km, m0.n IS NULL AS added FROM m1 LEFT JOIN m0 USING (road_id, trip_id)""")
def q_review_trips(t: Tables) -> DataFrame:
    """Conquests after a second review: trips came, went and changed since the first, and roads grew."""
    trips, roads = fx.trip_edges(t).drop("road_id", "user_id"), fx.road_edges(t)
    first = review.review_trips(roads.filter("road_id % 3 <> 0 or seq < 12"), trips.filter("trip_id % 5 <> 0 and (trip_id % 7 <> 0 or seq <= 1)"))
    first = review.written(first, new_path(t.spark, "review"))
    now = review.review_trips(roads, trips.filter("trip_id % 11 <> 0"), first)
    added = now.added.select("road_id", "trip_id", F.lit(True).alias("added"))
    return now.conquests.join(added, ["road_id", "trip_id"], "left").select("road_id", "trip_id", km6("km"), F.coalesce("added", F.lit(False)).alias("added"))


def order_changes(t: Tables) -> DataFrame:
    """Changes of trips of a user's roads, several to a trip, some of them withdrawals."""
    c = fx.conquests(t).select("user_id", F.col("item").alias("item_key"), "trip_id", F.datediff("trip_date", F.lit("1992-01-01").cast("date")).cast("long").alias("day"), "place_id")
    return c.select("user_id", "item_key", "trip_id", (F.col("day") + F.col("place_id") % 3).alias("trip_date"), (F.col("place_id") * 31 % 1000).alias("updated_at"), (F.col("place_id") % 4 == 0).alias("deleted"))


ORDER_CHANGES = "SELECT user_id, item AS item_key, trip_id, CAST(date_diff('day', DATE '1992-01-01', CAST(trip_date AS DATE)) + place_id % 3 AS BIGINT) AS trip_date, place_id * 31 % 1000 AS updated_at, place_id % 4 = 0 AS deleted FROM conquests"


def streamed(t: Tables, changes: DataFrame, name: str) -> tuple[DataFrame, str]:
    """changes as a stream of files, a few batches of them, and a new folder for what a stream keeps."""
    path = new_path(t.spark, name)
    files = 2 * -(-t.lineitem.count() // (24 * PART_ROWS))  # of a batch, by a row or none for each line
    changes.repartition(3 * files, F.xxhash64(*changes.columns)).write.parquet(f"{path}/in")
    return streaming.read_changes(t.spark, f"{path}/in", changes.schema, files), path


@query(using("conquests", more=f"c AS ({ORDER_CHANGES})") + """, l AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_key, trip_id ORDER BY updated_at DESC, deleted DESC, trip_date DESC) AS n FROM c)
SELECT user_id, item_key, arg_min(trip_id, (trip_date, trip_id)) AS trip_id, min(trip_date) AS trip_date FROM l WHERE n = 1 AND NOT deleted GROUP BY ALL""")
def q_stream_first_conquests(t: Tables) -> DataFrame:
    """First conquests that a stream keeps, whose changes come in no order."""
    changes, path = streamed(t, order_changes(t), "first")
    stream = streaming.stream_first_conquests(changes, f"{path}/table", f"{path}/cp", ["user_id", "item_key"], buckets=8)
    stream.trigger(availableNow=True).start().awaitTermination()
    return streaming.read_table(t.spark, f"{path}/table").select("user_id", "item_key", "trip_id", "trip_date")


@query(using("conquests", more=f"c AS ({ORDER_CHANGES})") + """SELECT user_id, item_key, max(updated_at * 10000000 + trip_id) // 10000000 AS updated_at, max(updated_at * 10000000 + trip_id) % 10000000 AS trip_id FROM c GROUP BY ALL""")
def q_stream_upserts(t: Tables) -> DataFrame:
    """Each key's last change, as a keyed table leaves it after batches in no order."""
    rows = order_changes(t).select("user_id", "item_key", "trip_id", (F.col("updated_at") * 10_000_000 + F.col("trip_id")).alias("at")).distinct()
    changes, path = streamed(t, rows, "upserts")
    stream = streaming.stream_upserts(changes, f"{path}/table", f"{path}/cp", ["user_id", "item_key"], "at", 8)
    stream.trigger(availableNow=True).start().awaitTermination()
    return streaming.read_table(t.spark, f"{path}/table").select("user_id", "item_key", F.floor(F.col("at") / 10_000_000).alias("updated_at"), "trip_id")


def spots(t: Tables) -> DataFrame:
    """A place in the Americas or beside them for each customer."""
    k = F.col("c_custkey").cast("long")
    return t.customer.select(k.alias("point_id"), (k * 7919 % 130000 / F.lit(1e3) - F.lit(56.5)).alias("lat"), (k * 104729 % 140000 / F.lit(1e3) - F.lit(171.0)).alias("lng"))


def _region_sql() -> str:
    ring = ", ".join(f"({p}, '{c}', {y}e0, {x}e0, {r[k - 1][0]}e0, {r[k - 1][1]}e0)" for p, c, r in outlines.rings() for k, (y, x) in enumerate(r))
    box = ", ".join(f"({p}, '{c}', {s}e0, {o}, {n}e0, {w}e0, {e}e0)" for p, c, s, o, n, w, e in outlines.boxes())
    return f"""spots AS (SELECT CAST(c_custkey AS BIGINT) AS point_id, CAST(c_custkey AS BIGINT) * 7919 % 130000 / 1e3 - 56.5e0 AS lat, CAST(c_custkey AS BIGINT) * 104729 % 140000 / 1e3 - 171e0 AS lng FROM customer),
ring(p, code, y, x, v, u) AS (VALUES {ring}), box(p, code, s, o, n, w, e) AS (VALUES {box}),
hit AS (SELECT point_id, p, code FROM spots JOIN ring ON (y > lat) <> (v > lat) AND lng < (u - x) * (lat - y) / (v - y) + x GROUP BY ALL HAVING count(*) % 2 = 1
  UNION ALL SELECT point_id, p, code FROM spots JOIN box ON (CASE WHEN o THEN lat > s ELSE lat >= s END) AND lat <= n AND lng BETWEEN w AND e),
region AS (SELECT point_id, arg_min(code, p) AS code FROM spots LEFT JOIN hit USING (point_id) GROUP BY ALL)"""


@query(f"WITH {_region_sql()} SELECT point_id, code FROM region")
def q_point_region(t: Tables) -> DataFrame:
    return regions.point_region(spots(t), *regions.outline_tables(t.spark))


@query(f"""WITH {_region_sql()} SELECT point_id, CASE WHEN point_id % 3 = 2 THEN 'BR-' || point_id WHEN code = 'UY' THEN 'INT:UY:RU:' || point_id WHEN code = 'AR' THEN 'INT:AR:RN:' || point_id
WHEN point_id % 3 = 0 THEN 'INT:AR:RN:' || point_id ELSE 'INT:UY:RU:' || point_id END AS label FROM region""")
def q_reclassify_badges(t: Tables) -> DataFrame:
    k = F.col("point_id")
    kind = F.when(k % 3 == 0, "INT:AR:RN:").when(k % 3 == 1, "INT:UY:RU:").otherwise("BR-")
    badges = spots(t).withColumn("label", F.concat(kind, k.cast("string")))
    return regions.reclassify_badges(badges, *regions.outline_tables(t.spark)).select("point_id", "label")
