"""Trips, roads, places, steps and sync tables derived from the business tables, in Spark and as SQL.

Coordinates are whole numbers of 1e-5 degrees divided by 1e5, so that every engine has the same doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.operators.sizes import dealt

ROAD_EDGES = 20


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def n_suppliers(t: Tables) -> int:
    return t.supplier.count()


def road_edges(t: Tables) -> DataFrame:
    """One road on a meridian for each supplier, ROAD_EDGES edges of 0.009 degrees."""
    r = t.supplier.select(F.col("s_suppkey").cast("long").alias("road_id"), F.explode(F.sequence(F.lit(0), F.lit(ROAD_EDGES - 1))).alias("seq"))
    lng = (F.col("road_id") * 2000 - 4900000) / 1e5
    return r.select("road_id", F.lit(0).alias("line_id"), "seq", ((F.col("seq") * 900 - 2000000) / 1e5).alias("alat"), lng.alias("alng"), (((F.col("seq") + 1) * 900 - 2000000) / 1e5).alias("blat"), lng.alias("blng"))


def road_vertices(t: Tables) -> DataFrame:
    v = t.supplier.select(F.col("s_suppkey").cast("long").alias("road_id"), F.explode(F.sequence(F.lit(0), F.lit(ROAD_EDGES))).alias("seq"))
    return v.select("road_id", "seq", ((F.col("seq") * 900 - 2000000) / 1e5).alias("lat"), ((F.col("road_id") * 2000 - 4900000) / 1e5).alias("lng"))


def trip_edges(t: Tables) -> DataFrame:
    """Each car or motorbike order drives part of one road, 0 to 0.004 degrees beside it."""
    n = n_suppliers(t)
    own = t.orders.filter(F.substring("o_orderpriority", 1, 1) < "4").select("o_orderkey", "o_custkey")
    o = dealt(own, 6 * t.orders.count(), "o_orderkey").select(  # a trip becomes two to ten edges where it lies
        F.col("o_orderkey").cast("long").alias("trip_id"), (F.col("o_orderkey") % n).cast("long").alias("road_id"), F.col("o_custkey").cast("long").alias("user_id"),
        F.explode(F.sequence(F.lit(0), F.least(F.lit(9), (1 + F.col("o_orderkey") % 9).cast("int")))).alias("seq"))
    at, lng = F.col("user_id") % 11 + F.col("seq"), (F.col("road_id") * 2000 - 4900000 + F.col("user_id") % 5 * 100) / 1e5
    return o.select("trip_id", "road_id", "user_id", "seq", ((at * 900 - 2000000) / 1e5).alias("alat"), lng.alias("alng"), (((at + 1) * 900 - 2000000) / 1e5).alias("blat"), lng.alias("blng"))


def places(t: Tables) -> DataFrame:
    n = n_suppliers(t)
    k = F.col("c_custkey").cast("long")
    code = F.when(F.col("c_mktsegment") == "FURNITURE", "PPLC").when(F.col("c_mktsegment") == "MACHINERY", "PPLA").when(F.col("c_mktsegment") == "BUILDING", "PPL").otherwise("PPLX")
    return t.customer.select(
        k.alias("place_id"), F.col("c_name").alias("name"), ((k * 7919 % 18000 - 2000000) / 1e5).alias("lat"), ((k * 104729 % (n * 2000) - 4900000) / 1e5).alias("lng"),
        F.floor(F.abs("c_acctbal") * 100).cast("long").alias("population"), code.alias("feature_code"), F.col("c_nationkey").cast("long").alias("country"), "c_mktsegment")


def trips(t: Tables) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    mode = F.when(p.isin("1", "3"), "carro").when(p == "2", "moto").when(p == "4", "bicicleta").otherwise("aviao")
    return t.orders.select(F.col("o_orderkey").cast("long").alias("trip_id"), F.col("o_custkey").cast("long").alias("user_id"), F.col("o_orderdate").alias("trip_date"), F.col("o_totalprice").cast("double").alias("distance_m"), mode.alias("mode"))


def steps(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    label = F.when(F.col("l_suppkey") % 4 == 3, "").otherwise(F.concat(F.lit("SP-"), (F.col("l_suppkey") % 20).cast("string")))
    own = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return dealt(own, t.lineitem.count(), "l_orderkey").select(F.col("l_orderkey").cast("long").alias("trip_id"), F.row_number().over(w).alias("step_no"), label.alias("label"), F.col("l_quantity").cast("double").alias("km"))


def conquests(t: Tables) -> DataFrame:
    """user_id, trip_id, trip_date, item: a road for each line of an order."""
    o = t.orders.select("o_orderkey", F.col("o_custkey").cast("long").alias("user_id"), F.col("o_orderdate").alias("trip_date"))
    l = t.lineitem.select("l_orderkey", "l_suppkey")
    n = t.lineitem.count()
    o, l = dealt(o, n, "o_orderkey"), dealt(l, n, "l_orderkey")
    j = o.join(l, o["o_orderkey"] == l["l_orderkey"])
    return j.select("user_id", F.col("o_orderkey").cast("long").alias("trip_id"), "trip_date", F.concat(F.lit("SP-"), (F.col("l_suppkey") % 97).cast("string")).alias("item"), F.col("l_suppkey").cast("long").alias("place_id"))


def local(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").cast("long").alias("trip_id"), (F.col("o_custkey") % 9).cast("long").alias("content"), (F.col("o_custkey") * 10 + F.col("o_orderkey") % 5).cast("long").alias("updated_at"))


def remote(t: Tables) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.filter("o_orderkey % 11 <> 0").select(
        o.cast("long").alias("trip_id"), (c % 9 + F.when(o % 3 == 0, 100).otherwise(0)).cast("long").alias("content"), (c * 10 + o % 4).cast("long").alias("updated_at"),
        F.when(o % 13 == 0, c * 10 + o % 6).cast("long").alias("deleted_at"))


def tombstones(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey % 14 = 0").select(F.col("o_orderkey").cast("long").alias("trip_id"), (F.col("o_custkey") * 10 + F.col("o_orderkey") % 6).cast("long").alias("deleted_at"))


#: The same as SQL, for WITH.
SQL = {
    "road_edges": "SELECT CAST(s_suppkey AS BIGINT) AS road_id, i AS seq, (i * 900 - 2000000) / 1e5 AS alat, (s_suppkey * 2000 - 4900000) / 1e5 AS alng, ((i + 1) * 900 - 2000000) / 1e5 AS blat, (s_suppkey * 2000 - 4900000) / 1e5 AS blng FROM supplier, unnest(range(0, 20)) AS r(i)",
    "road_vertices": "SELECT CAST(s_suppkey AS BIGINT) AS road_id, CAST(i AS INTEGER) AS seq, (i * 900 - 2000000) / 1e5 AS lat, (s_suppkey * 2000 - 4900000) / 1e5 AS lng FROM supplier, unnest(range(0, 21)) AS r(i)",
    "trip_edges": "SELECT CAST(o_orderkey AS BIGINT) AS trip_id, CAST(o_orderkey % (SELECT count(*) FROM supplier) AS BIGINT) AS road_id, CAST(o_custkey AS BIGINT) AS user_id, i AS seq, ((o_custkey % 11 + i) * 900 - 2000000) / 1e5 AS alat, ((o_orderkey % (SELECT count(*) FROM supplier)) * 2000 - 4900000 + o_custkey % 5 * 100) / 1e5 AS alng, ((o_custkey % 11 + i + 1) * 900 - 2000000) / 1e5 AS blat, ((o_orderkey % (SELECT count(*) FROM supplier)) * 2000 - 4900000 + o_custkey % 5 * 100) / 1e5 AS blng FROM orders, unnest(range(0, 10)) AS r(i) WHERE i <= 1 + o_orderkey % 9 AND substr(o_orderpriority, 1, 1) < '4'",
    "places": "SELECT CAST(c_custkey AS BIGINT) AS place_id, c_name AS name, (c_custkey * 7919 % 18000 - 2000000) / 1e5 AS lat, (c_custkey * 104729 % ((SELECT count(*) FROM supplier) * 2000) - 4900000) / 1e5 AS lng, CAST(floor(abs(c_acctbal) * 100) AS BIGINT) AS population, CASE c_mktsegment WHEN 'FURNITURE' THEN 'PPLC' WHEN 'MACHINERY' THEN 'PPLA' WHEN 'BUILDING' THEN 'PPL' ELSE 'PPLX' END AS feature_code, CAST(c_nationkey AS BIGINT) AS country, c_mktsegment FROM customer",
    "trips": "SELECT CAST(o_orderkey AS BIGINT) AS trip_id, CAST(o_custkey AS BIGINT) AS user_id, o_orderdate AS trip_date, CAST(o_totalprice AS DOUBLE) AS distance_m, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'carro' WHEN '3' THEN 'carro' WHEN '2' THEN 'moto' WHEN '4' THEN 'bicicleta' ELSE 'aviao' END AS mode FROM orders",
    "steps": "SELECT CAST(l_orderkey AS BIGINT) AS trip_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS step_no, CASE WHEN l_suppkey % 4 = 3 THEN '' ELSE 'SP-' || (l_suppkey % 20) END AS label, CAST(l_quantity AS DOUBLE) AS km FROM lineitem",
    "conquests": "SELECT CAST(o_custkey AS BIGINT) AS user_id, CAST(o_orderkey AS BIGINT) AS trip_id, o_orderdate AS trip_date, 'SP-' || (l_suppkey % 97) AS item, CAST(l_suppkey AS BIGINT) AS place_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "loc": "SELECT CAST(o_orderkey AS BIGINT) AS trip_id, CAST(o_custkey % 9 AS BIGINT) AS content, CAST(o_custkey * 10 + o_orderkey % 5 AS BIGINT) AS updated_at FROM orders WHERE o_orderkey % 7 <> 0",
    "rem": "SELECT CAST(o_orderkey AS BIGINT) AS trip_id, CAST(o_custkey % 9 + CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END AS BIGINT) AS content, CAST(o_custkey * 10 + o_orderkey % 4 AS BIGINT) AS updated_at, CAST(CASE WHEN o_orderkey % 13 = 0 THEN o_custkey * 10 + o_orderkey % 6 END AS BIGINT) AS deleted_at FROM orders WHERE o_orderkey % 11 <> 0",
    "tomb": "SELECT CAST(o_orderkey AS BIGINT) AS trip_id, CAST(o_custkey * 10 + o_orderkey % 6 AS BIGINT) AS deleted_at FROM orders WHERE o_orderkey % 14 = 0",
}


def using(*names: str, more: str = "") -> str:
    """A WITH clause of fixtures and further expressions."""
    return "WITH " + ", ".join([*(f"{n} AS ({SQL[n]})" for n in names), *([more] if more else [])]) + " "
