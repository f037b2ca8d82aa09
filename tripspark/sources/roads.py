"""Road geometry tables from OSM extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.text import canonical_keys
from tripspark.operators.lines import dedupe_lines, encode_lines, line_metrics


def _tag(name: str) -> F.Column:
    return F.element_at("tags", name)


def relation_member_keys(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """way_id, key: road keys of each way, from its own references and from the road relations it is a member of."""
    keys = lambda: F.explode(canonical_keys([_tag("ref"), _tag("nat_ref"), _tag("official_ref")], _tag("network"))).alias("key")
    roads = relations.filter(_tag("route") == "road").select(F.col("members"), keys())
    member = roads.select("key", F.explode("members").alias("m")).filter("m.type = 'way'").select(F.col("m.ref").alias("way_id"), "key")
    own = ways.select(F.col("id").alias("way_id"), keys())
    return own.union(member.join(ways.select(F.col("id").alias("way_id")), "way_id", "left_semi")).distinct()


def assemble_way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, seq, lat, lng: vertices of each way in order; nodes that are missing or out of range are left out, and ways of one point."""
    n = nodes.filter(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)).select(F.col("id").alias("node"), "lat", "lng")
    v = ways.select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("seq", "node")).join(n, "node")
    return v.withColumn("of_", F.count("*").over(Window.partitionBy("way_id"))).filter("of_ >= 2").select("way_id", "seq", "lat", "lng")


def build_road_catalog(way_keys: DataFrame, lines: DataFrame) -> DataFrame:
    """key, country, network, number, n_lines, n_points, km, s, w, n, e, encoded_lines: equal lines (6 decimals, either way round)
    count once; lines are in order of their encoding."""
    v = way_keys.join(lines, "way_id")
    kept = dedupe_lines(v, ["key"], "way_id", 6)
    v = v.join(kept, ["key", "way_id"], "left_semi")
    m, e = line_metrics(v, ["key", "way_id"]), encode_lines(v, ["key", "way_id"])
    j = m.join(e.select("key", "way_id", "encoded"), ["key", "way_id"])
    parts = F.split("key", r"\|")
    return j.groupBy("key").agg(
        F.count("*").alias("n_lines"), F.sum("n_points").alias("n_points"), F.sum("km").alias("km"), F.min("s").alias("s"), F.min("w").alias("w"), F.max("n").alias("n"), F.max("e").alias("e"),
        F.array_sort(F.collect_list("encoded")).alias("encoded_lines"),
    ).withColumns({"country": parts[0], "network": parts[1], "number": parts[2]})


def union_road_sources(vertices: DataFrame, arrivals: DataFrame, expected: tuple[str, ...] = ("relations", "ways")) -> tuple[DataFrame, DataFrame]:
    """The lines of each road (road_id, source, line_id) from all sources that arrived, equal ones once, and each road's state:
    road_id, arrived (names in the order of `expected`), n_lines, partial.

    vertices: road_id, source, line_id, seq, lat, lng; arrivals: road_id, source, ok. A source has arrived for a road once any of its
    answers was ok; lines of others are left out. Of lines that are equal at 5 decimals, either way round, the one of the first
    source stays, of that the least line_id; lines of one vertex go. A road is partial until all expected sources have arrived, so
    answers can come in any order and again: the state of a union of answers is that of all of them together."""
    flags = arrivals.groupBy("road_id", "source").agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok")).filter("ok")
    names = F.array(*[F.lit(x) for x in expected])
    here = flags.groupBy("road_id").agg(F.array_intersect(names, F.collect_set("source")).alias("arrived"))
    here = arrivals.select("road_id").distinct().join(here, "road_id", "left").withColumn("arrived", F.coalesce("arrived", F.array().cast("array<string>")))
    rank = F.array_position(names, F.col("source"))
    v = vertices.join(flags.select("road_id", "source"), ["road_id", "source"], "left_semi").withColumn("own_", F.struct(F.when(rank > 0, rank).otherwise(len(expected) + 1).alias("rank"), "source", "line_id"))
    long = v.groupBy("road_id", "own_").agg(F.count("*").alias("n")).filter("n >= 2").select("road_id", "own_")
    lines = dedupe_lines(v.join(long, ["road_id", "own_"], "left_semi"), ["road_id"], "own_").select("road_id", "own_.source", "own_.line_id")
    state = here.join(lines.groupBy("road_id").agg(F.count("*").alias("n_lines")), "road_id", "left")
    return lines, state.select("road_id", "arrived", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), (F.size("arrived") < len(expected)).alias("partial"))
