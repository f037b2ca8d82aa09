"""Earlier ways to scan trips for cities: by the outlines of municipalities with points where there are none, and by towns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.functions.text import plain
from tripspark.operators.coverage import ENDS
from tripspark.operators.places import PLACE_CELL_DEG, _cells, crossed_cities, line_in_polygon

#: Kinds of places that are looked at.
KINDS = ("city", "town", "village")


def fallback_radius_km(kind: Column) -> Column:
    """How near a trip must pass a place where no outline is known."""
    return F.when(kind == "city", 2.5).when(kind == "town", 1.5).otherwise(0.75)


def town_radius_km(population: Column, kind: Column) -> Column:
    """How far a town reaches: by population where it is 50,000 or more, else by kind."""
    out = F.when(population >= 1_000_000, 6.0)
    for least, km in ((300_000, 5.0), (100_000, 4.2), (50_000, 3.5)):
        out = out.when(population >= least, km)
    return out.when(kind == "city", 3.6).when(kind == "town", 2.2).otherwise(1.1)


def _box(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, s, n, w, e: bounds of edges."""
    low, high = (lambda a, b: F.min(F.least(a, b))), (lambda a, b: F.max(F.greatest(a, b)))
    return lines.groupBy(*by).agg(low("alat", "blat").alias("s"), high("alat", "blat").alias("n"), low("alng", "blng").alias("w"), high("alng", "blng").alias("e"))


def _overlaps(pieces: DataFrame, boxes: DataFrame, kept: list[str], cell: float) -> DataFrame:
    """piece and the columns `kept` of boxes (s, n, w, e) that share a point with the piece's own bounds; once each."""
    a = _cells(_box(pieces, ["piece"]), *[F.col(c) for c in "snwe"], cell)
    b = _cells(boxes.select(*kept, *[F.col(c).alias(f"{c}_") for c in "snwe"]), *[F.col(f"{c}_") for c in "snwe"], cell)
    return a.join(b, ["cx", "cy"]).filter("s <= n_ and s_ <= n and w <= e_ and w_ <= e").select("piece", *kept).distinct()


def _pieces(trips: DataFrame) -> DataFrame:
    return trips.select(F.struct("trip_id", "chunk").alias("piece"), *ENDS)


def scan_outlines(trips: DataFrame, rings: DataFrame, places: DataFrame, cell: float = 0.12) -> DataFrame:
    """trip_id, via, city_id: municipalities whose outline a trip crosses or has a vertex in (via admin), and, of the chunks whose bounds no
    municipality's bounds meet, the places that it passes near (via place); a city of both kinds is in both.

    trips: trip_id, chunk and the ends of edges (air trips left out by the caller); rings: area_id and edges of the outlines that can be
    relied on; places: place_id, kind, lat, lng. Places of other kinds, or without a position, are left out."""
    p = _pieces(trips)
    inside = line_in_polygon(p.withColumnRenamed("piece", "trip_id"), rings).select("trip_id.trip_id", F.lit("admin").alias("via"), F.col("area_id").alias("city_id"))
    held = _overlaps(p, _box(rings, ["area_id"]), [], cell)
    bare = p.join(held, "piece", "left_anti").select("piece.trip_id", *ENDS)
    known = places.filter(F.col("kind").isin(*KINDS) & F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumn("radius_km", fallback_radius_km(F.col("kind")))
    near = crossed_cities(bare, known, trips).select("trip_id", F.lit("place").alias("via"), F.col("place_id").alias("city_id"))
    return inside.union(near).distinct()


def scan_towns(trips: DataFrame, places: DataFrame, rings: DataFrame, municipalities: DataFrame, cell: float = 0.12) -> DataFrame:
    """trip_id, place_id, via, label, city, region, country_code, country: towns that a trip crosses, by their own outline (via boundary) or within
    their radius (via radius). via is boundary for every town that has an outline.

    trips: as for scan_outlines; places: place_id, kind, population, lat, lng, label, city, region, country_code, country; rings: place_id and
    edges of outlines; municipalities: area_id, name, region, country_code, country and bounds s, n, w, e. What a town does not say of region and
    country comes from the municipality of its name (of least id) among those whose bounds meet the chunk's: of several chunks, the first
    that has one. The label is then made of city, region and country."""
    p = _pieces(trips)
    known = places.filter(F.col("kind").isin(*KINDS))
    outlined = rings.select("place_id").distinct().withColumn("has_", F.lit(True))
    own = rings.join(known.select("place_id"), "place_id", "left_semi").withColumnRenamed("place_id", "area_id")
    across = line_in_polygon(p.withColumnRenamed("piece", "trip_id"), own).select(F.col("trip_id").alias("piece"), F.col("area_id").alias("place_id"))
    points = known.filter("lat is not null and lng is not null").withColumn("radius_km", town_radius_km(F.col("population"), F.col("kind")))
    near = crossed_cities(p.withColumnRenamed("piece", "trip_id"), points).select(F.col("trip_id").alias("piece"), "place_id")
    met = across.union(near).distinct().join(known.select("place_id", plain(F.coalesce(F.when(F.trim("city") != "", F.col("city")), F.col("label"), F.lit(""))).alias("name_")), "place_id")
    area = municipalities.select("area_id", plain(F.coalesce("name", F.lit(""))).alias("m_name"), F.struct("region", "country_code", "country").alias("m"), *"snwe")
    area = area.join(met.select(F.col("name_").alias("m_name")).distinct(), "m_name", "left_semi")
    around = _overlaps(p.join(met.select("piece").distinct(), "piece", "left_semi"), area, ["area_id", "m_name", "m"], cell)
    around = around.withColumnRenamed("piece", "piece_")
    j = met.join(around, (met["piece"] == around["piece_"]) & (met["name_"] == around["m_name"]), "left")
    best = j.groupBy("piece.trip_id", "place_id").agg(F.min(F.when(F.col("area_id").isNotNull(), F.struct("piece.chunk", "area_id", "m"))).alias("b"))
    out = best.join(known, "place_id").join(outlined, "place_id", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    for c in ("region", "country_code", "country"):
        out = out.withColumn(c, F.when(blank(F.col(c)), F.coalesce(F.col(f"b.m.{c}"), F.lit(""))).otherwise(F.col(c)))
    said = F.array_join(F.filter(F.array("city", "region", "country"), lambda x: ~blank(x)), ", ")
    label = F.when(F.col("b").isNotNull() & (said != ""), said).otherwise(F.col("label"))
    via = F.when(F.coalesce("has_", F.lit(False)), "boundary").otherwise("radius")
    return out.select("trip_id", "place_id", via.alias("via"), label.alias("label"), "city", "region", "country_code", "country")
