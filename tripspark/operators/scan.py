"""The scan of a trip for cities: which countries' catalogs it asks, what it comes near to, and whether that is all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.geo import point_edge_km, squeeze_at
from tripspark.operators.coverage import ENDS, edges
from tripspark.operators.places import PLACE_CELL_DEG, _around, _cells, radius_km
from tripspark.operators.regions import point_region
from tripspark.operators.rounds import Rounds

#: Countries that have a catalog beside Brazil's, kilometres around Brazil's capitals and its other cities, and how
#: far beyond a trip's bounds a place may lie, in degrees.
KNOWN = ("AR", "UY", "PY", "PE", "BO", "CL", "CO", "VE", "EC", "GY", "SR", "GF")
CAPITAL_KM, CITY_KM, PAD_DEG = 10.0, 4.0, 0.15


def catalog_radius_km(country: Column, capital: Column, population: Column, code: Column) -> Column:
    """How near a trip must pass: in Brazil by whether the city is a capital, elsewhere by population, else by kind of place."""
    return F.when(country == "BR", F.when(F.coalesce(capital, F.lit(False)), CAPITAL_KM).otherwise(CITY_KM)).otherwise(radius_km(population, F.coalesce(code, F.lit(""))))


def trip_countries(vertices: DataFrame, ends: DataFrame, boxes: DataFrame, rings: DataFrame, known: tuple[str, ...] = KNOWN, samples: int = 200) -> DataFrame:
    """trip_id, code, said, pos: countries of a trip's start, stops and end (ends: trip_id, ord, country_code), and of those `known`
    the ones that its line (vertices: trip_id, seq, lat, lng) passes, in that order.

    The line is looked at in every floor(n / samples)-th vertex, under 2 * samples of them, and in the last."""
    own = Window.partitionBy("trip_id")
    v = vertices.select("trip_id", "lat", "lng", (F.row_number().over(own.orderBy("seq")) - 1).alias("i"), F.count("*").over(own).alias("n"))
    v = v.filter((F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / samples)) == 0) | (F.col("i") == F.col("n") - 1))
    at = point_region(v.select(F.struct("trip_id", "i").alias("point_id"), "lat", "lng"), boxes, rings).filter(F.col("code").isin(*known))
    passed = at.select("point_id.trip_id", "code", F.lit(False).alias("said"), F.col("point_id.i").alias("pos"))
    said = ends.select("trip_id", F.upper(F.coalesce("country_code", F.lit(""))).alias("code"), F.lit(True).alias("said"), F.col("ord").cast("int").alias("pos")).filter("code <> ''")
    # written, as a scan asks for it several times
    return Rounds(vertices.sparkSession, "countries").write("countries", said.union(passed).groupBy("trip_id", "code").agg(F.min(F.struct((~F.col("said")).alias("a"), "pos")).alias("b")).select("trip_id", "code", (~F.col("b.a")).alias("said"), F.col("b.pos").alias("pos")))


def _asked(trips: DataFrame, countries: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """trip_id, country_code, said, pos of the catalogs that road trips ask: those of their countries, Brazil's first and also for trips of no country."""
    c = trips.select("trip_id").join(countries, "trip_id", "left").filter(F.col("code").isNull() | F.col("code").isin("BR", *known))
    code = F.coalesce("code", F.lit("BR"))
    return c.select("trip_id", code.alias("country_code"), F.coalesce("said", F.lit(False)).alias("said"), F.when(code == "BR", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))).otherwise(F.struct(F.when(F.col("said"), 1).otherwise(2).alias("a"), F.col("pos").alias("b"))).alias("pos"))


def scan_cities(trips: DataFrame, vertices: DataFrame, countries: DataFrame, places: DataFrame, known: tuple[str, ...] = KNOWN, cell: float = PLACE_CELL_DEG) -> tuple[DataFrame, DataFrame]:
    """What trips come near to: trip_id, place_id, ord, km; and the state of each: trip_id, source, complete.

    trips: trip_id, mode; vertices: trip_id, seq, lat, lng; countries: trip_countries; places: place_id, lat, lng, country_code, capital,
    population, feature_code. ord (by catalog, then place_id) is the order for unique_cities. Flights and trips of under two vertices have no
    cities and are complete; others are not if no place of theirs says its country, one lies where there is no catalog, or a catalog
    that they ask is empty.

    A place meets a trip by country and cell, so catalogs that no trip asks are not read: where places are stored by country_code, the few codes
    asked (one for each known country at most) prune their folders."""
    of = vertices.groupBy("trip_id").agg(F.count("*").alias("n"), F.min("lat").alias("s"), F.max("lat").alias("n_"), F.min("lng").alias("w"), F.max("lng").alias("e"))
    t = trips.select("trip_id", "mode").join(of, "trip_id", "left").withColumn("flies", F.coalesce(F.col("mode") == "aviao", F.lit(False)))
    road = t.filter("not flies and n >= 2")
    asked = _asked(road, countries, known)
    few = F.broadcast(asked.select("country_code").distinct())  # at most the known countries and Brazil
    near = places.filter("lat is not null and lng is not null").join(few, "country_code", "left_semi")
    near = near.select("place_id", "country_code", "lat", "lng", catalog_radius_km(*[F.col(c) for c in ("country_code", "capital", "population", "feature_code")]).alias("radius_km"), squeeze_at(F.col("lat")).alias("squeeze"))  # once for each place
    e = edges(vertices, ["trip_id"]).join(road.select("trip_id", "s", "n_", "w", "e"), "trip_id").join(asked.select("trip_id", "country_code", "pos"), "trip_id")
    e = _cells(e, F.least("alat", "blat"), F.greatest("alat", "blat"), F.least("alng", "blng"), F.greatest("alng", "blng"), cell)
    j = e.join(_around(near, F.col("radius_km"), cell), ["country_code", "cx", "cy"])
    inside = F.col("lat").between(F.col("s") - PAD_DEG, F.col("n_") + PAD_DEG) & F.col("lng").between(F.col("w") - PAD_DEG, F.col("e") + PAD_DEG)
    km = point_edge_km(F.col("lat"), F.col("lng"), *[F.col(c) for c in ENDS], F.col("squeeze"))
    met = j.filter(inside).withColumn("km", km).filter("km <= radius_km").groupBy("trip_id", "place_id").agg(F.min("km").alias("km"), F.min("pos").alias("pos"))
    found = met.select("trip_id", "place_id", F.row_number().over(Window.partitionBy("trip_id").orderBy("pos", "place_id")).alias("ord"), "km")
    there = F.broadcast(places.join(few, "country_code", "left_semi").select("country_code").distinct().withColumn("there", F.lit(True)))  # as few
    scanned = asked.join(there, "country_code", "left").groupBy("trip_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("pos", F.concat(F.lit("local-"), F.lower("country_code")).alias("name"))))).alias("parts"), F.count_if(F.col("there").isNull()).alias("n_empty"))
    said = countries.filter("said").groupBy("trip_id").agg(F.count("*").alias("n_said"), F.count_if(~F.col("code").isin("BR", *known)).alias("n_else"))
    s = t.join(scanned, "trip_id", "left").join(said, "trip_id", "left")
    still = F.col("flies") | F.coalesce(F.col("n") < 2, F.lit(True))
    whole = (F.coalesce("n_said", F.lit(0)) > 0) & (F.col("n_else") == 0) & (F.coalesce("n_empty", F.lit(0)) == 0)
    parts = F.transform(F.coalesce("parts", F.array().cast(s.schema["parts"].dataType)), lambda x: x["name"])
    rest = F.when(whole, F.array().cast("array<string>")).when(F.size(parts) > 0, F.array(F.lit("partial"))).otherwise(F.array(F.lit("pending")))
    named = F.array_join(F.concat(parts, rest), "+")
    source = F.when(F.col("flies"), "flight").when(still, "no-route").when(named == "", "local").otherwise(named)
    return found, s.select("trip_id", source.alias("source"), (still | whole).alias("complete"))
