"""Trips reviewed against roads, kept up to date: only pairs of which a side has changed are matched again.

A review is four tables: the runs of each matched (road, trip), the conquests that follow from them, and a signature of the
geometry of each road and each trip. A later review takes the earlier one's tables. Where neither the road's nor the trip's
signature has changed, the stored runs stay as they are and neither side's edges are looked at again."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.operators.coverage import ENDS, STRICT, covered_edges, covered_runs
from tripspark.operators.rounds import Rounds

#: Fixed value: kilometres of a run that count as a conquest.
LEAST_KM = 2.0


class Review(NamedTuple):
    """runs: road_id, trip_id, line_id, first_seq, last_seq, km. conquests: road_id, trip_id, km, n_runs, given. added: the
    conquests that the review before had not. roads: road_id, signature. trips: trip_id, signature."""

    runs: DataFrame
    conquests: DataFrame
    added: DataFrame
    roads: DataFrame
    trips: DataFrame


def signatures(edges: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """key, signature: a digest of all edges of each key, in no order; parts (line, seq) and ends are what an edge is."""
    one = F.xxhash64(*parts, *ENDS)
    sums = edges.groupBy(key).agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.sum(one.cast("decimal(20,0)")).alias("s"))
    return sums.select(key, F.concat_ws(":", "n", F.hex("x"), F.col("s").cast("string")).alias("signature"))


def matched_runs(roads: DataFrame, trips: DataFrame, least_km: float = LEAST_KM) -> DataFrame:
    """road_id, trip_id, line_id, first_seq, last_seq, km: the runs of roads that single trips match, of least_km or more.

    roads: road_id, line_id, seq, ends. trips: trip_id, seq, ends, of eligible trips."""
    c = covered_edges(roads, trips, ["trip_id"], *STRICT)
    runs = covered_runs(c, ["road_id", "trip_id", "line_id"]).filter(F.col("km") >= least_km)
    return runs.select("road_id", "trip_id", "line_id", "first_seq", "last_seq", "km")


def changed(now: DataFrame, before: DataFrame, key: str, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """Keys of now that are new or whose signature differs, and keys whose stored pairs are void (those that differ, or are gone)."""
    both = now.select(key, F.col("signature").alias("new")).join(before.select(key, F.col("signature").alias("old")), key, "full_outer")
    differs = ~F.col("new").eqNullSafe(F.col("old"))
    both = rounds.write(f"changed_{key}", both.filter(differs))  # asked for several times
    return both.filter(F.col("new").isNotNull()).select(key), both.filter(F.col("old").isNotNull()).select(key)


def _conquests(runs: DataFrame, given: DataFrame | None) -> DataFrame:
    own = runs.groupBy("road_id", "trip_id").agg(F.sum("km").alias("km"), F.count("*").alias("n_runs"))
    if given is None:
        return own.withColumn("given", F.lit(False))
    marked = given.select("road_id", "trip_id").distinct().withColumn("given", F.lit(True))
    return own.join(marked, ["road_id", "trip_id"], "full_outer").withColumn("given", F.coalesce("given", F.lit(False)))


def review_trips(roads: DataFrame, trips: DataFrame, before: Review | None = None, given: DataFrame | None = None, least_km: float = LEAST_KM) -> Review:
    """The review of trips against roads, from the one before (None: from nothing).

    given: conquests (road_id, trip_id) that a trip has by itself; they stay without any run (km and n_runs null). Pairs of a
    road or trip that is gone lose their runs. The result equals a review from nothing; before must have been made with the
    same least_km. Ids must be known; edges of no length are ignored.

    Runs and signatures are written as they are found, so that each is worked out once, whatever is then read of the review."""
    rounds = Rounds(roads.sparkSession, "review")
    road_signs = rounds.write("roads", signatures(roads, "road_id", ["line_id", "seq"]))
    trip_signs = rounds.write("trips", signatures(trips, "trip_id", ["seq"]))
    if before is None:
        runs = rounds.write("runs", matched_runs(roads, trips, least_km))
        conquests = _conquests(runs, given)
        return Review(runs, conquests, conquests, road_signs, trip_signs)
    new_roads, void_roads = changed(road_signs, before.roads, "road_id", rounds)
    new_trips, void_trips = changed(trip_signs, before.trips, "trip_id", rounds)
    stay = before.runs.join(void_roads, "road_id", "left_anti").join(void_trips, "trip_id", "left_anti")
    by_road = matched_runs(roads.join(new_roads, "road_id", "left_semi"), trips, least_km)
    by_trip = matched_runs(roads.join(new_roads, "road_id", "left_anti"), trips.join(new_trips, "trip_id", "left_semi"), least_km)
    runs = rounds.write("runs", stay.unionByName(by_road).unionByName(by_trip))
    conquests = _conquests(runs, given)
    return Review(runs, conquests, conquests.join(before.conquests, ["road_id", "trip_id"], "left_anti"), road_signs, trip_signs)


def written(review: Review, path: str) -> Review:
    """The review's tables written under path, which must be new, and read back: the form to hand on to the next review."""
    for name, table in review._asdict().items():
        table.write.parquet(f"{path}/{name}")
    return stored(review.runs.sparkSession, path)


def stored(spark: SparkSession, path: str) -> Review:
    return Review(*[spark.read.parquet(f"{path}/{name}") for name in Review._fields])
