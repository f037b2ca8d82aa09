"""Curated routes: the source of their geometry, their lines in few vertices under a budget of bytes, documents, manifest and bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripspark.operators.lines import encode_lines, line_metrics, sample_evenly, vertex_weights
from tripspark.sources.shared import new_path

#: Decimals of encoded vertices.
PRECISION = 5
#: Metres that a line may be off, the first that meets the budget counts; and vertices of a line, at most.
TOLERANCES = (40.0, 60.0, 90.0, 135.0, 200.0, 300.0, 450.0)
MOST_POINTS = 2200
#: Bytes of a group's documents, at most.
BUDGET = 250_000

OFFICIAL, ALTERNATIVE = "official", "alternative"


def _encoded(role: str) -> Column:
    """The encoded lines of a role in their order, as an aggregate."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("line_no", "encoded"))))
    return F.transform(ordered, lambda x: x["encoded"])


def _sum_km(role: str) -> Column:
    return F.round(F.sum(F.when(F.col("role") == role, F.col("km"))), 3)


def route_geometry(vertices: DataFrame, sources: tuple[str, ...] = ("road-catalog", "named-roads", "routed-waypoints")) -> DataFrame:
    """route_id, source, encoded_lines, alternate_lines, total_km, alternate_km, bounds: each route's official lines come from its first
    source that has a line of two vertices or more, its alternative lines from the first source that has any.

    vertices: route_id, role (official or alternative), source, line_no, seq, lat, lng. Lines of fewer vertices and sources that are not
    named are left out; a route without an official line has no row. Distances are in km at 3 decimals, null without a line; bounds
    (s, w, n, e) hold both roles."""
    rank = F.array_position(F.array(*[F.lit(x) for x in sources]), F.col("source"))
    by = ["route_id", "role", "source", "line_no"]
    v = vertices.filter((rank > 0) & F.col("role").isin(OFFICIAL, ALTERNATIVE)).withColumn("n_", F.count("*").over(Window.partitionBy(*by))).filter("n_ >= 2")
    v = v.withColumn("rank_", rank).withColumn("first_", F.min("rank_").over(Window.partitionBy("route_id", "role"))).filter("rank_ = first_")
    j = line_metrics(v, by).drop("n_points").join(encode_lines(v, by, PRECISION), by)
    routes = j.groupBy("route_id").agg(
        F.min(F.when(F.col("role") == OFFICIAL, F.col("source"))).alias("source"), _encoded(OFFICIAL).alias("encoded_lines"), _encoded(ALTERNATIVE).alias("alternate_lines"),
        _sum_km(OFFICIAL).alias("total_km"), _sum_km(ALTERNATIVE).alias("alternate_km"), F.struct(F.min("s").alias("s"), F.min("w").alias("w"), F.max("n").alias("n"), F.max("e").alias("e")).alias("bounds"))
    return routes.filter("source is not null")


def compact_lines(vertices: DataFrame, by: list[str], tolerances: tuple[float, ...] = TOLERANCES, most: int = MOST_POINTS) -> DataFrame:
    """by, n_source, tolerance_m, seq, lat, lng: each line at each tolerance, at most `most` vertices of it. A line is folded once,
    for the least tolerance; the others take the vertices that weigh more."""
    v = vertex_weights(vertices, by, min(tolerances))
    held = F.filter(F.array(*[F.lit(float(t)) for t in tolerances]), lambda t: F.col("weight") > t)
    v = v.select(*by, "n_source", F.explode(held).alias("tolerance_m"), "seq", "lat", "lng")
    return sample_evenly(v, [*by, "n_source", "tolerance_m"], most)


def _document() -> Column:
    box = F.when(F.col("bounds").isNotNull(), F.array(F.array("bounds.s", "bounds.w"), F.array("bounds.n", "bounds.e")))
    of = {"id": "route_id", "encodedLines": "encoded_lines", "alternateEncodedLines": "alternate_lines", "totalKm": "total_km", "alternateTotalKm": "alternate_km"}
    return F.to_json(F.struct(F.lit(PRECISION).alias("precision"), *[F.col(c).alias(name) for name, c in of.items()], box.alias("bounds")), {"ignoreNullFields": "false"})


def curated_catalog(routes: DataFrame, vertices: DataFrame, group: str | None = None, budget: int = BUDGET,
                    tolerances: tuple[float, ...] = TOLERANCES, most: int = MOST_POINTS) -> tuple[DataFrame, DataFrame]:
    """Documents of the routes, and the routes that have none: (route_id, bundle, tolerance_m, fits, encoded_lines, alternate_lines,
    bounds, total_km, alternate_km, source_points, points, document, bytes) and (route_id).

    routes: route_id (unique), disabled, total_km, alternate_km, bounds (struct s, w, n, e, or null), and `group`, whose routes share a
    bundle; without it all routes do. vertices: route_id, role (official or alternative), line_no, seq, lat, lng. Disabled routes are in
    neither result; routes without an official line of two vertices are in the second. Bounds are the given ones, else those of
    the vertices that stay, of both roles.

    All routes of a bundle have one tolerance: the least whose documents have `budget` bytes or fewer together (as UTF-8); where
    none has, the largest, and fits is false. Nothing is dropped to meet the budget."""
    spark, by = routes.sparkSession, ["route_id", "role", "line_no"]
    live = routes.filter(~F.coalesce("disabled", F.lit(False))).select("route_id", (F.col(group) if group else F.lit("all")).alias("bundle"), "total_km", "alternate_km", F.col("bounds").alias("given_"))
    v = vertices.filter(F.col("role").isin(OFFICIAL, ALTERNATIVE)).join(live.select("route_id"), "route_id", "left_semi")
    line = [*by, "n_source", "tolerance_m"]
    w = Window.partitionBy(*line)
    box = {"s": F.min("lat"), "w": F.min("lng"), "n": F.max("lat"), "e": F.max("lng")}
    c = compact_lines(v, by, tolerances, most).select(*line, "seq", *[F.round(x, PRECISION).alias(x) for x in ("lat", "lng")])
    c = c.select(*line, "seq", "lat", "lng", *[f.over(w).alias(k) for k, f in box.items()])
    lines = encode_lines(c, [*line, *box], PRECISION)
    found = lines.groupBy("route_id", "tolerance_m").agg(
        _encoded(OFFICIAL).alias("encoded_lines"), _encoded(ALTERNATIVE).alias("alternate_lines"), F.sum("n_source").alias("source_points"), F.sum("n_points").alias("points"),
        F.struct(F.min("s").alias("s"), F.min("w").alias("w"), F.max("n").alias("n"), F.max("e").alias("e")).alias("own_")).filter(F.size("encoded_lines") > 0)
    path = new_path(spark, "curated")
    docs = live.join(found, "route_id").withColumn("bounds", F.coalesce("given_", "own_")).withColumn("document", _document())
    docs.drop("given_", "own_").withColumn("bytes", F.octet_length("document").cast("long")).write.parquet(path)
    docs = spark.read.parquet(path)
    sizes = docs.groupBy("bundle", "tolerance_m").agg(F.sum("bytes").alias("bytes_"))
    least = F.min(F.when(F.col("bytes_") <= budget, F.col("tolerance_m")))
    choice = sizes.groupBy("bundle").agg(F.coalesce(least, F.max("tolerance_m")).alias("tolerance_m"), least.isNotNull().alias("fits"))
    same = docs["bundle"].eqNullSafe(choice["bundle"]) & (docs["tolerance_m"] == choice["tolerance_m"])
    kept = docs.join(choice, same).select(docs["*"], choice["fits"])
    return kept, live.select("route_id").join(docs.select("route_id").distinct(), "route_id", "left_anti")


def curated_manifest(catalog: DataFrame) -> DataFrame:
    """bundle, route_id, n_routes, tolerance_m, fits, bytes, points, source_points, total_km, bounds: a row for each document, and one for each
    bundle with its sums (route_id, total_km and bounds null)."""
    own = catalog.select("bundle", "route_id", F.lit(1).cast("long").alias("n_routes"), "tolerance_m", "fits", "bytes", "points", "source_points", "total_km", "bounds")
    sums = catalog.groupBy("bundle").agg(F.count("*").alias("n_routes"), F.first("tolerance_m").alias("tolerance_m"), F.first("fits").alias("fits"), *[F.sum(c).alias(c) for c in ("bytes", "points", "source_points")])
    return own.unionByName(sums, allowMissingColumns=True)


def write_curated(catalog: DataFrame, path: str) -> None:
    """Under path: documents/ (a folder for each route_id, one line of JSON), bundles/ (a folder for each bundle, a line for each
    route) and manifest/ (JSON lines). A bundle that fits its budget is one file; one that does not is cut by Spark as it comes."""
    catalog.select("route_id", F.col("document").alias("value")).repartition("route_id").write.mode("overwrite").partitionBy("route_id").text(f"{path}/documents")
    part = F.when(F.col("fits"), 0).otherwise(F.pmod(F.xxhash64("route_id"), F.lit(64)))
    catalog.select("bundle", part.alias("part_"), F.col("document").alias("value")).repartition("bundle", "part_").drop("part_").write.mode("overwrite").partitionBy("bundle").text(f"{path}/bundles")
    curated_manifest(catalog).write.mode("overwrite").json(f"{path}/manifest")


def read_curated(spark: SparkSession, path: str, bundles: list[str] | None = None) -> DataFrame:
    """bundle, id, precision, encodedLines, alternateEncodedLines, totalKm, alternateTotalKm, bounds: the routes of bundles; only the
    folders of the bundles asked are read."""
    schema = "precision int, id string, encodedLines array<string>, alternateEncodedLines array<string>, totalKm double, alternateTotalKm double, bounds array<array<double>>"
    t = spark.read.schema("value string, bundle string").text(f"{path}/bundles")
    if bundles is not None:
        t = t.filter(F.col("bundle").isin(bundles))
    return t.select("bundle", F.from_json("value", schema).alias("d")).select("bundle", "d.*")
