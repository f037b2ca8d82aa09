"""Files to tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.functions.geo import haversine
from tripspark.functions.text import STATES, clean_road_ref, road_key
from tripspark.operators.lines import decode_lines, encode_lines, line_metrics, polyline_deltas, simplify_lines

#: Number of each state in the municipality file.
UF_CODES = {11: "RO", 12: "AC", 13: "AM", 14: "RR", 15: "PA", 16: "AP", 17: "TO", 21: "MA", 22: "PI", 23: "CE", 24: "RN", 25: "PB", 26: "PE", 27: "AL", 28: "SE", 29: "BA", 31: "MG", 32: "ES", 33: "RJ", 35: "SP", 41: "PR", 42: "SC", 43: "RS", 50: "MS", 51: "MT", 52: "GO", 53: "DF"}
PLACE = "struct<label:string,city:string,region:string,country:string,countryCode:string,lat:double,lng:double>"
TRIP = (
    f"id string, name string, date string, mode string, startPlace {PLACE}, stopPlaces array<{PLACE}>, endPlace {PLACE}, visible boolean, createdAt string, updatedAt string, distance double, duration double, "
    f"roadLabels array<string>, routeGeometry struct<type:string,encodedPolyline:string,precision:int,coordinates:array<array<double>>>, conquests struct<cities:array<{PLACE}>,roads:array<string>>, roadSegments map<string,array<array<array<double>>>>"
)


def read_trips(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Trip documents with defaults filled in: lists empty instead of null, a creation time, road labels in canonical form,
    badge roads before stored ones, each once; road segments by canonical label (of equal labels all lines)."""
    t = spark.read.schema(TRIP).option("multiLine", multi_line).json(path)
    none = lambda c: F.coalesce(F.col(c), F.expr("array()").cast(t.schema[c].dataType))
    badges, stored = none("roadLabels"), F.coalesce("conquests.roads", F.array().cast("array<string>"))
    labels = F.filter(F.array_distinct(F.transform(F.concat(badges, stored), clean_road_ref)), lambda x: x != "")
    entries = F.transform(F.map_entries("roadSegments"), lambda e: F.struct(clean_road_ref(e["key"]).alias("k"), e["value"].alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    segments = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.flatten(F.transform(F.filter(entries, lambda e: e["k"] == k), lambda e: e["v"])))))
    return t.withColumns({
        "id": F.coalesce("id", F.sha2(F.to_json(F.struct(*[c for c in t.columns if c != "roadSegments"])), 256)), "stopPlaces": none("stopPlaces"), "roadLabels": F.transform(badges, clean_road_ref),
        "roads": labels, "createdAt": F.coalesce("createdAt", "updatedAt", "date"), "visible": F.coalesce("visible", F.lit(True)), "roadSegments": F.coalesce(segments, F.create_map().cast(t.schema["roadSegments"].dataType)),
    })


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (id, lat, lng, tags), ways (id, nodes, tags), relations (id, members, tags) of an OSM extract in XML."""
    tag = "tag array<struct<_k:string,_v:string>>"

    def rows(kind: str, schema: str) -> DataFrame:
        df = spark.read.format("xml").option("rowTag", kind).schema(f"_id long, {tag}, {schema}").load(path)
        tags = F.map_from_entries(F.transform(F.coalesce("tag", F.expr("array()").cast(df.schema["tag"].dataType)), lambda t: F.struct(t["_k"], t["_v"])))
        return df.withColumn("id", F.col("_id")).withColumn("tags", tags)

    nodes = rows("node", "_lat double, _lon double").select("id", F.col("_lat").alias("lat"), F.col("_lon").alias("lng"), "tags")
    ways = rows("way", "nd array<struct<_ref:long>>").select("id", F.col("nd._ref").alias("nodes"), "tags")
    relations = rows("relation", "member array<struct<_type:string,_ref:long,_role:string>>").select("id", F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members"), "tags")
    return nodes, ways, relations


def read_geonames(spark: SparkSession, path: str) -> DataFrame:
    """place_id, name, lat, lng, class, code, country, admin1, population of a tab file; rows of fewer than 19 fields are left out."""
    cells = F.split("value", "\t")
    t = spark.read.text(path).select(cells.alias("c")).filter(F.size("c") >= 19)
    at = lambda i, kind: F.col("c")[i].try_cast(kind)
    out = t.select(at(0, "long").alias("place_id"), F.col("c")[1].alias("name"), at(4, "double").alias("lat"), at(5, "double").alias("lng"), F.col("c")[6].alias("class"), F.col("c")[7].alias("code"), F.col("c")[8].alias("country"), F.col("c")[10].alias("admin1"), F.coalesce(at(14, "long"), F.lit(0)).alias("population"))
    return out.filter("place_id is not null and lat is not null and lng is not null")


def read_admin1(spark: SparkSession, path: str) -> DataFrame:
    """country, admin1, region: names of first-level areas."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 2)
    return t.select(F.substring_index(F.col("c")[0], ".", 1).alias("country"), F.substring_index(F.col("c")[0], ".", -1).alias("admin1"), F.col("c")[1].alias("region"))


def build_city_catalog(geonames: DataFrame, admin1: DataFrame) -> DataFrame:
    """country, place_id, name, lat, lng (5 decimals), region, population, code of relevant places; admin1 is a dimension of a few
    thousand rows."""
    from tripspark.operators.places import relevant_place

    kept = geonames.filter(relevant_place(F.col("class"), F.col("code"), F.col("population")))
    out = kept.join(admin1, ["country", "admin1"], "left")
    return out.select("country", "place_id", "name", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), F.coalesce("region", F.lit("")).alias("region"), "population", "code")


def read_municipalities(spark: SparkSession, path: str) -> DataFrame:
    """ibge, name, lat, lng, capital, uf, state; rows without a name or coordinates are left out."""
    t = spark.read.option("header", True).csv(path)
    codes, names = (F.create_map(*[F.lit(x) for p in table.items() for x in p]) for table in (UF_CODES, STATES))
    out = t.select(
        F.col("codigo_ibge").alias("ibge"), F.trim("nome").alias("name"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lng"),
        F.coalesce(F.col("capital") == "1", F.lit(False)).alias("capital"), F.element_at(codes, F.col("codigo_uf").try_cast("int")).alias("uf"))
    return out.filter("name <> '' and lat is not null and lng is not null").withColumn("state", F.element_at(names, F.col("uf")))


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    """iata, name, kind_rank, town, country, region, alat, alng of airports with scheduled flights."""
    t = spark.read.option("header", True).option("escape", '"').csv(path)
    rank = F.when(F.col("type") == "large_airport", 1).when(F.col("type") == "medium_airport", 2).when(F.col("type") == "small_airport", 3)
    out = t.filter((F.col("scheduled_service") == "yes") & (F.coalesce("iata_code", F.lit("")) != "") & rank.isNotNull())
    out = out.select(F.col("iata_code").alias("iata"), "name", rank.alias("kind_rank"), F.col("municipality").alias("town"), F.col("iso_country").alias("country"), F.col("iso_region").alias("region"), F.col("latitude_deg").try_cast("double").alias("alat"), F.col("longitude_deg").try_cast("double").alias("alng"))
    return out.filter(F.col("alat").between(-90, 90) & F.col("alng").between(-180, 180))


def _tracks(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """name and trkseg of a GPX file's tracks, without alternatives, car tracks and trails."""
    point = "struct<_lat:double,_lon:double>"
    t = spark.read.format("xml").option("rowTag", row_tag).schema(f"name string, trkseg array<struct<trkpt:array<{point}>>>").load(path)
    return t.filter(~F.coalesce("name", F.lit("")).rlike("(?i)alternativ|carro|trilha"))


def _latlng(p: Column) -> Column:
    return F.struct(p["_lat"].alias("lat"), p["_lon"].alias("lng"))


def read_gpx_tracks(spark: SparkSession, path: str, row_tag: str = "trk") -> DataFrame:
    """name, segment, coords (array of lat, lng) of a GPX file's tracks, without alternatives, car tracks and trails, and without
    segments of one point."""
    s = _tracks(spark, path, row_tag).select("name", F.posexplode("trkseg").alias("segment", "s"))
    return s.select("name", "segment", F.transform("s.trkpt", _latlng).alias("coords")).filter(F.size("coords") >= 2)


def _length_km(coords: Column) -> Column:
    """Great-circle length of an array of lat, lng in order."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(coords) - 1, F.lit(1))), lambda i: haversine(*[F.get(coords, k)[c] for k in (i - 1, i) for c in ("lat", "lng")]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def read_official_tracks(spark: SparkSession, path: str, least_km: float = 1.0, tolerance_m: float = 20.0, row_tag: str = "trk") -> DataFrame:
    """name, encoded, n_points, km of a GPX file's tracks, each with all its segments as one line: those of least_km or more, simplified.
    Lines that are equal forwards or backwards once simplified count once, under the least name (null first), then encoding; points without both
    coordinates are left out, and so are the tracks that read_gpx_tracks leaves out."""
    points = F.flatten(F.transform("trkseg", lambda s: F.coalesce(s["trkpt"], F.array().cast("array<struct<_lat:double,_lon:double>>"))))
    t = _tracks(spark, path, row_tag).select("name", F.filter(F.transform(points, _latlng), lambda p: p["lat"].isNotNull() & p["lng"].isNotNull()).alias("coords"))
    t = t.filter((F.size("coords") >= 2) & (_length_km(F.col("coords")) >= least_km)).select("name", F.sha2(F.to_json("coords"), 256).alias("line"), "coords")
    t = simplify_lines(t, tolerance_m).groupBy("line").agg(F.min(F.struct("name")).alias("n"), F.first("coords").alias("coords"))
    t = t.select("line", "n.name", _length_km(F.col("coords")).alias("km"), "coords")
    v = t.select("line", "name", "km", F.posexplode("coords").alias("seq", "p")).select("line", "name", "km", "seq", "p.*")
    there, back = encode_lines(v, ["line", "name", "km"]), encode_lines(v.withColumn("seq", -F.col("seq")), ["line"])
    both = there.join(back.select("line", F.col("encoded").alias("back_")), "line").groupBy(F.least("encoded", "back_").alias("either_"))
    return both.agg(F.min(F.struct("name", "encoded", "n_points", "km")).alias("f")).select("f.*")


CATALOG = "kind string, schema string, validationSchema string, key string, cacheVersion string, partial boolean, totalKm double, pointCount int, precision int, bounds array<array<double>>, compactToleranceM double, encodedLines array<string>"


def read_road_catalog(spark: SparkSession, path: str, version: str | None = None, expected: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Roads (key, totalKm, pointCount, lines, precision, bounds, compactToleranceM) that can be used, and the files that cannot: of another kind or
    version, partial, without a key, or without one line that decodes to two vertices or more.

    expected: what kind, schema and validationSchema must be; fields that are not named are not looked at. Lines that do not decode are left
    out of lines. A precision that is absent or 0 is 5, a tolerance 25 m; a length or number of points that is absent or 0 is that of the lines."""
    c = spark.read.schema(CATALOG).option("multiLine", True).option("recursiveFileLookup", True).json(path).select("*", F.col("_metadata.file_path").alias("file_"))
    good_lines = F.filter("encodedLines", lambda e: F.size(F.coalesce(polyline_deltas(e), F.array().cast("array<bigint>"))) >= 4)
    ok = F.col("key").isNotNull() & ~F.coalesce("partial", F.lit(False)) & (F.size(good_lines) >= 1)
    for field, value in ((expected or {}) | ({"cacheVersion": version} if version is not None else {})).items():
        ok = ok & (F.col(field) == value)
    c = c.withColumn("ok_", F.coalesce(ok, F.lit(False)))
    or_else = lambda name, other: F.when(F.coalesce(F.col(name), F.lit(0)) == 0, other).otherwise(F.col(name)).alias(name)
    good = c.filter("ok_").select("file_", "key", "totalKm", "pointCount", good_lines.alias("lines"), or_else("precision", F.lit(5)), "bounds", or_else("compactToleranceM", F.lit(25.0)))
    by = ["file_", "key", "precision", "line_"]
    lacking = good.filter("coalesce(totalKm, 0) = 0 or coalesce(pointCount, 0) = 0").select("file_", "key", "precision", F.posexplode("lines").alias("line_", "encoded"))
    scale = F.pow(F.lit(10.0), F.col("precision"))
    v = decode_lines(lacking, by, "encoded", 0).withColumns({"lat": F.col("lat") / scale, "lng": F.col("lng") / scale})
    own = line_metrics(v, by).groupBy("file_", "key").agg(F.sum("km").alias("km_"), F.sum("n_points").cast("int").alias("n_"))
    good = good.join(own, ["file_", "key"], "left").select("key", or_else("totalKm", F.col("km_")), or_else("pointCount", F.col("n_")), "lines", "precision", "bounds", "compactToleranceM")
    return good, c.filter("not ok_").drop("ok_", "file_")


def read_iconic_catalog(spark: SparkSession, specs: str, geometry: str) -> tuple[DataFrame, DataFrame]:
    """Routes with their geometry, disabled ones left out, and the ids of specs that have none."""
    s = spark.read.option("multiLine", True).json(specs)
    g = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema("id string, totalKm double, disabled boolean, sourceType string, encodedLines array<string>, alternateEncodedLines array<string>").json(geometry)
    live = g.filter(~F.coalesce("disabled", F.lit(False)))
    return s.join(live, "id"), s.join(g, "id", "left_anti").select("id")


def write_partitioned_catalog(roads: DataFrame, path: str, label: str = "key") -> DataFrame:
    """Write roads as JSON under country=/network=, one line for each key; returns those whose key has not three parts."""
    parts = F.split(label, r"\|")
    safe = lambda i: F.regexp_replace(F.lower(parts[i]), "[^a-z0-9_-]+", "-")
    ok = F.coalesce((F.size(parts) == 3) & ~F.exists(parts, lambda p: F.trim(p) == ""), F.lit(False))
    good = roads.filter(ok).withColumns({"country": safe(0), "network": safe(1), "number": safe(2)})
    good.repartition("country", "network").write.mode("overwrite").partitionBy("country", "network").json(path)
    return roads.filter(~ok)


def export_backup(trips: DataFrame, path: str) -> None:
    """Trips as JSON lines, without road segments."""
    trips.drop("roadSegments").write.mode("overwrite").json(path)


def import_backup(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Trips of a backup: a list of trips, an object with a list under `trips`, or (multi_line false) one trip a line."""
    if not multi_line:
        return read_trips(spark, path)
    t = spark.read.option("multiLine", True).schema(TRIP).json(path).filter("id is not null")
    wrapped = spark.read.option("multiLine", True).schema("trips array<string>").json(path).select(F.explode("trips").alias("s")).select(F.from_json("s", TRIP).alias("t")).select("t.*")
    return t.unionByName(wrapped)


def road_keys_of(labels: DataFrame) -> DataFrame:
    return labels.withColumn("road_key", road_key(F.col("label")))
