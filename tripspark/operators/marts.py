"""Achievement marts: first conquests, counts, groups, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.text import STATES, country_code, key, plain, state_of


def eligible_trips(trips: DataFrame) -> DataFrame:
    """Car and motorbike trips of two vertices or more."""
    return trips.filter(F.col("mode").isin("carro", "moto") & (F.col("n_points") >= 2))


def achievement_snapshot(conquests: DataFrame) -> DataFrame:
    """user_id, item_key, item, trip_id, trip_date: the first trip that won each item. conquests: user_id, trip_id, trip_date, item."""
    c = conquests.withColumn("item_key", key(F.col("item").cast("string"))).filter("item_key <> ''")
    first = F.min(F.struct("trip_date", "trip_id", "item")).alias("f")
    return c.groupBy("user_id", "item_key").agg(first).select("user_id", "item_key", F.col("f.item").alias("item"), F.col("f.trip_id").alias("trip_id"), F.col("f.trip_date").alias("trip_date"))


def new_conquests(items: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Distinct items (user_id, trip_id, item) whose key the user's snapshot lacks."""
    i = items.withColumn("item_key", key(F.col("item").cast("string")))
    return i.join(snapshot.select("user_id", "item_key"), ["user_id", "item_key"], "left_anti").select("user_id", "trip_id", "item").distinct()


def profile_stats(trips: DataFrame, cities: DataFrame, roads: DataFrame) -> DataFrame:
    """user_id, n_trips, km, n_cities, n_countries, n_roads: trips (user_id, distance_m), cities (user_id, place_id, country), roads (user_id, label)."""
    t = trips.groupBy("user_id").agg(F.count("*").alias("n_trips"), (F.sum("distance_m") / 1000).alias("km"))
    c = cities.groupBy("user_id").agg(F.count_distinct("place_id").alias("n_cities"), F.count_distinct("country").alias("n_countries"))
    r = roads.groupBy("user_id").agg(F.count_distinct("label").alias("n_roads"))
    return t.join(c, "user_id", "left").join(r, "user_id", "left").fillna(0, ["n_cities", "n_countries", "n_roads"])


def city_group(region: Column, label: Column, code: Column, country: Column) -> Column:
    """BR-XX by region, then by label; COUNTRY-XX abroad; BR-OUTROS if no state is known."""
    c, named = F.upper(F.trim(F.coalesce(code, F.lit("")))), plain(country)
    abroad = ((c != "") & ~c.isin("BR", "BRA")) | ((named != "") & ~named.isin("brasil", "brazil"))
    found = country_code(code, country)
    foreign = F.concat(F.lit("COUNTRY-"), F.when(found != "", found).otherwise(F.when(named != "", F.replace(named, F.lit(" "), F.lit("-"))).otherwise(F.lit("desconhecido"))))
    return F.when(abroad, foreign).otherwise(F.concat(F.lit("BR-"), F.coalesce(state_of(region), state_of(label), F.lit("OUTROS"))))


def group_cities(cities: DataFrame) -> DataFrame:
    """user_id, group_key, n_cities, pos: states by name, then the unknown state, then countries."""
    g = cities.withColumn("group_key", city_group(*[F.col(c) for c in ("region", "label", "country_code", "country")])).groupBy("user_id", "group_key").agg(F.count("*").alias("n_cities"))
    names = F.create_map(*[F.lit(x) for s, n in STATES.items() for x in (f"BR-{s}", n)])
    order = [F.col("group_key").startswith("COUNTRY-"), F.col("group_key") == "BR-OUTROS", plain(F.coalesce(F.element_at(names, F.col("group_key")), F.col("group_key"))), "group_key"]
    return g.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))


def recent_trips(trips: DataFrame, most: int = 5) -> DataFrame:
    """Each user's latest trips: user_id, trip_id, trip_date, pos."""
    w = Window.partitionBy("user_id").orderBy(F.desc("trip_date"), F.desc("trip_id"))
    return trips.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= most).select("user_id", "trip_id", "trip_date", "pos")


def road_report(progress: DataFrame, runs: DataFrame, cities: DataFrame, conquered: DataFrame) -> DataFrame:
    """user_id, road_id, traveled_km, total_km, percent, start_place, end_place for every conquered road: the places nearest to
    both ends of its longest run. Roads without progress keep nulls.

    runs: user_id, road_id, line_id, run_no, km, alat, alng, blat, blng (ends of the run); cities: place_id, lat, lng."""
    from tripspark.operators.places import nearest

    longest = runs.groupBy("user_id", "road_id").agg(F.max_by(F.struct("alat", "alng", "blat", "blng"), F.struct("km", -F.col("line_id"), -F.col("run_no"))).alias("r"))
    ends = longest.select("user_id", "road_id", F.explode(F.array(F.struct(F.lit("start").alias("end"), F.col("r.alat").alias("lat"), F.col("r.alng").alias("lng")), F.struct(F.lit("end").alias("end"), F.col("r.blat").alias("lat"), F.col("r.blng").alias("lng")))).alias("p"))
    ends = ends.select("user_id", "road_id", "p.*")
    # many runs begin or end at the same place: each is looked for once
    spot = nearest(ends.select(F.struct("lat", "lng").alias("point_id"), "lat", "lng").dropDuplicates(["lat", "lng"]), cities, 35.0).filter("place_id is not null")
    near = ends.join(spot.select("point_id.*", "place_id"), ["lat", "lng"]).groupBy("user_id", "road_id").agg(
        F.max(F.when(F.col("end") == "start", F.col("place_id"))).alias("start_place"), F.max(F.when(F.col("end") == "end", F.col("place_id"))).alias("end_place"))
    return conquered.join(progress, ["user_id", "road_id"], "left").join(near, ["user_id", "road_id"], "left").select("user_id", "road_id", "traveled_km", "total_km", "percent", "start_place", "end_place")


def compaction_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_lines, points_before, points_after, n_compacted of lines (line_id, n_points)."""
    j = before.join(after.select("line_id", F.col("n_points").alias("after_")), "line_id")
    return j.agg(F.count("*").alias("n_lines"), F.sum("n_points").alias("points_before"), F.sum("after_").alias("points_after"), F.count_if(F.col("after_") < F.col("n_points")).alias("n_compacted"))


def geometry_coverage_audit(conquered: DataFrame, catalog: DataFrame) -> DataFrame:
    """user_id, n_conquered, n_available, n_complete, n_pending, bytes: conquered roads (user_id, road_id) against stored geometry
    (road_id, validated, bytes)."""
    j = conquered.join(catalog.withColumn("there_", F.lit(True)), "road_id", "left")
    there = F.coalesce("there_", F.lit(False))
    return j.groupBy("user_id").agg(F.count("*").alias("n_conquered"), F.count_if(there).alias("n_available"), F.count_if(F.coalesce("validated", F.lit(False))).alias("n_complete"), F.count_if(~there).alias("n_pending"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def road_manifest(lines: DataFrame) -> DataFrame:
    """country, road_id, n_lines, n_points, km of every road (country, road_id, n_points, km), with sums by country and over all (nulls)."""
    return lines.rollup("country", "road_id").agg(F.count("*").alias("n_lines"), F.sum("n_points").alias("n_points"), F.sum("km").alias("km"))


def city_catalog_manifest(places: DataFrame) -> DataFrame:
    """country, n_places, population."""
    return places.groupBy("country").agg(F.count("*").alias("n_places"), F.sum("population").alias("population"))


def iconic_groups(specs: DataFrame) -> DataFrame:
    """kind, group_key, n_routes, pos: routes (route_id, n_countries, states array) by kind: international, one state, interstate
    or regional; larger groups first."""
    kind = F.when(F.col("n_countries") > 1, "international").when(F.size("states") == 1, "state").otherwise("br")
    group = F.when(F.col("n_countries") > 1, "international").when(F.size("states") == 1, F.col("states")[0]).when(F.size("states") > 1, "interstate").otherwise("regional")
    g = specs.groupBy(kind.alias("kind"), group.alias("group_key")).agg(F.count("*").alias("n_routes"))
    return g.withColumn("pos", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n_routes"), "group_key")))


def representative_points(points: DataFrame) -> DataFrame:
    """code, point_id: the middle one (floor(n / 2), from 0) of each country's points in order."""
    own = Window.partitionBy("code")
    p = points.withColumn("i_", F.row_number().over(own.orderBy("point_id")) - 1).withColumn("n_", F.count("*").over(own))
    return p.filter(F.col("i_") == F.floor(F.col("n_") / 2)).select("code", "point_id")


def check_min_length(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """segments (km, min_km) that are long enough, and those that are not."""
    ok = F.coalesce(F.col("km") >= F.col("min_km"), F.lit(False))
    return segments.filter(ok), segments.filter(~ok)


def family_priority(name: Column, family: Column, category: Column) -> Column:
    """Order of route families: 0 royal roads, 1 park roads, 2 paths, pilgrimages, historic and cultural routes, 3 the rest."""
    name, family, category = plain(name), plain(family), plain(category)
    path = F.startswith(name, F.lit("caminho ")) | F.startswith(name, F.lit("caminhos ")) | category.rlike("peregrin|historica|cultural")
    return (
        F.when((family == "estrada real") | F.startswith(name, F.lit("estrada real ")), 0)
        .when(F.contains(category, F.lit("estrada parque")) | F.contains(name, F.lit("estrada parque")), 1).when(path, 2).otherwise(3)
    )


def numbers_in_order(name: Column) -> Column:
    """plain(name) as a text that sorts with the numbers in it by their value, and before letters."""
    cut = F.regexp_extract_all(plain(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.array_join(F.transform(cut, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 6, "0"), bare(x))).otherwise(x)), "")


def family_priority_sort(routes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """routes (name, family, category) with priority and pos (1, 2, ...): by priority, then name without accents
    and with its numbers by value, then name, in each group."""
    ranked = routes.withColumn("priority", family_priority(F.col("name"), F.col("family"), F.col("category")))
    order = Window.partitionBy(*(group or ["priority"])).orderBy("priority", numbers_in_order(F.col("name")), "name")
    return ranked.withColumn("pos", F.row_number().over(order))
