"""Groups of routes and cities with places in them, first conquests with what their trips know, and what a road queue has left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.text import PARENT_STATE, STATES, key, plain
from tripspark.operators.marts import city_group, family_priority, numbers_in_order
from tripspark.operators.rounds import Rounds
from tripspark.operators.sizes import dealt
from tripspark.sources.shared import new_path

# Names that make a route's region foreign, without accents.
FOREIGN = [
    "argentina", "belize", "bolivia", "canada", "chile", "colombia", "costa rica", "ecuador", "el salvador", "equador", "estados unidos", "guatemala", "guiana", "honduras", "mexico",
    "panama", "paraguai", "paraguay", "peru", "suriname", "uruguai", "uruguay", "venezuela",
]
INTERSTATE, REGIONAL = "INTERSTATE", "REGIONAL"


def positions(rows: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """rows with each one's place (1, 2, ...) in its group, ascending, nulls first; rows of equal order are placed in any order and
    share a range, so an order that ends in a unique column is cut best.

    A group may hold any share of the rows: they are cut into ranges of the order, numbered in each, and begin after what the ranges
    before hold of their group. The ranges are written once, so that a lost executor leaves all numbers as they are."""
    path = new_path(rows.sparkSession, "ranges")
    rows.repartitionByRange(*by, *order).withColumn("range_", F.spark_partition_id()).write.parquet(path)
    cut = rows.sparkSession.read.parquet(path)
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = cut.groupBy(*by, "range_").agg(F.count("*").alias("n_")).select(*[F.col(c).alias(f"{c}_by_") for c in by], F.col("range_").alias("of_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    own = cut.withColumn("own_", F.row_number().over(Window.partitionBy(*by, "range_").orderBy(*order)))
    on = own["range_"] == starts["of_"]
    for c in by:
        on = on & own[c].eqNullSafe(starts[f"{c}_by_"])
    return own.join(starts, on).select(*rows.columns, (F.col("start_") + F.col("own_")).alias(name))


def route_kind(refs: Column, region: Column, category: Column) -> Column:
    """international, br or state, of a route's references, region and category."""
    refs = F.transform(F.coalesce(refs, F.array().cast("array<string>")), lambda r: F.upper(F.coalesce(r, F.lit(""))))
    region, category = (plain(F.coalesce(c, F.lit(""))) for c in (region, category))
    abroad = F.contains(category, F.lit("internacional")) | F.exists(refs, lambda r: F.startswith(r, F.lit("INT:"))) | region.rlike("|".join(FOREIGN))
    return F.when(abroad, "international").when(F.exists(refs, lambda r: r.rlike("^BR-[0-9]")), "br").otherwise("state")


def route_states(refs: Column, region: Column) -> Column:
    """Codes of the states, in order, that a route's references begin with (a smaller network counts for its state) or whose name or
    code is in its region as words of their own."""
    parents = F.create_map(*[F.lit(x) for p in PARENT_STATE.items() for x in p])
    prefix = F.transform(F.coalesce(refs, F.array().cast("array<string>")), lambda r: F.get(F.split(F.upper(F.coalesce(r, F.lit(""))), "-"), F.lit(0)))
    states = F.array(*[F.lit(s) for s in STATES])
    named = F.filter(F.transform(prefix, lambda p: F.coalesce(F.element_at(parents, p), p)), lambda p: F.array_contains(states, p))
    words = F.concat(F.lit(" "), plain(F.coalesce(region, F.lit(""))), F.lit(" "))
    known = F.array(*[F.struct(F.lit(s).alias("uf"), plain(F.lit(n)).alias("name")) for s, n in STATES.items()])
    inside = lambda x: F.contains(words, F.concat(F.lit(" "), x, F.lit(" ")))
    said = F.transform(F.filter(known, lambda s: inside(s["name"]) | inside(F.lower(s["uf"]))), lambda s: s["uf"])
    return F.array_sort(F.array_distinct(F.concat(named, said)))


def group_routes(routes: DataFrame) -> DataFrame:
    """route_id, kind, group_key, group_pos, pos. routes: route_id, name, family, category, region, road_refs (array).

    Routes of the kind state are grouped by their one state, INTERSTATE if they have several, REGIONAL if none; the other kinds are one
    group. Groups come by size, largest first, then by name; routes by family, name with numbers by value, name, id."""
    # the rules are worked out once, spread over all cores: a table of few bytes may come in one part
    routes = dealt(routes, routes.count(), "route_id")
    r = routes.withColumns({"kind": route_kind(*[F.col(c) for c in ("road_refs", "region", "category")]), "states_": route_states(F.col("road_refs"), F.col("region"))})
    r = Rounds(routes.sparkSession, "routes").write("routes", r.select("route_id", "name", "family", "category", "kind", "states_"))
    own = F.when(F.size("states_") == 1, F.col("states_")[0]).when(F.size("states_") > 1, INTERSTATE).otherwise(REGIONAL)
    r = r.select("route_id", "kind", F.when(F.col("kind") == "state", own).otherwise(F.upper("kind")).alias("group_key"),
                 family_priority(F.col("name"), F.col("family"), F.col("category")).alias("priority"), numbers_in_order(F.col("name")).alias("sorted"), "name")
    names = F.create_map(*[F.lit(x) for s in STATES.items() for x in s], F.lit(INTERSTATE), F.lit("Interestaduais"), F.lit(REGIONAL), F.lit("Regionais"))
    r = Rounds(routes.sparkSession, "sorted").write("sorted", r)
    placed = positions(r, ["kind", "group_key"], ["priority", "sorted", "name", "route_id"])
    size = placed.groupBy("kind", "group_key").agg(F.count("*").alias("n_"))  # 31 rows at most
    size = size.withColumn("group_pos", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n_"), plain(F.coalesce(F.element_at(names, F.col("group_key")), F.col("group_key"))), "group_key")))
    return placed.join(size, ["kind", "group_key"]).select("route_id", "kind", "group_key", "group_pos", "pos")


def ordered_city_groups(cities: DataFrame) -> DataFrame:
    """cities (user_id, city, label, region, country_code, country) with group_key, group_pos and pos: a user's states by name, then
    the unknown state, then countries; cities by name (the label if blank) without accents and with numbers by value, then as written."""
    name = F.when(F.trim(F.coalesce("city", F.lit(""))) != "", F.col("city")).otherwise(F.coalesce("label", F.lit("")))
    c = cities.withColumns({"group_key": city_group(*[F.col(x) for x in ("region", "label", "country_code", "country")]), "name_": name})
    c = positions(c.withColumn("sorted_", numbers_in_order(F.col("name_"))), ["user_id", "group_key"], ["sorted_", "name_"])
    names = F.create_map(*[F.lit(x) for s, n in STATES.items() for x in (f"BR-{s}", n)])
    groups = c.select(F.col("user_id").alias("user_"), F.col("group_key").alias("group_")).distinct()  # at most one for each state and country
    order = [F.col("group_").startswith("COUNTRY-"), F.col("group_") == "BR-OUTROS", plain(F.coalesce(F.element_at(names, F.col("group_")), F.col("group_"))), "group_"]
    groups = groups.withColumn("group_pos", F.row_number().over(Window.partitionBy("user_").orderBy(*order)))
    return c.join(groups, c["user_id"].eqNullSafe(groups["user_"]) & (c["group_key"] == groups["group_"])).select(*cities.columns, "group_key", "group_pos", "pos")


def city_snapshot(won: DataFrame, places: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """user_id, item_key, label, lat, lng, trip_id, trip_name, trip_date: the first conquest of each city by a user, the oldest trip first.

    won: user_id, trip_id, trip_name, trip_date, pos, label, city, lat, lng; the label is the city if blank, and a row without either is
    none. places: the places of each trip in order: trip_id, pos, label, city, region, country, lat, lng. excluded: user_id, trip_id
    of trips that do not count. A coordinate that is null comes from the trip's first place whose label (city, region and country if
    blank) is the item's, or whose city is its city."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    w = won.withColumn("label", F.when(blank("label"), F.col("city")).otherwise(F.col("label"))).withColumn("item_key", key(F.col("label"))).filter("item_key <> ''")
    if excluded is not None:
        w = w.join(excluded.select("user_id", "trip_id"), ["user_id", "trip_id"], "left_anti")
    kept = ["label", "city", "lat", "lng", "trip_name"]
    first = w.groupBy("user_id", "item_key").agg(F.min(F.struct("trip_date", "trip_id", "pos", *kept)).alias("f")).select("user_id", "item_key", "f.*")
    said = F.when(blank("label"), F.array_join(F.filter(F.array("city", "region", "country"), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")).otherwise(F.col("label"))
    names = lambda label, city: F.explode(F.array_distinct(F.array(F.struct(F.lit("label").alias("of"), key(label).alias("name")), F.struct(F.lit("city").alias("of"), key(city).alias("name"))))).alias("k")
    offered = places.select("trip_id", F.struct("pos", "lat", "lng").alias("place"), names(said, F.col("city"))).select("trip_id", "k.of", "k.name", "place").filter("name <> ''")
    offered = offered.groupBy("trip_id", "of", "name").agg(F.min("place").alias("place"))
    asked = first.filter("lat is null or lng is null").select("user_id", "item_key", "trip_id", names(F.col("item_key"), F.col("city"))).select("user_id", "item_key", "trip_id", "k.of", "k.name")
    source = asked.join(offered, ["trip_id", "of", "name"]).groupBy("user_id", "item_key").agg(F.min("place").alias("p"))
    out = first.join(source.withColumnRenamed("user_id", "u_").withColumnRenamed("item_key", "k_"), F.col("user_id").eqNullSafe(F.col("u_")) & (F.col("item_key") == F.col("k_")), "left")
    return out.select("user_id", "item_key", "label", F.coalesce("lat", "p.lat").alias("lat"), F.coalesce("lng", "p.lng").alias("lng"), "trip_id", "trip_name", "trip_date")


def profile_places(places: DataFrame) -> DataFrame:
    """user_id, n_states, n_countries of a user's places and cities (user_id, region, country_code, country): regions of Brazil by code
    or by name, and countries by code, by name where that is blank."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    region, code = F.lower(text("region")), F.upper(text("country_code"))
    home = (code == "BR") | text("country").rlike("(?i)brasil|brazil")
    country = F.when(code != "", code).otherwise(F.upper(text("country")))
    return places.groupBy("user_id").agg(F.count_distinct(F.when(home & (region != ""), region)).alias("n_states"), F.count_distinct(F.when(country != "", country)).alias("n_countries"))


def audit_queue(conquered: DataFrame, catalog: DataFrame, queue: DataFrame) -> DataFrame:
    """road_id, action, reason of every road that waits for its geometry or should: kept, added (pending) or dropped (complete: validated
    geometry is stored; orphan: nobody has conquered it any more). conquered, queue: road_id; catalog: road_id, validated."""
    c, q = conquered.select("road_id").distinct().withColumn("won_", F.lit(True)), queue.select("road_id").distinct().withColumn("waits_", F.lit(True))
    whole = catalog.groupBy("road_id").agg(F.coalesce(F.bool_or("validated"), F.lit(False)).alias("whole_"))
    j = c.join(q, "road_id", "full").join(whole, "road_id", "left")
    won, waits, whole = (F.coalesce(x, F.lit(False)) for x in ("won_", "waits_", "whole_"))
    action = F.when(~won, "dropped").when(whole & waits, "dropped").when(whole, None).when(waits, "kept").otherwise("added")
    return j.select("road_id", action.alias("action"), F.when(~won, "orphan").when(whole, "complete").otherwise("pending").alias("reason")).filter("action is not null")
