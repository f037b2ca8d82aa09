"""Grid joins of edges, corridor coverage, runs, road progress, crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.geo import bearing, bearing_difference, edges_meet, ends_km, haversine, point_edge_km, squeeze_at
from tripspark.operators.sizes import BROADCAST_ROWS, dealt, is_small, small

CELL_DEG = 0.012
#: Tolerance in km, degrees, and places along an edge of the strict match.
STRICT = (0.08, 38.0, (0.0, 0.5, 1.0))
ENDS = ("alat", "alng", "blat", "blng")


def edges(vertices: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """by, seq, alat, alng, blat, blng: consecutive vertices (lat, lng) of each line."""
    w = Window.partitionBy(*by).orderBy(order)
    out = vertices.select(*by, F.col(order).alias("seq"), F.col("lat").alias("alat"), F.col("lng").alias("alng"), F.lead("lat").over(w).alias("blat"), F.lead("lng").over(w).alias("blng"))
    return out.filter("blat is not null")


def with_cells(e: DataFrame, pad_km: float, cell: float = CELL_DEG) -> DataFrame:
    """A row for each grid cell (cx, cy) of the edge's box, padded by pad_km."""
    low_lat, high_lat = F.least("alat", "blat"), F.greatest("alat", "blat")
    pad_lat = F.lit(pad_km / 110.574)
    pad_lng = pad_km / (111.32 * F.greatest(F.lit(0.05), F.cos(F.radians(F.greatest(F.abs(F.col("alat")), F.abs(F.col("blat")))))))
    xs = F.sequence(F.floor((F.least("alng", "blng") - pad_lng) / cell), F.floor((F.greatest("alng", "blng") + pad_lng) / cell))
    ys = F.sequence(F.floor((low_lat - pad_lat) / cell), F.floor((high_lat + pad_lat) / cell))
    return e.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def grid_candidates(left: DataFrame, right: DataFrame, on: list[str], pad_km: float, condition: Column, how: str = "left_semi", cell: float = CELL_DEG, points: tuple[float, ...] = ()) -> DataFrame:
    """Joins edges l_* of left and r_* of right (ends, and dir for their bearing) that share a grid cell and `on`, under
    condition. left's rows are padded; a semi join gives each left cell row at most once. points: places along left's edges
    that near_and_parallel asks for. Rows of cells of an inner join are never broadcast: Spark takes them for no more than the edges."""
    own = lambda df, s: df.withColumns({**{f"{s}_{c}": F.col(c) for c in ENDS}, f"{s}_dir": bearing(*[F.col(c) for c in ENDS])})
    l, r = with_cells(with_points(own(left, "l"), points), pad_km, cell).drop(*ENDS), with_cells(own(right, "r"), 0.0, cell).drop(*ENDS)
    keys = [*on, "cx", "cy"]
    r = r.select(*keys, "r_dir", *[f"r_{c}" for c in ENDS], *([c for c in right.columns if c not in (*on, *ENDS)] if how == "inner" else []))
    match = condition
    for k in keys:
        match = match & (l[k] == r[k])
    return l.hint("merge").join(r, match, how) if how == "inner" else l.join(r, match, how)


def with_points(e: DataFrame, points: tuple[float, ...]) -> DataFrame:
    """e with l_lat, l_lng and l_squeeze, numbered, of the points along its edges l_ (0 the start, 1 the end): what a point alone
    tells is worked out once for each edge, and the condition of a join stays short enough to be compiled."""
    l = [F.col(f"l_{c}") for c in ENDS]
    at = {f"l_lat{i}": l[0] + (l[2] - l[0]) * t for i, t in enumerate(points)} | {f"l_lng{i}": l[1] + (l[3] - l[1]) * t for i, t in enumerate(points)}
    return e.withColumns(at).withColumns({f"l_squeeze{i}": squeeze_at(F.col(f"l_lat{i}")) for i in range(len(points))}) if points else e


def near_and_parallel(tolerance_km: float, bearing_deg: float, points: tuple[float, ...] = (0.5,)) -> Column:
    """Points along edge l_ (see with_points) all within tolerance of edge r_, and the directions alike."""
    r = [F.col(f"r_{c}") for c in ENDS]
    ok = bearing_difference(F.col("l_dir"), F.col("r_dir")) <= bearing_deg
    for i in range(len(points)):
        ok = ok & (point_edge_km(F.col(f"l_lat{i}"), F.col(f"l_lng{i}"), *r, F.col(f"l_squeeze{i}")) <= tolerance_km)
    return ok


def corridor_coverage(roads: DataFrame, trips: DataFrame, tolerance_km: float = 0.20, bearing_deg: float = 55.0, points: tuple[float, ...] = (0.5,), cell: float = CELL_DEG) -> DataFrame:
    """user_id, road_id, line_id, seq, ends, km, covered: each edge of each road that a user's trips come near.

    An edge is covered if some trip edge runs alike (undirected) and lies within tolerance of its middle. roads: road_id,
    line_id, seq and ends; trips: user_id and ends. Edges of no length are ignored. Users who never share a grid cell
    with a road have no rows for it."""
    e = roads.filter(haversine(*map(F.col, ENDS)) > 1e-6)
    t = trips.filter(haversine(*map(F.col, ENDS)) > 1e-6).select("user_id", *ENDS)
    # users whose trips pass a road's cells; then, for those, every edge of the road
    road_cells = with_cells(e, tolerance_km, cell).select("road_id", "cx", "cy").distinct()
    trip_cells = with_cells(t, 0.0, cell)
    seen = trip_cells.select("user_id", "cx", "cy").distinct().join(road_cells, ["cx", "cy"]).select("user_id", "road_id").distinct()
    asked = e.join(seen, "road_id")
    met = grid_candidates(asked, t, ["user_id"], tolerance_km, near_and_parallel(tolerance_km, bearing_deg, points), cell=cell, points=points)
    met = met.select("user_id", "road_id", "line_id", "seq").distinct().withColumn("covered", F.lit(True))
    out = asked.join(met, ["user_id", "road_id", "line_id", "seq"], "left")
    return out.select("user_id", "road_id", "line_id", "seq", *ENDS, haversine(*map(F.col, ENDS)).alias("km"), F.coalesce("covered", F.lit(False)).alias("covered"))


def covered_edges(roads: DataFrame, trips: DataFrame, by: list[str], tolerance_km: float = 0.20, bearing_deg: float = 55.0, points: tuple[float, ...] = (0.5,), cell: float = CELL_DEG) -> DataFrame:
    """by, road_id, line_id, seq, pos, joined, km, covered (true): the covered edges alone, by the columns `by` of trips.

    Each side is dealt to cells once, whatever the number of users or trips that share a road; see corridor_coverage for the
    rule. pos is an edge's place among its line's edges of some length, joined whether it begins where the one before it ends. The rows
    are dealt by `by` and road_id, so what is grouped by these or more after that is not dealt again."""
    w = Window.partitionBy("road_id", "line_id").orderBy("seq")
    joined = F.coalesce((F.lag("blat").over(w) == F.col("alat")) & (F.lag("blng").over(w) == F.col("alng")), F.lit(False))
    length = haversine(*map(F.col, ENDS))
    e = roads.filter(length > 1e-6).select("road_id", "line_id", "seq", *ENDS, F.row_number().over(w).alias("pos"), joined.alias("joined"), length.alias("km"))
    t = trips.filter(length > 1e-6).select(*by, *ENDS)
    met = grid_candidates(e, t, [], tolerance_km, near_and_parallel(tolerance_km, bearing_deg, points), "inner", cell, points)
    met = met.select(*by, "road_id", "line_id", "seq", "pos", "joined", "km").repartition(*by, "road_id")
    return met.dropDuplicates([*by, "road_id", "line_id", "pos"]).withColumn("covered", F.lit(True))


def covered_runs(coverage: DataFrame, by: list[str]) -> DataFrame:
    """by, run_no, first_seq, last_seq, n_edges, km: consecutive covered edges that touch, by line.

    Where coverage has the covered edges alone, pos and joined (see covered_edges) tell which are consecutive."""
    w = Window.partitionBy(*by).orderBy("seq")
    if "pos" in coverage.columns:
        touch = F.col("joined") & (F.lag("pos").over(w) + 1 == F.col("pos"))
    else:
        touch = F.lag("covered").over(w) & (F.lag("blat").over(w) == F.col("alat")) & (F.lag("blng").over(w) == F.col("alng"))
    c = coverage.withColumn("start_", F.when(F.col("covered") & ~F.coalesce(touch, F.lit(False)), 1).otherwise(0))
    c = c.withColumn("run_no", F.sum("start_").over(w)).filter("covered")
    return c.groupBy(*by, "run_no").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_edges"), F.sum("km").alias("km"))


def road_progress(coverage: DataFrame, complete_ratio: float = 0.985) -> DataFrame:
    """user_id, road_id, total_edges, covered_edges, total_km, traveled_km, raw_percent (1 decimal), percent, end_to_end: a
    ratio of complete_ratio or more counts as all of the road."""
    g = coverage.groupBy("user_id", "road_id").agg(
        F.count("*").alias("total_edges"), F.count_if("covered").alias("covered_edges"),
        F.sum("km").alias("total_km"), F.coalesce(F.sum(F.when(F.col("covered"), F.col("km"))), F.lit(0.0)).alias("covered_km"),
    )
    return _shares(g, complete_ratio)


def progress_of(covered: DataFrame, roads: DataFrame, complete_ratio: float = 0.985) -> DataFrame:
    """What road_progress gives for roads of which a user has covered some (covered_edges by user_id, or their covered_runs), with each
    road's sums made once."""
    e = roads.withColumn("km", haversine(*map(F.col, ENDS))).filter("km > 1e-6")
    totals = e.groupBy("road_id").agg(F.count("*").alias("total_edges"), F.sum("km").alias("total_km"))
    n = F.sum("n_edges") if "n_edges" in covered.columns else F.count("*")
    own = covered.groupBy("user_id", "road_id").agg(n.alias("covered_edges"), F.sum("km").alias("covered_km"))
    return _shares(own.join(totals, "road_id"), complete_ratio)


def _shares(g: DataFrame, complete_ratio: float) -> DataFrame:
    ratio = F.when(F.col("total_km") > 0, F.least("covered_km", "total_km") / F.col("total_km")).otherwise(F.lit(0.0))
    full = ratio >= complete_ratio
    return g.select(
        "user_id", "road_id", "total_edges", "covered_edges", "total_km",
        F.when(full, F.col("total_km")).otherwise(F.least("covered_km", "total_km")).alias("traveled_km"),
        F.round(ratio * 100, 1).alias("raw_percent"), F.when(full, F.lit(100.0)).otherwise(ratio * 100).alias("percent"), full.alias("end_to_end"),
    )


def conquest_match(roads: DataFrame, trips: DataFrame, min_run_km: float = 2.0) -> DataFrame:
    """user_id, road_id, run_km, n_runs: roads of which a run of min_run_km or more is matched strictly: start, middle and end
    of an edge within 0.08 km of one trip edge, directions within 38 degrees."""
    c = covered_edges(roads, trips, ["user_id"], *STRICT)
    runs = covered_runs(c, ["user_id", "road_id", "line_id"]).filter(F.col("km") >= min_run_km)
    return runs.groupBy("user_id", "road_id").agg(F.max("km").alias("run_km"), F.count("*").alias("n_runs"))


def road_medal(progress: DataFrame, gold_roads: DataFrame) -> DataFrame:
    """progress (road_id, country, percent, ...) with medal: gold on a gold route's roads and for 85 percent in BR, silver
    abroad for 90 percent, else null."""
    g = gold_roads.select("road_id").distinct().withColumn("gold_", F.lit(True))
    medal = F.when(F.col("gold_") | (F.col("country") == "BR") & (F.col("percent") >= 85), "gold").when((F.col("country") != "BR") & (F.col("percent") >= 90), "silver")
    return progress.join(g, "road_id", "left").withColumn("medal", medal).drop("gold_")


#: Routes that are held against what a user has touched at a time, about.
ROUTES_AT_ONCE = 1000
#: Users whose pairs with all routes count for as many partitions as dealt gives their number.
USERS_AT_ONCE = 2500


def untouched_routes(done: DataFrame, specs: DataFrame) -> DataFrame:
    """user_id and the columns of specs (route_id, ...): each route that a user of done (user_id, route_id: once each) has no row of.

    These are users x routes rows, so they are made where they leave Spark: what is dealt to partitions and written to disk is done, and the
    routes, in lists of about ROUTES_AT_ONCE, are held against the touched ones of their list alone. No pair is shuffled, sorted or kept."""
    kind, n = specs.schema["route_id"].dataType, specs.count()
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(-(-n // ROUTES_AT_ONCE) or 1))
    lists = specs.groupBy(part(F.col("route_id")).alias("part_")).agg(F.collect_list(F.struct(*specs.columns)).alias("routes_"))
    route = F.when(F.col("user_id").isNotNull(), F.col("route_id").cast(kind))
    # by the rows that are made of a user, not by its own few, which Spark would put together in one partition
    own = dealt(done.select("user_id", route.alias("route_id")), USERS_AT_ONCE * n, "user_id").groupBy("user_id", part(F.col("route_id")).alias("part_")).agg(F.collect_list("route_id").alias("of_"))
    own = own.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("part_", "of_"))).alias("own_"))
    every = own.crossJoin(F.broadcast(lists) if n <= BROADCAST_ROWS else lists)
    mine = F.coalesce(F.try_element_at("own_", F.col("part_")), F.array().cast(own.schema["own_"].dataType.valueType))
    every = every.select("user_id", mine.alias("mine_"), F.explode("routes_").alias("r_"))
    return every.filter(~F.coalesce(F.array_contains("mine_", F.col("r_.route_id")), F.lit(False))).select("user_id", "r_.*")


def route_achievement(runs: DataFrame, specs: DataFrame, untouched: bool = True) -> DataFrame:
    """Every route of specs (route_id, is_long, min_km, total_km) for every user of runs (user_id, route_id, km): longest_km,
    traveled_km, percent, discovered, complete; zeros for routes not touched, which makes users x routes rows. Without `untouched`
    only routes that a user has a run of."""
    done = runs.groupBy("user_id", "route_id").agg(F.max("km").alias("longest_km"), F.sum("km").alias("traveled_km"))
    s = specs.select("route_id", "is_long", "min_km", "total_km")
    percent = F.when(F.col("total_km") > 0, F.least(F.lit(100.0), F.col("traveled_km") / F.col("total_km") * 100)).otherwise(F.lit(0.0))
    found = F.col("longest_km") >= F.col("min_km")
    complete = F.when(F.col("is_long"), percent >= 85).otherwise(found)
    if not untouched:
        return done.join(s, "route_id").select("user_id", "route_id", "longest_km", "traveled_km", percent.alias("percent"), found.alias("discovered"), complete.alias("complete"))
    own = done.fillna(0.0, ["longest_km", "traveled_km"]).filter("user_id is not null").join(small(s), "route_id")
    own = own.select("user_id", F.col("route_id").cast(s.schema["route_id"].dataType).alias("route_id"), "longest_km", "traveled_km", percent.alias("percent"), found.alias("discovered"), complete.alias("complete"))
    # a route not touched says the same for every user, so that is worked out once
    zero = s.withColumns({"longest_km": F.lit(0.0), "traveled_km": F.lit(0.0)}).select("route_id", found.alias("discovered"), complete.alias("complete"))
    none = untouched_routes(done, zero).select("user_id", "route_id", *[F.lit(0.0).alias(c) for c in ("longest_km", "traveled_km", "percent")], "discovered", "complete")
    return own.union(none)


def route_medals(runs: DataFrame, specs: DataFrame, untouched: bool = False) -> DataFrame:
    """user_id, route_id, and for the official and the alternative lines of a route (prefix alternative_) traveled_km, percent and
    longest_km; discovered, complete, medal: gold for the official lines, silver if only the alternative ones are complete and the
    route gives medals for both, else null.

    runs: user_id, route_id, variant (official, alternative), km of continuous runs; specs: route_id, is_long, complete_percent (null: 85),
    min_km (null: 2), total_km, alternative_km (null or 0: no alternative lines), both. Long routes are complete by percent, others once
    discovered. Routes without a run are left out; with `untouched` every user gets every route, which makes users x routes rows."""
    official = F.col("variant") == "official"
    sums = [f(F.when(v, F.col("km"))).alias(n) for v, s in ((official, ""), (F.col("variant") == "alternative", "alternative_")) for f, n in ((F.sum, s + "traveled_km"), (F.max, s + "longest_km"))]
    done = runs.groupBy("user_id", "route_id").agg(*sums)
    if untouched:
        none = untouched_routes(done, specs.select("route_id"))
        done = done.filter("user_id is not null").unionByName(none, allowMissingColumns=True)
    j = done.join(specs.select("route_id", "is_long", "complete_percent", "min_km", "total_km", "alternative_km", "both"), "route_id")
    names = ["traveled_km", "longest_km", "alternative_traveled_km", "alternative_longest_km"]
    j = j.fillna(0.0, names).withColumn("there_", F.coalesce(F.col("alternative_km") > 0, F.lit(False)))
    for s, total in (("", F.coalesce("total_km", F.lit(0.0))), ("alternative_", F.coalesce("alternative_km", F.lit(0.0)))):
        j = j.withColumn(s + "traveled_km", F.least(F.col(s + "traveled_km"), total)).withColumn(s + "percent", F.when(total > 0, F.col(s + "traveled_km") / total * 100).otherwise(F.lit(0.0)))
        found = F.col(s + "longest_km") >= F.when(F.col("min_km") > 0, F.col("min_km")).otherwise(2.0)
        won = F.when(F.col("is_long"), F.col(s + "percent") >= F.when(F.col("complete_percent") > 0, F.col("complete_percent")).otherwise(85.0)).otherwise(found)
        there = F.col("there_") if s else F.lit(True)
        j = j.withColumn(s + "found_", there & found).withColumn(s + "won_", there & won)
    silver = F.coalesce("both", F.lit(False)) & F.col("alternative_won_")
    medal = F.when(F.col("won_"), "gold").when(silver, "silver")
    return j.select("user_id", "route_id", "traveled_km", "percent", "longest_km", *[f"alternative_{c}" for c in ("traveled_km", "percent", "longest_km")], (F.col("found_") | F.col("alternative_found_")).alias("discovered"), medal.isNotNull().alias("complete"), medal.alias("medal"))


def line_crossing(routes: DataFrame, trips: DataFrame, tolerance_km: float = 0.04, min_angle: float = 25.0) -> DataFrame:
    """trip_id, route_id: a trip's edge meets a route's, or comes within tolerance at an angle of min_angle or more."""
    angle = bearing_difference(F.col("l_dir"), F.col("r_dir"))
    hit = edges_meet("l_", "r_")
    if tolerance_km > 0:
        hit = hit | (angle >= min_angle) & (ends_km("l_", "r_") <= tolerance_km)
    return grid_candidates(trips.select("trip_id", *ENDS), routes.select("route_id", *ENDS), [], tolerance_km, hit, "inner").select("trip_id", "route_id").distinct()


def routes_for_trip(travelled: DataFrame, crossed: DataFrame) -> DataFrame:
    """trip_id, route_id, km, kind, pos: routes travelled (trip_id, route_id, km) first, longest first, then those only crossed."""
    only = crossed.join(travelled, ["trip_id", "route_id"], "left_anti").select("trip_id", "route_id", F.lit(0.0).alias("km"), F.lit("crossed").alias("kind"))
    both = travelled.select("trip_id", "route_id", "km", F.lit("travelled").alias("kind")).union(only)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("trip_id").orderBy(F.desc("kind"), F.desc("km"), "route_id")))


def traversal_density(trips: DataFrame, cell: float = CELL_DEG) -> DataFrame:
    """cx, cy, n_trips: distinct trips in each grid cell."""
    return with_cells(trips.select("trip_id", *ENDS), 0.0, cell).groupBy("cx", "cy").agg(F.count_distinct("trip_id").alias("n_trips"))


def bbox_prefilter(trips: DataFrame, routes: DataFrame, pad_deg: float = 0.025) -> DataFrame:
    """trip_id, route_id whose boxes (s, w, n, e) overlap, the route's padded; a missing box always passes.

    A list of routes that is too long to send to every executor is matched by cells of a degree first."""
    if not is_small(routes):
        box = F.col("s").isNotNull() & F.col("w").isNotNull() & F.col("n").isNotNull() & F.col("e").isNotNull()
        cut = lambda df, pad: df.filter(box).withColumn("cx", F.explode(F.sequence(F.floor(F.col("w") - pad), F.floor(F.col("e") + pad)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("s") - pad), F.floor(F.col("n") + pad))))
        t, r = cut(trips, 0.0).alias("t"), cut(routes, pad_deg).alias("r")
        over = (F.col("t.n") >= F.col("r.s") - pad_deg) & (F.col("t.s") <= F.col("r.n") + pad_deg) & (F.col("t.e") >= F.col("r.w") - pad_deg) & (F.col("t.w") <= F.col("r.e") + pad_deg)
        met = t.join(r, (F.col("t.cx") == F.col("r.cx")) & (F.col("t.cy") == F.col("r.cy")) & over).select("t.trip_id", "r.route_id").distinct()
        open_trips = trips.filter(~box).select("trip_id").crossJoin(routes.select("route_id"))  # each of these pairs is a result
        open_routes = trips.filter(box).select("trip_id").crossJoin(routes.filter(~box).select("route_id"))
        return met.union(open_trips).union(open_routes)
    t, r = trips.alias("t"), F.broadcast(routes).alias("r")
    over = (F.col("t.n") >= F.col("r.s") - pad_deg) & (F.col("t.s") <= F.col("r.n") + pad_deg) & (F.col("t.e") >= F.col("r.w") - pad_deg) & (F.col("t.w") <= F.col("r.e") + pad_deg)
    return t.join(r, F.coalesce(over, F.lit(True))).select("t.trip_id", "r.route_id")
