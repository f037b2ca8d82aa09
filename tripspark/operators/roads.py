"""Road labels along routes: groups, runs of steps, order and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.text import key, parse_road_code
from tripspark.operators.rounds import Rounds
from tripspark.operators.sizes import small


def road_groups(steps: DataFrame, max_gap_km: float = 20.0, min_km: float = 20.0) -> DataFrame:
    """trip_id, label, group_no, first_step, road_km, middle_step, middle_km: stretches of one label that at most max_gap_km
    of other road (unlabelled too) separate, if they come to more than min_km; and the step and the km into it where half
    the group's own length is reached.

    steps: trip_id, step_no, label (empty for none), km. Steps of no length are left out."""
    route = Window.partitionBy("trip_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, -1)
    s = steps.filter("km > 0").withColumn("from_km", F.coalesce(F.sum("km").over(route), F.lit(0.0)))
    s = s.withColumn("label", F.trim(F.coalesce("label", F.lit("")))).filter("label <> ''").withColumn("key_", key(F.col("label")))
    own = Window.partitionBy("trip_id", "key_").orderBy("step_no")
    gap = F.col("from_km") - F.lag(F.col("from_km") + F.col("km")).over(own)
    s = s.withColumn("new_", F.when(gap > max_gap_km, 1).otherwise(0)).withColumn("group_no", F.sum("new_").over(own))
    group = Window.partitionBy("trip_id", "key_", "group_no")
    s = s.withColumn("before_", F.coalesce(F.sum("km").over(group.orderBy("step_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("road_km", F.sum("km").over(group))
    half = F.col("road_km") / 2
    middle = (F.col("before_") < half) & (F.col("before_") + F.col("km") >= half)
    g = s.filter("road_km > {}".format(min_km)).groupBy("trip_id", "key_", "group_no").agg(
        F.min_by("label", "step_no").alias("label"), F.min("step_no").alias("first_step"), F.max("road_km").alias("road_km"),
        F.min(F.when(middle, F.col("step_no"))).alias("middle_step"), F.min(F.when(middle, half - F.col("before_"))).alias("middle_km"))
    return g.select("trip_id", "label", "group_no", "first_step", "road_km", "middle_step", "middle_km")


def ordered_badges(groups: DataFrame) -> DataFrame:
    """trip_id, label, pos: distinct labels of a route's groups in order of appearance."""
    first = groups.groupBy("trip_id", "label").agg(F.min("first_step").alias("first_step"))
    return first.select("trip_id", "label", F.row_number().over(Window.partitionBy("trip_id").orderBy("first_step", "label")).alias("pos"))


def base_label_groups(steps: DataFrame) -> DataFrame:
    """trip_id, run_no, label, n_steps, km, middle_step: runs of steps with one label; a step without one breaks a run."""
    w = Window.partitionBy("trip_id").orderBy("step_no")
    s = steps.withColumn("label", F.coalesce("label", F.lit("")))
    s = s.withColumn("run_no", F.sum(F.when(F.col("label") == F.lag("label").over(w), 0).otherwise(1)).over(w)).filter("label <> ''")
    own = Window.partitionBy("trip_id", "run_no")
    s = s.withColumn("i_", F.row_number().over(own.orderBy("step_no")) - 1).withColumn("n_", F.count("*").over(own))
    return s.groupBy("trip_id", "run_no", "label").agg(F.count("*").alias("n_steps"), F.sum("km").alias("km"), F.min(F.when(F.col("i_") == F.floor(F.col("n_") / 2), F.col("step_no"))).alias("middle_step"))


def merge_step_segments(segments: DataFrame, gap_km: float = 0.15) -> DataFrame:
    """trip_id, label, piece, first_step, last_step, km: segments (trip_id, step_no, label, start_km, km) of one label that follow
    one another with a gap under gap_km are joined."""
    w = Window.partitionBy("trip_id", "label").orderBy("step_no")
    gap = F.col("start_km") - F.lag(F.col("start_km") + F.col("km")).over(w)
    s = segments.withColumn("piece", F.sum(F.when(gap < gap_km, 0).otherwise(1)).over(w))
    return s.groupBy("trip_id", "label", "piece").agg(F.min("step_no").alias("first_step"), F.max("step_no").alias("last_step"), F.sum("km").alias("km"))


def carry_country_hint(steps: DataFrame) -> DataFrame:
    """steps (trip_id, step_no, code) with hint: the last code seen up to the step; null before the first."""
    w = Window.partitionBy("trip_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("hint", F.last("code", ignorenulls=True).over(w))


def vote_country(points: DataFrame) -> DataFrame:
    """trip_id, step_no, code: the code most of a step's points (trip_id, step_no, point_no, code) are in; of equals the earliest."""
    g = points.filter(F.coalesce("code", F.lit("")) != "").groupBy("trip_id", "step_no", "code").agg(F.count("*").alias("n"), F.min("point_no").alias("first"))
    return g.groupBy("trip_id", "step_no").agg(F.max_by("code", F.struct("n", -F.col("first"))).alias("code"))


def ordered_roads(badges: DataFrame, conquered: DataFrame) -> DataFrame:
    """trip_id, label, pos: conquered roads (trip_id, label, ord) in badge order (trip_id, label, pos) first, the rest after."""
    c = conquered.withColumn("key_", key(F.col("label"))).groupBy("trip_id", "key_").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"))
    b = badges.withColumn("key_", key(F.col("label"))).groupBy("trip_id", "key_").agg(F.min("pos").alias("badge"))
    w = Window.partitionBy("trip_id").orderBy(F.col("badge").asc_nulls_last(), "ord")
    return c.join(b, ["trip_id", "key_"], "left").select("trip_id", "label", F.row_number().over(w).alias("pos"))


def route_summary(steps: DataFrame, most: int = 4) -> DataFrame:
    """trip_id, summary: the first `most` distinct road labels of a route, joined."""
    s = steps.filter(F.coalesce("label", F.lit("")) != "").groupBy("trip_id", "label").agg(F.min("step_no").alias("first"))
    s = s.withColumn("pos", F.row_number().over(Window.partitionBy("trip_id").orderBy("first", "label"))).filter(F.col("pos") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "label")))
    return s.groupBy("trip_id").agg(F.array_join(F.transform(ordered, lambda x: x["label"]), " · ").alias("summary"))


def rank_road_achievements(roads: DataFrame) -> DataFrame:
    """user_id, label, tier, state, pos: federal roads by number, then states by how many roads they have, name and number,
    then roads abroad in the order of their first conquest. roads: user_id, label, first_at."""
    # a label's parts are worked out once, not for each user that has it
    p, parsed = F.col("p_"), roads.select("label").distinct().withColumn("p_", parse_road_code(F.col("label")))
    parsed = Rounds(roads.sparkSession, "labels").write("labels", parsed)
    r = roads.join(small(parsed), "label", "left").withColumn("tier", F.when(p["international"], 3).when(p["federal"], 1).otherwise(2))
    r = r.withColumn("state", F.when(F.col("tier") == 3, "").when(F.col("tier") == 1, "BR").otherwise(F.coalesce(p["parent_state"], F.substring_index(F.upper("label"), "-", 1))))
    r = r.withColumn("number", F.coalesce(F.regexp_extract(F.coalesce(p["number"], "label"), r"\d{1,4}", 0).try_cast("int"), F.lit(0)))
    r = r.withColumn("n_state", F.when(F.col("tier") == 2, F.count("*").over(Window.partitionBy("user_id", "tier", "state"))).otherwise(0))
    order = ["tier", F.desc("n_state"), "state", F.when(F.col("tier") < 3, F.col("number")).otherwise(0), F.when(F.col("tier") == 3, F.col("first_at")), "label"]
    return r.select("user_id", "label", "tier", "state", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).alias("pos"))


def road_groups_from_segments(segments: DataFrame, max_gap_km: float = 20.0, min_km: float = 20.0) -> DataFrame:
    """trip_id, label, group_no, road_km: the same groups from stored pieces (trip_id, label, ord, coords) that have no order along
    the route's steps: each piece is turned so that its nearer end follows the piece before, and a gap over max_gap_km between
    those ends begins a new group. How a piece is turned depends on the one before, so a trip's road is gone through in turn."""
    import math

    import pyarrow as pa

    def far(a: dict, b: dict) -> float:
        p, q = math.radians(a["lat"]), math.radians(b["lat"])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lng"] - a["lng"]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))

    def run(key, table):
        groups, end = [], None
        for row in sorted(table.to_pylist(), key=lambda r: r["ord"]):
            line = row["coords"] or []
            if len(line) < 2:
                continue
            if end is not None and far(end, line[-1]) < far(end, line[0]):
                line = line[::-1]
            if end is None or far(end, line[0]) > max_gap_km:
                groups.append(0.0)
            groups[-1] += sum(far(a, b) for a, b in zip(line, line[1:]))
            end = line[-1]
        kept = [(i, km) for i, km in enumerate(groups) if km > min_km]
        return pa.table({"trip_id": pa.array([key[0].as_py()] * len(kept), pa.int64()), "label": pa.array([key[1].as_py()] * len(kept), pa.string()), "group_no": pa.array([i for i, _ in kept], pa.int32()), "road_km": pa.array([km for _, km in kept], pa.float64())})

    pieces = segments.select(F.col("trip_id").cast("long").alias("trip_id"), "label", "ord", "coords")
    return pieces.groupBy("trip_id", "label").applyInArrow(run, "trip_id long, label string, group_no int, road_km double")


def order_route_points(points: DataFrame) -> DataFrame:
    """points (trip_id, kind, ord, progress) with pos: by progress; within 1e-6 stops before adjustments, then in input order."""
    w = Window.partitionBy("trip_id").orderBy(F.round("progress", 6), F.when(F.col("kind") == "stop", 0).otherwise(1), "ord")
    return points.withColumn("pos", F.row_number().over(w))


def preserve_waypoints(controls: DataFrame, waypoints: DataFrame) -> DataFrame:
    """waypoints (trip_id, waypoint_id, progress) with after_ord: the control point they stand after.

    controls: trip_id, ord, progress of the new list of places; their progress is made to rise by 1e-4 at least from each to
    the next. Waypoints before the first control get null."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "progress")))
    c = controls.groupBy("trip_id").agg(ordered.alias("cs"))
    start = F.struct(F.lit(-1.0).alias("last"), F.array().cast("array<struct<ord:bigint,at:double>>").alias("out"))

    def step(s, x):
        at = F.greatest(x["progress"], s["last"] + 1e-4)
        return F.struct(at.alias("last"), F.concat(s["out"], F.array(F.struct(x["ord"].cast("long").alias("ord"), at.alias("at")))).alias("out"))

    c = c.select("trip_id", F.aggregate("cs", start, step)["out"].alias("cs"))
    j = waypoints.join(c, "trip_id", "left")
    return j.withColumn("after_ord", F.get(F.reverse(F.filter("cs", lambda x: x["at"] <= F.col("progress"))), F.lit(0))["ord"]).drop("cs")
