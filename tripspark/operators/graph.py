"""Graphs of line vertices: edges, chains, nearest nodes, shortest paths by rounds of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.geo import haversine
from tripspark.operators.coverage import edges
from tripspark.operators.rounds import Rounds

#: Ways that no trip is routed on, and how much a track counts over its length.
BLOCKED = ("footway", "path", "steps", "pedestrian", "cycleway", "construction", "proposed")
TRACK_FACTOR = 1.05


def graph_edges(vertices: DataFrame, by: list[str], places: int = 5) -> DataFrame:
    """src, dst, km: consecutive vertices of lines, both ways, least length of each pair; nodes are coordinates rounded to `places`."""
    e = edges(vertices.withColumns({c: F.round(c, places) for c in ("lat", "lng")}), by)
    node = lambda s: F.format_string(f"%.{places}f,%.{places}f", F.col(f"{s}lat"), F.col(f"{s}lng"))
    e = e.select(node("a").alias("src"), node("b").alias("dst"), haversine(*[F.col(c) for c in ("alat", "alng", "blat", "blng")]).alias("km")).filter("src <> dst")
    return e.union(e.select("dst", "src", "km")).groupBy("src", "dst").agg(F.min("km").alias("km"))


def edge_cost(km: Column, highway: Column) -> Column:
    """What an edge of a way of this class counts for in routing; null where none may go (no class, or a blocked one)."""
    return F.when(F.coalesce(highway, F.lit("")) == "", None).when(highway.isin(*BLOCKED), None).when(highway == "track", km * TRACK_FACTOR).otherwise(km)


def contract(graph: DataFrame, terminals: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """src, dst, km, last_src, last_dst, chain_km, n_left: each edge of graph (src, dst, km) and the chain that it is in.

    A chain runs on from the edge to the next junction; chain_km and n_left are what is left to there, and its last edge names it. A node
    is a junction if it is a terminal (node), or does not have the same two neighbours on its way in and out. Each round doubles how
    far every edge sees, so a chain of n edges takes log2(n) rounds. Left out are edges of null km or from a node to itself, all but
    the shortest of parallel ones, and rings without a junction, to which no path from a terminal leads."""
    rounds = rounds or Rounds(graph.sparkSession, "chains")
    e = graph.filter("src <> dst and km is not null").groupBy("src", "dst").agg(F.min("km").alias("km"))
    near = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("out")).union(e.select("dst", "src", F.lit(0)))
    near = near.groupBy("node", "other").agg(F.count("*").alias("ways"))
    inner = near.groupBy("node").agg(F.count("*").alias("n"), F.min("ways").alias("ways"), F.min("other").alias("one"), F.max("other").alias("two")).filter("n = 2 and ways = 2")
    inner = inner.join(terminals.select("node").distinct(), "node", "left_anti").select(F.col("node").alias("dst"), "one", "two")
    onward = F.when(F.col("one") == F.col("src"), F.col("two")).otherwise(F.col("one"))
    # to_src, to_dst: the edge that the view ends at; null once a junction is in sight
    view = e.join(inner, "dst", "left").select(
        "src", "dst", "km", F.when(onward.isNotNull(), F.col("dst")).alias("to_src"), onward.alias("to_dst"),
        F.col("src").alias("last_src"), F.col("dst").alias("last_dst"), F.col("km").alias("chain_km"), F.lit(1).cast("long").alias("n_left"))
    view = rounds.write("view", view.join(inner.select(F.col("dst").alias("src"), F.lit(True).alias("inside")), "src", "left"))
    while view.filter("to_src is not null and inside is null").take(1):
        there = view.select(*[F.col(c).alias(f"t_{c}") for c in ("src", "dst", "to_src", "to_dst", "last_src", "last_dst", "chain_km", "n_left")])
        far = view.join(there, (F.col("to_src") == F.col("t_src")) & (F.col("to_dst") == F.col("t_dst"))).select(
            "src", "dst", "km", F.col("t_to_src").alias("to_src"), F.col("t_to_dst").alias("to_dst"), F.col("t_last_src").alias("last_src"), F.col("t_last_dst").alias("last_dst"),
            (F.col("chain_km") + F.col("t_chain_km")).alias("chain_km"), (F.col("n_left") + F.col("t_n_left")).alias("n_left"), "inside")
        view = rounds.write("view", view.filter("to_src is null").unionByName(far))
    return view.filter("to_src is null").drop("to_src", "to_dst", "inside")


def _reached(chains: DataFrame, pairs: DataFrame, most_rounds: int, rounds: Rounds) -> DataFrame:
    """pair_id, target, node, km, n_edges, prev, last_src: junctions by the way of least km (of equals the fewest edges), the junction
    before each and the last edge's source. Nodes that are farther than a pair's target is known to be are not gone on from."""
    hops = chains.filter("src <> last_dst").groupBy("src", "last_dst").agg(F.min(F.struct("chain_km", "n_left", "last_src")).alias("h"))
    hops = rounds.write("hops", hops.select("src", F.col("last_dst").alias("dst"), F.col("h.chain_km").alias("more"), F.col("h.n_left").alias("n"), F.col("h.last_src").alias("via")))
    none = F.lit(None).cast(chains.schema["src"].dataType)
    known = pairs.filter("source is not null and target is not null").select(
        "pair_id", "target", F.col("source").alias("node"), F.lit(0.0).alias("km"), F.lit(0).cast("long").alias("n_edges"), none.alias("prev"), none.alias("last_src"), F.lit(True).alias("fresh"))
    known = rounds.write("known", known)
    for _ in range(most_rounds):
        bound = known.filter("node = target").select("pair_id", F.col("km").alias("at_most"))
        front = known.filter("fresh and node <> target").join(bound, "pair_id", "left").filter("at_most is null or km <= at_most")
        step = front.join(hops, F.col("node") == F.col("src")).select(
            "pair_id", "target", F.col("dst").alias("node"), (F.col("km") + F.col("more")).alias("km"), (F.col("n_edges") + F.col("n")).alias("n_edges"), F.col("node").alias("prev"), F.col("via").alias("last_src"), "fresh")
        both = known.withColumn("fresh", F.lit(False)).unionByName(step)
        best = both.groupBy("pair_id", "target", "node").agg(F.min(F.struct("km", "n_edges", "fresh", "prev", "last_src")).alias("b"))
        known = rounds.write("known", best.select("pair_id", "target", "node", "b.km", "b.n_edges", "b.prev", "b.last_src", "b.fresh"))
        if not known.filter("fresh").take(1):
            return known.drop("fresh")
    raise ValueError(f"paths still got shorter after {most_rounds} rounds")


def _terminals(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("source", "target")).alias("node")).filter("node is not null")


def shortest_paths(graph: DataFrame, pairs: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """pair_id, km, n_edges: the path of least km from source to target, of equals that of the fewest edges; null if there is none.

    graph: src, dst, km (0 or more); pairs: pair_id (unique), source, target. Chains between junctions are contracted first, so that the
    rounds of joins that follow are as many as the junctions on a path, not its vertices. Only whether rows are left comes back."""
    rounds = Rounds(graph.sparkSession, "paths")
    known = _reached(contract(graph, _terminals(pairs), rounds), pairs, most_rounds, rounds)
    found = known.filter("node = target").select("pair_id", "km", "n_edges")
    out = rounds.write("out", pairs.select("pair_id").join(found, "pair_id", "left"))
    rounds.drop("view", "hops", "known")
    return out


def shortest_path_edges(graph: DataFrame, pairs: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """pair_id, seq (1, 2, ...), src, dst, km: the edges of the paths of shortest_paths, in order.

    What lies on a path is marked back from its target by pointers that double, in rounds of the logarithm of the junctions; then the chains
    between them are expanded to edges."""
    rounds = Rounds(graph.sparkSession, "paths")
    chains = contract(graph, _terminals(pairs), rounds)
    known = _reached(chains, pairs, most_rounds, rounds)
    back = rounds.write("back", known.filter("prev is not null").select("pair_id", "node", F.col("prev").alias("to")))
    marked = rounds.write("marked", known.filter("node = target").select("pair_id", "node"))
    while back.take(1):
        marked = rounds.write("marked", marked.union(marked.join(back, ["pair_id", "node"]).select("pair_id", F.col("to").alias("node"))).distinct())
        further = back.select("pair_id", F.col("node").alias("to"), F.col("to").alias("next"))
        back = rounds.write("back", back.join(further, ["pair_id", "to"]).select("pair_id", "node", F.col("next").alias("to")))
    hops = known.join(marked, ["pair_id", "node"], "left_semi").filter("prev is not null").select("pair_id", "last_src", F.col("node").alias("last_dst"), "n_edges")
    out = hops.join(chains, ["last_src", "last_dst"]).select("pair_id", (F.col("n_edges") - F.col("n_left") + 1).alias("seq"), "src", "dst", "km")
    out = rounds.write("out", out)
    rounds.drop("view", "hops", "known", "back", "marked")
    return out


def snap_to_node(points: DataFrame, nodes: DataFrame, most_km: float = 50.0) -> DataFrame:
    """point_id, place_id, km: the nearest node (place_id, lat, lng) to each point."""
    from tripspark.operators.places import nearest

    return nearest(points, nodes, most_km)


def pick_geometry(candidates: DataFrame) -> DataFrame:
    """Of each route's candidate geometries (route_id, source, priority, n_points, ...) the first by priority with two points or more."""
    w = Window.partitionBy("route_id").orderBy("priority", "source")
    return candidates.filter("n_points >= 2").withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")
