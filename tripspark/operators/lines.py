"""Line tables: polylines to vertices and back, metrics, cleaning, sampling, cutting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.geo import haversine
from tripspark.operators.coverage import edges


def polyline_deltas(encoded: Column) -> Column:
    """Signed steps of an encoded polyline, latitude and longitude in turn; null if it is cut short or has other characters.

    The characters of each step are cut out first, so a line costs as much as its length, whatever that is."""
    steps = F.regexp_extract_all(encoded, F.lit(r"[_-~]*[?-^]"), F.lit(0))

    def value(step: Column) -> Column:
        digits = F.transform(F.split(step, ""), lambda c: F.ascii(c) - 63)
        places = F.transform(F.filter(digits, lambda d: d >= 0), lambda d, i: F.when(i < 13, d.bitwiseAND(31).cast("bigint") * F.pow(F.lit(32.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(places, F.lit(0).cast("bigint"), lambda a, x: a + x)

    signed = F.transform(F.transform(steps, value), lambda v: F.when(v % 2 == 1, -F.floor(v / 2) - 1).otherwise(F.floor(v / 2)).cast("bigint"))
    return F.when(encoded.rlike(r"\A[?-~]*[?-^]\z") & (F.size(steps) % 2 == 0), signed)


def decode_lines(lines: DataFrame, by: list[str], encoded: str = "encoded", precision: int = 5) -> DataFrame:
    """by, seq, lat, lng: vertices of encoded polylines. Null, empty and corrupt ones have none."""
    d = lines.select(*by, F.posexplode(polyline_deltas(F.col(encoded))).alias("i", "step"))
    w = Window.partitionBy(*by, "axis").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(*by, F.floor(F.col("i") / 2).cast("int").alias("seq"), (F.col("i") % 2).alias("axis"), "step").withColumn("at", F.sum("step").over(w))
    scale = 10.0**precision
    return d.groupBy(*by, "seq").agg((F.max(F.when(F.col("axis") == 0, F.col("at"))) / scale).alias("lat"), (F.max(F.when(F.col("axis") == 1, F.col("at"))) / scale).alias("lng"))


def _signs(step: Column) -> Column:
    """One step as polyline characters."""
    zigzag = F.when(step < 0, -step * 2 - 1).otherwise(step * 2).cast("bigint")
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(F.bin(zigzag)) - 1) / 5)).cast("int"))
    chars = F.transform(parts, lambda k: F.chr((F.floor(zigzag / F.pow(F.lit(32.0), k)) % 32 + F.when(k < F.size(parts) - 1, 32).otherwise(0) + 63).cast("int")))
    return F.array_join(chars, "")


def encode_lines(vertices: DataFrame, by: list[str], precision: int = 5) -> DataFrame:
    """by, encoded, n_points: vertices (seq, lat, lng) as polylines; halves are rounded up."""
    w = Window.partitionBy(*by).orderBy("seq")
    v = vertices.select(*by, "seq", *[F.floor(F.col(c) * 10.0**precision + 0.5).cast("bigint").alias(c) for c in ("lat", "lng")])
    v = v.select(*by, "seq", *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(c) for c in ("lat", "lng")])
    v = v.select(*by, F.struct("seq", F.concat(_signs(F.col("lat")), _signs(F.col("lng"))).alias("s")).alias("p"))
    ordered = F.array_sort(F.collect_list("p"))  # one line's vertices
    return v.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda p: p["s"]), "").alias("encoded"), F.count("*").alias("n_points"))


def line_metrics(vertices: DataFrame, by: list[str]) -> DataFrame:
    """by, n_points, km, s, w, n, e: vertices, great-circle length and box of each line."""
    w = Window.partitionBy(*by).orderBy("seq")
    step = haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    return vertices.withColumn("step_", F.coalesce(step, F.lit(0.0))).groupBy(*by).agg(
        F.count("*").alias("n_points"), F.sum("step_").alias("km"), F.min("lat").alias("s"), F.min("lng").alias("w"), F.max("lat").alias("n"), F.max("lng").alias("e"))


def clean_points(vertices: DataFrame, by: list[str], unwrapped: bool = False) -> DataFrame:
    """by, seq, lat, lng: points in range that differ from the point before; lines of fewer than two are left out. seq is numbered anew.

    unwrapped: longitudes go on past 180 degrees, so any of them is in range."""
    v = vertices.filter(F.col("lat").between(-90, 90) & (F.col("lng").isNotNull() if unwrapped else F.col("lng").between(-180, 180)))
    w = Window.partitionBy(*by).orderBy("seq")
    same = (F.abs(F.col("lat") - F.lag("lat").over(w)) < 1e-7) & (F.abs(F.col("lng") - F.lag("lng").over(w)) < 1e-7)
    v = v.withColumn("same_", F.coalesce(same, F.lit(False))).filter(~F.col("same_")).drop("same_")
    v = v.withColumn("of_", F.count("*").over(Window.partitionBy(*by))).withColumn("seq", F.row_number().over(w) - 1)
    return v.filter("of_ >= 2").select(*by, "seq", "lat", "lng")


def sample_evenly(vertices: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most `most` vertices of each line, at even places, first and last among them, none twice."""
    w = Window.partitionBy(*by)
    v = vertices.withColumn("i_", F.row_number().over(w.orderBy("seq")) - 1).withColumn("n_", F.count("*").over(w))
    # vertex i is kept if it is the rounded place of some k of most
    k = F.ceil((F.col("i_") - 0.5) * (most - 1) / (F.col("n_") - 1))
    kept = (F.col("n_") <= most) | (F.floor(k * (F.col("n_") - 1) / (most - 1) + 0.5) == F.col("i_"))
    return v.filter(kept).drop("i_", "n_")


def dedupe_lines(vertices: DataFrame, by: list[str], line: str, places: int = 5) -> DataFrame:
    """by and the least line of each set of lines of a group that are equal, forwards or backwards, at `places` decimals."""
    p = vertices.select(*by, line, F.struct("seq", F.concat_ws(",", F.format_number("lat", places), F.format_number("lng", places)).alias("p")).alias("v"))
    p = p.groupBy(*by, line).agg(F.array_sort(F.collect_list("v")).alias("vs"))
    forward = F.transform("vs", lambda v: v["p"])
    sign = F.sha2(F.least(F.array_join(forward, ";"), F.array_join(F.reverse(forward), ";")), 256)
    return p.groupBy(*by, sign.alias("sign")).agg(F.min(line).alias(line)).drop("sign")


def great_circle_route(stops: DataFrame, by: list[str], points: int = 81) -> DataFrame:
    """by, seq, lat, lng: stops (seq, lat, lng) joined by great circles of `points` vertices, joints once."""
    e = edges(stops, by).select(*by, F.col("seq").alias("leg"), "alat", "alng", "blat", "blng", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    a1, o1, a2, o2 = (F.radians(c) for c in ("alat", "alng", "blat", "blng"))
    half = F.pow(F.sin((a2 - a1) / 2), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), F.lit(2.0))
    d, t = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(half))), F.col("k") / (points - 1)
    p, q = F.when(d == 0, 1 - t).otherwise(F.sin((1 - t) * d) / F.sin(d)), F.when(d == 0, t).otherwise(F.sin(t * d) / F.sin(d))
    x = p * F.cos(a1) * F.cos(o1) + q * F.cos(a2) * F.cos(o2)
    y = p * F.cos(a1) * F.sin(o1) + q * F.cos(a2) * F.sin(o2)
    z = p * F.sin(a1) + q * F.sin(a2)
    first = F.min("leg").over(Window.partitionBy(*by))
    v = e.withColumn("first_", first).filter("k > 0 or leg = first_")
    return v.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("leg", "k")) - 1).alias("seq"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lng"))


def merge_route_parts(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, distance, duration, n_parts: summed over parts; duration is null if any part lacks it."""
    whole = F.count("duration") == F.count("*")
    return parts.groupBy(*by).agg(F.sum("distance").alias("distance"), F.when(whole, F.sum("duration")).alias("duration"), F.count("*").alias("n_parts"))


def merge_route_lines(vertices: DataFrame, by: list[str]) -> DataFrame:
    """by, seq, lat, lng: the parts (part, seq, lat, lng) of each route joined in order, seq numbered anew from 0. A part's first vertex
    goes if it is exactly the vertex before it; other repeated vertices stay. Routes of fewer than two vertices are left out."""
    w = Window.partitionBy(*by).orderBy("part", "seq")
    joint = (F.lag("part").over(w) != F.col("part")) & (F.lag("lat").over(w) == F.col("lat")) & (F.lag("lng").over(w) == F.col("lng"))
    v = vertices.select(*by, "part", "seq", "lat", "lng", F.coalesce(joint, F.lit(False)).alias("joint_")).filter("not joint_")
    v = v.withColumn("of_", F.count("*").over(Window.partitionBy(*by))).withColumn("n_", F.row_number().over(w) - 1)
    return v.filter("of_ >= 2").select(*by, F.col("n_").alias("seq"), "lat", "lng")


def _weights(lat: np.ndarray, lng: np.ndarray, least_m: float) -> np.ndarray:
    """For each vertex the metres below which, as a tolerance, Ramer-Douglas-Peucker keeps it, in one plane for the whole line (at its
    mean latitude): where a piece is split does not depend on the tolerance, so a vertex stays as long as it and all splits above it
    are farther out. Both ends are endless; vertices that least_m drops have 0."""
    # plain sums and roots, as SQL has them: vertices at equal distances must not be told apart by the last bit
    x, y = lng * 111320.0 * math.cos(math.radians(float(np.cumsum(lat)[-1]) / len(lat))), lat * 110540.0
    weight = np.zeros(len(lat))
    weight[[0, -1]] = np.inf
    todo = [(0, len(lat) - 1, np.inf)]
    while todo:
        a, b, bound = todo.pop()
        if b - a < 2:
            continue
        dx, dy, px, py = x[b] - x[a], y[b] - y[a], x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        length = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / length, 0, 1) if length > 0 else np.zeros(b - a - 1)
        d = np.sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2)
        at = int(d.argmax())
        own = min(bound, float(d[at]))
        if own > least_m:
            weight[a + 1 + at] = own
            todo += [(a, a + 1 + at, own), (a + 1 + at, b, own)]
    return weight


def vertex_weights(vertices: DataFrame, by: list[str], least_m: float = 0.0) -> DataFrame:
    """by, seq, lat, lng, n_source, weight: the vertices of each line (of two or more; null coordinates left out) with the tolerance in
    metres below which simplifying keeps them. Lines at any tolerance t of least_m or more are the vertices of weight over t, so one fold
    of a line serves all of them."""
    v = vertices.filter("lat is not null and lng is not null").select(*by, F.struct("seq", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).alias("p"))
    lines = v.groupBy(*by).agg(F.array_sort(F.collect_list("p")).alias("ps")).filter(F.size("ps") >= 2)  # one line's vertices
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column("ps")
            flat, size = ps.flatten(), ps.value_lengths().to_numpy()
            lat, lng = (flat.field(c).to_numpy() for c in ("lat", "lng"))
            ends = np.cumsum(size).tolist()
            found = [_weights(lat[e - n : e], lng[e - n : e], least_m) for e, n in zip(ends, size.tolist())]
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            weights = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0), *found])))
            yield pa.RecordBatch.from_arrays([*batch.columns, weights], [*batch.schema.names, "ws"])

    out = lines.mapInArrow(run, f"{schema}, ws array<double>").select(*by, F.size("ps").alias("n_source"), F.explode(F.arrays_zip("ps", "ws")).alias("v"))
    return out.select(*by, "v.ps.seq", "v.ps.lat", "v.ps.lng", "n_source", F.col("v.ws").alias("weight"))


def _simplified(lat: np.ndarray, lng: np.ndarray, tolerance_m: float) -> np.ndarray:
    """Which vertices stay: Ramer-Douglas-Peucker in a plane at each piece, ends kept, split where the distance is over tolerance."""
    keep = np.zeros(len(lat), bool)
    keep[[0, -1]] = True
    todo = [(0, len(lat) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        scale = np.maximum(0.15, np.cos(np.radians((lat[a + 1 : b] + lat[a] + lat[b]) / 3)))
        x, y = (lng[a + 1 : b] - lng[a]) * 111320 * scale, (lat[a + 1 : b] - lat[a]) * 110540
        dx, dy = (lng[b] - lng[a]) * 111320 * scale, np.full(b - a - 1, (lat[b] - lat[a]) * 110540)
        length = dx * dx + dy * dy
        t = np.clip(np.where(length > 0, (x * dx + y * dy) / np.where(length > 0, length, 1), 0), 0, 1)
        d = np.hypot(x - t * dx, y - t * dy)
        at = int(d.argmax())
        if d[at] > tolerance_m:
            keep[a + 1 + at] = True
            todo += [(a, a + 1 + at), (a + 1 + at, b)]
    return keep


def _by_line(lines: DataFrame, out: str, work) -> DataFrame:
    """lines: columns and coords (array of struct lat, lng); work(lat, lng) gives the vertices to keep. One line at a time."""
    names = [c for c in lines.columns if c != "coords"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for coords in batch.column("coords").to_pylist():
                points = coords or []
                if len(points) > 2:
                    keep = work(np.array([p["lat"] for p in points]), np.array([p["lng"] for p in points]))
                    points = [p for p, k in zip(points, keep.tolist()) if k]
                kept.append(points)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept, pa.list_(pa.struct([("lat", pa.float64()), ("lng", pa.float64())])))], [*names, "coords"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(*names).schema)
    return lines.select(*names, "coords").mapInArrow(run, f"{schema}, coords array<struct<lat:double,lng:double>>")


def simplify_lines(lines: DataFrame, tolerance_m: float) -> DataFrame:
    """coords simplified, line by line. Null lines come back empty; lines of one or two points as they are."""
    return _by_line(lines, "coords", lambda lat, lng: _simplified(lat, lng, tolerance_m))


def thin_by_spacing(lines: DataFrame, km: float) -> DataFrame:
    """First, last, and the points that lie km or more from the last kept."""

    def work(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
        keep, at = np.zeros(len(lat), bool), 0
        keep[[0, -1]] = True
        p, o = np.radians(lat), np.radians(lng)
        while True:
            h = np.sin((p[at + 1 :] - p[at]) / 2) ** 2 + np.cos(p[at]) * np.cos(p[at + 1 :]) * np.sin((o[at + 1 :] - o[at]) / 2) ** 2
            far = np.flatnonzero(2 * 6371.0088 * np.arcsin(np.sqrt(h)) >= km)
            if not len(far):
                return keep
            at += 1 + int(far[0])
            keep[at] = True

    return _by_line(lines, "coords", work)


def chunk_by_km(vertices: DataFrame, by: list[str], km: float) -> DataFrame:
    """by, chunk, seq, lat, lng: a line cut where its length from the last cut would pass km; neighbours share the vertex of the cut."""
    w = Window.partitionBy(*by).orderBy("seq")
    v = vertices.select(*by, F.struct("seq", "lat", "lng", F.coalesce(haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")), F.lit(0.0)).alias("km")).alias("p"))
    lists = v.groupBy(*by).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0.0).alias("km"), F.array().cast("array<struct<chunk:int,seq:int,lat:double,lng:double>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        cut = (s["km"] > 0) & (s["km"] + p["km"] > km)
        chunk = s["chunk"] + cut.cast("int")
        own = F.struct(chunk.alias("chunk"), p["seq"].cast("int").alias("seq"), p["lat"].alias("lat"), p["lng"].alias("lng"))
        last = F.element_at(s["out"], -1)
        joint = F.struct(chunk.alias("chunk"), last["seq"].alias("seq"), last["lat"].alias("lat"), last["lng"].alias("lng"))
        return F.struct(chunk.alias("chunk"), F.when(cut, p["km"]).otherwise(s["km"] + p["km"]).alias("km"), F.when(cut, F.concat(s["out"], F.array(joint, own))).otherwise(F.concat(s["out"], F.array(own))).alias("out"))

    return lists.select(*by, F.explode(F.aggregate("ps", start, step)["out"]).alias("p")).select(*by, "p.*")


def stitch_rings(members: DataFrame) -> DataFrame:
    """relation_id, ring, coords: outer member lines (relation_id, member, role, coords) joined end to end within 1e-5 degrees
    in any direction; closed rings of 4 points or more. A relation's members are worked through together."""

    def run(key, table):
        lines = [[(p["lat"], p["lng"]) for p in r["coords"]] for r in sorted(table.to_pylist(), key=lambda r: r["member"]) if r["coords"] and len(r["coords"]) > 1]
        near = lambda a, b: abs(a[0] - b[0]) <= 1e-5 and abs(a[1] - b[1]) <= 1e-5
        rings = []
        while lines:
            ring = lines.pop(0)
            while not near(ring[0], ring[-1]):
                for i, other in enumerate(lines):
                    if near(ring[-1], other[0]) or near(ring[-1], other[-1]):
                        ring = ring + (other if near(ring[-1], other[0]) else other[::-1])[1:]
                    elif near(ring[0], other[-1]) or near(ring[0], other[0]):
                        ring = (other if near(ring[0], other[-1]) else other[::-1])[:-1] + ring
                    else:
                        continue
                    del lines[i]
                    break
                else:
                    break
            if len(ring) >= 4 and near(ring[0], ring[-1]):
                rings.append([{"lat": a, "lng": b} for a, b in ring])
        kind = pa.list_(pa.struct([("lat", pa.float64()), ("lng", pa.float64())]))
        return pa.table({"relation_id": pa.array([key[0].as_py()] * len(rings), pa.int64()), "ring": pa.array(range(len(rings)), pa.int32()), "coords": pa.array(rings, kind)})

    outer = members.filter(F.coalesce(F.trim("role"), F.lit("")).isin("", "outer"))
    return outer.select(F.col("relation_id").cast("long").alias("relation_id"), "member", "coords").groupBy("relation_id").applyInArrow(run, "relation_id long, ring int, coords array<struct<lat:double,lng:double>>")
