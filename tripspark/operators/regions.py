"""Points in regions: rings through a cover of cells, boxes through cells, the first region by priority.

A ring is covered by grid cells that lie wholly inside it and cells that its edge passes. A point in an inside cell needs no
test; one in an edge cell is held only against the ring's edges that reach its row of cells. So a point costs what its own cell
asks for, however many vertices a ring has, and points and rings meet by an equi-join on the cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.functions import regions as outlines
from tripspark.functions.display import reclassify_label
from tripspark.operators.coverage import ENDS
from tripspark.operators.sizes import small

CELL_DEG = 1.0


def ring_edges(rings: DataFrame) -> DataFrame:
    """priority, code, ends of the edges of rings (priority, code, ring: array of lat, lng); the last vertex joins the first.

    An edge goes from a vertex to the one before it."""
    before = F.element_at("ring", F.when(F.col("i") == 0, F.size("ring")).otherwise(F.col("i")))
    v = rings.select("priority", "code", "ring", F.posexplode("ring").alias("i", "v"))
    return v.select("priority", "code", F.col("v.lat").alias("alat"), F.col("v.lng").alias("alng"), before["lat"].alias("blat"), before["lng"].alias("blng"))


def _rows(edges: DataFrame, cell: float) -> DataFrame:
    """edges, once for each row of cells (cy) that they reach."""
    low, high = F.floor(F.least("alat", "blat") / cell), F.floor(F.greatest("alat", "blat") / cell)
    return edges.withColumn("cy", F.explode(F.sequence(low, high)))


def _lng_at(lat: Column) -> Column:
    """Where an edge that is not level passes a latitude."""
    return (F.col("blng") - F.col("alng")) * (lat - F.col("alat")) / (F.col("blat") - F.col("alat")) + F.col("alng")


def cell_cover(edges: DataFrame, cell: float = CELL_DEG) -> DataFrame:
    """priority, code, cx, cy, edge: the cells of each ring (ring_edges); edge tells those that its edge may pass from those
    that are wholly inside."""
    rows = _rows(edges, cell)
    low = F.greatest(F.least("alat", "blat"), F.col("cy") * cell)
    high = F.least(F.greatest("alat", "blat"), (F.col("cy") + 1) * cell)
    level = F.col("alat") == F.col("blat")
    x, y = F.when(level, F.col("alng")).otherwise(_lng_at(low)), F.when(level, F.col("blng")).otherwise(_lng_at(high))
    reach = F.sequence(F.floor(F.least(x, y) / cell - 1e-9), F.floor(F.greatest(x, y) / cell + 1e-9))
    on_edge = rows.select("priority", "code", "cy", F.explode(reach).alias("cx")).distinct()
    # a row's middle latitude passes the ring's edges in pairs, between which it is inside
    middle = (F.col("cy") + 0.5) * cell
    passed = rows.filter((F.col("alat") > middle) != (F.col("blat") > middle)).select("priority", "code", "cy", _lng_at(middle).alias("x"))
    passed = passed.groupBy("priority", "code", "cy").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.get("xs", i).alias("a"), F.get("xs", i + 1).alias("b")))
    spans = passed.filter(F.size("xs") > 1).select("priority", "code", "cy", F.explode(pairs).alias("p"))
    inner = spans.select("priority", "code", "cy", "p", F.explode(F.sequence(F.floor(F.col("p.a") / cell), F.floor(F.col("p.b") / cell))).alias("cx"))
    centre = (F.col("cx") + 0.5) * cell
    inner = inner.filter((centre > F.col("p.a")) & (centre < F.col("p.b"))).select("priority", "code", "cy", "cx").distinct()
    inner = inner.join(on_edge, ["priority", "code", "cy", "cx"], "left_anti")
    return on_edge.withColumn("edge", F.lit(True)).union(inner.withColumn("edge", F.lit(False))).select("priority", "code", "cx", "cy", "edge")


def points_in_rings(points: DataFrame, rings: DataFrame, cell: float = CELL_DEG) -> DataFrame:
    """point_id, priority, code: the rings that hold each point (point_id, lat, lng), by the parity of edges east of it."""
    edges = ring_edges(rings)
    placed = points.select("point_id", "lat", "lng", F.floor(F.col("lng") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    met = placed.join(small(cell_cover(edges, cell)), ["cx", "cy"])
    sure = met.filter(~F.col("edge")).select("point_id", "priority", "code")
    spans = (F.col("alat") > F.col("lat")) != (F.col("blat") > F.col("lat"))
    near = _rows(edges, cell).select("priority", F.col("cy"), *ENDS)
    tested = met.filter("edge").join(small(near), ["priority", "cy"]).filter(spans & (F.col("lng") < _lng_at(F.col("lat"))))
    odd = tested.groupBy("point_id", "priority", "code").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return sure.union(odd.select("point_id", "priority", "code")).distinct()


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = CELL_DEG) -> DataFrame:
    """point_id, priority, code: the boxes (priority, code, s, open, n, w, e) that hold each point, borders included; where open,
    the southern border is not. A side (w, e) that is null has no end, so any longitude that way is inside."""
    reach = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    cells = boxes.filter("w is not null and e is not null").withColumn("cx", reach("w", "e")).withColumn("cy", reach("s", "n"))
    rows = boxes.filter("w is null or e is null").withColumn("cy", reach("s", "n"))
    placed = points.select("point_id", "lat", "lng", F.floor(F.col("lng") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    inside = (F.col("lat") > F.col("s")) | ~F.col("open") & (F.col("lat") == F.col("s"))
    inside = inside & (F.col("lat") <= F.col("n")) & (F.col("w").isNull() | (F.col("lng") >= F.col("w"))) & (F.col("e").isNull() | (F.col("lng") <= F.col("e")))
    found = [placed.join(small(c), on).filter(inside & F.col("lng").isNotNull()).select("point_id", "priority", "code") for c, on in ((cells, ["cx", "cy"]), (rows, ["cy"]))]
    return found[0].union(found[1]).distinct()


def outline_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The boxes and rings of the countries' outlines."""
    boxes = spark.createDataFrame(outlines.boxes(), "priority int, code string, s double, open boolean, n double, w double, e double")
    return boxes, spark.createDataFrame(outlines.rings(), "priority int, code string, ring array<struct<lat:double,lng:double>>")


def point_region(points: DataFrame, boxes: DataFrame, rings: DataFrame, cell: float = CELL_DEG) -> DataFrame:
    """point_id, code: of the boxes and rings that hold a point the first by priority; null outside all, and for points
    without coordinates. Repeated ids count as one point each time they stand in the same place."""
    hit = points_in_boxes(points, boxes, cell).union(points_in_rings(points, rings, cell)).groupBy("point_id").agg(F.min_by("code", "priority").alias("code"))
    return points.select("point_id").distinct().join(hit, "point_id", "left")


def reclassify_badges(badges: DataFrame, boxes: DataFrame, rings: DataFrame) -> DataFrame:
    """badges (point_id, label, lat, lng) with the label that belongs to the country where the badge stands (see reclassify_label)."""
    where = point_region(badges, boxes, rings)
    return badges.join(where, "point_id", "left").withColumn("label", reclassify_label(F.col("label"), F.col("code"))).drop("code")
