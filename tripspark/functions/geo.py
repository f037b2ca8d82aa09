"""Geometry as column expressions. Latitudes and longitudes are degrees; lengths are kilometres.

One set of constants is used throughout: the mean earth radius for great circles, 111.32 km a degree for distances to
edges, measured in a plane at the point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
DEGREE_KM = 111.32


def haversine(alat: Column, alng: Column, blat: Column, blng: Column, radius: float = EARTH_KM) -> Column:
    half_lat, half_lng = F.radians(blat - alat) / 2, F.radians(blng - alng) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(alat)) * F.cos(F.radians(blat)) * F.sin(half_lng) * F.sin(half_lng)
    return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def bearing(alat: Column, alng: Column, blat: Column, blng: Column) -> Column:
    """Initial bearing, 0 to 360."""
    turn = F.radians(blng - alng)
    y = F.sin(turn) * F.cos(F.radians(blat))
    x = F.cos(F.radians(alat)) * F.sin(F.radians(blat)) - F.sin(F.radians(alat)) * F.cos(F.radians(blat)) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def bearing_difference(a: Column, b: Column) -> Column:
    """Between undirected lines: 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def squeeze_at(plat: Column) -> Column:
    """How much shorter a degree of longitude is than one of latitude, in the plane at a point."""
    return F.greatest(F.lit(0.01), F.cos(F.radians(plat)))


def point_edge_km(plat: Column, plng: Column, alat: Column, alng: Column, blat: Column, blng: Column, squeeze: Column | None = None) -> Column:
    """Distance from a point to an edge, in the plane at the point.

    Written so that few terms stand twice: inside a join condition Spark does not share them. squeeze: the point's squeeze_at where
    it has been worked out before."""
    squeeze = squeeze_at(plat) if squeeze is None else squeeze
    wx, wy, vx, vy = (plng - alng) * squeeze, plat - alat, (blng - alng) * squeeze, blat - alat
    along, length = wx * vx + wy * vy, vx * vx + vy * vy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(along, length), F.lit(0.0))))
    return DEGREE_KM * F.hypot(wx - t * vx, wy - t * vy)


def _side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    v = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return F.when(F.abs(v) <= 1e-12, 0).otherwise(F.signum(v).cast("int"))


def edges_meet(a: str, b: str) -> Column:
    """Whether two edges share a point; a and b are the prefixes of their columns alat, alng, blat, blng."""
    ax, ay, bx, by = (F.col(f"{a}{c}") for c in ("alng", "alat", "blng", "blat"))
    cx, cy, dx, dy = (F.col(f"{b}{c}") for c in ("alng", "alat", "blng", "blat"))

    def inside(px: Column, py: Column, qx: Column, qy: Column, x: Column, y: Column) -> Column:
        e = 1e-10
        return x.between(F.least(px, qx) - e, F.greatest(px, qx) + e) & y.between(F.least(py, qy) - e, F.greatest(py, qy) + e)

    o1, o2, o3, o4 = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy), _side(cx, cy, dx, dy, ax, ay), _side(cx, cy, dx, dy, bx, by)
    touch = (o1 == 0) & inside(ax, ay, bx, by, cx, cy) | (o2 == 0) & inside(ax, ay, bx, by, dx, dy) | (o3 == 0) & inside(cx, cy, dx, dy, ax, ay) | (o4 == 0) & inside(cx, cy, dx, dy, bx, by)
    return (o1 != o2) & (o3 != o4) | touch


def ends_km(a: str, b: str) -> Column:
    """Least distance of an end of either edge to the other edge: that of edges that do not meet."""
    p = {f"{s}{c}": F.col(f"{s}{c}") for s in (a, b) for c in ("alat", "alng", "blat", "blng")}
    ends = []
    for s, t in ((a, b), (b, a)):
        edge = [p[f"{t}{c}"] for c in ("alat", "alng", "blat", "blng")]
        ends += [point_edge_km(p[f"{s}{e}lat"], p[f"{s}{e}lng"], *edge) for e in "ab"]
    return F.least(*ends)


def edges_km(a: str, b: str) -> Column:
    """0 if two edges meet, else the least distance of an end to the other edge."""
    return F.when(edges_meet(a, b), F.lit(0.0)).otherwise(ends_km(a, b))
