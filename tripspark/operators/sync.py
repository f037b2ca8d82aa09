"""Last-writer-wins sync of trip tables: local rows, remote rows, tombstones and the state of the last sync, joined by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that stay on the device.
LOCAL_FIELDS = frozenset("roadSegments matchingRoadSegments highwayCache highwayProgress overpassCache media photos videos photoBytes videoBytes visible".split())


def trip_time(*candidates: Column) -> Column:
    """The first that is a timestamp, else the epoch."""
    return F.coalesce(*[F.try_to_timestamp(c) for c in candidates], F.timestamp_seconds(F.lit(0)))


def fingerprint(columns: list[str]) -> Column:
    """Digest of the columns by name, in order of name, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def byte_size(columns: list[str]) -> Column:
    return F.octet_length(F.to_json(F.struct(*columns)))


def _stripped(c: Column, kind: T.DataType, left_out: frozenset[str]) -> Column:
    """c without the fields left_out at any depth; a struct that loses all its fields becomes null."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _stripped(x, kind.elementType, left_out))
    if not isinstance(kind, T.StructType):
        return c
    kept = [_stripped(c[f.name], f.dataType, left_out).alias(f.name) for f in kind.fields if f.name not in left_out]
    return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)


def strip_for_cloud(trips: DataFrame, id_col: str = "id", trip_id_col: str = "trip_id", left_out: frozenset[str] = LOCAL_FIELDS) -> DataFrame:
    """trips without the fields left_out, at any depth of structs and arrays; a missing or empty id is taken from trip_id_col."""
    columns = [_stripped(F.col(f.name), f.dataType, left_out).alias(f.name) for f in trips.schema if f.name not in left_out and f.name not in (id_col, trip_id_col)]
    own = F.col(id_col).cast("string") if id_col in trips.columns else F.lit(None).cast("string")
    return trips.select(F.coalesce(F.nullif(own, F.lit("")), F.col(trip_id_col).cast("string")).alias(id_col), *columns)


def route_signature(schema: str, polyline: Column, coordinates: Column, updated: list[Column], points: Column | None = None) -> Column:
    """schema, geometry and time of the last update, joined by bars: equal signatures mean that a trip need not be scanned again.

    The geometry is told by its encoded line, else by its coordinates, else by the trip's own points, if given, else as none; a time is the first that is not empty."""
    shape = F.when(polyline.isNotNull(), F.concat(F.lit("poly:"), F.length(polyline).cast("string"), F.lit(":"), F.sha2(polyline, 256)))
    own = F.lit(None).cast("string") if points is None else F.concat(F.lit("pts:"), F.size(points).cast("string"), F.lit(":"), F.sha2(F.to_json(points), 256))
    shape = F.coalesce(shape, F.concat(F.lit("geo:"), F.size(coordinates).cast("string"), F.lit(":"), F.sha2(F.to_json(coordinates), 256)), own, F.lit("none"))
    return F.concat_ws("|", F.lit(schema), shape, F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in updated], F.lit("")))


def _joined(local: DataFrame, remote: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    l = local.select(*keys, F.col("content").alias("l_content"), F.col("updated_at").alias("l_at"), F.lit(True).alias("l"))
    r = remote.select(*keys, F.col("content").alias("r_content"), F.col("updated_at").alias("r_at"), F.col("deleted_at").alias("r_deleted"), F.lit(True).alias("r"))
    t = tombstones.select(*keys, F.col("deleted_at").alias("t_at"), F.lit(True).alias("t"))
    out = l.join(r, keys, "full_outer").join(t, keys, "full_outer")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("l", "r", "t")})


def reconcile(local: DataFrame, remote: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """keys, action, content, deleted_at for every id: keep, download, upload (all three with the content that stays),
    delete_remote or drop (both with the tombstone's time).

    A remote deletion wins if it is as late as the local row; a local one if it is later than the remote row; equal
    contents need nothing; else the later side wins, on a tie the local one. local: content, updated_at; remote: also
    deleted_at; tombstones: deleted_at."""
    j = _joined(local, remote, tombstones, keys)
    gone = F.col("r_deleted").isNotNull()
    action = (
        F.when(F.col("r") & gone & (~F.col("l") | (F.col("r_deleted") >= F.col("l_at"))), "drop")
        .when(F.col("r") & F.col("t") & ~gone & (F.col("t_at") > F.col("r_at")), "delete_remote")
        .when(F.col("r") & gone & F.col("t") & (F.col("t_at") > F.col("r_at")), "delete_remote")
        .when(F.col("r") & ~F.col("l"), "download")
        .when(F.col("r") & F.col("l") & F.col("l_content").eqNullSafe(F.col("r_content")), "keep")
        .when(F.col("r") & F.col("l") & (F.col("r_at") > F.col("l_at")), "download")
        .when(F.col("r") & F.col("l"), "upload")
        .when(F.col("t"), "delete_remote")
        .otherwise("upload")
    )
    j = j.withColumn("action", action)
    content = F.when(F.col("action") == "download", F.col("r_content")).when(F.col("action").isin("keep", "upload"), F.col("l_content"))
    deleted = F.when(F.col("action") == "drop", F.col("r_deleted")).when(F.col("action") == "delete_remote", F.col("t_at"))
    return j.select(*keys, "action", content.alias("content"), deleted.alias("deleted_at"))


def plan_incremental_sync(local: DataFrame, remote: DataFrame, tombstones: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """keys, upload, download, delete_local, delete_remote (booleans) for every id that needs something.

    state: fingerprint (of the content) and revision (the remote row's time) at the last sync. A side has changed if it
    differs from the state; if both have, the later wins and a tie downloads; an unchanged remote row never beats a local
    deletion."""
    s = state.select(*keys, F.col("fingerprint").alias("s_content"), F.col("revision").alias("s_at"), F.lit(True).alias("s"))
    j = _joined(local, remote, tombstones, keys).join(s, keys, "left").withColumn("s", F.coalesce("s", F.lit(False)))
    l, r, t, gone = F.col("l"), F.col("r"), F.col("t"), F.col("r_deleted").isNotNull()
    l_new = l & (~F.col("s") | ~F.col("s_content").eqNullSafe(F.col("l_content")))
    r_new = r & (~F.col("s") | ~F.col("s_at").eqNullSafe(F.col("r_at")) | gone)
    bury = t & (~r | ~r_new | (F.col("t_at") > F.coalesce("r_deleted", "r_at")))
    later = F.col("l_at") > F.col("r_at")
    upload = ~t & F.when(gone, l_new & (F.col("l_at") > F.col("r_deleted"))).when(l & ~r, True).when(l & r, l_new & (~r_new | later)).otherwise(False)
    download = F.when(t, ~bury & ~gone).otherwise(F.when(gone, False).when(~l & r, True).when(l & r, r_new & (~l_new | ~later)).otherwise(False))
    delete_local = F.when(t, l).otherwise(gone & l & ~upload)
    out = j.select(*keys, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in (("upload", upload), ("download", download), ("delete_local", delete_local), ("delete_remote", bury))])
    return out.filter("upload or download or delete_local or delete_remote")


def create_sync_state(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint, revision of ids that live on both sides."""
    r = remote.filter("deleted_at is null").select(*keys, F.col("updated_at").alias("revision"))
    return local.select(*keys, F.col("content").alias("fingerprint")).join(r, keys)


def apply_plan(local: DataFrame, plan: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Local rows after a plan: without those deleted, with those downloaded in place of their own."""
    gone = plan.filter("delete_local or download").select(*keys)
    new = remote.join(plan.filter("download").select(*keys), keys, "left_semi").select(*local.columns)
    return local.join(gone, keys, "left_anti").unionByName(new)


def verify_remote(local: DataFrame, remote: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, n_local, n_live, n_equal, verified: whether all local rows stand, live and equal, on the remote side."""
    r = remote.select(*keys, F.col("content").alias("r_content"), F.col("deleted_at").isNull().alias("live"))
    j = local.join(r, keys, "left")
    live, equal = F.coalesce("live", F.lit(False)), F.coalesce(F.col("live") & F.col("content").eqNullSafe(F.col("r_content")), F.lit(False))
    return j.groupBy(*by).agg(F.count("*").alias("n_local"), F.count_if(live).alias("n_live"), F.count_if(equal).alias("n_equal"), F.bool_and(equal).alias("verified"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], at: str = "updated_at", deal: tuple | None = None) -> DataFrame:
    """table after changes: the later row of each key stays, on a tie the change; of several changes to a key the last. deal: a number of
    partitions and some of the keys, by which rows are dealt to them."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("new_"))
    both = table.withColumn("new_", F.lit(0)).unionByName(changes.select(*table.columns).withColumn("new_", F.lit(1)))
    both = both if deal is None else both.repartition(*deal)
    return both.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_", "new_")


def visible_rows(rows: DataFrame, user_id, cached: str = "cache|") -> DataFrame:
    """A user's own live rows, without cached roads, whose ids begin with `cached`."""
    return rows.filter((F.col("user_id") == user_id) & F.col("deleted_at").isNull() & ~F.col("trip_id").cast("string").startswith(cached))


def pending_work(trips: DataFrame, done: DataFrame, key: str = "trip_id") -> DataFrame:
    """Trips (key, signature) that have not been worked through, completely, under their present signature."""
    return trips.join(done.filter("complete").select(key, "signature"), [key, "signature"], "left_anti")


def fresh_entries(cache: DataFrame, version: str, now: Column, days: int = 30) -> DataFrame:
    """Entries of this version that are younger than `days`."""
    return cache.filter((F.col("version") == version) & (F.col("saved_at") > now - F.make_dt_interval(F.lit(days))))


def reconcile_stored_roads(conquered: DataFrame, runs: DataFrame, min_km: float = 2.0) -> DataFrame:
    """Conquered roads (user_id, road_id) without those whose stored runs are all shorter than min_km; those without runs stay."""
    best = runs.groupBy("user_id", "road_id").agg(F.max("km").alias("best_"))
    return conquered.join(best, ["user_id", "road_id"], "left").filter(F.col("best_").isNull() | (F.col("best_") >= min_km)).drop("best_")
