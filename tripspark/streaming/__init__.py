"""Trip changes as streams: upserts by key, first conquests, pending scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripspark.streaming.table import BUCKETS, KEEP, merge_batch, read_buckets_of, read_table, remove_old, stream_of

__all__ = ["first_by_time", "read_changes", "read_table", "stream_first_arrivals", "stream_first_conquests", "stream_pending_scan", "stream_upserts"]


def read_changes(spark: SparkSession, path: str, schema: str | T.StructType, most_files: int = 100) -> DataFrame:
    """A stream of Parquet files of changes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def stream_upserts(changes: DataFrame, table_path: str, checkpoint: str, keys: list[str], at: str = "updated_at", buckets: int = BUCKETS, gone: Column | None = None, keep: int = KEEP):
    """Keep the table under table_path (see table.merge_batch) up to date: in each batch the last change of a key by time wins over
    an older row; a late, older change loses, so no watermark is needed. A batch of k keys rewrites k buckets at most; one that
    is run again after a failure changes nothing. Read it with read_table; the newest `keep` versions stay."""

    def apply(batch: DataFrame, number: int) -> None:
        merge_batch(batch, table_path, keys, at, stream_of(batch.sparkSession, checkpoint), number, buckets, gone)
        remove_old(batch.sparkSession, table_path, keep)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def stream_first_conquests(changes: DataFrame, table_path: str, checkpoint: str, keys: list[str], trip: str = "trip_id", at: str = "trip_date", updated: str = "updated_at", deleted: str = "deleted", buckets: int = BUCKETS, remembered: object = None):
    """Keep a table of each key's first conquest by time under table_path, from changes in any order, with the rule of
    first.first_conquests; keys whose trips are all withdrawn leave it. Read it with read_table; its column revision is the batch that told
    the row.

    Each trip's last change is a row of a keyed table of its own, in the folder trips beside it, whose buckets are those of the keys:
    a batch brings its buckets up to date, works out the firsts of those anew, and passes on the ones that differ from what was told.
    It all runs as joins and groups of Spark, where a processor of state would call Python for each key."""
    last, first = F.struct(F.col(updated).alias("updated"), F.coalesce(deleted, F.lit(False)).alias("deleted"), F.col(at).alias("at")), f"{table_path}/trips"

    def forget(trips: DataFrame) -> DataFrame:
        latest = F.max("last.updated").over(Window.partitionBy(*keys))
        return trips.withColumn("latest_", latest).filter(~F.col("last.deleted") | (F.col("last.updated") >= F.col("latest_") - F.lit(remembered))).drop("latest_")

    def apply(batch: DataFrame, number: int) -> None:
        spark, stream = batch.sparkSession, stream_of(batch.sparkSession, checkpoint)
        rows = batch.filter(F.col(trip).isNotNull() & F.col(at).isNotNull() & F.col(updated).isNotNull()).select(*keys, trip, last.alias("last"))
        merge_batch(rows, first, [*keys, trip], "last", stream, number, buckets, by=keys, clean=None if remembered is None else forget)
        live = read_buckets_of(spark, first, rows, keys).filter("not last.deleted")
        now = live.groupBy(*keys).agg(F.min(F.struct("last.at", trip)).alias("f")).select(*keys, F.col(f"f.{trip}").alias(trip), F.col("f.at").alias(at))
        told = read_buckets_of(spark, table_path, rows, keys)
        if told is not None:
            was = told.select(*keys, F.col(trip).alias("trip_"), F.col(at).alias("at_"))
            same = F.col(trip).eqNullSafe(F.col("trip_")) & F.col(at).eqNullSafe(F.col("at_"))
            match = F.lit(True)
            for k in keys:  # a key may be null
                match = match & now[k].eqNullSafe(was[k])
            now = now.join(was, match, "full_outer").filter(~same).select(*[F.coalesce(now[k], was[k]).alias(k) for k in keys], trip, at)
        now = now.withColumn("revision", F.lit(number).cast("long")).persist()  # merged in two passes
        try:
            merge_batch(now, table_path, keys, "revision", stream, number, buckets, F.col(trip).isNull())
        finally:
            now.unpersist()
        remove_old(spark, first)
        remove_old(spark, table_path)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def stream_first_arrivals(conquests: DataFrame, keys: tuple[str, ...] = ("user_id", "item_key")) -> DataFrame:
    """The first row that arrives for each key, once; state is one entry for each key. For the first by trip time see
    stream_first_conquests."""
    return conquests.dropDuplicates(list(keys))


def first_by_time(table: DataFrame, batch: DataFrame, keys: list[str], at: str = "trip_date") -> DataFrame:
    """Conquests after a batch: the earliest by time of each key (of equal times the least trip)."""
    both = table.unionByName(batch.select(*table.columns))
    rest = [c for c in table.columns if c not in keys]
    order = [at, "trip_id", *[c for c in rest if c not in (at, "trip_id")]]
    first = F.min(F.struct(*order)).alias("f")
    return both.groupBy(*keys).agg(first).select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest]).select(*table.columns)


def stream_pending_scan(changes: DataFrame, scan: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str):
    """Run a scan (changed trips -> rows) for each batch and write its rows under the batch's number."""

    def apply(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
