"""A table of keyed rows that is brought up to date by batches of changes, a bucket of keys at a time.

Keys are dealt to a fixed number of buckets by hash. A batch reads and rewrites only the buckets that its keys fall into, into a
folder of its own, and then puts down a new manifest, which names the live folder of every bucket: a reader sees the table
before the batch or after it, never between. A batch that fails before its manifest leaves the table as it was. The manifest
also says which batch of which stream came last, so one that is run again changes nothing."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripspark.operators.sizes import PART_ROWS
from tripspark.operators.sync import upsert
from tripspark.sources.shared import Files

#: Buckets of a new table. A bucket is rewritten whole: take so many that one is a file or two.
BUCKETS = 64
#: Versions that readers may still be reading when older ones are removed.
KEEP = 2


class Manifest(NamedTuple):
    version: int
    buckets: int
    keys: list[str]
    schema: str
    #: The live folder of each bucket that has rows, under the table's path.
    folders: dict[str, str]
    #: The last batch of each stream.
    batches: dict[str, int]
    #: The keys that tell a row's bucket, where that is some of them.
    by: list[str] | None = None


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The newest manifest, or that of a version; None for a table that does not exist."""
    files = Files(spark, path)
    have = [n for n in files.names("manifests") if n.endswith(".json") and not n.startswith(".")]
    if not have:
        return None
    return Manifest(**json.loads(files.read(f"manifests/{have[-1] if version is None else _name(version)}")))


def _name(version: int) -> str:
    return f"{version:012d}.json"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, now: Manifest, only: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(now.schema))
    folders = [f for b, f in now.folders.items() if only is None or int(b) in set(only)]
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as its newest manifest names it, or as an older one that has not been removed does."""
    now = manifest(spark, path, version)
    if now is None:
        raise FileNotFoundError(path)
    return _read(spark, path, now)


def read_buckets_of(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The buckets of the table that the keys of rows fall into, whole; None for a table that does not exist."""
    now = manifest(spark, path)
    if now is None:
        return None
    only = [r["b"] for r in rows.select(bucket_of(keys, now.buckets).alias("b")).distinct().collect()]  # a number each
    return _read(spark, path, now, only)


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows of the keys in wanted; only their buckets are read. Types of the keys must be the table's."""
    now = manifest(spark, path)
    buckets = [r["b"] for r in wanted.select(bucket_of(now.by or now.keys, now.buckets).alias("b")).distinct().collect()]  # a number each
    return _read(spark, path, now, buckets).join(wanted.select(*now.keys).distinct(), now.keys, "left_semi")


def merge_batch(changes: DataFrame, path: str, keys: list[str], at: str = "updated_at", stream: str = "", batch: int | None = None, buckets: int = BUCKETS, gone: Column | None = None, by: list[str] | None = None, clean: Callable[[DataFrame], DataFrame] | None = None) -> Manifest:
    """Bring the table under path up to date with changes, of which the last of each key by `at` counts; a row that is later in the
    table stays. The first batch makes the table, with `buckets` buckets and the columns of changes.

    stream, batch: a batch with a number at or below the stream's last is passed over. gone: rows that are left out of
    rewritten buckets (deleted ones whose time to be kept is over); clean: what is done with rewritten buckets before that. by: keys
    that tell the bucket, if not all of them. A large bucket is written by several tasks, so that none's share grows with the table. If another writer puts its manifest down first, this
    batch is given up with an error and leaves the table alone."""
    spark, files = changes.sparkSession, Files(changes.sparkSession, path)
    now = manifest(spark, path)
    if now is not None and batch is not None and batch <= now.batches.get(stream, -1):
        return now
    if now is None:
        now = Manifest(-1, buckets, keys, json.dumps(changes.schema.jsonValue()), {}, {}, by)
    if keys != now.keys:
        raise ValueError(f"the table's keys are {now.keys}")
    fields = T.StructType.fromJson(json.loads(now.schema)).fields
    rows = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    own = bucket_of(now.by or keys, now.buckets)
    found = {r["b"]: r["count"] for r in rows.groupBy(own.alias("b")).count().collect()}  # a number for each bucket
    touched = sorted(found)
    version, folders = now.version + 1, dict(now.folders)
    if touched:
        table = _read(spark, path, now, touched)
        parts = -(-(table.count() + sum(found.values())) // (PART_ROWS * len(touched)))  # of a bucket, each a task's work
        place = {"bucket_": own, "part_": F.pmod(F.xxhash64(F.lit("part"), *keys), F.lit(parts)).cast("int")}
        merged = upsert(table.withColumns(place), rows.withColumns(place), [*place, *keys], at, (len(touched) * parts, *place)).drop("part_")
        merged = merged if clean is None else clean(merged)
        if gone is not None:
            merged = merged.filter(~F.coalesce(gone, F.lit(False)))
        folder = f"data/{version:012d}"
        merged.write.partitionBy("bucket_").mode("overwrite").parquet(f"{path}/{folder}")
        full = {n.removeprefix("bucket_=") for n in files.names(folder) if n.startswith("bucket_=")}
        folders |= {b: f"{folder}/bucket_={b}" for b in full}
        for b in map(str, touched):
            if b not in full:
                folders.pop(b, None)
    batches = now.batches | ({} if batch is None else {stream: batch})
    new = Manifest(version, now.buckets, keys, now.schema, folders, batches, now.by)
    if not files.put_new(f"manifests/{_name(version)}", json.dumps(new._asdict())):
        raise RuntimeError(f"version {version} of {path} was written by another batch")
    return new


def remove_old(spark: SparkSession, path: str, keep: int = KEEP) -> None:
    """Delete all but the newest `keep` manifests, and the folders of buckets that none of those names."""
    files = Files(spark, path)
    have = [n for n in files.names("manifests") if n.endswith(".json") and not n.startswith(".")]
    kept = [json.loads(files.read(f"manifests/{n}")) for n in have[-keep:]]
    live = {f for m in kept for f in m["folders"].values()}
    for n in have[:-keep]:
        files.remove(f"manifests/{n}")
    for version in files.names("data"):
        if int(version) > kept[-1]["version"]:
            continue  # a batch that is being written
        own = [n for n in files.names(f"data/{version}") if n.startswith("bucket_=")]
        dead = [n for n in own if f"data/{version}/{n}" not in live]
        for n in dead if len(dead) < len(own) else []:
            files.remove(f"data/{version}/{n}")
        if len(dead) == len(own):
            files.remove(f"data/{version}")


def stream_of(spark: SparkSession, checkpoint: str) -> str:
    """The name that Spark gives the stream of a checkpoint, the same after a restart, another for a new checkpoint."""
    return json.loads(Files(spark, checkpoint).read("metadata"))["id"]
