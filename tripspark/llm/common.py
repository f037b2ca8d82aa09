"""Shared helpers: the shared folder, written intermediate tables, row keys, Arrow slices, document ranges."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy pass takes at a time; a longer text is a pass of its own.
SLICE_BYTES = 1 << 19
#: Rows of a table that is sent to every executor, at most; its rows are a few numbers or a word each.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch between Spark and Python, about.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset: a temporary one if Spark is one process
    (as in tests), which is then set, and the warehouse on a cluster, as executors share that too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] == "local":
        found = "file://" + tempfile.mkdtemp(prefix="tripspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses, under one folder for the application (see clean)."""
    return f"{shared_dir(spark)}/tripspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application's operators have written to the shared folder. Results that still read them
    must be written elsewhere first: operators are lazy, so they cannot tell when their last reader is done."""
    _delete(spark, f"{shared_dir(spark)}/tripspark-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Paths of the tables written in each open scratch block, innermost last.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize writes inside the block are deleted at its end, but those that stay. What is used after the
    block must read nothing else."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def materialize(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors.

    stays: the innermost scratch block leaves it, for the block around that, if any, to delete."""
    spark, path, schema = df.sparkSession, new_path(df.sparkSession, name), df.schema
    blocks = _SCRATCH[:-1] if stays else _SCRATCH
    if blocks:
        blocks[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, whose results now stand in written tables. What the driver's Python
    has freed goes back to the machine."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has BROADCAST_ROWS rows at most; more are left to be joined by shuffling."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until df has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def whole_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether the ids are whole numbers."""
    return isinstance(docs.schema[id_col].dataType, T.IntegralType)


def with_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs and two key columns that stand for (id, text); rows with equal id and text share a key.

    The first key is the id if that is a whole number, else a hash of it; a null id has the least long, and an id of just that
    number counts as null."""
    k1, k2 = free_name(docs, "k_id"), free_name(docs, "k_text")
    own = F.col(id_col).cast("long") if whole_ids(docs, id_col) else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string")))
    keyed = docs.withColumn(k1, F.coalesce(own, F.lit(-(2**63)).cast("long")))
    return keyed.withColumn(k2, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())), [k1, k2]


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))


def slices(batch: pa.RecordBatch, col: int | str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batch whose texts in col have most bytes together at most, or one row each."""
    _, offsets = text_buffer(batch.column(col))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the offsets where each begins; null counts as empty."""
    a = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts to a few MB; a setting of the user's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, str(BATCH_BYTES))


#: What a worker keeps from one task to the next: one vocabulary with its memo, by name.
_RESIDENT: dict = {}


def resident(key: tuple, make: Callable[[], object]) -> object:
    """make()'s object, kept for the worker's next tasks of the same key; whatever was kept before goes first."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def give_back() -> None:
    """Return what a task has freed to the machine: workers live on, idle or in other stages, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str, keeps: bool = False) -> DataFrame:
    """mapInArrow with state made once in each task: make() returns the function of a batch.

    keeps: make() asks for a resident vocabulary; a task without one drops what earlier tasks of its worker kept."""

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _RESIDENT.clear()
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)
        del work
        give_back()

    return df.mapInArrow(run, schema)


def id_ranges(ids: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most parts - 1 boundaries that cut the ids into ranges of about equal counts; a bounded list for the driver."""
    got = ids.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()
    return sorted(set(got["q"] or []))


def range_of(id_col: str | Column, bounds: list[int]) -> Column:
    """How many boundaries are at or below the id; a null id is in range 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= c))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], id_col: str, text_col: str, rows: int, most_bytes: int) -> DataFrame:
    """id_col, the label columns (int) and text_col of at most `rows` rows and most_bytes bytes of text in all, half of them for
    either value of the last label: those of least hash, written to the shared folder.

    Only ids whose crc32 (as text) mod 5 is not 0, with a text and with 0 or 1 for each label, are taken. An id counts once:
    of its texts the least is taken, and ids whose rows of labels differ are left out. Each value has half of the bytes; a text
    that does not fit into what is left of them is passed over, and those after it still come. A value none of whose texts fit
    is an error, so no model is fitted without it."""
    y = label_cols[-1]
    whole = [F.col(c).isin(0, 1) for c in label_cols]
    known = labels.filter(F.crc32(F.col(id_col).cast("string")) % 5 != 0)
    for one in whole:
        known = known.filter(one)
    known = known.select(id_col, *[F.col(c).cast("int").alias(c) for c in label_cols]).groupBy(id_col)
    known = known.agg(*[F.min(c).alias(c) for c in label_cols], *[(F.min(c) == F.max(c)).alias(f"{c}_same") for c in label_cols])
    for c in label_cols:
        known = known.filter(F.col(f"{c}_same")).drop(f"{c}_same")
    order = [F.xxhash64(id_col), F.col(id_col)]
    picked = [known.filter(F.col(y) == v).orderBy(*order).limit(rows // 2) for v in (0, 1)]
    texts = docs.select(id_col, text_col).filter(F.col(text_col).isNotNull()).join(F.broadcast(picked[0].union(picked[1])), id_col)
    texts = materialize(texts.groupBy(id_col, *label_cols).agg(F.min(text_col).alias(text_col)), "labelled")
    # at most `rows` ids and lengths; which texts fit depends on those before
    sizes = texts.select(F.col(y).alias("y_"), F.col(id_col).alias("id_"), F.octet_length(text_col).alias("n_")).orderBy("y_", F.xxhash64("id_"), "id_").collect()
    left, fit, seen = {0: most_bytes // 2, 1: most_bytes // 2}, [], set()
    for r in sizes:
        seen.add(r["y_"])
        if r["n_"] <= left[r["y_"]]:
            left[r["y_"]] -= r["n_"]
            fit.append((r["id_"], r["y_"]))
    for v in seen - {v for _, v in fit}:
        raise ValueError(f"no text of {y} = {v} has {most_bytes // 2} bytes or less: raise most_bytes")
    if len(fit) == len(sizes):
        return texts
    ids = texts.sparkSession.createDataFrame([(i,) for i, _ in fit], T.StructType([T.StructField(id_col, texts.schema[id_col].dataType)]))
    return texts.join(F.broadcast(ids), id_col, "left_semi")


def positions(ids: DataFrame, col: str, out: str) -> DataFrame:
    """ids (one column) with its place in ascending order (long, from 0), nulls first; written to the shared folder.

    Ranges of ids are sorted apart; a range's places begin after the rows of the ranges before it."""
    ranged = ids.select(col).repartitionByRange(F.col(col).asc_nulls_first()).sortWithinPartitions(F.col(col).asc_nulls_first())
    ranged = materialize(ranged.withColumn("at_", F.monotonically_increasing_id()), "ranged").withColumn("range_", F.shiftright("at_", 33))
    sizes = ranged.groupBy("range_").agg(F.count("*").alias("n_"))  # a row for each range
    before = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("range_", before.alias("start_")))
    place = F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start_")
    return materialize(ranged.join(starts, "range_").select(col, place.alias(out)), "places")
