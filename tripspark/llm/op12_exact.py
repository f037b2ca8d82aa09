"""Exact dedup by a tree of merges of sorted digest runs, in DataFrame operations only.

Every row is signed: a 64-bit digest of its text, and for verification the text's SHA-256 and number of bytes. Each input
partition is a run, sorted by digest, that holds each text once with its size and its best identifier. In each round, `ways`
neighbouring runs meet and are merged into one, so after log(runs) rounds one run is left. At every level rows are one text
only if digest, SHA-256 and length all agree, and the best identifier of those that met stays. A run is never in one task:
its digests are dealt over all partitions, and a text of very many copies is one row of each run, so it costs as many rows
as there are runs and not as there are copies. Each level is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.common import materialize, scratch, with_key

#: Runs that one merge takes.
WAYS = 16
#: What tells texts apart: the runs' order, and what verifies it.
SIGNATURE = ["digest", "sha", "bytes"]
#: Bits of monotonically_increasing_id below the partition's number.
PLACE_BITS = 33


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, place (a number of the row's own), run (its input partition), digest, sha, bytes of every row, written to the shared
    folder: the texts themselves are read once and move nowhere."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("place"), text.alias("text"))
    rows = rows.select("id", "place", F.shiftright("place", PLACE_BITS).alias("run"), F.xxhash64("text").alias("digest"), F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("bytes"))
    return materialize(rows, "signatures")


def merge_runs(runs: DataFrame, keep: str, ways: int) -> DataFrame:
    """One merge: run numbers r * ways to r * ways + ways - 1 become run r, each text in it once. runs: run, SIGNATURE, best, n."""
    best = F.max("best") if keep == "largest" else F.min("best")
    merged = runs.withColumn("run", F.floor(F.col("run") / ways)).groupBy("run", *SIGNATURE).agg(best.alias("best"), F.sum("n").alias("n"))
    return merged.sortWithinPartitions("run", *SIGNATURE)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", ways: int = WAYS) -> DataFrame:
    """id_col, keep_id, group_size (long), kept, text_sha256 of every row of docs.

    keep: of equal texts the row of the 'smallest' or 'largest' identifier stays. Null counts as the empty text. A null identifier
    is beaten by any other; of rows that tie (repeated identifiers) just one stays. Identifiers may be of any type with an order.
    An empty table gives no rows."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    with scratch(docs.sparkSession):
        rows = signatures(docs, id_col, text_col)
        known = F.col("id").isNotNull() if keep == "largest" else F.col("id").isNull()
        first = rows.select("run", *SIGNATURE, F.struct(known.alias("known"), "id", "place").alias("best"), F.lit(1).cast("long").alias("n"))
        first = materialize(merge_runs(first, keep, 1), "runs")
        runs, left = first, (rows.agg(F.max("run")).first()[0] or 0) + 1
        while left > 1:
            runs, left = materialize(merge_runs(runs, keep, ways), "runs"), -(-left // ways)
        # back to the rows by run and text: a text's copies are spread over as many keys as it has runs
        whole = runs.select(*SIGNATURE, F.col("best.id").alias("keep_id"), F.col("best.place").alias("keep_place"), F.col("n").alias("group_size"))
        told = first.select("run", *SIGNATURE).join(whole, SIGNATURE)
        out = rows.join(told, ["run", *SIGNATURE])
        out = materialize(out.select("id", "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), F.col("sha").alias("text_sha256")), "groups", stays=True)
    return out.withColumnRenamed("id", id_col)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", ways: int = WAYS) -> DataFrame:
    """docs without the rows that exact_groups drops, all columns as they are."""
    kept = exact_groups(docs, id_col, text_col, keep, ways).filter("kept").select(F.col(id_col).alias("id"), "text_sha256")
    keyed, keys = with_key(docs, id_col, text_col)
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    same = F.col(id_col).eqNullSafe(F.col("kept_.id")) & (sha == F.col("kept_.text_sha256"))
    found = keyed.alias("docs_").join(kept.alias("kept_"), same, "left_semi")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return found.withColumn(keys[1], F.xxhash64(text)).dropDuplicates(keys).select(*docs.columns)


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of documents; the largest doc_id of equal texts stays. Null texts
    count as empty ones; of repeated rows one stays; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs, keep="largest")


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
