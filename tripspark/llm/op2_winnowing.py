"""Document fingerprints by winnowing.

Every run of k characters is hashed; of every w hashes in a row the smallest is chosen, the rightmost of equals, and
kept with its position. Two texts that share k + w - 1 characters in a row share a chosen hash, and the positions say
where. A text of fewer than k characters has one hash, of all of it; a text with fewer than w hashes is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripspark.llm.common import id_ranges, map_rows, materialize, positions, range_of, slices, small, whole_ids, with_key
from tripspark.llm.hashing import prefix_sums, span_hashes

GRAM, WIDTH = 10, 20
#: Boundaries of ids that the driver holds, at most; between two of them ranges are cut evenly, as many as the corpus needs.
COARSE = 512
#: Documents in a range, about.
RANGE_ROWS = 500
_ENTRY = np.dtype([("hash", ">u8"), ("at", ">u4")])


def winnow(text: str, gram: int = GRAM, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions in code points, by position. An empty text has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(gram, n)
    start = np.arange(n - k + 1)
    value = span_hashes(prefix_sums(codes * np.uint64(0xD1342543DE82EF95) + np.uint64(1)), start, start + k)
    w = min(width, len(value))
    low, at, have = value, start, 1
    while have < w:  # windows of 1, 2, 4, ... hashes, then two that overlap; of equals the right one
        step = min(have, w - have)
        right = low[step:] <= low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    at = np.unique(at)
    return value[at], at


def written(hashes: np.ndarray, at: np.ndarray) -> str:
    """24 hexadecimal digits for each chosen hash: its 64 bits, then its position in 32 bits."""
    out = np.empty(len(at), _ENTRY)
    out["hash"], out["at"] = hashes, at
    return out.tobytes().hex()


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    entries = np.frombuffer(bytes.fromhex(fingerprint), _ENTRY)
    return entries["hash"].astype(np.uint64), entries["at"].astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of the distinct hashes of two fingerprints (Jaccard); 1 if neither has any."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def with_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", gram: int = GRAM, width: int = WIDTH) -> DataFrame:
    """docs with out_col (string, see written) for every whole text. Null and empty texts have an empty fingerprint;
    repeated rows each come back; a column of this name is replaced, others stay."""
    names = [c for c in docs.columns if c != out_col]
    schema = docs.select(*names).schema.add(out_col, T.StringType(), False)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, text_col):
                out = [written(*winnow(t or "", gram, width)) for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out, pa.string())], [*names, out_col])

        return work

    return map_rows(docs.select(*names), make, schema)


def in_ranges(docs: DataFrame, id_col: str, text_col: str, coarse: int = COARSE, rows: int = RANGE_ROWS) -> DataFrame:
    """Rows dealt out by ranges of ids, in each partition by range and then descending id (equal ids by a hash of the text,
    null ids last), with the first row of the next lower range after each range, marked `next_`; after the last, the first of all.

    The number of ranges follows the number of rows. Texts are shuffled once; the ranges' first rows are found by a scan."""
    keyed, keys = with_key(docs.select(id_col, text_col), id_col, text_col)
    edges = docs.agg(F.count("*").alias("n"), F.min(id_col).alias("a"), F.max(id_col).alias("b")).first()
    bounds = id_ranges(docs, id_col, coarse)
    cuts = max(1, -(-edges["n"] // (coarse * rows)))
    part = range_of(id_col, bounds).cast("long")
    if cuts > 1 and edges["a"] is not None:
        ends = F.array(*[F.lit(float(x)) for x in [edges["a"], *bounds, edges["b"] + 1]])
        low, high = F.get(ends, part.cast("int")), F.get(ends, part.cast("int") + 1)
        cut = F.floor((F.col(id_col) - low) / F.greatest(high - low, F.lit(1.0)) * cuts)
        part = part * cuts + F.coalesce(F.greatest(F.lit(0), F.least(F.lit(cuts - 1), cut)), F.lit(0))
    keyed = keyed.withColumn("range_", part)
    heads = keyed.groupBy("range_").agg(F.max(F.struct(*keys)).alias("h")).select("range_", "h.*", F.floor(F.col("range_") / cuts).alias("c_"))
    heads = materialize(heads, "heads")
    # the next range above, within a coarse range, else the first of the next one that has rows, else the first of all
    firsts = heads.groupBy("c_").agg(F.min("range_").alias("first_"))
    order = Window.orderBy("c_")  # a row for each coarse range
    firsts = firsts.select("c_", F.coalesce(F.lead("first_").over(order), F.min("first_").over(Window.partitionBy(F.lit(0)))).alias("after_"))
    above = heads.withColumn("above_", F.lead("range_").over(Window.partitionBy("c_").orderBy("range_"))).join(firsts, "c_")
    above = above.select(*keys, F.coalesce("above_", "after_").alias("above_"))
    more = keyed.join(small(above), keys).select(id_col, *keys, text_col, F.col("above_").alias("range_"), F.lit(True).alias("next_"))
    placed = keyed.select(id_col, *keys, text_col, "range_", F.lit(False).alias("next_")).union(more)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.floor(F.col("range_") * parts / ((len(bounds) + 1) * cuts)).cast("int")  # ranges that follow one another, about as many in each
    return placed.repartitionById(parts, own).sortWithinPartitions("range_", "next_", F.desc(keys[0]), F.desc(keys[1]))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, width: int = WIDTH, coarse: int = COARSE, rows: int = RANGE_ROWS) -> DataFrame:
    """Each document against its edited text, whose last half is replaced by the beginning of the next document's, in
    descending order of id: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. Repeated rows follow one another; the only document is its own next. Ids that are not whole numbers
    are ordered as text, come back as text, and stand for their places in that order meanwhile."""
    if not whole_ids(docs, id_col):
        own = docs.select(F.col(id_col).cast("string").alias("own_"), F.col(text_col).alias("text_"))
        places = positions(own.select("own_").filter("own_ is not null").distinct(), "own_", "id_")
        found = edit_report(own.join(places, "own_", "left").select("id_", "text_"), "id_", "text_", gram, width, coarse, rows)
        found = found.join(places, "id_", "left").drop("id_").withColumnRenamed("own_", id_col)
        return found.select(id_col, *[c for c in found.columns if c != id_col])
    placed = in_ranges(docs, id_col, text_col, coarse, rows)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def pair(a: tuple, b: tuple) -> tuple:
            n = len(a[1])
            edited = a[1][: n - n // 2] + b[1][: n // 2]
            h, at = winnow(edited, gram, width)
            return a[0], n, hashlib.sha256(edited.encode()).hexdigest(), a[3], written(h, at), likeness(a[2], h), likeness(a[2], b[2])

        for batch in batches:
            for part in slices(batch, 1) if batch.num_rows else ():
                out = []
                for own, text, where, after in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if after and (held is None or held[4] != where):
                        continue  # one of several equal rows that begin the next range
                    hashes, at = winnow(text or "", gram, width)
                    row = (own, text or "", hashes, written(hashes, at), where)
                    if held is not None and held[4] == where:
                        out.append(pair(held, row))
                    held = None if after else row
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return placed.select(F.col(id_col).cast("long").alias(id_col), text_col, "range_", "next_").mapInArrow(run, schema)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edit_report of documents. Null and empty texts have empty fingerprints; repeated rows each come back; a null id comes
    after all others; an empty table gives no rows."""
    return edit_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
