"""Substring dedup by level-wise doubling.

Words are runs of characters other than ASCII white space; a window is `window` consecutive words of one
document. A window is repeated if its words also start anywhere else, in the same document or another.

Levels: base, 2 * base, ... , window. At each level below the last, every window still in question is stood for
by the smallest hash among the pieces of the level's length inside it. Equal windows hold equal pieces, so a
window whose smallest piece is found once in the corpus is alone, and is not carried to the next length. As
neighbouring windows mostly share their smallest piece, a level moves one row for a run of windows, not one for
each. Runs whose whole word sequence is found twice settle all their windows at once; only one of each such runs
goes on, as a witness, and only where a run that is not settled shares its piece.

Pieces, runs and windows are told apart by 64-bit hashes of their words, a piece and a window together at the last level;
words are not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripspark.llm.common import free_name, map_rows, materialize, scratch, slices, with_key
from tripspark.llm.hashing import prefix_sums, sliding_min, span_hashes, word_hashes, word_spans


def levels(base: int, window: int) -> list[int]:
    """base, twice that, and so on up to window: 9, 18, 35."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _runs(prefix: np.ndarray, starts: np.ndarray, owner: np.ndarray | None, length: int, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their smallest piece of the given length.

    starts: first words of windows, ascending within each owner. Returns, for each run, the index in starts of its first
    window, its count of windows, the piece's hash, and whether the piece stands at two places or more inside the run."""
    at = np.arange(len(prefix) - length)
    piece = span_hashes(prefix, at, at + length)
    least = sliding_min(piece, window - length + 1)[starts]
    new = (least[1:] != least[:-1]) | (np.diff(starts) != 1)
    if owner is not None:
        new |= owner[1:] != owner[:-1]
    first = np.flatnonzero(np.concatenate(([True], new)))
    count = np.diff(np.append(first, len(starts)))
    value, width = least[first], count + window - length
    begin = np.cumsum(width) - width
    inside = np.repeat(starts[first] - begin, width) + np.arange(width.sum())
    times = np.add.reduceat((piece[inside] == np.repeat(value, width)).astype(np.int32), begin)
    return first, count, value, times > 1


def _scan(keyed: DataFrame, keys: list[str], text_col: str, length: int, window: int) -> DataFrame:
    """A row for each run of windows of each document: key, first window, count, piece, whether twice, hash of the run's words."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, 2):
                data, start, end, first = word_spans(part.column(2))
                prefix = prefix_sums(word_hashes(data, start, end))
                size = np.diff(first)
                doc = np.repeat(np.arange(len(size)), size)
                windows = np.flatnonzero(doc[window - 1 :] == doc[: len(doc) - window + 1]) if len(doc) >= window else np.zeros(0, np.int64)
                if len(windows):
                    at, count, value, twice = _runs(prefix, windows, None, length, window)
                    at = windows[at]
                    whole = span_hashes(prefix, at, at + count + window - 1)
                    owner = pa.array(doc[at])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(owner), part.column(1).take(owner), pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(value.view(np.int64)), pa.array(twice), pa.array(whole.view(np.int64))],
                        [*keys, "start", "n", "piece", "twice", "whole"],
                    )

        return work

    schema = f"{keys[0]} long, {keys[1]} long, start int, n int, piece long, twice boolean, whole long"
    return map_rows(keyed.select(*keys, text_col), make, schema)


def _extend(rows: DataFrame, keys: list[str], length: int, window: int) -> DataFrame:
    """rows: key, text_, runs_ (array of piece, whole, times, off, start, n). Cuts each run into sub-runs of windows that
    share their smallest piece of this length, and gives those windows' own hashes; off counts from the run's first window."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, 2):
                data, begin, end, first = word_spans(part.column(2))
                prefix = prefix_sums(word_hashes(data, begin, end))
                lists = part.column(3)
                size, given = lists.value_lengths().to_numpy(), lists.flatten()
                doc = np.repeat(np.arange(len(size)), size)
                start, n = given.field("start").to_numpy().astype(np.int64), given.field("n").to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                starts = np.repeat(first[doc] + start, n) + place
                at, count, value, twice = _runs(prefix, starts, owner, length, window)
                own = owner[at]
                hashes = span_hashes(prefix, starts, starts + window).view(np.int64)
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(pa.array(doc[own])) for k in (0, 1)), *(given.field(c).take(take) for c in ("piece", "whole", "times")), pa.array((given.field("off").to_numpy()[own] + place[at]).astype(np.int32)), pa.array((start[own] + place[at]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(value.view(np.int64)), pa.array(twice), pa.ListArray.from_arrays(pa.array(np.append(at, len(starts)).astype(np.int32)), pa.array(hashes))],
                    [*keys, "piece", "whole", "times", "off", "start", "n", "next", "twice", "hashes"],
                )

        return work

    schema = f"{keys[0]} long, {keys[1]} long, piece long, whole long, times long, off int, start int, n int, next long, twice boolean, hashes array<long>"
    return map_rows(rows.select(*keys, "text_", "runs_"), make, schema)


def _again(rows: DataFrame, by: list[str], weight) -> DataFrame:
    """The values of `by` that are found twice or more in the corpus, written out: a join with them then has an exchange
    of its own on either side, of which Spark can split a hot value's."""
    return materialize(rows.groupBy(*by).agg(F.sum(weight).alias("w_")).filter("w_ > 1").select(*by), "again")


def _with_text(keyed: DataFrame, keys: list[str], text_col: str, runs: DataFrame) -> DataFrame:
    """Texts of the documents that have runs, with those in one array, which is never longer than the text."""
    runs = runs.groupBy(*keys).agg(F.collect_list(F.struct("piece", "whole", "times", "off", "start", "n")).alias("runs_"))
    return keyed.select(*keys, F.col(text_col).alias("text_")).join(runs, keys)


def repeated_spans(keyed: DataFrame, keys: list[str], text_col: str, window: int, base: int) -> DataFrame:
    """key, start, n, offs: runs of windows that are all repeated (offs null), or those of them at the offsets offs."""
    steps = levels(base, window)
    weight = 1 + F.col("twice").cast("long")
    runs = materialize(_scan(keyed, keys, text_col, steps[0], window), "runs")
    live = materialize(runs.join(_again(runs, ["piece"], weight), "piece", "left_semi"), "live")

    kinds = live.groupBy("piece", "whole").agg(F.count("*").alias("times"), F.min(F.struct(*keys, "start", "n")).alias("at"))
    kinds = materialize(kinds, "kinds")
    open_pieces = materialize(kinds.groupBy("piece").agg(F.min("times").alias("least")).filter("least = 1").select("piece"), "open")
    asked = kinds.join(open_pieces, "piece", "left_semi").select("piece", "whole", "times", F.lit(0).alias("off"), "at.*")
    for length in steps[1:-1] or steps[-1:]:
        found = materialize(_extend(_with_text(keyed, keys, text_col, asked), keys, length, window), "level")
        asked = found.join(_again(found, ["next"], F.col("times") * weight), "next", "left_semi")

    windows = asked.select("piece", "whole", "times", "off", "next", F.posexplode("hashes").alias("i", "hash"))
    windows = materialize(windows.withColumn("off", F.col("off") + F.col("i")).drop("i"), "windows")
    hit = windows.filter("times = 1").join(_again(windows, ["next", "hash"], F.col("times")), ["next", "hash"], "left_semi")
    hit = hit.groupBy("piece", "whole").agg(F.collect_set("off").alias("offs"))
    settled = kinds.filter("times > 1").select("piece", "whole", F.lit(None).cast("array<int>").alias("offs"))
    return live.join(settled.unionByName(hit), ["piece", "whole"]).select(*keys, "start", "n", "offs")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, base: int = 9) -> DataFrame:
    """docs with n_words, n_removed (long) and kept (string): the words left, joined by one space.

    A word goes if a repeated window covers it; windows are judged on the input. Null and empty texts have no words;
    texts of fewer words than window keep all. Repeated rows count as so many places, and each comes back. Columns of
    these names are replaced; all other columns stay."""
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    keyed, keys = with_key(docs.select(*names), id_col, text_col)
    with scratch(docs.sparkSession):
        spans = materialize(repeated_spans(keyed, keys, text_col, window, base), "spans", stays=True)
    own = free_name(keyed, "spans_")
    spans = spans.groupBy(*keys).agg(F.collect_list(F.struct("start", "n", "offs")).alias(own))
    rows = keyed.join(spans, keys, "left").select(*names, own)
    schema = docs.select(*names).schema
    for name, kind in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType())):
        schema = schema.add(name, kind, False)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, text_col):
                words = [t.encode().split() if t else [] for t in part.column(text_col).to_pylist()]
                total = np.array([len(w) for w in words])
                first = np.concatenate(([0], np.cumsum(total)))
                lists = part.column(own)
                spans, size = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                a = np.repeat(first[:-1], size) + spans.field("start").to_numpy()
                n, offs = spans.field("n").to_numpy(), spans.field("offs")
                some = offs.is_valid().to_numpy(zero_copy_only=False)
                single = np.repeat(a, offs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + offs.flatten().to_numpy()
                drop = np.zeros(first[-1] + window + 1, np.int64)
                for at, wide in ((a[~some], n[~some]), (single, 1)):
                    np.add.at(drop, at, 1)
                    np.add.at(drop, at + wide + window - 1, -1)
                stay = np.cumsum(drop)[: first[-1]] == 0
                left = np.diff(np.concatenate(([0], np.cumsum(stay)))[first])
                gone = total - left
                kept = [b" ".join(w if not g else compress(w, stay[f : f + len(w)].tolist())).decode() for w, g, f in zip(words, gone, first)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

        return work

    return map_rows(rows, make, schema)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of documents. Null and empty texts have no words and the digest of
    nothing; repeated rows count as so many places, and each comes back; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as text, counted over all documents; a word goes if one of the windows over it is found twice.
OP1_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 33, 1))) AS t(i)),
rep AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM rep, unnest(range(0, 35)) AS t(k)),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string([x FOR x, j IN w IF NOT list_contains(ps, j)], ' ') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
