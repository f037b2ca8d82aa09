"""Byte-level BPE encoding and decoding, by prefix dynamic programming (see prefix_bpe)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripspark.llm.common import map_rows, resident, slices, tokenizer_path
from tripspark.llm.prefix_bpe import Memo, ids_of, rank_file, ranks_of, splitter


def _pattern(pattern: str | None) -> str:
    import public_tokenizers

    return pattern or public_tokenizers.PATTERN


def _encoder(path: str, pattern: str) -> Callable[[pa.Array], pa.Array]:
    """Texts -> lists of token ids; the vocabulary and the words met stay with the worker."""

    def made() -> tuple:
        bpe = rank_file(path)
        return splitter(pattern), Memo(lambda words: ids_of(bpe, words))

    split, memo = resident(("ranks", path, pattern), made)

    def encoded(texts: pa.Array) -> pa.Array:
        rows = memo.joined([split(t) if t else [] for t in texts.to_pylist()])
        at = np.cumsum([0, *(len(r) // 4 for r in rows)])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    return encoded


def _decoder(path: str) -> Callable[[pa.Array], pa.Array]:
    """Lists of token ids -> the bytes of their pieces."""
    piece = {rank: p for p, rank in ranks_of(path).items()}
    pieces = [piece.pop(i, None) for i in range(max(piece) + 1)]
    size = np.array([len(p) if p is not None else -1 for p in pieces], np.int64)
    start = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))
    table = np.frombuffer(b"".join(p or b"" for p in pieces), np.uint8)

    def decoded(column: pa.Array) -> pa.Array:
        out = []
        for row in column:
            ids = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int64)
            n = size[ids]
            if len(n) and n.min() < 0:
                raise ValueError("an id has no rank")
            ends = np.cumsum(n)
            at = np.repeat(start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            out.append(table[at].tobytes())
        return pa.array(out, pa.binary())

    return decoded


def encode(docs: DataFrame, path: str, pattern: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col (array of int): the token ids of every whole text.

    path: a rank file that every executor can read; pattern: splits the text before the merges. Null and empty
    texts have no ids. All other columns and repeated rows stay; a column named ids_col is replaced."""
    pattern, names = _pattern(pattern), [c for c in docs.columns if c != ids_col]
    schema = docs.select(*names).schema.add(ids_col, T.ArrayType(T.IntegerType(), False), False)

    def make():
        encoded = _encoder(path, pattern)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), encoded(part.column(text_col))], [*names, ids_col])

        return work

    return map_rows(docs, make, schema, keeps=True)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """tokens with bytes_col (binary): the bytes of the ids in order. Null ids give empty bytes; an id without a rank fails.
    All other columns and repeated rows stay; a column named bytes_col is replaced."""
    names = [c for c in tokens.columns if c != bytes_col]
    schema = tokens.select(*names).schema.add(bytes_col, T.BinaryType(), False)

    def make():
        decoded = _decoder(path)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), decoded(batch.column(ids_col))], [*names, bytes_col])

        return work

    return map_rows(tokens.select(*dict.fromkeys([*names, ids_col])), make, schema)


def round_trip(docs: DataFrame, path: str, pattern: str | None = None, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """What decode(encode(docs)) gives, in one pass through the Python workers."""
    pattern, names = _pattern(pattern), [c for c in docs.columns if c not in (ids_col, bytes_col)]
    schema = docs.select(*names).schema.add(ids_col, T.ArrayType(T.IntegerType(), False), False).add(bytes_col, T.BinaryType(), False)

    def make():
        encoded, decoded = _encoder(path, pattern), _decoder(path)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, text_col):
                ids = encoded(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), ids, decoded(ids)], [*names, ids_col, bytes_col])

        return work

    return map_rows(docs, make, schema, keeps=True)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens (long), ids_sha256 (of decimal ids joined by commas), decoded_sha256 of every whole text."""
    both = round_trip(docs.select("doc_id", "text"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digests of documents. Null and empty texts have no ids and the digests of nothing; repeated rows and null ids each come
    back; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"))
