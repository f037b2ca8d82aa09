"""Token counts at every prefix, by prefix dynamic programming over a sentencepiece BPE vocabulary.

No piece goes on past a white-space mark that follows another character, so a text falls into stretches of marks and
what follows them, each encoded on its own, and a prefix's count is that of the stretches before plus that inside its
own. Each stretch's counts come from the table of the last token of every prefix (see prefix_bpe).
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripspark.llm.common import map_rows, resident, slices, tokenizer_path
from tripspark.llm.prefix_bpe import Memo, PrefixBPE

MARK = "▁"


def sentencepiece_bpe(path: str) -> tuple[PrefixBPE, re.Pattern]:
    """Merge ranks by falling score, and the pattern of stretches that encode on their own.

    Only for BPE models with byte fallback that leave text as it is and put one mark before it."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    plain.sort(key=lambda i: (-sp.get_score(i), i))
    pieces = {sp.id_to_piece(i): rank for rank, i in enumerate(plain)}
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece goes on past a white-space mark")
    inside = {a for p in pieces if len(p) > 1 for a in p}
    alone = "".join(c for c in "\n\t\r" if c not in inside)
    after = {b for p in pieces for a, b in zip(p, p[1:]) if a.isalpha()}
    ends = "".join(re.escape(c) for c in string.punctuation if c not in after)  # no piece has one of these after a letter
    word = f"{MARK}*+[^\\W\\d_{MARK}]++(?=[{ends}])|" if ends else ""
    return PrefixBPE(pieces), re.compile(f"{word}{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))


def _bytes(symbol: str) -> int:
    return len(symbol.encode())


def stretches(text: str, pattern: re.Pattern) -> list[str]:
    """The stretches of the marked text: one mark before it, spaces as marks."""
    return pattern.findall(MARK + text.replace(" ", MARK)) if text else []


def prefix_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with changes (binary) and n_tokens (long), for every whole text.

    changes: int8 for each symbol of the marked text, how many tokens the prefix that ends there has more than the one
    before. Running sums are the counts of all prefixes; the sum is n_tokens. path: a sentencepiece model that every executor can read. Null and empty texts have no tokens. Repeated rows each
    come back; columns of these names are replaced, others stay."""
    names = [c for c in docs.columns if c not in ("changes", "n_tokens")]
    schema = docs.select(*names).schema.add("changes", T.BinaryType(), False).add("n_tokens", T.LongType(), False)

    def make():
        def made() -> tuple:
            bpe, pattern = sentencepiece_bpe(path)
            return pattern, Memo(lambda found: bpe.changes(found, _bytes))

        pattern, memo = resident(("sentencepiece", path), made)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, text_col):
                rows = memo.joined([stretches(t or "", pattern) for t in part.column(text_col).to_pylist()])
                total = [int(np.frombuffer(r, np.int8).sum(dtype=np.int64)) for r in rows]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(rows, pa.binary()), pa.array(total, pa.int64())], [*names, "changes", "n_tokens"])

        return work

    return map_rows(docs.select(*names), make, schema, keeps=True)


def within_budget(counted: DataFrame, budget: int, out_col: str = "fits") -> DataFrame:
    """counted (see prefix_counts) with out_col (long): characters of the longest prefix of the text with budget tokens at
    most, read off the stored counts. Counts may fall as merges complete, so the last prefix that fits is taken."""
    names = [c for c in counted.columns if c != out_col]
    schema = counted.select(*names).schema.add(out_col, T.LongType(), False)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = []
            for row in batch.column("changes").to_pylist():
                fits = np.flatnonzero(np.cumsum(np.frombuffer(row or b"", np.int8), dtype=np.int64)[1:] <= budget)
                out.append(int(fits[-1]) + 1 if len(fits) else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.int64())], [*names, out_col])

        return work

    return map_rows(counted.select(*names), make, schema)


def op9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of documents. Null and empty texts have no bytes and no tokens; repeated rows and
    null ids each come back; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return prefix_counts(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
