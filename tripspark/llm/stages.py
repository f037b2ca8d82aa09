"""Stages of the corpus pipeline: name, and a function of (spark, docs, sf_dir) that returns what it keeps.

Every stage works on all rows of docs and hands on all their columns; null and empty texts pass unless a rule names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm import op1_substring, op7_decontaminate, op8_quality, op10_bpe, similar
from tripspark.llm.common import free_name, materialize, scratch, small, tokenizer_path, with_key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or more; it is trained on the labelled rows among docs."""
    model = op8_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "score_")
    return op8_quality.score(docs, model, score_col=score).filter(F.col(score) >= op8_quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by fingerprints or by a likeness of 0.8 or more (Jaccard of five-word shingles) the document
    of smallest id stays (of equal ids and texts, one row)."""
    with scratch(spark):
        found = similar.similar_groups(docs)
        keys = found.columns[:2]
        first = materialize(found.groupBy("group").agg(F.min(F.struct(*keys)).alias("k")).select("k.*"), "first", stays=True)
    keyed, own = with_key(docs, "doc_id", "text")
    first = first.toDF(*own)
    return keyed.join(first, own, "left_semi").dropDuplicates(own).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; texts that have none stay as they are. No document goes."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = plain.columns[docs.columns.index("text")]
    out = op1_substring.substring_dedup(plain, plain.columns[docs.columns.index("doc_id")], text)
    changed = F.col("n_removed") > 0
    kept = F.when(changed, F.col("kept")).otherwise(F.col(text))
    columns = []
    for name, c in zip(docs.columns, plain.columns):
        if name == "text":
            columns.append(kept.alias(name))
        elif name == "n_chars":
            columns.append(F.when(changed, F.char_length("kept")).otherwise(F.col(c)).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(c).alias(name))
    return out.select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark's items."""
    with scratch(spark):
        found, keys = op7_decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        bad = small(materialize(found.filter("contaminated").select(*keys).distinct(), "bad", stays=True))
    keyed, own = with_key(docs, "doc_id", "text")
    return keyed.join(bad.toDF(*own), own, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text's bytes."""
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    both = op10_bpe.round_trip(docs.select("doc_id", "text"), path)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontaminate),
    ("byte_bpe", encode),
]
