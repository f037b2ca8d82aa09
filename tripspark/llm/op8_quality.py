"""Quality classifier: learned vectors of hashed word and character n-grams, averaged for each document, with a softmax
on top, trained by numpy stochastic gradient descent on a bounded sample of labelled rows.

Three families of features are averaged each on its own and added: words and pairs of words; pieces of 3 and 4 bytes
inside words (word ends included); and one mark for each word, which says whether it repeats the word before it, stands
in a triple of words that the text has had before, or neither. Words are between ASCII white space, A-Z lower-cased.

As the softmax is linear in the averages, a trained model is one number for each bucket: tasks look those up and
average them, over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripspark.llm.common import give_back, labelled_sample, map_rows, slices, text_buffer
from tripspark.llm.hashing import SPACE, mix, prefix_sums, span_hashes, word_spans

BUCKETS = 1 << 18
GRAMS = (3, 4)
#: Labelled rows that a model is fitted on, at most; half of either class.
TRAIN_ROWS = 3000
#: Bytes of their texts, at most.
TRAIN_BYTES = 32 << 20
#: Steps of training, at least; small samples are gone through more often.
STEPS = 400
THRESHOLD = 0.3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[SPACE] = 32
_CODE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _bucket(h: np.ndarray, family: int) -> np.ndarray:
    return (mix(h + np.uint64(family * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(46)).astype(np.int64)


def features(column: pa.Array) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each family a list of (bucket, document, place is used), over all texts of the column."""
    data, start, end, first = word_spans(column)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    low = _LOWER[data]
    words = span_hashes(prefix_sums(_CODE[low]), start, end)
    same2 = doc[1:] == doc[:-1]
    pairs = words[1:] * _ODD + words[:-1]
    first_family = [(_bucket(words, 1), doc, np.ones(len(words), bool)), (_bucket(pairs, 2), doc[1:], same2)]

    chars = []
    code = _CODE[low]
    space = low == 32
    owner = np.repeat(np.arange(len(size)), np.diff(text_buffer(column)[1]))
    for n in GRAMS:
        m = len(low) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        used = owner[n - 1 :] == owner[:m]
        for j in range(n):
            h = h * _ODD + code[j : j + m]
            if 0 < j < n - 1:
                used &= ~space[j : j + m]
        chars.append((_bucket(h, 2 + n), owner[:m], used))

    mark = np.zeros(len(words), np.int64)
    if len(words) > 2:
        triple = mix(words[2:] * _ODD + words[1:-1]) * _ODD + words[:-2] + doc[2:].astype(np.uint64)
        _, once = np.unique(triple, return_index=True)
        seen = np.ones(len(triple), bool)
        seen[once] = False
        mark[2:][seen & (doc[2:] == doc[:-2])] = 1
    mark[1:][same2 & (words[1:] == words[:-1])] = 2
    marks = [(_bucket(mark.astype(np.uint64), 9), doc, np.ones(len(words), bool))]
    return [first_family, chars, marks]


@dataclass
class Model:
    """value: what each bucket adds to the log odds of label 1; bias: log odds without features."""

    value: np.ndarray
    bias: float

    def log_odds(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for family in features(column):
            total, count = np.zeros(len(column)), np.zeros(len(column))
            for bucket, doc, used in family:
                total += np.bincount(doc, np.where(used, self.value[bucket], 0), len(column))
                count += np.bincount(doc, used, len(column))
            out += total / np.maximum(count, 1)
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, dim: int = 4, epochs: int = 5, rate: float = 0.5, lift: float = 4.0, batch: int = 32, seed: int = 3) -> Model:
    """rows: buckets and weights of each document. prior: share of label 1 among all labelled rows, as the sample is balanced."""
    rng = np.random.default_rng(seed)
    table = ((rng.random((BUCKETS, dim)) - 0.5) / dim).astype(np.float32)
    top, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(epochs, -(-STEPS // -(-len(rows) // batch)))
    steps, done = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            bucket = np.concatenate([rows[i][0] for i in pick]).astype(np.int64)
            weight = np.concatenate([rows[i][1] for i in pick]).astype(np.float32)
            doc = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            each = table[bucket] * weight[:, None]
            hidden = np.stack([np.bincount(doc, each[:, d], len(pick)) for d in range(dim)], 1).astype(np.float32)
            scores = hidden @ top + bias
            scores = np.exp(scores - scores.max(1, keepdims=True))
            error = scores / scores.sum(1, keepdims=True)
            error[np.arange(len(pick)), labels[pick]] -= 1
            step = rate * (1 - done / steps)
            back = error @ top.T
            top -= step * hidden.T @ error / len(pick)
            bias -= step * error.mean(0)
            there, at_bucket = np.unique(bucket, return_inverse=True)
            often = np.maximum(np.bincount(at_bucket, weight), 1)  # a bucket of many documents moves by their mean
            for d in range(dim):
                table[there, d] -= step * lift * np.bincount(at_bucket, weight * back[doc, d]) / often
            done += 1
    shift = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) if 0 < prior < 1 else 0.0
    toward = top[:, 1] - top[:, 0]
    return Model((table @ toward).astype(np.float32), float(bias[1] - bias[0] + shift))


def _gathered(batch_column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and weights of each document of a column."""
    n = len(batch_column)
    docs, buckets, weights = [], [], []
    for family in features(batch_column):
        count = sum((np.bincount(doc, used, n) for _, doc, used in family), np.zeros(n))
        for bucket, doc, used in family:
            docs.append(doc[used])
            buckets.append(bucket[used])
            weights.append(1 / count[doc[used]])
    doc, bucket, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, buckets, weights))
    key, inverse = np.unique(doc * BUCKETS + bucket, return_inverse=True)
    total = np.bincount(inverse, weight, len(key))
    cut = np.searchsorted(key, np.arange(n + 1) * BUCKETS)
    for a, b in zip(cut[:-1], cut[1:]):
        yield key[a:b] % BUCKETS, total[a:b]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """A model from labelled rows whose crc32(id as text) mod 5 is not 0: half of `rows` of either class at most, and
    most_bytes of text (see labelled_sample). Null labels, ids and texts are left out, repeated ids count once. Without rows
    of both classes the model gives every text the share of label 1 (a half without any rows)."""
    known = labels.filter(F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % 5 != 0)).select(F.col(label_col).cast("int").alias("y_"))
    counts = {r["y_"]: r["n"] for r in known.groupBy("y_").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    prior = (ones + 1) / (ones + zeros + 2)
    sample = labelled_sample(docs, labels, [label_col], id_col, text_col, rows, most_bytes).select(label_col, text_col)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, 1):
                got = list(_gathered(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.astype(np.int32).tobytes() for b, _ in got], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, w in got], pa.binary())], ["y", "bucket", "weight"])

        return work

    found = map_rows(sample, make, "y int, bucket binary, weight binary").toArrow()
    given = [(np.frombuffer(b.as_buffer(), np.int32), np.frombuffer(w.as_buffer(), np.float32)) for b, w in zip(found["bucket"], found["weight"])]  # no copies
    order = sorted(range(len(given)), key=lambda i: (len(given[i][0]), given[i][0].tobytes()))  # whatever order the tasks ended in
    y = found["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    model = fit([given[i] for i in order], y[order].astype(np.int64), prior)
    del found, given
    give_back()  # the driver lives on through the pipeline's other stages
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col (double, 0 to 1) for every row; null and empty texts get the score of a text without features."""
    names = [c for c in docs.columns if c != score_col]
    schema = docs.select(*names).schema.add(score_col, T.DoubleType(), False)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, text_col):
                p = 1 / (1 + np.exp(-np.clip(sent.value.log_odds(part.column(text_col)), -500, 500)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p)], [*names, score_col])

        return work

    return map_rows(docs.select(*names), make, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents. Null and empty texts get the score of a text without
    features; a null id is not held out; repeated rows each come back; an empty table gives no rows."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
