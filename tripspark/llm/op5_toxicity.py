"""Toxicity by a classifier chain.

Categories are the 0/1 columns of the labels that the caller names; where labels tell only whether a text is toxic, kinds of
toxic texts are learned first: the features that tell toxic texts from others are clustered by the texts they share, and a
toxic text is of each kind that it has a feature of. Categories are predicted one after another, each by a linear (logistic) model of the words of a text and of the
probabilities of the categories before it. While training, those probabilities are out-of-fold: each comes from a model
that has not seen the row, as at prediction; the models that are kept are then fitted on all training rows.

Features are the distinct words of the whole text (between ASCII white space, without punctuation at their ends, A-Z
lower-cased) and the distinct pieces of four bytes inside words, hashed, each scaled by how much more often it stands in
texts with the category than without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.common import labelled_sample, map_rows, slices
from tripspark.llm.hashing import SPACE, mix, prefix_sums, span_hashes, word_spans

BUCKETS = 1 << 20
GRAM = 4
FOLDS = 5
#: Log-likelihood ratio over which a word counts as telling a category.
SURE = 12.0
#: Labelled rows that the chain is fitted on, at most, half of them toxic, and bytes of their texts, at most.
TRAIN_ROWS, TRAIN_BYTES = 8000, 32 << 20
#: Rows of the sample that a feature must stand in to be looked at.
SEEN = 3
#: Features of a link, at most: those that tell most.
USED = 2048
#: Kinds of toxic texts that are learned where labels have no categories, and the telling features they are made of, at most.
KINDS, TELLING = 3, 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that a word's ends are freed of: ASCII other than letters and digits.
_EDGE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(44)).astype(np.int64)


def features(column: pa.Array, grams: bool = True, told: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """document, bucket of each distinct word, and piece of a word, of each text, in that order; of told buckets only."""
    data, start, end, first = word_spans(column)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = _CODE[_LOWER[data]]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = ~(_EDGE[data] | SPACE[data])
    at = np.flatnonzero(inside)
    a, b = np.searchsorted(at, start), np.searchsorted(at, end)
    solid = b > a
    begin, stop = at[a[solid]], at[b[solid] - 1] + 1
    keys = [doc[solid] * BUCKETS + _bucket(span_hashes(prefix_sums(code), begin, stop))]
    if grams and len(data) >= GRAM:
        h, used = np.zeros(len(data) - GRAM + 1, np.uint64), np.ones(len(data) - GRAM + 1, bool)
        for j in range(GRAM):
            h = h * _ODD + code[j : j + len(h)]
            used &= inside[j : j + len(h)]
        place = np.flatnonzero(used)
        word = np.searchsorted(start, place, "right") - 1  # texts stand without a gap, so a piece may run on into the next
        place, word = place[place + GRAM <= end[word]], word[place + GRAM <= end[word]]
        keys.append(doc[word] * BUCKETS + _bucket(h[place]))
    every = np.concatenate(keys)
    if told is not None:
        every = every[told[every % BUCKETS]]
    key = np.unique(every)
    return key // BUCKETS, key % BUCKETS


@dataclass
class Link:
    """One category's model: weight of each bucket, of the earlier categories' probabilities, and the bias."""

    weight: np.ndarray
    chain: np.ndarray
    bias: float

    def predict(self, doc: np.ndarray, bucket: np.ndarray, before: np.ndarray) -> np.ndarray:
        z = np.bincount(doc, self.weight[bucket], len(before)) + before @ self.chain + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass
class Chain:
    """The categories in order, the last of which is toxicity itself, and a link for each."""

    names: list[str]
    links: list[Link]


def telling(doc: np.ndarray, bucket: np.ndarray, label: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the log of how much more often it stands in rows with the label, and its log-likelihood ratio."""
    n, pos = len(label), label.sum()
    ones, all_ = np.bincount(bucket, label[doc], size), np.bincount(bucket, minlength=size)
    zeros, share = all_ - ones, pos / n
    scale = np.log((ones + 0.5) / (pos + 1)) - np.log((zeros + 0.5) / (n - pos + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(ones > 0, ones * np.log(ones / (all_ * share)), 0) + np.where(zeros > 0, zeros * np.log(zeros / (all_ * (1 - share))), 0))
    return scale, g


def learned_kinds(doc: np.ndarray, bucket: np.ndarray, label: np.ndarray, size: int, kinds: int = KINDS) -> np.ndarray:
    """A 0/1 column for each kind: clusters (by cosine, begun at buckets far from one another) of the buckets that tell
    labelled rows, as columns over those rows. Fewer telling buckets than kinds leave kinds that no row has."""
    out = np.zeros((len(label), kinds))
    if label.sum() in (0, len(label)):
        return out
    scale, g = telling(doc, bucket, label, size)
    best = np.flatnonzero((scale > 0) & (g > SURE))
    best = best[np.lexsort((best, -g[best]))[:TELLING]]
    place = np.full(size, -1)
    place[best] = np.arange(len(best))
    there = (place[bucket] >= 0) & (label[doc] == 1)
    rows = np.cumsum(label == 1) - 1
    table = np.zeros((len(best), int(label.sum())), np.float32)
    table[place[bucket[there]], rows[doc[there]]] = 1
    unit = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)
    if not len(best):
        return out
    centres = [unit[0]]
    for _ in range(min(kinds, len(best)) - 1):
        centres.append(unit[np.argmin(np.max(unit @ np.stack(centres).T, axis=1))])
    centre = np.stack(centres)
    for _ in range(10):
        of = np.argmax(unit @ centre.T, axis=1)
        sums = np.stack([unit[of == k].sum(axis=0) for k in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    for k in range(len(centre)):
        out[label == 1, k] = table[of == k].any(axis=0)
    return out


def fit_link(doc: np.ndarray, bucket: np.ndarray, before: np.ndarray, label: np.ndarray, size: int, epochs: int = 60, rate: float = 1.0) -> Link:
    """Logistic regression by full gradient steps over scaled presence of `size` buckets; without both labels, a constant."""
    n, pos = len(label), label.sum()
    if pos in (0, n):
        return Link(np.zeros(size, np.float32), np.zeros(before.shape[1]), 30.0 if pos and n else -30.0)
    scale, g = telling(doc, bucket, label, size)
    told = np.flatnonzero(g > SURE)  # what may well be chance tells nothing
    told = told[np.lexsort((told, -g[told]))[:USED]]
    rest = np.ones(size, bool)
    rest[told] = False
    scale[rest] = 0
    used = np.flatnonzero(scale[bucket])
    doc, value = doc[used], scale[bucket[used]]
    there = np.flatnonzero(scale)
    place = np.zeros(size, np.int64)
    place[there] = np.arange(len(there))
    at = place[bucket[used]]
    often = np.maximum(np.bincount(at, minlength=len(there)), 1)
    gain, chain, bias = np.full(len(there), 0.5), np.zeros(before.shape[1]), float(np.log(pos / (n - pos)))
    for _ in range(epochs):
        z = np.bincount(doc, gain[at] * value, n) + before @ chain + bias
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - label
        gain -= rate * np.bincount(at, error[doc] * value, len(there)) / often
        chain -= rate * before.T @ error / n
        bias -= rate * error.mean()
    weight = np.zeros(size, np.float32)
    weight[there] = gain * scale[there]
    return Link(weight, chain, bias)


def fit_chain(doc: np.ndarray, bucket: np.ndarray, labels: np.ndarray, fold: np.ndarray, size: int) -> list[Link]:
    """labels: a column for each category, in order. Later links learn from out-of-fold probabilities of the earlier ones."""
    before, links = np.zeros((len(labels), 0)), []
    for k in range(labels.shape[1]):
        apart = np.zeros(len(labels))
        for f in range(FOLDS):
            rest = fold != f
            index = np.cumsum(rest) - 1
            own = rest[doc]
            link = fit_link(index[doc[own]], bucket[own], before[rest], labels[rest, k], size)
            apart[~rest] = link.predict(doc, bucket, before)[~rest]
        links.append(fit_link(doc, bucket, before, labels[:, k], size))
        before = np.column_stack([before, apart])
    return links


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", categories: list[str] | None = None, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Chain:
    """A chain from labelled rows whose crc32(id as text) mod 5 is not 0: half of `rows` of either label at most, and
    most_bytes of text (see labelled_sample). categories: 0/1 columns of labels that come before label_col in the chain;
    without them KINDS kinds are learned. Null labels, ids and texts are left out, repeated ids count once; without rows of
    both labels every text has probability 0."""
    columns = [*(categories or []), label_col]
    names = [*(categories or [f"kind_{k + 1}" for k in range(KINDS)]), "toxic"]
    sample = labelled_sample(docs, labels, columns, id_col, text_col, rows, most_bytes)
    sample = sample.select(F.array(*columns).alias("y_"), F.pmod(F.xxhash64(id_col, text_col), F.lit(FOLDS)).cast("int").alias("fold_"), text_col)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, 2):
                doc, bucket = features(part.column(2))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                own = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary())], ["y", "fold", "bucket"])

        return work

    found = map_rows(sample, make, "y array<int>, fold int, bucket binary").toArrow()
    given = sorted(zip(found["bucket"].to_pylist(), found["y"].to_pylist(), found["fold"].to_pylist()))
    y = np.array([y for _, y, _ in given], np.float64).reshape(len(given), len(columns))
    if len(set(y[:, -1])) < 2:
        return Chain(names, [Link(np.zeros(BUCKETS, np.float32), np.zeros(k), -30.0) for k in range(len(names))])
    sets = [np.frombuffer(b, np.int32) for b, _, _ in given]
    doc, bucket, fold = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), np.array([f for _, _, f in given])
    there = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS) >= SEEN)
    place = np.full(BUCKETS, -1, np.int32)
    place[there] = np.arange(len(there))
    at = place[bucket]
    doc, at = doc[at >= 0], at[at >= 0].astype(np.int64)
    before = y[:, :-1] if categories else learned_kinds(doc, at, y[:, -1], len(there))
    links = fit_chain(doc, at, np.column_stack([before, y[:, -1]]), fold, len(there))
    own, known = y[:, -1].mean(), labels.filter(F.col(label_col).isin(0, 1)).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    known = min(max(known, 1e-6), 1 - 1e-6)
    links[-1].bias += float(np.log(known / (1 - known)) - np.log(own / (1 - own)))  # the sample has more toxic rows than the labels
    for link in links:
        weight = np.zeros(BUCKETS, np.float32)
        weight[there] = link.weight
        link.weight = weight
    return Chain(names, links)


def predict(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs with a column p_<category> (double) for each category, for every row. Null and empty texts have the
    probabilities of a text without words. Columns of these names are replaced; others stay."""
    added = [f"p_{c}" for c in chain.names]
    names = [c for c in docs.columns if c not in added]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema] + [f"{c} double" for c in added])
    sent = docs.sparkSession.sparkContext.broadcast(chain.links)  # BUCKETS numbers for each category, whatever the corpus

    def make():
        told = np.any([link.weight != 0 for link in sent.value], axis=0)  # other buckets add nothing

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, text_col):
                doc, bucket = features(part.column(text_col), told=told)
                p = np.zeros((part.num_rows, 0))
                for link in sent.value:
                    p = np.column_stack([p, link.predict(doc, bucket, p)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(p[:, k]) for k in range(len(added)))], [*names, *added])

        return work

    return map_rows(docs.select(*names), make, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, a probability for each learned kind and for toxicity, predicted (1 if p_toxic is 0.5 or more) of every
    row of documents. Null and empty texts have the probabilities of a text without words; a null id is not held out;
    repeated rows each come back; an empty table gives no rows."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chain = train(docs, labels)
    scored = predict(docs.select("doc_id", "text"), chain)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), *[f"p_{c}" for c in chain.names], (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"))
