"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at few differing bits.

Pairs come from fingerprints that agree on enough of eight blocks of bits (with r differing bits, 8 - r blocks
agree). A pivot table holds each distinct fingerprint's Hamming distances to reference fingerprints; it is made once and its
rows go with the fingerprints into their buckets. By the triangle inequality two fingerprints within r bits differ by at most
r in every coordinate. In a bucket, members are ordered by the first coordinate, so only a band around each is looked at;
pairs whose largest coordinate difference is over r are discarded, and the rest are verified bit by bit. A bucket gives one
row for each linked member, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.common import give_back, map_rows, materialize, slices, with_key
from tripspark.llm.components import components
from tripspark.llm.hashing import mix

BLOCKS = 8
#: A bucket of more fingerprints is dealt out again by the bits that are left; what then agrees has 2**16 values at most.
BUCKET = 1 << 16
#: Buckets of so many or fewer are compared all together, at each distance in the order of the rows.
SMALL = 8
#: Reference fingerprints of the pivot table; eight coordinates of a byte each make one number.
PIVOTS = np.random.default_rng(42).integers(0, 2**64, 8, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the shingles of words (between ASCII white space, A-Z lower-cased), repeats included; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", fp_col: str = "fp", shingle: int = 4) -> DataFrame:
    """docs with fp_col (long): the fingerprint's 64 bits as a signed number. Null and empty texts have 0."""
    names = [c for c in docs.columns if c != fp_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + f", `{fp_col}` long"

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, text_col):
                fps = np.array([fingerprint((t or "").encode(), shingle) for t in part.column(text_col).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(fps.view(np.int64))], [*names, fp_col])

        return work

    return map_rows(docs.select(*names), make, schema)


def _keys(fps: np.ndarray, wide: int, agree: int) -> Iterator[np.ndarray]:
    """For each choice of `agree` of the 8 blocks of `wide` bits: the choice's number and the bits of those blocks."""
    blocks = [(fps >> np.uint64(wide * i)) & np.uint64((1 << wide) - 1) for i in range(BLOCKS)]
    for number, chosen in enumerate(combinations(range(BLOCKS), agree)):
        key = np.full(len(fps), number, np.uint64)
        for i in chosen:
            key = key << np.uint64(wide) | blocks[i]
        yield key


def _rest(fps: np.ndarray, keys: np.ndarray, agree: int) -> np.ndarray:
    """The bits of the blocks that each key leaves out, next to one another."""
    number, out = (keys >> np.uint64(8 * agree)).astype(np.int64), np.zeros(len(fps), np.uint64)
    for n, chosen in enumerate(combinations(range(BLOCKS), agree)):
        at = np.flatnonzero(number == n)
        for i in range(BLOCKS):
            if i not in chosen:
                out[at] = out[at] << np.uint64(8) | (fps[at] >> np.uint64(8 * i)) & np.uint64(255)
    return out


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to the pivots: a row of int8 each."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def may_link(table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Whether no coordinate of the rows i and j of the pivot table differs by more than radius."""
    return (np.abs(table[i] - table[j]) <= radius).all(axis=-1)


def _near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those within radius: first by the pivots' coordinates, then by all bits."""
    ok = may_link(table, i, j, radius)
    i, j = i[ok], j[ok]
    ok = np.bitwise_count(fps[i] ^ fps[j]) <= radius
    return i[ok], j[ok]


def _large(fps: np.ndarray, table: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of one bucket, in blocks: rows of the pivot table in the order of its first coordinate."""
    order = np.argsort(table[:, 0], kind="stable")
    table, first = table[order], table[order, 0].astype(np.int64)
    step = max(1, (1 << 20) // len(fps))
    for a in range(0, len(fps), step):
        b = min(a + step, len(fps))
        end = int(np.searchsorted(first, first[b - 1] + radius, "right"))
        ok = np.abs(table[a:b, None, 0] - table[None, a:end, 0]) <= radius
        for p in range(1, len(PIVOTS)):
            ok &= np.abs(table[a:b, None, p] - table[None, a:end, p]) <= radius
        i, j = np.nonzero(ok)
        i, j = order[i + a], order[j + a]
        near = (np.bitwise_count(fps[i] ^ fps[j]) <= radius) & (i != j)
        yield i[near], j[near]


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root: the least index that each index is known to reach; the same after the pairs (i, j) are linked."""
    while True:
        a, b = root[i], root[j]
        if np.array_equal(a, b):
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, shorter := root[root]):
            root = shorter


def _linked(keys: np.ndarray, fps: np.ndarray, packed: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of key: each linked fingerprint and the one of its bucket that it is reached from."""
    table = packed.view(np.int8).reshape(-1, len(PIVOTS))
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    size = np.diff(cut)
    place = np.repeat(size, size)
    pairs_i, pairs_j = [], []
    few = place <= SMALL
    for d in range(1, SMALL):
        i = np.flatnonzero(few[:-d] & (keys[:-d] == keys[d:])) if len(keys) > d else np.zeros(0, np.int64)
        i, j = _near(fps, table, i, i + d, radius) if len(i) else (i, i)
        pairs_i.append(i)
        pairs_j.append(j)
    root = _joined(np.arange(len(fps)), np.concatenate(pairs_i), np.concatenate(pairs_j))
    for b in np.flatnonzero(size > SMALL):
        own = fps[cut[b] : cut[b + 1]]
        sub = np.arange(len(own))
        for i, j in _large(own, table[cut[b] : cut[b + 1]], radius):
            sub = _joined(sub, i, j)
        root[cut[b] : cut[b + 1]] = cut[b] + sub
    at = np.flatnonzero(root != np.arange(len(root)))
    return fps[at], fps[root[at]]


def _bucket_links(rows: DataFrame, radius: int, bound: int | None) -> DataFrame:
    """rows: key, fp, coords. Returns a, b, again: links; or, of buckets over bound, the fingerprint and key to deal out again."""

    def make():
        held: list[list[np.ndarray]] = []
        state = {"over": None}

        def flush(keys: np.ndarray, fps: np.ndarray, packed: np.ndarray, again: bool) -> pa.RecordBatch:
            a, b = (fps, keys) if again else _linked(keys, fps, packed, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), again))], ["a", "b", "again"])

        def work(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if batch is not None:
                own = [batch.column(i).to_numpy().view(np.uint64) for i in range(3)]
                if held:
                    own = [np.concatenate(x) for x in zip(held.pop(), own)]
                tail = int(np.searchsorted(own[0], own[0][-1]))  # the last bucket may go on in the next batch
                if state["over"] is not None:
                    n = int(np.searchsorted(own[0], np.uint64(state["over"]), "right"))
                    if n:
                        yield flush(*(x[:n] for x in own), True)
                    if n < len(own[0]):
                        state["over"] = None
                    own, tail = [x[n:] for x in own], max(0, tail - n)
                if tail:
                    yield from parts(*(x[:tail] for x in own))
                if len(own[0]) > tail:
                    if bound and len(own[0]) - tail > bound:
                        state["over"] = int(own[0][-1])
                        yield flush(*(x[tail:] for x in own), True)
                    else:
                        held.append([x[tail:].copy() for x in own])
            elif held:
                yield from parts(*held.pop())

        def parts(keys: np.ndarray, fps: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
            size = np.diff(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))))
            over = np.repeat(size > bound, size) if bound else np.zeros(len(keys), bool)
            if over.any():
                yield flush(keys[over], fps[over], packed[over], True)
            yield flush(keys[~over], fps[~over], packed[~over], False)

        return work

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)
        yield from work(None)
        give_back()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, again boolean")


def links(fps: DataFrame, radius: int) -> DataFrame:
    """fps: fp, each once. Returns a, b: links that connect whatever pairs within radius bits (0 to 4) connect.

    A bucket of more than BUCKET fingerprints is dealt out again, at any radius, by as many of eight narrow blocks of the
    8 * radius bits that its key leaves out; nothing is left out."""
    agree = BLOCKS - radius

    def dealt(wide: int, before: bool):
        def make():
            def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                for at in range(0, batch.num_rows, 1 << 12):
                    part = batch.slice(at, 1 << 12)
                    own = part.column(0).to_numpy().view(np.uint64)
                    coords = pa.array(pivot_table(own).view(np.int64).reshape(-1))
                    keys = part.column(1).to_numpy().view(np.uint64) if before else None
                    for key in _keys(own if keys is None else _rest(own, keys, agree), wide, agree):
                        key = key if keys is None else mix(keys) + key  # buckets that fall together are only compared in vain
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0), coords], ["key", "fp", "coords"])

            return work

        return make

    form = "key long, fp long, coords long"
    first = materialize(_bucket_links(map_rows(fps.select("fp"), dealt(8, False), form), radius, BUCKET), "links")
    over = first.filter("again").select(F.col("a").alias("fp"), F.col("b").alias("key"))
    out = first.filter("not again").select("a", "b")
    if over.take(1):
        more = _bucket_links(map_rows(over, dealt(radius, True), form).distinct(), radius, None)
        out = out.union(more.select("a", "b"))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """id_col, k_id, k_text, fp (long) and component_id for every row of docs.

    Two texts are linked if their fingerprints differ in radius bits or fewer; component_id is the smallest id reachable
    over links. Null and empty texts have fingerprint 0, linked like any other. Repeated rows each come back; a null id
    is never the smallest unless all ids of its component are null. radius is 4 or less."""
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4")
    keyed, keys = with_key(docs.select(id_col, text_col), id_col, text_col)
    rows = materialize(with_fingerprints(keyed, text_col, "fp", shingle).select(id_col, *keys, "fp"), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = components(links(fps, radius)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    named = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select(id_col, *keys, "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of documents. Null and empty texts have fingerprint zero; repeated rows
    each come back; component_id is null where all ids of a component are; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
