"""Groups of texts that are linked by fingerprints (see op4_simhash) or whose sets of word shingles have a Jaccard likeness of 0.8 or more.

Of each set the least shingle in each of 120 random orders is taken; five of them together are a place, 24 places in all. Sets
of likeness j share a place with probability 1 - (1 - j**5)**24: 0.99993 at 0.8, so of a hundred thousand pairs at the very
limit about seven are not looked at, and 0.06 at 0.3. Sets at one place are compared by size, then by parity bitmaps (which
differ in no more bits than the sets differ in shingles), then in full, so nothing less alike is linked. So that a large group
costs no pairs of all its members, sets are first compared with one set of each place, and then only across groups. A place
that still holds many groups (texts around one common passage, say) is left for the rarest shingles of its sets, of which
alike sets share one for certain, so what is common to all of them brings no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.llm import op4_simhash
from tripspark.llm.common import map_rows, materialize, slices, small, with_key
from tripspark.llm.components import components
from tripspark.llm.hashing import mix, prefix_sums, span_hashes, word_hashes, word_spans

SHINGLE = 5
#: Likeness of a pair, as a fraction.
ABOVE, BELOW = 4, 5
#: Bits of a parity bitmap, and the columns that hold them.
BITS = 1024
MAP = [f"b{i}" for i in range(BITS // 64)]
#: Places of a set, and least shingles that make one.
PLACES, LEAST = 24, 5
_TURN, _SPREAD = np.random.default_rng(24).integers(0, 2**63, (2, PLACES * LEAST), dtype=np.uint64)
_SPREAD = _SPREAD * np.uint64(2) + np.uint64(1)
#: Rounds in which sets are compared with one set of each place.
ROUNDS = 2
#: Groups at a place beyond which its sets meet at their rarest shingles instead. No pair is lost by it, at any number; up to
#: it, a place's pairs are fewer than what looking for the rarest shingles costs.
CROWD = 1000
#: Counters of shingles, by 18 bits of their hashes, and so the bound of what the driver is sent.
COUNTERS = 1 << 18


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of words (between ASCII white space, A-Z lower-cased); a shorter text is one shingle."""
    data, start, end, first = word_spans(column)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    prefix = prefix_sums(word_hashes(data, start, end))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        k = min(shingle, b - a)
        at = np.arange(a, b - k + 1) if k else np.zeros(0, np.int64)
        out.append(np.unique(span_hashes(prefix, at, at + k)))
    return out


def name_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64))


def bitmap(own: np.ndarray) -> np.ndarray:
    """For each place of BITS, whether an odd number of the set's shingles fall on it, as numbers of 64 bits."""
    return np.packbits(np.bincount((own >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1).view(np.int64)


def places(sets: list[np.ndarray]) -> np.ndarray:
    """PLACES numbers for each set, a row each; an empty set has zeros."""
    size = np.array([len(x) for x in sets])
    out = np.zeros((len(sets), PLACES), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        every, begin = np.concatenate(sets), (np.cumsum(size) - size)[full]
        for p in range(PLACES):
            key = np.full(len(full), p + 1, np.uint64)
            for h in range(p * LEAST, (p + 1) * LEAST):
                key = mix(key * _SPREAD[0] + np.minimum.reduceat((every ^ _TURN[h]) * _SPREAD[h], begin))
            out[full, p] = key
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * BELOW >= ABOVE * (len(a) + len(b) - both)


def counter_of(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(20)).astype(np.int64) % COUNTERS


def rarest(own: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first shingles of a set by level of their counters, then by hash: as many as leave fewer than an alike set must share.
    In any one order of all shingles, alike sets have one of these in common."""
    most = len(own) + (-len(own) * ABOVE) // BELOW + 1
    return own[np.lexsort((own, level[counter_of(own)]))[:most]]


def _mapped(docs: DataFrame, text_col: str, schema: str, row) -> DataFrame:
    """row(part, sets): the columns of schema for a part of docs and its shingle sets."""
    names = [c.split()[0] for c in schema.split(", ")]

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays(row(part, shingle_sets(part.column(text_col))), names)

        return work

    return map_rows(docs, make, schema)


def _signed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))


def _named(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([name_of(s) for s in sets], pa.int64())


def _filtered(pairs: DataFrame, columns: tuple[str, str], keep) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, y = (batch.column(c).to_pylist() for c in columns)
            ok = pa.array([keep(p, q) for p, q in zip(x, y)], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

        return work

    return map_rows(pairs, make, "a long, b long")


def _both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs a, b with the columns of table (by node) for each."""
    for c in "ab":
        pairs = pairs.join(table.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]), c)
    return pairs


def _may(x: str, y: str) -> Column:
    """Whether sets may be alike by their sizes and bitmaps, columns of the frames x and y."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in MAP])
    return (F.least(n, m) * BELOW >= F.greatest(n, m) * ABOVE) & ((ABOVE + BELOW) * differ <= (BELOW - ABOVE) * (n + m))


def _sized(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs a, b those that may be alike."""
    for c in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(c), F.struct("n", *MAP).alias(f"of_{c}")), c)
    return pairs.filter(_may("of_a", "of_b")).select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs a, b those that are alike."""
    own = lambda p, q: alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64))
    return _filtered(_both(pairs, sets, "own").select("a", "b", "own_a", "own_b"), ("own_a", "own_b"), own)


def _levels(sets: DataFrame) -> np.ndarray:
    """How common the shingles of each counter are in the sets, as one byte (eight times the logarithm)."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            every = np.concatenate([np.frombuffer(x, np.uint64) for x in batch.column("own").to_pylist()])
            at, n = np.unique(counter_of(every), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["counter", "n"])

        return work

    out = np.zeros(COUNTERS, np.uint8)
    got = map_rows(sets.select("own"), make, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out[got["counter"]] = np.minimum(8 * np.log2(1 + got["n"].to_numpy(float)), 255)
    return out


def _rare(sets: DataFrame) -> DataFrame:
    """token, node: the rarest shingles of each set."""
    level = _levels(sets)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [rarest(np.frombuffer(x, np.uint64), level) for x in batch.column("own").to_pylist()]
            node = np.repeat(batch.column("node").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([_signed(found), pa.array(node)], ["token", "node"])

        return work

    return map_rows(sets.select("node", "own"), make, "token long, node long")


def _uncrowded(placed: DataFrame, sets_of, crowd: int) -> DataFrame:
    """token, node, root: placed without the places of more than `crowd` groups, but with the rarest shingles of their sets,
    and only where different groups meet. sets_of(nodes): the sets (node, own)."""
    groups = placed.select("token", "root").distinct().groupBy("token").agg(F.count("*").alias("n"))
    groups = materialize(groups.filter("n > 1"), "places")
    few = placed.join(groups.filter(F.col("n") <= crowd), "token", "left_semi").select("token", "node", "root")
    full = groups.filter(F.col("n") > crowd).select("token")
    if not full.take(1):
        return few
    members = materialize(placed.join(full, "token", "left_semi").select("node", "root").distinct(), "members")
    rare = materialize(_rare(materialize(sets_of(members.select("node")), "crowded")), "rare").distinct().join(members, "node")
    rare = materialize(rare.select("token", "node", "root"), "rare_placed")
    met = rare.groupBy("token").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p <> q").select("token")
    return few.union(rare.join(met, "token", "left_semi"))


def _near_fingerprints(rows: DataFrame) -> DataFrame:
    """Links of nodes whose texts have fingerprints that op4_simhash links."""
    of = materialize(rows.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    found = op4_simhash.links(of.select("fp"), 4)
    for c in "ab":
        found = found.join(of.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}")), c)
    equal = rows.join(of, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).union(equal).filter("a <> b").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """k_id, k_text, group (long) for each different pair of id and text (see with_key): texts of a group are reached over links.

    crowd: see CROWD; it changes the cost, not the groups. Texts without words are a group. Each round's tables are written to the shared folder."""
    keyed, keys = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    keyed = keyed.select(*keys, "text")

    def shingled(part, sets):
        fps = np.array([op4_simhash.fingerprint((t or "").encode()) for t in part.column("text").to_pylist()], np.uint64)
        at = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PLACES), _signed([places(sets).reshape(-1)]))
        return [part.column("k_id"), part.column("k_text"), _signed([fps]), _named(sets), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(column) for column in np.stack([bitmap(s) for s in sets]).T.copy()), at]

    rows = materialize(_mapped(keyed, "text", "k_id long, k_text long, fp long, node long, n long, " + "".join(f"{c} long, " for c in MAP) + "at array<long>", shingled), "shingled")
    nodes = materialize(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", *MAP, "at")], F.min(F.struct(*keys)).alias("text")), "nodes")
    at = nodes.select("node", F.explode("at").alias("token"))
    held = materialize(at.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token"), "held")
    at = materialize(at.join(held, "token"), "shared")
    own = lambda texts: _mapped(texts, "text", "node long, own binary", lambda _, sets: [_named(sets), pa.array([s.tobytes() for s in sets], pa.binary())])

    def sets_of(wanted: DataFrame) -> DataFrame:  # one text for each set is cut into shingles again
        texts = materialize(wanted.join(nodes.select("node", "text.*"), "node").select(*keys), "wanted")
        return own(keyed.join(small(texts), keys, "left_semi")).groupBy("node").agg(F.first("own").alias("own"))

    links = materialize(_near_fingerprints(rows.select("fp", "node").distinct()), "links")
    roots, done = components(links), None
    for r in range(ROUNDS + 1):
        placed = at.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root_")), "node", "left").select("token", "node", F.coalesce("root_", "node").alias("root"))
        if r < ROUNDS:
            placed = materialize(placed, "placed")
            centre = placed.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(r), F.col("token") % 4), "node", "root")).alias("c"))
            pairs = placed.join(centre, "token").filter("root <> c.root").select("node", F.col("c.node").alias("other"))
            pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
            pairs = materialize(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
            done = pairs if done is None else done.union(pairs)
            near = materialize(_sized(pairs, nodes), "near")
        else:  # whatever is left: only pairs that pass the bounds leave the join
            placed = _uncrowded(materialize(placed, "placed"), sets_of, crowd)
            placed = materialize(placed.join(nodes.drop("at", "text"), "node"), "bounded")
            x, y = placed.alias("x"), placed.alias("y")
            met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _may("x", "y"))
            pairs = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
            near = materialize(pairs.join(done, ["a", "b"], "left_anti"), "near")
        sets = sets_of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        found = materialize(_alike(near, sets), "alike")
        if found.take(1):
            roots = components(roots.union(found))
    out = rows.select(*keys, "node").distinct()
    return out.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(*keys, F.coalesce("root", "node").alias("group"))
