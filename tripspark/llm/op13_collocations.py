"""Phrase collocations: pairs of frequency-ranked units counted in direct-address tiles, recursively for longer phrases.

A unit is a word of a group (a language), or a phrase that is frequent. A phrase of k words is a pair: the unit of its first k - 1
words and its last word. A phrase can only be frequent if its first and its last k - 1 words are, so each length is counted over
the frequent units of the length before, which are ranked by frequency anew. Each counting pass reads the texts once:

- the `HEAD` commonest units have their rank as address. A pair of two such units falls on a tile of SIDE ranks by SIDE ranks; a
  tile with many pairs is counted by numpy's bincount, cell by cell, and a tile with few is sorted and counted as coordinates
- all other units have 64-bit hashes, and their pairs are counted as sorted coordinates of hashes
- Spark adds up what the tasks have counted, by pair: a common pair is one row of each batch of texts

What the tasks are sent has a fixed bound: the head's hashes, and a bit for each of 2**BITS hash values that says whether a
frequent unit may have it. The bits only spare work: units that pass by chance are dropped by exact counts. Words and phrases are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripspark.llm.common import map_rows, materialize, scratch, slices, text_buffer
from tripspark.llm.hashing import mix, word_hashes

#: Units that have an address of their own, and ranks on a tile's side.
HEAD, SIDE = 1 << 16, 256
#: A tile is counted by bincount if it has a pair for each so many cells.
FILL = 16
#: Hash bits of the table of frequent units (2 MB).
BITS = 24
#: Parts that a group's phrases are ranked in before the last ranking.
SALTS = 64
#: Times the group's number is spread before words are added to it, and phrases before a word is.
_GROUP, _NEXT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)

_KIND = np.ones(256, np.uint8)  # 1: of a word, 0: between words, 2: between pieces
_KIND[[9, 32]] = 0
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2


class Spans:
    """Words of a slice of texts: lower-cased bytes, start and end of each word, its text, and whether the next word follows in its piece."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffer(column)
        self.data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        kind = _KIND[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        word = kind == 1
        first, last = word.copy(), word.copy()
        if len(data):
            first[1:] &= ~word[:-1] | edge[1:-1]
            last[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        breaks = np.concatenate(([0], np.cumsum(kind == 2)))
        self.follows = (self.text[1:] == self.text[:-1]) & (breaks[self.start[1:]] == breaks[self.start[:-1]])

    def units(self, groups: list[str]) -> np.ndarray:
        """A hash for each word and its text's group."""
        of = {g: xxhash.xxh64_intdigest(g.encode(), 13) for g in set(groups)}
        group = np.array([of[g] for g in groups], np.uint64)
        return mix(word_hashes(self.data, self.start, self.end) + group[self.text] * _GROUP)


class Frequent:
    """What tasks know of the frequent units of a length: the head's hashes in order of rank, and the bits."""

    def __init__(self, head: np.ndarray, bits: np.ndarray):
        self.head, self.bits = head, bits
        self.order = np.argsort(head)
        self.sorted = head[self.order]

    def may(self, unit: np.ndarray) -> np.ndarray:
        at = unit >> np.uint64(64 - BITS)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def rank(self, unit: np.ndarray) -> np.ndarray:
        """Ranks of units of the head, -1 for others."""
        if not len(self.head):
            return np.full(len(unit), -1)
        at = np.minimum(np.searchsorted(self.sorted, unit), len(self.sorted) - 1)
        return np.where(self.sorted[at] == unit, self.order[at], -1)


def counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted coordinates of pairs, each once, and their counts."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[first], b[first], np.diff(np.append(first, len(a)))


def count_pairs(a: np.ndarray, b: np.ndarray, left: Frequent, right: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different pair of units (a, b) with its count: pairs within the heads by tile, others as coordinates."""
    x, y = left.rank(a), right.rank(b)
    inner = (x >= 0) & (y >= 0)
    out = [counted(a[~inner], b[~inner])]
    x, y = x[inner], y[inner]
    wide = HEAD // SIDE
    tile = (x // SIDE) * wide + y // SIDE
    order = np.argsort(tile, kind="stable")
    x, y, tile = x[order], y[order], tile[order]
    cut = np.append(np.flatnonzero(np.concatenate((np.ones(min(1, len(tile)), bool), tile[1:] != tile[:-1]))), len(tile))
    dense = np.diff(cut) * FILL >= SIDE * SIDE
    for k in np.flatnonzero(dense):
        at = slice(cut[k], cut[k + 1])
        cells = np.bincount((x[at] % SIDE) * SIDE + y[at] % SIDE, minlength=SIDE * SIDE)
        full = np.flatnonzero(cells)
        u, v = full // SIDE + tile[cut[k]] // wide * SIDE, full % SIDE + tile[cut[k]] % wide * SIDE
        out.append((left.head[u], right.head[v], cells[full]))
    thin = np.repeat(~dense, np.diff(cut))
    u, v, n = counted(x[thin], y[thin])
    out.append((left.head[u], right.head[v], n))
    return tuple(np.concatenate(c) for c in zip(*out))


def _rows(docs: DataFrame, group_col: str, text_col: str, default: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit(default)).alias("group"), F.col(text_col).alias("text"))


def _spans(batch: pa.RecordBatch) -> tuple[list[Spans], np.ndarray, np.ndarray, np.ndarray]:
    """The words of a batch, cut in slices: their spans, units, the row of each, and whether the next follows in its piece."""
    groups, begin, found, units, rows, follows = batch.column("group").to_pylist(), 0, [], [], [], []
    for part in slices(batch, "text"):
        spans = Spans(part.column("text"))
        found.append(spans)
        units.append(spans.units(groups[begin : begin + part.num_rows]))
        rows.append(spans.text + begin)
        follows += [spans.follows, np.zeros(min(1, len(spans.text)), bool)]
        begin += part.num_rows
    return found, np.concatenate(units), np.concatenate(rows), np.concatenate(follows)[:-1]


def word_counts(rows: DataFrame) -> DataFrame:
    """unit, group, phrase, f of every word of every group, counted a batch at a time."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found, units, row, _ = _spans(batch)
            unit, first, n = np.unique(units, return_index=True, return_counts=True)
            size = np.cumsum([len(s.start) for s in found])
            words, order = [b""] * len(first), np.argsort(first)
            for k, spans in enumerate(found):
                mine = order[np.searchsorted(first[order], size[k] - len(spans.start)) : np.searchsorted(first[order], size[k])]
                at, raw = first[mine] - (size[k] - len(spans.start)), spans.data.tobytes()
                for m, i, j in zip(mine.tolist(), spans.start[at].tolist(), spans.end[at].tolist()):
                    words[m] = raw[i:j]
            group = batch.column("group").take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), group, pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], ["unit", "group", "phrase", "f"])

        return work

    found = map_rows(rows, make, "unit long, group string, phrase string, f long")
    return found.groupBy("unit", "group", "phrase").agg(F.sum("f").alias("f"))


def frequent(units: DataFrame) -> Frequent:
    """The head of units (unit, f) and the bits of all of them: HEAD rows and 2**BITS bits at most."""
    head = units.orderBy(F.desc("f"), "unit").limit(HEAD).select("unit").toPandas()["unit"].to_numpy(np.int64)
    at = F.shiftrightunsigned("unit", 64 - BITS)
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    words = units.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(unit, {64 - BITS}) & 63 as int))")).alias("bits")).toPandas()
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return Frequent(head.view(np.uint64), bits)


def phrase_counts(rows: DataFrame, length: int, known: list[Frequent]) -> DataFrame:
    """head, last, unit, f: the phrases of `length` words whose first and last length - 1 words may be frequent, as the unit of
    those first words and the last word's. known: the frequent units of each smaller length."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            _, word, _, ok = _spans(batch)
            frequent_word = known[0].may(word)
            unit, ok = word, ok & frequent_word[:-1] & frequent_word[1:]
            for k in range(1, length):  # the phrases of k + 1 words from each place on, and whether all their parts may be frequent
                head, last = unit[:-1], word[k:]
                unit = mix(head * _NEXT + last)
                if k + 1 < length:
                    ok = ok & known[k].may(unit)
                    ok = ok[:-1] & ok[1:]
            a, b, n = count_pairs(head[ok], last[ok], known[length - 2], known[0])
            unit = mix(a * _NEXT + b)
            yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in (a, b, unit)), pa.array(n.astype(np.int64))], ["head", "last", "unit", "f"])

        return work

    found = map_rows(rows, make, "head long, last long, unit long, f long")
    return found.groupBy("head", "last", "unit").agg(F.sum("f").alias("f"))


def cut_score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in whole numbers of 38 digits; a is at most l and r, so it is at most 1000000."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, wide(l) * wide(r))


def _level(found: DataFrame, levels: list[DataFrame], length: int, least: int) -> DataFrame:
    """unit, group, phrase, f, and for each cut k the units left_k, rest_k and their counts l_k, r_k, of the phrases found.

    levels: the same for the smaller lengths. Both sides of every cut are frequent, as the phrase is."""
    rows = found.filter(F.col("f") >= least)
    before = levels[length - 2]
    cuts = range(1, length - 1)
    head = before.select(
        F.col("unit").alias("head"), "group", F.col("phrase").alias("before"), F.col("f").alias(f"l_{length - 1}"), F.col("unit").alias(f"left_{length - 1}"),
        *[F.col(f"{c}_{k}") for k in cuts for c in ("left", "l")], *[F.col(f"rest_{k}").alias(f"head_{k}") for k in cuts],
    )
    last = levels[0].select(F.col("unit").alias("last"), F.col("unit").alias(f"rest_{length - 1}"), F.col("phrase").alias("word"), F.col("f").alias(f"r_{length - 1}"))
    rows = rows.join(head, "head").join(last, "last")
    for k in cuts:  # the rest after k words ends in the same word
        shorter = levels[length - k - 1].select(F.col("head").alias(f"head_{k}"), "last", F.col("unit").alias(f"rest_{k}"), F.col("f").alias(f"r_{k}"))
        rows = rows.join(shorter, [f"head_{k}", "last"])
    sides = [F.col(f"{c}_{k}") for k in range(1, length) for c in ("left", "rest", "l", "r")]
    return rows.select("head", "last", "unit", "group", F.concat_ws(" ", "before", "word").alias("phrase"), "f", *sides)


def collocations(
    docs: DataFrame, group_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, default: str = "und"
) -> DataFrame:
    """group_col, rank (from 1), phrase, a, l, r, n, score: the collocations of each group, the first `top` of each.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and those into words at spaces and tabs. Phrases of
    2 to `longest` words within a piece that occur `least` times or more are candidates; a phrase's score is that of its weakest cut
    (of equal ones the first), l and r the counts of its sides. A candidate that a longer candidate holds in `inside` percent
    or more of its places is dropped. n: words of the group. Null texts are empty, a null group is `default`, repeated rows count each time;
    an empty table gives no rows."""
    spark, rows = docs.sparkSession, _rows(docs, group_col, text_col, default)
    with scratch(spark):
        words = materialize(word_counts(rows), "words")
        total = words.groupBy("group").agg(F.sum("f").alias("n"))
        levels = [materialize(words.filter(F.col("f") >= least).select("unit", "group", "phrase", "f"), "level")]
        known = []
        for length in range(2, longest + 1):
            known.append(frequent(levels[-1].select("unit", "f")))
            levels.append(materialize(_level(phrase_counts(rows, length, known), levels, length, least), "level"))
        found = None
        for k, level in enumerate(levels[1:], 2):
            scored = [F.struct(cut_score(F.col("f"), F.col(f"l_{c}"), F.col(f"r_{c}")).alias("score"), F.lit(c).alias("k"), F.col(f"l_{c}").alias("l"), F.col(f"r_{c}").alias("r")) for c in range(1, k)]
            best = F.least(*scored) if len(scored) > 1 else scored[0]
            own = level.select("unit", "group", "phrase", F.col("f").alias("a"), best.alias("cut"))
            for longer in levels[k:]:  # the parts of k words of each longer candidate
                held = _parts(longer, levels, k)
                own = own.join(held, "unit", "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))).drop("most")
            found = own if found is None else found.union(own)
        out = materialize(_ranked(found, total, top), "collocations", stays=True)
    return out.select(F.col("group").alias(group_col), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _parts(longer: DataFrame, levels: list[DataFrame], k: int) -> DataFrame:
    """unit, most: the units of k words inside the phrases of longer, and the greatest count of a phrase that holds each."""
    width = next(i for i, x in enumerate(levels, 1) if x is longer)
    inner = longer.select("unit", "f")
    for size in range(width, k, -1):  # from size words to the first and the last size - 1
        side = levels[size - 1].select("unit", F.explode(F.array(f"left_{size - 1}", "rest_1")).alias("part"))
        inner = inner.join(side, "unit").groupBy(F.col("part").alias("unit")).agg(F.max("f").alias("f"))
    return inner.withColumnRenamed("f", "most")


def _ranked(found: DataFrame, total: DataFrame, top: int) -> DataFrame:
    """The first ones of each group: they are among the first ones of the group's parts, so no task ranks a whole group."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = found.select("group", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    for by in (["group", "salt"], ["group"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return rows.join(total, "group")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first 2000 phrases of 2 or 3 words. Null texts are empty, a null lang
    is und, repeated rows count each time; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    return collocations(docs)


#: Phrases as text, counted over all pieces.
OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
f AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS s, CAST(count(*) AS BIGINT) AS f
  FROM p, (VALUES (1), (2), (3)) AS ks(k), unnest(range(1, len(w) - k + 2)) AS u(i) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, s, f AS a, string_split(s, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, s, a, w, unnest(range(1, k)) AS j FROM c),
scored AS (SELECT cuts.lang, cuts.s, a, j, x.f AS l, y.f AS r,
    CAST(1000000 * CAST(a AS HUGEINT) * CAST(a AS HUGEINT) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.s = array_to_string(w[1:j], ' ') AND x.k = j
    JOIN f y ON y.lang = cuts.lang AND y.s = array_to_string(w[j+1:], ' ') AND y.k = len(w) - j),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, j) = 1),
held AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE k = 3) GROUP BY ALL)
SELECT best.lang, CAST(row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, s) AS BIGINT) AS rank, s AS phrase, a, l, r, n, score
FROM best JOIN n ON n.lang = best.lang LEFT JOIN held ON held.lang = best.lang AND held.part = s
WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, s) <= 2000
"""
