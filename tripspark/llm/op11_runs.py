"""Periodic runs of words: longest common extensions over a difference cover, asked on a harmonic grid.

A run is a stretch of consecutive words with smallest period q, of at least `times` periods and `least` words, that no
neighbouring word extends. Texts are worked on a slice at a time; in a slice the words of all texts stand in one row of
numbers, each text closed by a number of its own, so nothing extends from one text into another.

Extensions: of any two places, both moved by the same few words stand on places of the cover (numbers modulo COVER that differ
by every amount). So only the suffixes at cover places, about a quarter, are sorted: by their first COVER words, then by
doubling. A sparse table of minima over the neighbours' common lengths answers any two sampled suffixes; other places compare
the few words up to the next sampled ones first.

Grid: a run of period p repeats itself p words on over (times - 1) * p places or more, so with grid places of twice the
period's distance one lies near its beginning, from which the forward extension is over (times - 3) * p. Pairs that extend that
far are grown backward (extensions of the reversed texts) to the whole run; of periods with the same stretch the smallest counts.
There are n/2p grid places for a period p, so n log n / 2 in all, and they are asked in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripspark.llm.common import free_name, map_rows, slices

#: A difference cover: the differences of its members give all numbers modulo COVER.
COVER = 13
MEMBERS = np.array([0, 1, 3, 9])
_IN = np.isin(np.arange(COVER), MEMBERS)
#: How far two places of given remainders have to move until both are on the cover.
_STEPS = np.array([[next(k for k in range(COVER) if _IN[(i + k) % COVER] and _IN[(j + k) % COVER]) for j in range(COVER)] for i in range(COVER)])
#: Grid pairs that are asked at a time, about.
BLOCK = 1 << 19


class Extensions:
    """Longest common extensions of any two places of a row of numbers, whose last number is found nowhere else."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate((words.astype(np.int64), np.full(2 * COVER, -1)))
        place = np.flatnonzero(_IN[np.arange(n) % COVER])
        self.index = np.full(n + COVER, -1)  # sampled places' numbers; beyond the end there are none
        self.index[place] = np.arange(len(place))
        levels = [self._by_words(place)]
        length = COVER
        while levels[-1].max() + 1 < len(place):
            levels.append(self._doubled(levels[-1], place, length))
            length *= 2
        self.rank = levels[-1]
        order = np.empty(len(place), np.int64)
        order[self.rank] = place
        self.table = [self._common(order, levels)]
        while 2 << (len(self.table) - 1) <= len(place):
            last, width = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-width], last[width:]))

    def _by_words(self, place: np.ndarray) -> np.ndarray:
        """Ranks of sampled suffixes by their first COVER words, a few words packed into one number."""
        top = int(self.words.max()) + 2
        each = max(1, 62 // top.bit_length())
        keys = []
        for begin in range(0, COVER, each):
            key = np.zeros(len(place), np.int64)
            for k in range(begin, min(begin + each, COVER)):
                key = key * top + self.words[place + k] + 1
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(place), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        return self._ranked(order, new)

    def _doubled(self, rank: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
        """Ranks by twice the words: those `length` words on are sampled too if length is a multiple of COVER."""
        ahead = np.minimum(place + length, len(self.index) - 1)
        after = self.index[ahead]
        key = rank * (len(place) + 1) + np.where(after >= 0, rank[after] + 1, 0)
        order = np.argsort(key, kind="stable")
        return self._ranked(order, np.concatenate(([False], key[order[1:]] != key[order[:-1]])))

    @staticmethod
    def _ranked(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _common(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of each sampled suffix and the next in order, from the ranks of every length down to single words."""
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            x, y = (self.index[np.minimum(p + common, len(self.index) - 1)] for p in (a, b))
            common += np.where((x >= 0) & (y >= 0) & (levels[level][x] == levels[level][y]), COVER << level, 0)
        return common + self._compared(a + common, b + common, np.full(len(a), COVER))

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, up to most (COVER at most)."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        for k in range(COVER):
            live = live[(self.words[i[live] + k] == self.words[j[live] + k]) & (most[live] > k)]
            if not len(live):
                break
            out[live] = k + 1
        return out

    def ask(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i and j differ."""
        few = _STEPS[i % COVER, j % COVER]
        out = self._compared(i, j, few)
        deep = np.flatnonzero(out == few)
        if len(deep):
            x, y = (self.rank[self.index[p[deep] + few[deep]]] for p in (i, j))
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for one in np.unique(level):
                at = np.flatnonzero(level == one)
                row = self.table[one]
                out[deep[at]] += np.minimum(row[low[at]], row[high[at] - (1 << int(one))])
        return out


def _joined(texts: list[np.ndarray], first_free: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' numbers in a row, each text closed by a number of its own, and where each text begins."""
    ends = first_free + np.arange(len(texts))
    row = np.concatenate([x for t, e in zip(texts, ends) for x in (t, [e])]) if texts else np.zeros(0, np.int64)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    return row, begin


def find_runs(texts: list[np.ndarray], times: int = 4, least: int = 6) -> list[np.ndarray]:
    """For each text (numbers that stand for its words) its runs: rows of start, length, period by start, then period."""
    if times < 3:
        raise ValueError("times: 3 or more")
    texts = [np.asarray(t, np.int64) for t in texts]
    free = 1 + max((int(t.max()) for t in texts if len(t)), default=0)
    size = np.array([len(t) for t in texts], np.int64)
    shape = np.zeros((0, 3), np.int64)
    out = [shape] * len(texts)
    periods = np.where(size >= least, size // times, 0)
    if not periods.sum():
        return out
    row, begin = _joined(texts, free)
    forward = Extensions(row)

    owner = np.repeat(np.arange(len(texts)), periods)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    grid = -(-(size[owner] - period) // (2 * period))  # places 0, 2p, ... whose word p words on is in the text
    done = np.concatenate(([0], np.cumsum(grid)))
    found, at = [], 0
    while at < len(owner):
        end = max(at + 1, int(np.searchsorted(done, done[at] + BLOCK, "right")) - 1)
        one = np.repeat(np.arange(at, end), grid[at:end])
        p, d = period[one], owner[one]
        i = begin[d] + (np.arange(len(one)) - (done[one] - done[at])) * 2 * p
        same = np.flatnonzero(row[i] == row[i + p])
        p, d, i = p[same], d[same], i[same]
        far = forward.ask(i, i + p)
        ok = far > np.maximum(least, times * p) - 3 * p  # places of the run less the grid's distance
        p, d, i, far = p[ok], d[ok], i[ok], far[ok]
        if len(p):  # the first grid place of each run
            stop = i + far
            new = np.concatenate(([True], (p[1:] != p[:-1]) | (stop[1:] != stop[:-1])))
            found.append(np.stack((d, p, i, stop))[:, new])
        at = end
    if not found:
        return out
    d, p, i, stop = np.concatenate(found, axis=1)

    back = np.unique(d)
    row, rear = _joined([texts[k][::-1] for k in back], free)
    mirror = np.searchsorted(back, d)
    x = rear[mirror] + size[d] - (i - begin[d])  # the word before i, in the reversed text
    start = i - Extensions(row).ask(x, x - p)
    length = stop + p - start
    ok = length >= np.maximum(least, times * p)
    d, start, length, p = d[ok], start[ok] - begin[d[ok]], length[ok], p[ok]
    order = np.lexsort((p, length, start, d))
    d, start, length, p = d[order], start[order], length[order], p[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])))[: len(d)]
    d, runs = d[new], np.stack((start, length, p), axis=1)[new]
    order = np.lexsort((runs[:, 2], runs[:, 0], d))
    runs, cut = runs[order], np.searchsorted(d, np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(cut[:-1], cut[1:])]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length / period, in whole numbers; of equal ones that of smallest start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words any run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] > 0


_RUN = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())


def periodic_runs(docs: DataFrame, text_col: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """docs with n_words (long), runs (array of start, length, period, by start, then period), strongest (one of them, or null)
    and collapsed (string: the words that no run holds after its first period, joined by one space).

    Words lie between ASCII white space. Null and empty texts have no words, no runs and an empty collapsed text. Each row is
    judged on its own, so repeated rows give equal results. Columns of these names are replaced; all others stay."""
    own = ("n_words", "runs", "strongest", "collapsed")
    names = [c for c in docs.columns if c not in own or c == text_col]
    text = free_name(docs, "text_")
    rows = docs.select(*names, F.col(text_col).alias(text))
    names = [c for c in names if c not in own]
    schema = docs.select(*names).schema.add("n_words", T.LongType(), False).add("runs", T.ArrayType(_RUN, False), False).add("strongest", _RUN).add("collapsed", T.StringType(), False)
    arrow = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, text):
                words = [(t or "").encode().split() for t in part.column(text).to_pylist()]
                size = np.array([len(w) for w in words])
                ids = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy()
                runs = find_runs(np.split(ids, np.cumsum(size)[:-1]), times, least)
                gone = [dropped(len(w), r).tolist() if len(r) else None for w, r in zip(words, runs)]
                kept = [b" ".join(w if g is None else [x for x, y in zip(w, g) if not y]).decode() for w, g in zip(words, gone)]
                every, first = np.concatenate(runs), np.cumsum([0] + [len(r) for r in runs])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in every.T], ["start", "length", "period"]))
                best = [b and dict(zip(("start", "length", "period"), b)) for b in map(strongest, runs)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(size, pa.int64()), lists, pa.array(best, arrow), pa.array(kept, pa.string())], [*names, "n_words", "runs", "strongest", "collapsed"])

        return work

    return map_rows(rows.select(*names, text), make, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs with every text whose crc32(doc_id) is a multiple of 10 made periodic from a word on: the contract's change of the input.
    A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    split = docs.withColumn("words_", F.when((h % 10 == 0) & F.col("text").isNotNull(), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    n = F.greatest(F.size("words_"), F.lit(1)).cast("long")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    head, part = F.slice("words_", F.lit(1), a), F.slice("words_", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(part, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    text = F.when(F.size("words_") > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text"))
    return split.select("doc_id", text.alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row of documents, a tenth of
    them made periodic first. Null and empty texts have no runs; repeated rows each come back; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(with_planted_runs(docs))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
