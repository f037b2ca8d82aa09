"""Token files of directly addressable codes.

A block holds the ids of consecutive documents. Level 0 has the low 8 bits of every id, level 1 the next 8 bits of the
ids that need them, and so on. Each level has a bitmap of which of its ids go on, and a rank directory, the number of
ones before every 512 bits, so any token is found in a step a level: the place of an id in the next level is the number
of ones before it. Blocks are rows of Parquet files in the shared folder, in ascending order of document id.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripspark.llm.common import bound_batches, give_back, map_rows, new_path, resident, slices, tokenizer_path, whole_ids, with_key
from tripspark.llm.prefix_bpe import LONGEST, splitter, unnamed

CHUNK = 8
RANK_BITS = 512
#: Tokens after which a block is closed; a document is never cut, so a longer one is a block of its own.
BLOCK_TOKENS = 1 << 18
#: Words that a generation of those learnt holds, about; two are kept (of rare words most come again only in other texts).
WORDS = 250_000
#: Columns of the files; ids are whole numbers, or text where they are of another type.
BLOCK = "shard int, block int, first_id {id}, first_key long, n_tokens long, ids array<{id}>, ends array<long>, chunks array<binary>, flags array<binary>, ranks array<binary>"


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, bitmaps and rank directories, by level, of non-negative ids."""
    kind = np.uint32 if ids.dtype == np.uint32 else np.uint64
    chunks, flags, ranks, rest = [], [], [], ids.astype(kind, copy=False)
    while len(rest) or not chunks:
        chunks.append((rest & kind(255)).astype(np.uint8).tobytes())
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)))
        ones = np.bitwise_count(bits).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32)
        flags.append(bits.tobytes())
        ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).tobytes())
        rest = rest[more] >> kind(CHUNK)
    return chunks, flags, ranks


class Block:
    """Reads tokens of a packed block without decoding the rest of it."""

    def __init__(self, chunks: list[bytes], flags: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(c, np.uint8) for c in chunks]
        self.flags = [np.frombuffer(f, np.uint8) for f in flags]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    def ones_before(self, level: int, i: int) -> int:
        """Ones of the level's bitmap before bit i: the directory's entry, and at most 512 bits."""
        at = i // RANK_BITS
        if at >= len(self.ranks[level]):
            at = len(self.ranks[level]) - 1
            if at < 0:
                return 0
        bits = np.unpackbits(self.flags[level][at * RANK_BITS // 8 : -(-i // 8)], bitorder="little")[: i - at * RANK_BITS]
        return int(self.ranks[level][at]) + int(bits.sum())

    def token(self, i: int) -> int:
        value, shift = 0, 0
        for level in range(len(self.chunks)):
            value |= int(self.chunks[level][i]) << shift
            if not self.flags[level][i // 8] >> (i % 8) & 1:
                break
            i, shift = self.ones_before(level, i), shift + CHUNK
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens start .. end - 1."""
        out, at, a, b = self.chunks[0][start:end].astype(np.uint32), np.zeros(0, np.int64), start, end
        for level in range(len(self.chunks)):
            if level:
                out[at] |= self.chunks[level][a:b].astype(np.uint32) << np.uint32(CHUNK * level)
            more = np.unpackbits(self.flags[level][a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a].view(bool)
            if not more.any():
                break
            at, a = at[more] if level else np.flatnonzero(more), self.ones_before(level, a)
            b = a + len(at)
        return out


class _Learnt(dict):
    """Words -> bytes, each learnt when it is first asked for. before: those of the generation before, looked at first."""

    def __init__(self, learn: Callable[[str], bytes], before: dict[str, bytes]):
        super().__init__()
        self.learn, self.before = learn, before

    def __missing__(self, word: str) -> bytes:
        value = self.before.get(word)
        if value is None:
            value = self.learn(word)
        if len(word) <= LONGEST:
            self[word] = value
        return value


class WordIds:
    """Texts -> their ids as bytes of uint32, by the library's model for each word that the tokenizer's own steps cut.

    Texts that hold an added token, or a character that this Python's Unicode tables don't name while the library's may,
    are handed to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        kinds = [x["type"] for x in said["normalizer"]["normalizers"]]
        cut, level = said["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or cut["behavior"] != "Removed" or not cut["invert"] or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError("not a tokenizer of lower-cased words with white space dropped")
        self.split = splitter(cut["pattern"]["Regex"])
        self.added = [x["content"] for x in said["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.sign = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.model, self.memo = self.library.model, _Learnt(self._learn, {})

    def _learn(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.sign)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lower-cases letter by letter
        return self.split(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        rows, of = [], self.memo.__getitem__
        for text in texts:
            if any(a in text for a in self.added) or unnamed(text):
                rows.append(array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                rows.append(b"".join(map(of, self._words(text))))
        if len(self.memo) > WORDS:
            self.memo.before = {}
            self.memo = _Learnt(self._learn, self.memo)
        return rows


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token ids of every whole text, each document's followed by end_id, as blocks under out.

    path: a tokenizers file that every executor can read. Null and empty texts have the end id alone. Ids of whole numbers are
    written as long (a null one as the smallest long), others as text and in its order; null ids come first. Repeated rows are
    written as often as they come."""
    keyed, keys = with_key(docs.select(id_col, text_col), id_col, text_col)
    kind, id_type = ("long", pa.int64()) if whole_ids(docs, id_col) else ("string", pa.string())
    own_id = F.col(keys[0]) if kind == "long" else F.col(id_col).cast("string")
    ordered = keyed.select(own_id.alias("id_"), F.col(keys[1]).alias("key_"), F.col(text_col).alias("text_"))
    ordered = ordered.repartitionByRange("id_", "key_").sortWithinPartitions("id_", "key_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = resident(("words", path), lambda: WordIds(path)), TaskContext.get().partitionId(), 0
        ids: list[int] = []
        firsts: list[int] = []
        parts: list[bytes] = []
        size, last = 0, np.array([end_id], np.uint32).tobytes()

        def closed() -> pa.RecordBatch:
            ends = np.cumsum([len(p) // 4 for p in parts])
            chunks, flags, ranks = pack(np.frombuffer(b"".join(parts), np.uint32))
            row = (shard, number, ids[0], firsts[0], int(ends[-1]), ids, ends.tolist(), chunks, flags, ranks)
            kinds = (pa.int32(), pa.int32(), id_type, pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            for part in slices(batch, 2) if batch.num_rows else ():
                encoded = encoder.encode([t or "" for t in part.column(2).to_pylist()])
                for k1, k2, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encoded):
                    parts.append(own + last)
                    ids.append(k1)
                    firsts.append(k2)
                    size += len(parts[-1]) // 4
                    if size >= BLOCK_TOKENS:
                        yield closed()
                        number, size = number + 1, 0
                        ids, firsts, parts = [], [], []
        if parts:
            yield closed()
        give_back()

    bound_batches(docs.sparkSession)
    ordered.mapInArrow(run, BLOCK.format(id=kind)).write.parquet(out)


def read_blocks(spark: SparkSession, out: str) -> DataFrame:
    """The blocks under out with start (long): ids of all blocks before. Sums go by shard, then by block in a shard."""
    blocks = spark.read.parquet(out)
    shards = blocks.groupBy("shard").agg(F.min(F.struct("first_id", "first_key")).alias("at"), F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("shard_start"))  # a row for each file
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("in_shard"))
    places = places.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("in_shard")).alias("start"))
    return blocks.join(places, ["shard", "block"])


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """doc_id (long or string, as written), start, n_tokens (long), ids (binary: little-endian unsigned 32-bit integers) of every
    document under out."""
    rows = read_blocks(spark, out).select("ids", "ends", "n_tokens", "chunks", "flags", "ranks", "start")
    kind = rows.schema["ids"].dataType.elementType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in batch.to_pylist():
                block = Block(row["chunks"], row["flags"], row["ranks"])
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                every = block.tokens(0, row["n_tokens"]).astype("<u4").tobytes()
                ids = [every[4 * a : 4 * b] for a, b in zip(starts.tolist(), row["ends"])]
                own = pa.array([None if i == -(2**63) else i for i in row["ids"]], id_type)
                yield pa.RecordBatch.from_arrays([own, pa.array(starts + row["start"]), pa.array(ends - starts), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

        return work

    return map_rows(rows, make, f"doc_id {'string' if kind == 'string' else 'long'}, start long, n_tokens long, ids binary")


def token_at(spark: SparkSession, out: str, places: DataFrame) -> DataFrame:
    """places (place: long, counted over all documents) with token (long): the token that stands there in the files under out.

    Only the block that holds a place is looked into, by the rank directories and without decoding the rest of it. Places that
    come twice come back twice; a null place, or one past the end or below 0, has no row."""
    blocks = read_blocks(spark, out).select("start", (F.col("start") + F.col("n_tokens")).alias("end"), "chunks", "flags", "ranks")
    cell = F.lit(BLOCK_TOKENS)
    held = blocks.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))))
    asked = places.select("place").filter("place >= 0").withColumn("cell", F.floor(F.col("place") / cell))
    met = asked.groupBy("cell").agg(F.collect_list("place").alias("places")).join(held, "cell")

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in batch.to_pylist():
                block = Block(row["chunks"], row["flags"], row["ranks"])
                own = [p for p in row["places"] if row["start"] <= p < row["end"]]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([block.token(p - row["start"]) for p in own], pa.int64())], ["place", "token"])

        return work

    return map_rows(met.select("places", "start", "end", "chunks", "flags", "ranks"), make, "place long, token long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of documents, read back from the files. Null and empty texts have the end
    id alone; null ids come first; repeated rows are written and come back as often; an empty table gives no rows."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "tokens")
    write_tokens(docs, tokenizer_path("word_bpe_49k.json"), out)
    return read_documents(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
