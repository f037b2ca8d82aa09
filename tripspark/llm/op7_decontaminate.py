"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The index holds a posting (term, document, position) for each training word that the benchmark has too, and one
for each document's end, whose position is its number of words. Each test window is looked up by its rarest term:
a posting of it fixes where in the document the window would begin. Neighbouring windows of an item share their
rarest term, so an item is looked up at a few offsets. What is left is intersected with the offset-adjusted list
of the window's second rarest term, and then with the lists of all the item's terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripspark.llm.common import ascii_lower, materialize, small, whole_ids, with_key

#: What ends a word, once A-Z is lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The term that stands for a document's end; no word is empty.
END = ""


def words_of(text: str) -> F.Column:
    return F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), lambda w: w != "")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, item_id, at, term, size: the words of each item in order; rows with equal id and text are one item."""
    keyed, keys = with_key(items.select(id_col, text_col), id_col, text_col)
    words = keyed.select(F.struct(*keys).alias("item"), F.col(id_col).cast("string").alias("item_id"), words_of(text_col).alias("words")).dropDuplicates(["item"])
    return words.select("item", "item_id", F.posexplode("words").alias("at", "term"), F.size("words").alias("size"))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term_id, key columns, pos: the postings of terms (term, term_id) in docs, written to the shared folder.

    terms must hold END, whose posting stands at a document's number of words; so every document has a posting."""
    keyed, keys = with_key(docs.select(id_col, text_col), id_col, text_col)
    listed = keyed.select(*keys, F.posexplode(F.concat(words_of(text_col), F.array(F.lit(END)))).alias("pos", "term"))
    return materialize(listed.join(small(terms), "term").select("term_id", *keys, "pos"), "postings")


def phrase_hits(index: DataFrame, keys: list[str], tokens: DataFrame, window: int) -> DataFrame:
    """key, item, shift, start, end: the words start .. end - 1 of a document are covered by windows of the item, whose
    word 0 stands at shift. tokens: item, at, term_id, size. An item of fewer words than window is one window."""
    counts = index.groupBy("term_id").agg(F.count("*").alias("cf"))
    tokens = tokens.join(counts, "term_id", "left")
    need = F.least(F.col("size"), F.lit(window))
    ahead = Window.partitionBy("item").orderBy("at").rowsBetween(0, window - 1)
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), "term_id", "at")).over(ahead))
    windows = tokens.withColumn("ranked", ranked).filter(F.col("at") + need <= F.col("size"))
    windows = windows.filter(F.col("ranked")[0]["cf"] > 0)  # a term that the corpus lacks rules its windows out
    second = F.element_at("ranked", F.least(F.size("ranked"), F.lit(2)))
    anchors = windows.select("item", F.col("ranked")[0]["term_id"].alias("term_id"), F.col("ranked")[0]["at"].alias("at"), second["term_id"].alias("term_2"), second["at"].alias("at_2")).distinct()
    anchors = materialize(anchors, "anchors")

    first = index.join(small(anchors), "term_id").select(*keys, "item", (F.col("pos") - F.col("at")).alias("shift"), "term_2", "at_2")
    first = first.select(*keys, "item", "shift", F.col("term_2").alias("term_id"), (F.col("shift") + F.col("at_2")).alias("pos"))
    lists = index.join(small(anchors.select(F.col("term_2").alias("term_id")).distinct()), "term_id", "left_semi")
    at = materialize(first.join(lists, [*keys, "term_id", "pos"], "left_semi").select(*keys, "item", "shift").distinct(), "alignments")

    lists = index.join(small(at.select(*keys).distinct()), keys, "left_semi")
    asked = at.join(tokens.select("item", "at", "term_id", "size"), "item").withColumn("pos", F.col("shift") + F.col("at"))
    met = asked.join(lists, [*keys, "term_id", "pos"], "left_semi")
    row = Window.partitionBy(*keys, "item", "shift").orderBy("at")
    met = met.withColumn("run", F.col("at") - F.row_number().over(row))
    runs = met.groupBy(*keys, "item", "shift", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.max("size").alias("size"))
    return runs.filter(F.col("end") - F.col("start") >= need).drop("run", "size")


def proximity_hits(index: DataFrame, keys: list[str], pairs: DataFrame, within: int) -> DataFrame:
    """key, pair, start: places where a pair's two terms stand at most `within` words apart, in either order.

    pairs: pair, term_a, term_b. Looked up from the rarer term's list; matched in cells of `within` words, so a
    place meets only lists near it."""
    counts = index.groupBy("term_id").agg(F.count("*").alias("cf"))
    both = pairs.join(counts.toDF("term_a", "cf_a"), "term_a").join(counts.toDF("term_b", "cf_b"), "term_b")
    swap = F.col("cf_a") > F.col("cf_b")
    both = both.select("pair", F.when(swap, F.col("term_b")).otherwise(F.col("term_a")).alias("rare"), F.when(swap, F.col("term_a")).otherwise(F.col("term_b")).alias("term_id"))
    cell = F.floor(F.col("pos") / within)
    near = index.join(both, index["term_id"] == both["rare"]).select(*keys, "pair", both["term_id"], F.col("pos").alias("start"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    lists = index.join(both.select("term_id").distinct(), "term_id", "left_semi").withColumn("cell", cell)
    met = near.join(lists, [*keys, "term_id", "cell"]).filter((F.abs(F.col("pos") - F.col("start")) <= within) & (F.col("pos") != F.col("start")))
    return met.select(*keys, "pair", "start").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20) -> tuple[DataFrame, list[str]]:
    """For every row of docs: id_col, the key columns, n_words, n_hit, n_items (long), items (array of string, sorted),
    contaminated (n_hit > 0 and share * n_hit >= n_words); and the names of the key columns.

    Null and empty texts have no words and no hits; items without words match nothing. Repeated rows of docs each come
    back, and repeated items count once; a null item id is named as an empty string."""
    tokens = materialize(item_terms(items, item_col, item_text), "items")
    ids = tokens.select("term").union(tokens.sparkSession.createDataFrame([(END,)], "term string")).distinct()
    terms = materialize(ids.select("term", F.xxhash64("term").alias("term_id")), "terms")
    tokens = tokens.withColumn("term_id", F.xxhash64("term"))
    _, keys = with_key(docs.select(id_col, text_col), id_col, text_col)
    index = build_index(docs, terms, id_col, text_col)
    end = index.filter(F.col("term_id") == F.xxhash64(F.lit(END)))
    inner = index.filter(F.col("term_id") != F.xxhash64(F.lit(END)))

    hits = materialize(phrase_hits(inner, keys, tokens, window), "hits")
    words = hits.select(*keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos")).groupBy(*keys).agg(F.count_distinct("pos").alias("n_hit"))
    named = hits.join(tokens.select("item", "item_id").distinct(), "item")
    named = named.groupBy(*keys).agg(F.array_sort(F.collect_set(F.coalesce("item_id", F.lit("")))).alias("items"))
    found = words.join(named, keys)
    id_of = F.when(F.col(keys[0]) != -(2**63), F.col(keys[0]))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = end.select(*keys, F.col("pos").cast("long").alias("n_words")).join(found, keys, "left")
    if not whole_ids(docs, id_col):  # the keys are hashes of the ids
        keyed, own = with_key(docs.select(id_col, text_col), id_col, text_col)
        id_of = F.col("id_")
        out = out.join(keyed.select(F.col(id_col).alias("id_"), *[F.col(c).alias(k) for c, k in zip(own, keys)]).distinct(), keys)
    return out.select(
        id_of.alias(id_col), *keys, "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    ), keys


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of documents. Null and empty texts have no words
    and no hits; repeated rows each come back; without items nothing is hit; an empty table gives no rows."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found, _ = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


#: Windows as text, counted over all documents and items.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i+least(13, len(w))-1], ' ') AS s FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
m AS (SELECT DISTINCT doc_id, item_id, i, n FROM dw JOIN bw USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
