"""Ids that are text, and labelled samples with long texts."""

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tripspark.llm import common, op2_winnowing, op3_token_files, op5_toxicity, op8_quality

ROWS = [("b", "two words here"), ("a/1", "one " * 40), ("a/1", "one " * 40), ("a/10", None), (None, "no id " * 9), ("é", ""), ("A", "upper case id"), ("a/2", "x")]


def test_text_ids_in_token_files(spark):
    out = common.new_path(spark, "tokens")
    op3_token_files.write_tokens(spark.createDataFrame(ROWS, "doc_id string, text string"), P.path("word_bpe_49k.json"), out)
    got = sorted(op3_token_files.read_documents(spark, out).collect(), key=lambda r: r["start"])
    want = sorted(ROWS, key=lambda r: (r[0] is not None, (r[0] or "").encode()))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    library, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for r, (_, text) in zip(got, want):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["start"] == start and r["n_tokens"] == len(ids)
        start += len(ids)


def test_text_ids_in_winnowing(spark):
    rows = [r for r in ROWS if r[0] != "a/1"] + [ROWS[1]]
    got = {r["doc_id"]: r for r in op2_winnowing.edit_report(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0].encode(), reverse=True) + [r for r in rows if r[0] is None]
    numbered = [(100 - k, t) for k, (_, t) in enumerate(order)]
    want = {r["doc_id"]: r for r in op2_winnowing.edit_report(spark.createDataFrame(numbered, "doc_id long, text string")).collect()}
    for (i, _), (k, _) in zip(order, numbered):
        assert tuple(got[i])[1:] == tuple(want[k])[1:]
    assert len(got) == len(rows)


def test_positions(spark):
    ids = [f"k{i * 7919 % 1000}" for i in range(1000)]
    got = common.positions(spark.createDataFrame([(i,) for i in [*ids, None]], "id string").repartition(7), "id", "at").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["at"])] == [None, *sorted(ids)] and sorted(r["at"] for r in got) == list(range(1001))


def labelled(spark, long_class):
    docs = [(i, ("good plain words " if i % 2 else "bad junk tokens ") * 3 + f"n{i}") for i in range(400)]
    docs += [(1000 + k, "huge " * 120_000) for k in range(30)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1000 + k, long_class) for k in range(30)], "doc_id long, quality int")
    return docs, labels


@pytest.mark.parametrize("long_class", [0, 1])
def test_a_long_text_empties_no_class(spark, long_class):
    docs, labels = labelled(spark, long_class)
    sample = common.labelled_sample(docs, labels, ["quality"], "doc_id", "text", 1000, 1 << 20).collect()
    for v in (0, 1):
        own = [r for r in sample if r["quality"] == v]
        assert len(own) > 100 and sum(len(r["text"]) for r in own) <= 1 << 19
    model = op8_quality.train(docs, labels, most_bytes=1 << 20)
    scores = {r["doc_id"]: r["score"] for r in op8_quality.score(docs, model).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(400))
    chain = op5_toxicity.train(docs, labels.withColumnRenamed("quality", "toxic"), most_bytes=1 << 20)
    p = {r["doc_id"]: r["p_toxic"] for r in op5_toxicity.predict(docs, chain).collect()}
    assert all((p[i] > 0.5) == bool(i % 2) for i in range(400))


def test_no_text_that_fits_is_an_error(spark):
    docs, labels = labelled(spark, 1)
    labels = labels.filter("quality = 0 or doc_id >= 1000")
    with pytest.raises(ValueError, match="quality = 1"):
        common.labelled_sample(docs, labels, ["quality"], "doc_id", "text", 1000, 1 << 20)
