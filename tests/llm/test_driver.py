"""What the driver is sent, and what it keeps."""

import numpy as np
from pyspark.sql import DataFrame

from tripspark.llm import common, op8_quality


def test_small_counts_rows_and_is_sent_none(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("rows were sent to the driver")

    for name in ("take", "collect", "head", "limit"):
        monkeypatch.setattr(type(spark.range(1)), name, refused)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    hinted = [("broadcast" in common.small(spark.range(n))._jdf.queryExecution().logical().toString().lower()) for n in (0, 10, 11)]
    assert hinted == [True, True, False]
    assert isinstance(spark.range(1), DataFrame)


def test_training_rows_are_not_copied(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("good plain words " if i % 2 else "bad junk tokens ") * 3 + f"n{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    fitted, given = op8_quality.fit, []

    def fit(rows, y, prior):
        given.extend((b.dtype, b.flags.owndata, w.flags.owndata) for b, w in rows)
        return fitted([(b.astype(np.int64), w) for b, w in rows], y, prior), fitted(rows, y, prior)

    monkeypatch.setattr(op8_quality, "fit", fit)
    wide, narrow = op8_quality.train(docs, labels)
    assert given and set(given) == {(np.dtype(np.int32), False, False)}
    assert np.array_equal(wide.value, narrow.value) and wide.bias == narrow.bias
