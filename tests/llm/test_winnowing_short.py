"""Fingerprints of short texts."""

import random

from tripspark.llm.op2_winnowing import edit_report


def test_short_texts_keep_their_likeness(spark):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices("abcdefghij ", k=60 + 6 * i))) for i in range(30)]  # 60 to 234 characters, half of each kept
    got = edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 30 and all(r["near_edited"] > r["near_next"] for r in got)
