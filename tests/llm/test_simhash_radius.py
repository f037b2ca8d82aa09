"""Large buckets at a radius under 4."""

from tripspark.llm import op4_simhash
from tripspark.llm.components import components


def test_large_buckets_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(op4_simhash, "BUCKET", 5)
    fps = spark.createDataFrame([(1 << i,) for i in range(60)], "fp long")  # all within 2 bits of one another
    assert components(op4_simhash.links(fps, 3)).count() == 59
