"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.llm.common import materialize

#: Parts that the edges of one node are joined in.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with m, the least of their a; a node of very many edges is joined in parts."""
    parts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    return edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least.withColumn("s", parts), ["a", "s"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(down, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def _done(edges: DataFrame) -> bool:
    """Whether all edges go down to the least node of a star: no node has two, or one of its own and another's."""
    own = edges.select(F.col("a").alias("node"), F.when(F.col("a") > F.col("b"), 1).otherwise(2).alias("out"), F.lit(0).alias("met"))
    ends = own.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("out").alias("out"), F.max("met").alias("met"))
    return not ends.agg(F.count_if(F.expr("out > 1 or out + met > 1")).alias("n")).first()["n"]


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns a, b: every node but the least of each component, and that least node.

    Loops over rounds, of which there are few even for long chains; each round's edges are written to the shared folder.
    Whether a round is the last is asked of its edges, so that none is spent on finding that nothing changes."""
    edges = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    while not _done(edges):
        edges = materialize(_small_star(_large_star(edges)).distinct(), "edges")
    return edges
