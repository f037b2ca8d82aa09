"""Whether a table is small enough to be sent to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is broadcast, at most.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return len(df.select(F.lit(1)).take(most + 1)) <= most


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has `most` rows at most; Spark shuffles it otherwise."""
    return F.broadcast(df) if is_small(df, most) else df


#: Rows of a partition that is sorted or grouped, about.
PART_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df (about `rows` rows, or what will be made of it within its partitions) dealt by keys into partitions whose size does not grow
    with it; what is grouped, joined or put in order by keys after that is not dealt again."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)), *keys)
