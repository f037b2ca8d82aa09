"""Tables between rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripspark.sources.shared import Files, new_path


class Rounds:
    """Tables that rounds of joins write to the shared folder to cut lineage. A table replaces the one of its name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.latest, self.n = spark, new_path(spark, name), {}, 0

    def write(self, name: str, df: DataFrame) -> DataFrame:
        old, schema, self.n = self.latest.get(name), df.schema, self.n + 1
        self.latest[name] = f"{name}-{self.n}"
        path = f"{self.root}/{self.latest[name]}"
        df.write.parquet(path)
        if old:
            Files(self.spark, self.root).remove(old)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            Files(self.spark, self.root).remove(self.latest.pop(name))
