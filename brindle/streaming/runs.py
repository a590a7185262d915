"""Running streams to their end and keeping counters in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drained(df: DataFrame, checkpoint: str, mode: str, name: str) -> DataFrame:
    """All of a stream's output so far, through an in-memory table; for tests and small streams."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def merge_counts(spark: SparkSession, path: str, keys: list[str]):
    """A foreachBatch function: the newest count of each key replaces the old one; versions are kept as folders."""

    def merge(batch: DataFrame, epoch: int) -> None:
        new = batch.withColumn("epoch", F.lit(epoch))
        old = spark.read.parquet(f"{path}/{epoch - 1}") if epoch else new.limit(0)
        best = old.unionByName(new).groupBy(*keys).agg(F.max(F.struct("epoch", "n")).alias("x"))
        best.select(*keys, "x.n", "x.epoch").write.mode("overwrite").parquet(f"{path}/{epoch}")

    return merge
