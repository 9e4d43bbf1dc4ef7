"""A fetch log as a stream: first sight of each content digest, and windowed counts with late rows.

An addition: the batch form is sources.catalog.append_log. State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def first_seen(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows (source, sha256, at) without later repeats inside the watermark."""
    return log.withWatermark("at", delay).dropDuplicatesWithinWatermark(["source", "sha256"])


def counts(log: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return log.withWatermark("at", delay).groupBy(F.window("at", window), "source").agg(F.count("*").alias("n"))


def upsert(log: DataFrame, target: str, checkpoint: str):
    """Each micro-batch replaces its sources' rows in a dated folder of the target."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
