"""User state kept up to date from a stream of events.

The folds are those of lexiquarry.operators.state; here the log arrives in micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, glob: str = "*.parquet", files: int = 1) -> DataFrame:
    """Events from files as they arrive, so many files a micro-batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(path)


def last_values(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last value of each key by (ts, event_id); as a stream run it in update or complete mode."""
    at = F.struct("ts", "event_id")
    return events.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max("ts").alias("updated_at"))


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys switched on by an odd number of events; the parity is a count, so late events need no order."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("created_at")).filter("n % 2 = 1")


def rate_windows(events: DataFrame, width: str, late: str = "10 minutes", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Requests in tumbling windows; state of windows older than the watermark is dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Visits: events of a user with no longer pause than the gap."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Every micro-batch's changed keys as a new generation of files beside the old: readers take the newest of each key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()
