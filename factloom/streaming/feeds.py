"""The log as a stream: windows with watermarks, sessions, alarms without repeats, and a change feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, glob: str | None = None, late: str = "1 hour", files: int | None = None) -> DataFrame:
    """A folder of Parquet files as an event-time stream."""
    reader = spark.readStream.schema(spark.read.parquet(f"{path}/{glob}" if glob else path).schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(log: DataFrame, key: str, length: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return log.groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("window.start").alias("window_start"), key, "n", "errors")


def sessions(log: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    return log.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("first_at"), key, "n")


def alarms(log: DataFrame, key: list[str]) -> DataFrame:
    """Of repeated alarms within the watermark only the first."""
    return log.dropDuplicatesWithinWatermark(key)


def change_feed(log: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of changes on, at least once; apply must tolerate a batch it has seen."""
    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is there to Parquet and stop."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
