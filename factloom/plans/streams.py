"""The event log read as a stream, drained, and the same in SQL over the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.checkpoints import ready
from ..streaming import feeds
from .queries import query

DAY = "yyyy-MM-dd HH:mm:ss"


def folder(spark: SparkSession) -> str:
    ready(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{shared}/stream-{uuid.uuid4().hex}"


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out = folder(spark)
    feeds.drained(stream, f"{out}/rows", f"{out}/log")
    return spark.read.parquet(f"{out}/rows")


@query("""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, errors FROM (
  SELECT time_bucket(INTERVAL 6 HOUR, ts) AS w, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2)
  WHERE w + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_tumbling(spark, d):
    """Windows that the watermark has closed."""
    out = drained(spark, feeds.windowed(feeds.read_log(spark, d, "events.parquet"), "event_type", "6 hours"))
    return out.withColumn("window_start", F.date_format("window_start", DAY))


@query("""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, errors FROM (
  SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS w, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events, range(4) r(k) GROUP BY 1, 2)
  WHERE w + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sliding(spark, d):
    out = drained(spark, feeds.windowed(feeds.read_log(spark, d, "events.parquet"), "event_type", "24 hours", "6 hours"))
    return out.withColumn("window_start", F.date_format("window_start", DAY))


@query("""SELECT strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_at, user_id, n FROM (SELECT user_id, session, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2)
  WHERE last_at + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, d):
    out = drained(spark, feeds.sessions(feeds.read_log(spark, d, "events.parquet"), "user_id"))
    return out.select(F.date_format("first_at", DAY).alias("first_at"), "user_id", "n")


@query("SELECT event_type, count(*) AS changes, max(event_id) AS last_id FROM events GROUP BY 1")
def stream_changes(spark, d):
    """The change feed kept as one folder a batch, so that a repeated batch replaces itself."""
    out = folder(spark)

    def keep(batch: DataFrame, i: int) -> None:
        batch.select("event_id", "event_type").write.mode("overwrite").parquet(f"{out}/batch={i}")

    feeds.change_feed(feeds.read_log(spark, d, "events.parquet"), keep, f"{out}-log").awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("changes"), F.max("event_id").alias("last_id"))
