"""Event activity in windows, and the newest price per fund, over streams. The same functions serve batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, value and users per window and type. On a stream, rows later than ``late`` no longer count."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value"), F.approx_count_distinct("user_id").alias("users")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", F.col("value").cast("double").alias("value"), "users"
    )


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
