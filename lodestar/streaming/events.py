"""Extension: the events table as a stream, in tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").parquet(folder)


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and sum in cents by event type and window; also works on a batch of events."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        events.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "value_cents")
    )


def run_available(events: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there, writing closed windows as parquet."""
    query = windowed(events).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
