"""Keyed event streams: windowed rates with late data, and the newest state of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of each key and window; of a stream, windows come once they ended ``late`` before the newest row, and rows for them are left out from then on."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need a time zone
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(ts, width).alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def append_to(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Ingest a stream of rows into a Parquet table, exactly once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
