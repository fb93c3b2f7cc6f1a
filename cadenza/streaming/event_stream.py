"""Listening events as a stream: checked, deduplicated, counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.schemas import EVENT_TYPES


def checked(stream: DataFrame, *, lateness: str = "1 hour") -> DataFrame:
    """Events of known types with a time, each id once within the lateness."""
    rows = stream.filter(F.col("event_type").isin(*EVENT_TYPES) & F.col("occurred_at").isNotNull())
    return rows.withWatermark("occurred_at", lateness).dropDuplicatesWithinWatermark(["id"])


def counts(stream: DataFrame, *, window: str = "1 hour") -> DataFrame:
    """Events of each type and window; late ones beyond the watermark are left out."""
    return stream.groupBy(F.window("occurred_at", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Append checked events to a folder, once each."""
    return checked(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
