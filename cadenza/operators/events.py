"""Listening events: recording, recent ones, summaries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import checks
from cadenza.schemas import EVENT_TYPES


def new_event(track_id: str, event_type: str, *, occurred_at: datetime | None = None, context: str | None = None, seconds_played: float | None = None) -> dict:
    """A checked event in UTC; a blank context becomes null, any other stays as it is."""
    checks.text(track_id, "track_id")
    if event_type not in EVENT_TYPES:
        raise ValueError(f"unknown event type: {event_type!r}")
    at = occurred_at or datetime.now(UTC)
    if at.tzinfo is None or at.utcoffset() is None:
        raise ValueError("occurred_at must carry a time zone")
    if seconds_played is not None:
        seconds_played = checks.number(seconds_played, "seconds_played", low=0.0)
    return {"track_id": track_id, "event_type": event_type, "occurred_at": at.astimezone(UTC), "context": context if context and context.strip() else None, "seconds_played": seconds_played}


def recent(events: DataFrame, *, limit: int = 1000) -> DataFrame:
    """The newest events, ties by the larger id: a top-k."""
    return events.orderBy(F.desc("occurred_at"), F.desc("id")).limit(checks.positive(limit, "limit"))


def type_counts(events: DataFrame) -> DataFrame:
    """``event_type, n`` for all types, 0 included, and their ``ord``."""
    kinds = events.sparkSession.createDataFrame(list(enumerate(EVENT_TYPES)), "ord int, event_type string")
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"))
    return F.broadcast(kinds).join(counts, "event_type", "left").select("ord", "event_type", F.coalesce("n", F.lit(0).cast("long")).alias("n")).orderBy("ord")


def context_counts(events: DataFrame) -> DataFrame:
    """``context, event_count, distinct_tracks``; contexts compared by key, blank ones as null, null last."""
    key = F.lower(F.regexp_replace("context", r"(?U)^\s+|\s+$", ""))
    rows = events.select(F.when(key != "", key).alias("context"), "track_id")
    found = rows.groupBy("context").agg(F.count("*").alias("event_count"), F.countDistinct("track_id").alias("distinct_tracks"))
    return found.orderBy(F.asc_nulls_last("context"))


def totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total_events"), F.countDistinct("track_id").alias("distinct_tracks"))


def format_events(events: DataFrame) -> DataFrame:
    """``line``: tab-separated fields with tabs and line ends of the context escaped, in the order of the rows."""
    context = F.coalesce("context", F.lit(""))
    for raw, shown in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        context = F.replace(context, F.lit(raw), F.lit(shown))
    at = F.concat(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format("occurred_at", "SSSSSS") != "000000", F.date_format("occurred_at", ".SSSSSS")).otherwise(F.lit("")), F.lit("+00:00"))
    return events.select(F.concat_ws("\t", at, "event_type", "track_id", context, F.coalesce(F.col("seconds_played").cast("string"), F.lit(""))).alias("line"))


def known_tracks(ids: DataFrame, tracks: DataFrame) -> DataFrame:
    """The ids that the catalog holds, active or not."""
    return ids.join(tracks.select("track_id"), "track_id", "left_semi")


