"""Decayed preference and novelty from listening events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import scalars as S

HALF_LIFE = 30.0
# What an event adds to which counter.
WEIGHTS = {"play": ("positive", 0.15), "complete": ("positive", 0.35), "like": ("positive", 1.0), "replay": ("replay", 1.25), "dislike": ("negative", 1.0), "skip": ("skip", 0.75)}
CHANNELS = ("positive", "negative", "replay", "skip")


def _channel(name: str, now: datetime, half_life: float) -> Column:
    kinds = {k: w for k, (c, w) in WEIGHTS.items() if c == name}
    weight = F.lit(0.0)
    for kind, w in kinds.items():
        weight = F.when(F.col("event_type") == kind, F.lit(w)).otherwise(weight)
    return F.sum(weight * S.decay(F.col("occurred_at"), now, half_life))


def in_context(events: DataFrame, context: str | None) -> DataFrame:
    """Events of one context, compared without case and outer white space; none for a blank context."""
    if context is None or not context.strip():
        return events.limit(0)
    return events.filter(F.lower(F.regexp_replace("context", r"(?U)^\s+|\s+$", "")) == context.strip().lower())


def preference(events: DataFrame, *, now: datetime, half_life: float = HALF_LIFE) -> DataFrame:
    """``track_id``, the four counters and ``preference_score`` in (-1, 1): one aggregation, combined before the shuffle."""
    sums = events.groupBy("track_id").agg(*(_channel(c, now, half_life).alias(c) for c in CHANNELS))
    net = S.preference_score(*(F.col(c) for c in ("positive", "negative", "replay", "skip")))
    return sums.withColumn("preference_score", S.bounded(net))


def contextual_preference(events: DataFrame, *, context: str | None, now: datetime, half_life: float = HALF_LIFE) -> DataFrame:
    return preference(in_context(events, context), now=now, half_life=half_life)


def contextual_novelty(events: DataFrame, *, context: str | None, now: datetime, half_life: float = HALF_LIFE) -> DataFrame:
    """``track_id, exposure, novelty_score`` of the tracks met in a context; non-finite exposure drops out."""
    met = in_context(events, context).groupBy("track_id").agg(F.sum(S.decay(F.col("occurred_at"), now, half_life)).alias("exposure"))
    return met.filter(S.finite(F.col("exposure"))).withColumn("novelty_score", 1 / (1 + F.col("exposure")))


def personal(events: DataFrame, *, context: str, now: datetime, half_life: float = HALF_LIFE) -> DataFrame:
    """Preference and novelty of a context in one aggregation."""
    sums = in_context(events, context).groupBy("track_id").agg(*(_channel(c, now, half_life).alias(c) for c in CHANNELS), F.sum(S.decay(F.col("occurred_at"), now, half_life)).alias("exposure"))
    net = S.preference_score(*(F.col(c) for c in ("positive", "negative", "replay", "skip")))
    return sums.select("track_id", S.bounded(net).alias("preference_score"), F.when(S.finite(F.col("exposure")), 1 / (1 + F.col("exposure"))).alias("novelty_score"))


def taste_profile(events: DataFrame, *, now: datetime, half_life: float = HALF_LIFE) -> DataFrame:
    """Rows ``channel, value, strength, first_event``: for each counter the tracks with a share in it, and the contexts (channel ``context``).

    A channel's order is by falling ``strength`` (rounded), then by ``first_event`` (the
    least ``id`` that counts), then by ``value``; no channel is gathered in one row or task.
    """
    kinds = {c: [k for k, (x, _) in WEIGHTS.items() if x == c] for c in CHANNELS}
    firsts = [F.min(F.when(F.col("event_type").isin(kinds[c]), F.col("id"))).alias(f"{c}_at") for c in CHANNELS]
    sums = events.groupBy("track_id").agg(*(_channel(c, now, half_life).alias(c) for c in CHANNELS), *firsts)
    parts = F.array(*(F.struct(F.lit(c).alias("channel"), F.round(c, 9).alias("strength"), F.col(f"{c}_at").alias("first_event")) for c in CHANNELS))
    tracks = sums.select(F.col("track_id").alias("value"), F.explode(parts).alias("p")).filter("p.first_event IS NOT NULL")
    contexts = events.filter("context != ''").groupBy(F.col("context").alias("value")).agg(F.min("id").alias("first_event"))
    return tracks.select("p.channel", "value", "p.strength", "p.first_event").unionByName(contexts.select(F.lit("context").alias("channel"), "value", F.lit(None).cast("double").alias("strength"), "first_event"))


def taste_lists(profile: DataFrame) -> dict[str, list[str]]:
    """The ordered lists of a profile of one listener: ids for each counter, contexts by name."""
    rows = profile.collect()
    by_strength = lambda r: (-r["strength"], r["first_event"], r["value"])
    lists = {c: [r["value"] for r in sorted((r for r in rows if r["channel"] == c), key=by_strength)] for c in CHANNELS}
    return lists | {"context": sorted(r["value"] for r in rows if r["channel"] == "context")}
