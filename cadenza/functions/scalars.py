"""Column builders for the scalar rules of the catalog.

Null means unknown unless a function says otherwise.
"""

from __future__ import annotations

import math
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Whether a number is known and finite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def finite_or_zero(c: Column) -> Column:
    return F.when(finite(c), c).otherwise(F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null, although greatest and least would skip it."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c.cast("double"))))


def collapse(c: Column) -> Column:
    """White space runs of any script become one space; none stays at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def match_key(c: Column) -> Column:
    """The key under which names are compared: lower case, collapsed white space."""
    return F.lower(collapse(c))


def energy(rms: Column) -> Column:
    return clamp(rms)


def brightness(centroid: Column, sample_rate: Column) -> Column:
    """Spectral centroid as a share of the Nyquist frequency; null without a positive rate."""
    return F.when(centroid.isNotNull() & (sample_rate > 0), clamp(centroid / (sample_rate / F.lit(2.0))))


def genre_values(genre: Column) -> Column:
    """Distinct lower-case genres of a comma list, sorted; none for null."""
    parts = F.transform(F.split(F.coalesce(genre, F.lit("")), ","), match_key)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda g: g != "")))


def json_vector(text: Column) -> Column:
    """A JSON list of numbers, or an empty array for anything else."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def similarity_score(raw: Column) -> Column:
    """A cosine mapped from [-1, 1] to [0, 1]; unknown or non-finite counts as 0."""
    return F.when(finite(raw), clamp((raw + 1) / 2)).otherwise(F.lit(0.0))


def bounded(net: Column) -> Column:
    return F.when(finite(net), F.tanh(net / 2)).otherwise(F.lit(0.0))


def instant(now: datetime) -> Column:
    """A literal timestamp from an aware datetime."""
    if now.tzinfo is None or now.utcoffset() is None:
        raise ValueError("now must carry a time zone")
    return F.timestamp_micros(F.lit(round(now.astimezone(UTC).timestamp() * 1_000_000)))


def decay(occurred_at: Column, now: datetime, half_life_days: float) -> Column:
    """Half-life decay by age in days; the future has age 0."""
    if not math.isfinite(half_life_days) or half_life_days <= 0:
        raise ValueError("half_life_days must be positive")
    micros = F.unix_micros(instant(now)) - F.unix_micros(occurred_at.cast("timestamp"))
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), micros / F.lit(8.64e10)) / F.lit(float(half_life_days)))


def preference_score(positive: Column, negative: Column, replay: Column, skip: Column) -> Column:
    return positive + replay - negative - skip


def preference_boost(net: Column, minimum: float = -1.0, maximum: float = 1.0) -> Column:
    if minimum >= maximum:
        raise ValueError("minimum must be below maximum")
    return clamp(net, minimum, maximum)


def journey_target(position: Column, total: Column) -> Column:
    """The energy a journey aims at: .3 to .9 over the playlist, .5 for a single track."""
    return F.when(total <= 1, F.lit(0.5)).otherwise(F.round(F.lit(0.3) + F.lit(0.6) * position / (total - 1), 10))


def transition_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Weighted distance of two tracks (``energy``, ``tempo_bpm``, ``brightness``); unknown terms drop out."""
    part = lambda k, w: F.coalesce(F.abs(a[k] - b[k]) * F.lit(w), F.lit(0.0))
    return part("energy", 0.5) + part("tempo_bpm", 0.3 / 60) + part("brightness", 0.2)


def tokens(c: Column) -> Column:
    """Distinct lower-case words: runs of letters, digits and underscores of any script."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([\p{L}\p{N}_]+)"), 1), F.lower))
