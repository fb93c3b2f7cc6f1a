"""Fusion of weighted signals into one ranking, with explanations."""

from __future__ import annotations

from dataclasses import astuple, dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import checks
from cadenza.functions import scalars as S
from cadenza.operators import preference as P
from cadenza.schemas import SIGNALS


@dataclass(frozen=True)
class FusionWeights:
    """Weights of the signals in the order of ``SIGNALS``."""

    metadata: float = 0.18
    dsp: float = 0.18
    learned: float = 0.36
    preference: float = 0.18
    novelty: float = 0.05
    diversity: float = 0.05

    def normalized(self) -> tuple[float, ...]:
        total = sum(astuple(self))
        if total <= 0:
            raise ValueError("weights must add up to more than 0")
        return tuple(w / total for w in astuple(self))


def explain(candidates: DataFrame, weights: FusionWeights | None = None) -> DataFrame:
    """Candidates with ``contributions``, their sum ``score`` and the ``strongest_signal`` (null if all are 0)."""
    shares = (weights or FusionWeights()).normalized()
    parts, total = [], None
    for name, w in zip(SIGNALS, shares, strict=True):
        part = S.finite_or_zero(F.col(name).cast("double")) * F.lit(w)
        total = part if total is None else total + part
        parts.append(F.struct(F.lit(name).alias("name"), F.col(name).cast("double").alias("raw_score"), F.lit(w).alias("weight"), part.alias("contribution")))
    rows = candidates.withColumn("contributions", F.array(*parts)).withColumn("score", total)
    order = F.array_sort(F.transform("contributions", lambda c, i: F.struct((-F.abs(c["contribution"])).alias("a"), i.alias("i"), c["name"].alias("name"))))
    first = F.get(order, F.lit(0))
    return rows.withColumn("strongest_signal", F.when(first["a"] < 0, first["name"]))


def rank(candidates: DataFrame, *, weights: FusionWeights | None = None, limit: int = 10) -> DataFrame:
    """The best candidates by score, ties by id: a top-k, no full sort."""
    checks.positive(limit, "limit")
    return explain(candidates, weights).orderBy(F.round("score", 9).desc(), "track_id").limit(limit)


def with_preference(candidates: DataFrame, events: DataFrame, *, now: datetime, context: str | None = None) -> DataFrame:
    """Candidates with their preference; 0 where nothing is known."""
    known = P.preference(events, now=now) if context is None else P.contextual_preference(events, context=context, now=now)
    met = candidates.drop("preference_score").join(known.select("track_id", "preference_score"), "track_id", "left")
    return met.withColumn("preference_score", F.coalesce("preference_score", F.lit(0.0)))


def with_novelty(candidates: DataFrame, events: DataFrame, *, now: datetime, context: str) -> DataFrame:
    """Candidates with their novelty; 1 where the context never met them."""
    known = P.contextual_novelty(events, context=checks.text(context, "context"), now=now)
    met = candidates.drop("novelty_score").join(known.select("track_id", "novelty_score"), "track_id", "left")
    return met.withColumn("novelty_score", F.coalesce("novelty_score", F.lit(1.0)))


def with_personal(candidates: DataFrame, events: DataFrame, *, now: datetime, context: str) -> DataFrame:
    """Both at once, from one aggregation of the events."""
    known = P.personal(events, context=checks.text(context, "context"), now=now)
    met = candidates.drop("preference_score", "novelty_score").join(known, "track_id", "left")
    return met.withColumns({"preference_score": F.coalesce("preference_score", F.lit(0.0)), "novelty_score": F.coalesce("novelty_score", F.lit(1.0))})


def with_learned(candidates: DataFrame, similar: DataFrame, seed: str) -> DataFrame:
    """Candidates with the learned similarity to a seed where it is known; the seed and the others keep their own."""
    found = similar.filter(F.col("track_id") != seed).select("track_id", S.similarity_score(F.col("score")).alias("_learned"))
    return candidates.join(found, "track_id", "left").withColumn("learned_score", F.coalesce("_learned", "learned_score")).drop("_learned")


def preference_rank(candidates: DataFrame, events: DataFrame, *, now: datetime, context: str | None = None, limit: int = 10) -> DataFrame:
    return rank(with_preference(candidates, events, now=now, context=context), limit=limit)


def novelty_rank(candidates: DataFrame, events: DataFrame, *, now: datetime, context: str, limit: int = 10) -> DataFrame:
    return rank(with_novelty(candidates, events, now=now, context=context), limit=limit)
