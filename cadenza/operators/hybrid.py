"""Fusion of lexical and semantic results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import checks
from cadenza.functions import scalars as S


@dataclass(frozen=True)
class HybridWeights:
    lexical: float = 0.5
    semantic: float = 0.5

    def __post_init__(self) -> None:
        checks.number(self.lexical, "lexical", low=0.0)
        checks.number(self.semantic, "semantic", low=0.0)
        if self.lexical + self.semantic <= 0:
            raise ValueError("weights must add up to more than 0")

    def normalized(self) -> tuple[float, float]:
        total = self.lexical + self.semantic
        return self.lexical / total, self.semantic / total


def min_max(score: Column) -> Column:
    """Scores of one bounded result list on a scale from 0 to 1; all equal: 1."""
    whole = Window.partitionBy()
    low, high = F.min(score).over(whole), F.max(score).over(whole)
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def _source(rows: DataFrame, name: str) -> DataFrame:
    """One side of the join; ids and scores are checked in the plan, so the source runs once."""
    twice = F.count("*").over(Window.partitionBy("track_id")) > 1
    bad = twice | ~S.finite(F.col("score")) | F.col("track_id").isNull() | (F.trim("track_id") == "")
    wrong = F.raise_error(F.concat(F.lit(f"{name} results need unique ids and finite scores: "), F.coalesce("track_id", F.lit("null"))))
    rows = rows.withColumn("score", F.when(bad, wrong.cast("double")).otherwise(F.col("score")))
    meta = [F.col(c).alias(f"{name}_{c}") for c in ("title", "artist", "album")]
    fields = [F.col("matched_fields")] if "matched_fields" in rows.columns else []
    return rows.select("track_id", F.col("score").alias(f"{name}_score"), min_max(F.col("score")).alias(f"{name}_normalized_score"), *fields, *meta)


def fuse(lexical: DataFrame, semantic: DataFrame, *, weights: HybridWeights | None = None, limit: int = 10) -> DataFrame:
    """Both result lists (each of a bounded length) joined by id; a missing side counts 0, names come from the lexical side first.  Repeated ids and odd scores raise when the plan runs."""
    checks.positive(limit, "limit")
    wl, ws = (weights or HybridWeights()).normalized()
    met = _source(lexical, "lexical").join(_source(semantic, "semantic"), "track_id", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    met = met.select(
        "track_id",
        *(zero(f"{s}_{k}").alias(f"{s}_{k}") for s in ("lexical", "semantic") for k in ("score", "normalized_score")),
        F.coalesce(F.col("matched_fields"), F.array().cast("array<string>")).alias("matched_fields") if "matched_fields" in lexical.columns else F.array().cast("array<string>").alias("matched_fields"),
        *(F.coalesce(f"lexical_{c}", f"semantic_{c}").alias(c) for c in ("title", "artist", "album")),
    )
    met = met.withColumn("lexical_contribution", F.col("lexical_normalized_score") * wl).withColumn("semantic_contribution", F.col("semantic_normalized_score") * ws)
    met = met.withColumn("score", F.col("lexical_contribution") + F.col("semantic_contribution"))
    return met.orderBy(F.round("score", 9).desc(), "track_id").limit(limit)
