"""End-to-end flows: retrieval picks the candidates, ranking owns the score, sequencing owns the order."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import checks
from cadenza.operators import catalog, hybrid, intent, lexical, ranking, sequencing, vectors
from cadenza.operators.events import recent

MODES = ("catalog", "lexical", "semantic", "semantic-indexed", "hybrid", "hybrid-indexed")
CARRIED = ("energy", "tempo_bpm", "brightness")


@dataclass
class FlowResult:
    intent: intent.MusicIntent
    ranked: DataFrame
    playlist: DataFrame


@dataclass(frozen=True)
class Request:
    text: str
    mode: str = "smooth"
    limit: int = 10
    sequence_seed: str | None = None

    def __post_init__(self) -> None:
        checks.text(self.text, "text")
        checks.positive(self.limit, "limit")
        if self.mode not in sequencing.MODES:
            raise ValueError(f"unknown mode: {self.mode!r}")


def _playlist(ranked: DataFrame, request: Request) -> DataFrame:
    rows = ranked.select("track_id", F.col("score").alias("base_score"), *CARRIED, F.col("novelty_score"))
    return sequencing.sequence(rows, mode=request.mode, limit=request.limit, seed=request.sequence_seed)


def end_to_end(candidates: DataFrame, request: Request, *, weights: ranking.FusionWeights | None = None) -> FlowResult:
    """Intent, ranking to the limit, order."""
    read = intent.parse_intent(request.text)
    ranked = ranking.rank(intent.enrich(checks.distinct_rows(candidates), read), weights=weights, limit=request.limit)
    return FlowResult(read, ranked, _playlist(ranked.withColumn("novelty_score", F.col("candidate_novelty")), request))


def learned(candidates: DataFrame, request: Request, *, similar: DataFrame, seed: str) -> FlowResult:
    """The same with learned similarity to a seed, which itself is left out."""
    rows = ranking.with_learned(candidates, similar, seed).filter(F.col("track_id") != seed)
    return end_to_end(rows, request)


def context_aware(candidates: DataFrame, request: Request, *, events: DataFrame, context: str, now: datetime, similar: DataFrame | None = None, learned_seed: str | None = None, weights: ranking.FusionWeights | None = None) -> FlowResult:
    """The flow with a listener's preference and novelty in a context; they replace the intent's own signals."""
    checks.text(context, "context")
    if learned_seed is not None:
        if similar is None:
            raise ValueError("a learned seed needs similarities")
        candidates = ranking.with_learned(candidates, similar, learned_seed).filter(F.col("track_id") != learned_seed)
    read = intent.parse_intent(request.text)
    enriched = intent.enrich(candidates, read)
    personal = ranking.with_personal(enriched, events, now=now, context=context)
    ranked = ranking.rank(personal, weights=weights, limit=request.limit)
    return FlowResult(read, ranked, _playlist(ranked, request))


class SearchService:
    """Search over one catalog."""

    def __init__(self, tracks: DataFrame) -> None:
        self.tracks = tracks

    def search(self, query: str, *, limit: int = 10, expand: bool = False) -> DataFrame:
        return lexical.search(self.tracks, query, limit=limit, expand=expand)

    def semantic_search(self, query: str, provider: vectors.TextEmbeddingProvider, *, limit: int = 10) -> DataFrame:
        return vectors.semantic_search(self.tracks, query, provider, limit=limit)

    def rebuild_semantic_index(self, path: str, provider: vectors.TextEmbeddingProvider, profile: vectors.TextEmbeddingProfile) -> int:
        return vectors.SemanticTextIndex(self.tracks.sparkSession, path).rebuild(self.tracks, provider, profile)

    def semantic_search_indexed(self, query: str, path: str, provider: vectors.TextEmbeddingProvider, profile: vectors.TextEmbeddingProfile, *, limit: int = 10) -> DataFrame:
        return vectors.SemanticTextIndex(self.tracks.sparkSession, path).search(self.tracks, query, provider, profile, limit=limit)

    def hybrid_search(self, query: str, provider: vectors.TextEmbeddingProvider, *, limit: int = 10, expand: bool = False, weights: hybrid.HybridWeights | None = None) -> DataFrame:
        """Each source is cut to the limit before its scores are scaled."""
        return hybrid.fuse(self.search(query, limit=limit, expand=expand), self.semantic_search(query, provider, limit=limit), weights=weights, limit=limit)

    def hybrid_search_indexed(self, query: str, path: str, provider: vectors.TextEmbeddingProvider, profile: vectors.TextEmbeddingProfile, *, limit: int = 10, expand: bool = False, weights: hybrid.HybridWeights | None = None) -> DataFrame:
        return hybrid.fuse(self.search(query, limit=limit, expand=expand), self.semantic_search_indexed(query, path, provider, profile, limit=limit), weights=weights, limit=limit)


def retrieve(tracks: DataFrame, query: str, mode: str, *, request_limit: int, retrieval_limit: int | None = None, catalog_limit: int | None = None, provider=None, profile=None, index_path: str | None = None, expand: bool = False, weights: hybrid.HybridWeights | None = None) -> DataFrame:
    """Candidates by one of the six modes; only their ids survive retrieval, never its scores."""
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode: {mode!r}")
    if catalog_limit is not None and mode != "catalog":
        raise ValueError("catalog_limit belongs to the catalog mode")
    if mode == "catalog":
        return catalog.candidates(tracks, limit=catalog_limit)
    if mode != "lexical" and provider is None:
        raise ValueError(f"{mode} needs an embedding provider")
    if mode.endswith("-indexed") and (index_path is None or profile is None):
        raise ValueError(f"{mode} needs an index and a profile")
    limit = max(50, request_limit) if retrieval_limit is None else checks.positive(retrieval_limit, "retrieval_limit")
    s = SearchService(tracks)
    found = {
        "lexical": lambda: s.search(query, limit=limit, expand=expand),
        "semantic": lambda: s.semantic_search(query, provider, limit=limit),
        "semantic-indexed": lambda: s.semantic_search_indexed(query, index_path, provider, profile, limit=limit),
        "hybrid": lambda: s.hybrid_search(query, provider, limit=limit, expand=expand, weights=weights),
        "hybrid-indexed": lambda: s.hybrid_search_indexed(query, index_path, provider, profile, limit=limit, expand=expand, weights=weights),
    }[mode]()
    ids = found.select("track_id")  # at most ``limit`` rows
    return catalog.adapt(catalog.active(tracks).join(F.broadcast(ids), "track_id", "left_semi"))


def recommend(tracks: DataFrame, events: DataFrame, request: Request, *, context: str, now: datetime, event_limit: int = 1000, mode: str = "catalog", similar: DataFrame | None = None, learned_seed: str | None = None, **retrieval) -> FlowResult:
    """The flagship: retrieval, the newest events, intent, personal signals, ranking, order.

    With similarities but no learned seed the request's own seed is the one they belong to.
    """
    if similar is not None and learned_seed is None:
        learned_seed = request.sequence_seed
    found = retrieve(tracks, request.text, mode, request_limit=request.limit, **retrieval)
    return context_aware(found, request, events=recent(events, limit=event_limit), context=context, now=now, similar=similar, learned_seed=learned_seed)
