"""Ordering a ranked selection into a playlist.

Each step takes the best track left, given the one before, so the order of one
playlist can't be computed in parts.  Its input is a selection that ranking has
cut to the request's limit; many requests are ordered side by side.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import checks

MODES = ("smooth", "contrast", "journey", "discovery")
_TERMS = (("energy", 0.5), ("tempo_bpm", 0.3 / 60), ("brightness", 0.2))


def _known(v) -> bool:
    return v is not None and not (isinstance(v, float) and math.isnan(v))


def distance(a: dict, b: dict) -> float:
    return sum(w * abs(a[k] - b[k]) for k, w in _TERMS if _known(a[k]) and _known(b[k]))


def target_energy(position: int, total: int) -> float:
    return 0.5 if total <= 1 else round(0.3 + 0.6 * position / (total - 1), 10)


def step_score(track: dict, last: dict, mode: str, position: int, total: int) -> float:
    base = track["base_score"]
    if mode == "smooth":
        return base - distance(last, track)
    if mode == "contrast":
        return base + distance(last, track)
    if mode == "discovery":
        return base + 0.5 * track["novelty_score"]
    return base - (abs(track["energy"] - target_energy(position, total)) if _known(track["energy"]) else 0.0)


def validate(track: dict) -> None:
    if not track["track_id"]:
        raise ValueError("track_id must be non-empty")
    for name in ("base_score", "novelty_score"):
        checks.number(float(track[name]), name)
    for name in ("energy", "brightness"):
        if _known(track[name]) and not 0 <= track[name] <= 1:
            raise ValueError(f"{name} must lie in [0, 1]")
    if _known(track["tempo_bpm"]) and not 0 < track["tempo_bpm"] < math.inf:
        raise ValueError("tempo_bpm must be positive")


def order(tracks: list[dict], mode: str, limit: int, seed: str | None = None) -> list[tuple[str, float, float]]:
    """(track_id, sequence_score, base_score) in playing order; the seed or the best track opens."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    checks.positive(limit, "limit")
    for t in tracks:
        validate(t)
    checks.unique_ids([t["track_id"] for t in tracks])
    left = {t["track_id"]: t for t in tracks}
    if seed is not None and seed not in left:
        raise ValueError(f"seed track not found: {seed!r}")
    if not left:
        return []
    total = min(limit, len(left))
    last = left.pop(seed if seed is not None else min(left, key=lambda i: (-round(left[i]["base_score"], 9), i)))
    out = [(last["track_id"], last["base_score"], last["base_score"])]
    while len(out) < total:
        scores = {i: step_score(t, last, mode, len(out), total) for i, t in left.items()}
        best = min(scores, key=lambda i: (-round(scores[i], 9), i))
        last = left.pop(best)
        out.append((best, scores[best], last["base_score"]))
    return out


RESULT = "request_id string, position int, track_id string, sequence_score double, base_score double"


def sequence(candidates: DataFrame, *, mode: str = "smooth", limit: int = 10, seed: str | None = None) -> DataFrame:
    """``request_id, position`` (from 0), ``track_id, sequence_score, base_score`` for each request (one without ``request_id``)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    checks.positive(limit, "limit")
    names = ("track_id", "base_score", "energy", "tempo_bpm", "brightness", "novelty_score")
    request = F.col("request_id") if "request_id" in candidates.columns else F.lit("request")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = order(part[list(names)].to_dict("records"), mode, limit, seed)
        return pd.DataFrame([(part["request_id"].iloc[0], n, *row) for n, row in enumerate(found)], columns=["request_id", "position", "track_id", "sequence_score", "base_score"])

    rows = candidates.select(request.alias("request_id"), *(F.col(n) if n == "track_id" else F.col(n).cast("double").alias(n) for n in names))
    return rows.groupBy("request_id").applyInPandas(run, RESULT)
