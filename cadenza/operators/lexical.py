"""Lexical search over the catalog's text fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import checks
from cadenza.functions import scalars as S
from cadenza.operators.catalog import active, column

# Weights of the fields, in the order in which matches are named.
WEIGHTS = {"title": 1.0, "artist": 0.85, "album": 0.75, "album_artist": 0.65, "composer": 0.55, "genre": 0.6, "file_name": 0.3}

# Phrases and what they may be replaced by, in order.
ALIASES = (
    ("background score", ("background music", "bgm")),
    ("background music", ("bgm", "background score")),
    ("bgm", ("background music", "background score")),
    ("original soundtrack", ("ost", "soundtrack")),
    ("soundtrack", ("ost", "original soundtrack")),
    ("ost", ("soundtrack", "original soundtrack")),
    ("theme song", ("theme music",)),
    ("theme music", ("theme song",)),
    ("film score", ("movie score",)),
    ("movie score", ("film score",)),
)


def expand_query(query: str, *, legacy_substring: bool = False) -> list[str]:
    """The query and its variants, each by one rule; phrases are whole words unless ``legacy_substring``."""
    plain = " ".join(checks.text(query, "query").split())
    edge = ("", "") if legacy_substring else (r"(?<!\w)", r"(?!\w)")
    found = [plain]
    for phrase, aliases in ALIASES:
        rule = re.compile(edge[0] + re.escape(phrase) + edge[1], re.IGNORECASE)
        if rule.search(plain):
            found.extend(rule.sub(alias, plain) for alias in aliases)
    return list(dict.fromkeys(found))


def query_tokens(query: str) -> list[str]:
    """Distinct words of the query, sorted so that sums have one order."""
    words = sorted(set(re.findall(r"\w+", query.casefold())))
    if not words:
        raise ValueError("query has no searchable words")
    return words


def _scored(words: list[str]) -> tuple[Column, Column]:
    """Score and matched fields of one variant over the columns ``_t_<field>``."""
    holds = {f: {w: F.array_contains(f"_t_{f}", w) for w in words} for f in WEIGHTS}
    best = [F.greatest(*(F.when(holds[f][w], F.lit(WEIGHTS[f])).otherwise(F.lit(0.0)) for f in WEIGHTS)) for w in words]
    total = best[0]
    for b in best[1:]:
        total = total + b
    fields = []
    seen: list[str] = []
    for f in WEIGHTS:
        fresh = None
        for w in words:
            one = holds[f][w]
            for g in seen:
                one = one & ~holds[g][w]
            fresh = one if fresh is None else fresh | one
        fields.append(F.when(fresh, F.lit(f)))
        seen.append(f)
    return total / F.lit(float(len(words))), F.filter(F.array(*fields), lambda x: x.isNotNull())


def search(tracks: DataFrame, query: str, *, limit: int = 10, expand: bool = False) -> DataFrame:
    """``track_id, score, matched_fields, matched_query, title, artist, album`` of the best active tracks.

    A track takes its best variant: the higher score, then the smaller fields, then
    the smaller variant.  One scan, then a top-k; variants are columns, not rows.
    """
    checks.positive(limit, "limit")
    variants = expand_query(query) if expand else [" ".join(checks.text(query, "query").split())]
    rows = active(tracks)
    rows = rows.select("track_id", *(column(rows, c).alias(c) for c in ("title", "artist", "album")), *(S.tokens(column(rows, f)).alias(f"_t_{f}") for f in WEIGHTS))
    scored = []
    for v in variants:
        score, fields = _scored(query_tokens(v))
        scored.append(F.struct((-score).alias("loss"), fields.alias("fields"), F.lit(v).alias("variant")))
    rows = rows.withColumn("_best", F.array_min(F.array(*scored))).filter(F.col("_best.loss") < 0)
    found = rows.select("track_id", (-F.col("_best.loss")).alias("score"), F.col("_best.fields").alias("matched_fields"), F.col("_best.variant").alias("matched_query"), "title", "artist", "album")
    return found.orderBy(F.round("score", 9).desc(), "track_id").limit(limit)
