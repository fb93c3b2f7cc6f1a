"""Reading a request's intent and matching tracks against it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import checks
from cadenza.schemas import FACETS

# Phrases (words, with an optional letter marked by ?) and the facet value each stands for.
VOCABULARY = {
    "regions": {"south indians?": "south_india", "south india": "south_india"},
    "languages": {w: w for w in ("tamil", "telugu", "malayalam", "kannada")},
    "music_types": {"bgm": "bgm", "background music": "bgm", "soundtracks?": "soundtrack", "songs?": "song"},
    "scenes": {
        "hero entry": "hero_entry", "mass entry": "hero_entry", "chase": "chase", "battle": "battle", "fight": "battle",
        "romance": "romance", "romantic": "romance", "suspense": "suspense", "thriller": "suspense", "climax": "climax",
    },
    "moods": {w: w for w in ("dark", "emotional", "sad", "happy", "cinematic", "mass", "folk", "classical", "electronic", "orchestral")},
}
# The first rule that applies decides.
ENERGIES = ((("very high", "very intense", "intense"), 0.95), (("high", "energetic"), 0.8), (("medium", "moderate"), 0.5), (("low", "calm"), 0.3))
VOCALS = ((("without vocals?", "no vocals?", "less vocals?"), "without"), (("instrumental",), "instrumental"), (("vocals?",), "vocal"))
NOVELTIES = ((("something new", "discovery", "discover"), "discovery"), (("something i know", "familiar", "known"), "familiar"))


@dataclass(frozen=True)
class MusicIntent:
    raw_text: str = ""
    genres: tuple[str, ...] = ()
    moods: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    instrumentation: tuple[str, ...] = ()
    music_types: tuple[str, ...] = ()
    scenes: tuple[str, ...] = ()
    energy: float | None = None
    vocal_preference: str = "any"
    novelty: str = "any"
    negative_terms: tuple[str, ...] = field(default=())
    confidence: float = 0.0

    def __post_init__(self) -> None:
        if self.energy is not None and not 0 <= checks.number(self.energy, "energy") <= 1:
            raise ValueError("energy must lie in [0, 1]")
        if not 0 <= self.confidence <= 1:
            raise ValueError("confidence must lie in [0, 1]")
        if self.vocal_preference not in ("any", "instrumental", "vocal") or self.novelty not in ("any", "familiar", "discovery"):
            raise ValueError("unknown vocal preference or novelty")


def _rule(phrase: str) -> str:
    return rf"\b{phrase.replace(' ', ' +')}\b"


def _normal(text: str) -> str:
    return " ".join(re.sub(r"[-_]+", " ", text.lower()).split())


def parse_intent(text: str) -> MusicIntent:
    """The intent of one request; confidence is a fifth for each thing found, 1 at most."""
    plain = _normal(checks.text(text, "text"))
    says = lambda phrase: re.search(_rule(phrase), plain) is not None
    first = lambda rules: next((v for phrases, v in rules if any(map(says, phrases))), None)
    facets = {f: tuple(sorted({v for phrase, v in words.items() if says(phrase)})) for f, words in VOCABULARY.items()}
    energy, vocals, novelty = first(ENERGIES), first(VOCALS), first(NOVELTIES)
    hits = sum(map(len, facets.values())) + sum(x is not None for x in (energy, vocals, novelty))
    return MusicIntent(
        raw_text=text, energy=energy, vocal_preference={None: "any", "without": "instrumental"}.get(vocals, vocals), novelty=novelty or "any",
        negative_terms=("vocals",) if vocals == "without" else (), confidence=round(min(1.0, 0.2 * hits), 3), **facets,
    )


def parse_intents(requests: DataFrame, column: str = "text") -> DataFrame:
    """The same reading as columns, for a table of requests."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(column), "[-_]+", " "), r"\s+", " "))
    says = lambda phrase: F.col("_plain").rlike(_rule(phrase))
    any_of = lambda phrases: [says(p) for p in phrases]

    def first(rules, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for phrases, v in reversed(rules):
            hit = any_of(phrases)[0]
            for p in any_of(phrases)[1:]:
                hit = hit | p
            out = F.when(hit, F.lit(v)).otherwise(out)
        return out

    rows = requests.withColumn("_plain", plain)
    for f, words in VOCABULARY.items():
        found = F.array(*(F.when(says(phrase), F.lit(v)) for phrase, v in words.items()))
        rows = rows.withColumn(f, F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))))
    rows = rows.withColumn("energy", first(ENERGIES, "double")).withColumn("_vocals", first(VOCALS, "string")).withColumn("novelty", F.coalesce(first(NOVELTIES, "string"), F.lit("any")))
    vocals = F.when(F.col("_vocals").isNull(), "any").when(F.col("_vocals") == "without", "instrumental").otherwise(F.col("_vocals"))
    negative = F.when(F.col("_vocals") == "without", F.array(F.lit("vocals"))).otherwise(F.array().cast("array<string>"))
    hits = sum((F.size(f) for f in VOCABULARY), F.lit(0)) + F.col("energy").isNotNull().cast("int") + F.col("_vocals").isNotNull().cast("int") + (F.col("novelty") != "any").cast("int")
    rows = rows.withColumn("vocal_preference", vocals).withColumn("negative_terms", negative).withColumn("confidence", F.round(F.least(F.lit(1.0), hits * F.lit(0.2)), 3))
    return rows.drop("_plain", "_vocals")


def _dimensions(intent: MusicIntent) -> list[tuple[str, Column]]:
    """The requested dimensions in order, each with a candidate's score."""
    out = []
    for f in FACETS:
        asked = sorted(set(getattr(intent, f)))
        if asked:
            out.append((f, F.size(F.array_intersect(F.col(f), F.array(*map(F.lit, asked)))) / F.lit(float(len(asked)))))
    if intent.energy is not None:
        near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("energy") - F.lit(float(intent.energy))))
        out.append(("energy", F.when(F.col("energy").isNull(), F.lit(0.5)).otherwise(near)))
    if intent.vocal_preference != "any":
        has = F.col("vocal_preference")
        if "vocals" in intent.negative_terms:
            score = F.when(has == "vocal", 0.0).when(has == "instrumental", 1.0).otherwise(0.5)
        else:
            score = F.when(has == intent.vocal_preference, 1.0).when(has == "any", 0.5).otherwise(0.0)
        out.append(("vocal", score))
    if intent.novelty != "any":
        n = F.col("candidate_novelty")
        out.append(("novelty", n if intent.novelty == "discovery" else 1 - n))
    return out


def score(candidates: DataFrame, intent: MusicIntent) -> DataFrame:
    """Candidates with ``intent_score`` (mean over the requested dimensions), its parts and ``matched_dimensions``."""
    dims = _dimensions(intent)
    by = dict(dims)
    total = sum((s for _, s in dims[1:]), dims[0][1]) / F.lit(float(len(dims))) if dims else F.lit(0.0)
    matched = F.filter(F.array(*(F.when(s > 0, F.lit(n)) for n, s in dims)), lambda x: x.isNotNull()) if dims else F.array().cast("array<string>")
    parts = {f"{n}_match": by.get(n, F.lit(0.0)).cast("double") for n in ("energy", "vocal", "novelty")}
    return candidates.withColumns({"intent_score": total.cast("double"), "matched_dimensions": matched, **parts})


def enrich(candidates: DataFrame, intent: MusicIntent) -> DataFrame:
    """Candidates whose signals follow the intent where it asks for something, and their own otherwise."""
    scored = score(candidates, intent)
    signals = {}
    if _dimensions(intent):
        signals["metadata_score"] = F.col("intent_score")
    if intent.energy is not None:
        signals["dsp_score"] = F.col("energy_match")
    if intent.novelty != "any":
        signals["novelty_score"] = F.col("novelty_match")
    return scored.withColumns(signals) if signals else scored
