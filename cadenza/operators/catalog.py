"""Catalog scans and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import checks
from cadenza.functions import scalars as S
from cadenza.schemas import FACETS, SIGNALS

#: Labels and columns of a track's text, in order.
TEXT_FIELDS = (("title", "title"), ("artist", "artist"), ("album", "album"), ("album artist", "album_artist"), ("composer", "composer"), ("genre", "genre"), ("file name", "file_name"))


def column(df: DataFrame, name: str, kind: str = "string"):
    """A column, or null of a type where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def active(tracks: DataFrame) -> DataFrame:
    """Tracks in use; the filter reaches the scan."""
    return tracks.filter(F.col("status") == "active")


def music_dna(tracks: DataFrame) -> DataFrame:
    """Acoustic description of each track; unknown parts stay null, broken vectors are empty."""
    c = lambda n: column(tracks, n, "double")
    return tracks.select(
        "track_id",
        c("tempo_bpm").cast("double").alias("tempo_bpm"),
        S.energy(c("rms_energy")).alias("energy"),
        S.brightness(c("spectral_centroid"), c("sample_rate")).alias("brightness"),
        c("spectral_bandwidth").cast("double").alias("spectral_bandwidth"),
        c("spectral_rolloff").cast("double").alias("spectral_rolloff"),
        c("zero_crossing_rate").cast("double").alias("zero_crossing_rate"),
        S.json_vector(column(tracks, "mfcc_json")).alias("mfcc"),
        S.json_vector(column(tracks, "chroma_json")).alias("chroma"),
    )


def candidates(tracks: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Active tracks as candidates: facets, features and base signals (all 0); by id where there is a limit.

    A track's own evidence fills genres and energy only; facet columns of the same
    name in ``tracks`` are taken as they are.
    """
    rows = active(tracks)
    if limit is not None:
        rows = rows.orderBy("track_id").limit(checks.positive(limit, "limit"))
    return adapt(rows)


def adapt(rows: DataFrame) -> DataFrame:
    """Candidates from any track rows."""
    facets = [(F.col(f) if f in rows.columns else S.genre_values(column(rows, "genre")) if f == "genres" else F.array().cast("array<string>")).alias(f) for f in FACETS]
    c = lambda n: column(rows, n, "double")
    return rows.select(
        "track_id",
        *(column(rows, n).alias(n) for n in ("title", "artist", "album")),
        *facets,
        S.energy(c("rms_energy")).alias("energy"),
        (F.col("vocal_preference") if "vocal_preference" in rows.columns else F.lit("any")).alias("vocal_preference"),
        c("tempo_bpm").cast("double").alias("tempo_bpm"),
        S.brightness(c("spectral_centroid"), c("sample_rate")).alias("brightness"),
        F.lit(0.0).alias("candidate_novelty"),
        *(F.lit(0.0).alias(s) for s in SIGNALS),
    )


def ordered_ids(tracks: DataFrame, ids: list[str]) -> DataFrame:
    """``track_id`` and ``pos`` of the asked ids."""
    spark = tracks.sparkSession
    return spark.createDataFrame([(i, n) for n, i in enumerate(checks.unique_ids(list(ids)))], "track_id string, pos int")


def candidates_by_ids(tracks: DataFrame, ids: list[str]) -> DataFrame:
    """Candidates of the given ids in the given order; unknown and inactive ids drop out."""
    asked = ordered_ids(tracks, ids)
    rows = active(tracks).join(F.broadcast(asked), "track_id", "left_semi")
    return adapt(rows).join(F.broadcast(asked), "track_id").orderBy("pos")


def catalog_text(tracks: DataFrame) -> DataFrame:
    """``track_id`` and ``text``: the filled fields as ``label: value`` joined by bars."""
    parts = []
    for label, name in TEXT_FIELDS:
        c = column(tracks, name)
        parts.append(F.when(c != "", F.concat(F.lit(f"{label}: "), c)))
    return tracks.select("track_id", F.concat_ws(" | ", *parts).alias("text"))


def dsp_embedding(tracks: DataFrame) -> DataFrame:
    """The 31 acoustic numbers of each track, of unit length; zeros where the length is not a positive number."""
    plain = F.array(*(F.coalesce(column(tracks, n, "double").cast("double"), F.lit(0.0)) for n in ("tempo_bpm", "rms_energy", "spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "zero_crossing_rate")))
    raw = F.concat(plain, F.slice(S.json_vector(column(tracks, "mfcc_json")), 1, 13), F.slice(S.json_vector(column(tracks, "chroma_json")), 1, 12))
    rows = tracks.select("track_id", raw.alias("_raw"))
    rows = rows.withColumn("_raw", F.when(F.size("_raw") == 31, F.col("_raw")).otherwise(F.raise_error(F.concat(F.lit("embedding needs 31 numbers: "), F.col("track_id"))).cast("array<double>")))
    norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("_norm", norm)
    unit = F.when(S.finite(F.col("_norm")) & (F.col("_norm") > 0), F.transform("_raw", lambda x: x / F.col("_norm"))).otherwise(F.transform("_raw", lambda x: F.lit(0.0)))
    return rows.select("track_id", unit.cast("array<float>").alias("vector"))
