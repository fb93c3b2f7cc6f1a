"""Incremental ingestion of a folder of audio files."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.audio_embedding import local_path
from cadenza.sources.store import Store

# File extensions of audio.
EXTENSIONS = (".mp3", ".flac", ".wav", ".m4a", ".ogg", ".opus", ".aac")
METADATA = "title string, artist string, album string, album_artist string, composer string, genre string, year int, duration_seconds double, bitrate int, sample_rate int, channels int"
ANALYSIS = "tempo_bpm double, rms_energy double, spectral_centroid double, spectral_bandwidth double, spectral_rolloff double, zero_crossing_rate double, mfcc_json string, chroma_json string, analysis_seconds double, analysis_mode string"
# How a track of a folder and its analysis are marked.
SOURCE, MODE = "local_file", "bounded"
FEATURES = ("tempo_bpm", "rms_energy", "spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "zero_crossing_rate", "mfcc_json", "chroma_json")


_OPENED = 16  # rows put together at a time


@dataclass(frozen=True)
class AnalysisConfig:
    max_analysis_seconds: float = 180.0
    analysis_offset_seconds: float = 0.0

    def __post_init__(self) -> None:
        if not math.isfinite(self.max_analysis_seconds) or self.max_analysis_seconds <= 0 or not self.analysis_offset_seconds >= 0:
            raise ValueError("the window must be positive and its offset must not be negative")

    @property
    def version(self) -> str:
        return f"m0.5|max={self.max_analysis_seconds:g}|off={self.analysis_offset_seconds:g}"


def file_uri(path: Column) -> Column:
    """Spark's path of a local file as a ``file://`` URI, with all but letters, digits and ``/_.-~`` in percent form."""
    coded = F.url_encode(F.regexp_replace(path, r"^file:/+", "/"))
    for written, wanted in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(written), F.lit(wanted))
    return F.concat(F.lit("file://"), coded)


def stable_track_id(uri: Column) -> Column:
    return F.sha2(uri.cast("binary"), 256)


def is_audio(path: Column) -> Column:
    """Whether a path ends like an audio file, in any case of letters."""
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)).isin(*EXTENSIONS)


def audio_files(spark: SparkSession, root: str) -> DataFrame:
    """``source_uri, path, file_name, file_size, modified_at_ns`` (microseconds at best) of audio files below a folder.

    Only names and sizes are read, never contents.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = found.filter(is_audio(F.col("path")))
    own = [file_uri(F.col("path")).alias("source_uri"), F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), (F.unix_micros("modificationTime") * 1000).alias("modified_at_ns")]
    return kept.select(*own)


def tag_reader(content: bytes, name: str) -> dict:
    """Tags and stream facts by the optional mutagen package."""
    import io

    try:
        import mutagen
    except ImportError as error:
        raise RuntimeError("install mutagen to read tags") from error
    got = mutagen.File(io.BytesIO(content), filename=name, easy=True)
    if got is None:
        return {}
    first = lambda k: next(iter((got.tags or {}).get(k) or []), None)
    date = str(first("date") or "")[:4]
    info = got.info
    return {
        "title": first("title"), "artist": first("artist"), "album": first("album"), "album_artist": first("albumartist"), "composer": first("composer"), "genre": first("genre"),
        "year": int(date) if date.isdigit() else None, "duration_seconds": float(getattr(info, "length", 0) or 0) or None, "bitrate": int(getattr(info, "bitrate", 0) or 0) or None,
        "sample_rate": int(getattr(info, "sample_rate", 0) or 0) or None, "channels": int(getattr(info, "channels", 0) or 0) or None,
    }


def audio_analyzer(config: AnalysisConfig) -> Callable[[bytes, str], dict]:
    """Means of the acoustic features of a window, by the optional librosa package."""

    def analyze(content: bytes, name: str) -> dict:
        import io
        import json

        try:
            import librosa
        except ImportError as error:
            raise RuntimeError("install librosa to analyse audio") from error
        y, rate = librosa.load(io.BytesIO(content), sr=None, mono=True, offset=config.analysis_offset_seconds, duration=config.max_analysis_seconds)
        if not len(y):
            return {"sample_rate": int(rate), "channels": 1, "mfcc_json": "[]", "chroma_json": "[]", "analysis_seconds": 0.0, "analysis_mode": MODE}
        f = librosa.feature
        mean = lambda a: float(a.mean())
        tempo = librosa.beat.beat_track(y=y, sr=rate)[0]
        return {
            "sample_rate": int(rate), "channels": 1, "tempo_bpm": float(getattr(tempo, "item", lambda: tempo)()), "rms_energy": mean(f.rms(y=y)), "spectral_centroid": mean(f.spectral_centroid(y=y, sr=rate)),
            "spectral_bandwidth": mean(f.spectral_bandwidth(y=y, sr=rate)), "spectral_rolloff": mean(f.spectral_rolloff(y=y, sr=rate)), "zero_crossing_rate": mean(f.zero_crossing_rate(y)),
            "mfcc_json": json.dumps(f.mfcc(y=y, sr=rate, n_mfcc=13).mean(1).tolist()), "chroma_json": json.dumps(f.chroma_stft(y=y, sr=rate).mean(1).tolist()),
            "analysis_seconds": len(y) / rate, "analysis_mode": MODE,
        }

    return analyze


def read_audio(files: DataFrame, metadata: Callable[[bytes, str], dict], analyze: Callable[[bytes, str], dict] | None, *, hashes: bool = True) -> DataFrame:
    """Hash, metadata and features of files, each opened once where the task runs; failures become ``issues``, never errors.

    With ``hashes`` off a known hash (``_hash``) stays as it is.
    """
    meta = [c.split()[0] for c in METADATA.split(", ")]
    feat = [c.split()[0] for c in ANALYSIS.split(", ")]

    def one(uri: str, name: str, known: str | None) -> dict:
        row, issues = dict.fromkeys(("new_hash", *meta, *feat)), []

        def attempt(stage: str, work: Callable[[], dict]) -> bool:
            try:
                row.update(work())
                return True
            except Exception as error:  # a broken file must not stop the scan
                issues.append((stage, uri, type(error).__name__, str(error)))
                return False

        held: list[bytes] = []
        if attempt("read", lambda: held.append(Path(local_path(uri)).read_bytes()) or {}):
            content = held[0]
            row["new_hash"] = hashlib.sha256(content).hexdigest() if hashes or not known else known
            attempt("metadata", lambda: metadata(content, name))
            if analyze is not None and not attempt("analysis", lambda: {"analysis_mode": MODE} | analyze(content, name)):
                row["analysis_mode"] = "failed"
        else:
            row |= {"new_hash": known, "analysis_mode": "failed" if analyze is not None else None}
        return {"source_uri": uri, **row, "issues": issues}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), _OPENED):
                own = part.iloc[a : a + _OPENED]
                rows = [one(*r) for r in zip(own["source_uri"], own["file_name"], own["_hash"], strict=True)]
                out = pd.DataFrame(rows, columns=["source_uri", "new_hash", *meta, *feat, "issues"])
                for c in ("year", "bitrate", "sample_rate", "channels"):
                    out[c] = out[c].astype("Int32")
                yield out

    kept = F.when(F.col("_hash") != "", F.col("_hash")).alias("_hash")
    return files.select("source_uri", "file_name", kept).mapInPandas(run, f"source_uri string, new_hash string, {METADATA}, {ANALYSIS}, issues array<struct<stage string, source string, error_type string, message string>>")


def changed_files(files: DataFrame, state: DataFrame, tracks: DataFrame, config: AnalysisConfig | None) -> DataFrame:
    """Files with ``changed``: unknown, of another size or time, without a row, or (when analysing) analysed otherwise."""
    s = state.select("source_uri", F.col("file_size").alias("_size"), F.col("modified_at_ns").alias("_time"), F.col("content_hash").alias("_hash"))
    t = tracks.select("source_uri", F.col("track_id").alias("_track"), F.col("analysis_version").alias("_version"), F.col("analysis_seconds").alias("_seconds"))
    met = files.join(s, "source_uri", "left").join(t, "source_uri", "left")
    same = F.col("_track").isNotNull() & (F.col("_size") == F.col("file_size")) & (F.col("_time") == F.col("modified_at_ns"))
    if config is not None:
        same = same & (F.col("_version") == config.version) & F.col("_seconds").isNotNull()
    return met.withColumn("changed", ~F.coalesce(same, F.lit(False)))


def scan(
    store: Store, root: str, *, compute_content_hash: bool = True, config: AnalysisConfig | None = None, analyze: bool = True, metadata: Callable[[bytes, str], dict] = tag_reader,
    analyzer: Callable[[bytes, str], dict] | None = None, sweep_all: bool = False, now: datetime | None = None,
) -> tuple[int, DataFrame]:
    """Bring the store up to date with a folder; the number of changed files, and the issues met.

    Only changed files are opened, once each, by the task that reads them.  Files that are gone from this folder (with
    ``sweep_all``: from any) are marked missing.  A failed analysis keeps the old
    features and is tried again next time.
    """
    spark, at = store.spark, now or datetime.now(UTC)
    config = config or AnalysisConfig()
    tracks, state = store.table("tracks"), store.table("scan_state")
    files = changed_files(audio_files(spark, root), state, tracks, config if analyze else None).cache()
    todo = files.filter("changed")
    # as a table of its own nothing of it is computed, and no file opened, twice
    read = store.log("readings", read_audio(todo.repartition(max(1, min(todo.count(), spark.sparkContext.defaultParallelism * 4))), metadata, (analyzer or audio_analyzer(config)) if analyze else None, hashes=compute_content_hash))
    hashes = read.select("source_uri", "new_hash")
    n = todo.count()
    meta = [c.split()[0] for c in METADATA.split(", ")]
    old = tracks.withColumn("_old", F.lit(True))
    fresh = todo.select("source_uri", "file_name", "file_size", "modified_at_ns").join(read.drop("issues"), "source_uri").join(old.select("source_uri", "created_at", *(F.col(f).alias(f"_{f}") for f in FEATURES), F.col("analysis_version").alias("_v"), F.col("analysis_mode").alias("_m"), F.col("analysis_seconds").alias("_s")), "source_uri", "left")
    failed = F.col("analysis_mode") == "failed"
    done = F.lit(analyze)
    fresh = fresh.select(
        stable_track_id(F.col("source_uri")).alias("track_id"), F.col("new_hash").alias("content_hash"), F.lit(SOURCE).alias("source_type"), "source_uri", "file_name", "file_size", "modified_at_ns",
        F.lit("active").alias("status"), F.coalesce("created_at", F.lit(at)).alias("created_at"), F.lit(at).alias("updated_at"), *meta,
        *(F.when(done & ~F.coalesce(failed, F.lit(False)), F.col(f)).otherwise(F.col(f"_{f}")).alias(f) for f in FEATURES),
        F.when(done, F.col("analysis_mode")).otherwise(F.col("_m")).alias("analysis_mode"),
        F.when(done, F.when(~failed, F.col("analysis_seconds"))).otherwise(F.col("_s")).alias("analysis_seconds"),
        F.when(done, F.lit(config.version)).otherwise(F.col("_v")).alias("analysis_version"),
    )
    seen = files.select("source_uri", F.col("changed").alias("_changed"))
    prefix = audio_prefix(root)
    rest = tracks.join(seen, "source_uri", "left").filter("_changed IS NULL OR NOT _changed")
    under = F.col("source_uri").startswith("file://") & (F.lit(sweep_all) | F.col("source_uri").startswith(prefix))
    gone = F.col("_changed").isNull() & under & (F.col("status") == "active")
    rest = rest.withColumn("status", F.when(gone, "missing").when(F.col("_changed").isNotNull(), "active").otherwise(F.col("status"))).withColumn("updated_at", F.when(gone | F.col("_changed").isNotNull(), F.lit(at)).otherwise(F.col("updated_at")))
    states = files.join(hashes, "source_uri", "left").select("source_uri", F.lit(at).alias("last_seen_at"), "file_size", "modified_at_ns", F.coalesce("new_hash", "_hash").alias("content_hash"))
    kept = state.join(seen, "source_uri", "left_anti")
    issues = store.log("issues", read.select(F.explode("issues").alias("i")).select("i.*"))
    store.replace("tracks", rest.drop("_changed").unionByName(fresh))
    store.replace("scan_state", kept.unionByName(states))
    files.unpersist()
    return n, issues


def audio_prefix(root: str) -> str:
    plain = "/" + root.removeprefix("file:").strip("/")
    return f"file://{quote(plain)}/"
