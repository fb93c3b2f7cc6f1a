"""Learned audio vectors: patches of a log-mel spectrogram through an ONNX network, averaged.

Decoding needs librosa and the network needs onnxruntime and a model file; all are
optional and loaded once in each worker.  The file is fetched by the caller.
"""

from __future__ import annotations

import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import checks
from cadenza.operators.catalog import active
from cadenza.operators.vectors import VectorIndex


@dataclass(frozen=True)
class NetworkConfig:
    # What the network was made for.
    model_path: str
    rate: int = 16000
    seconds: float = 180.0
    mels: int = 96
    fft: int = 512
    hop: int = 256
    frames: int = 128
    stride: int = 62
    width: int = 1280


def local_path(uri: str | None) -> str | None:
    """The path of a ``file://`` URI (with its host, if it names one), or None."""
    parts = urlparse(uri or "")
    if parts.scheme != "file":
        return None
    path = unquote(parts.path)
    return f"//{parts.netloc}{path}" if parts.netloc and parts.netloc != "localhost" else path


# Fixed value: where the network is published.
MODEL_URL = "https://essentia.upf.edu/models/feature-extractors/discogs-effnet/discogs-effnet-bsdynamic-1.onnx"


def fetch_model(destination: str, *, url: str = MODEL_URL) -> str:
    """Download a model file unless it is there."""
    path = Path(destination)
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        urllib.request.urlretrieve(url, part)  # noqa: S310
        part.replace(path)
    return str(path)


def log_bands(power: np.ndarray) -> np.ndarray:
    """Natural logarithms of a (mels, frames) power spectrogram, as (frames, mels); silence counts as 1e-10."""
    return np.log(np.maximum(power, 1e-10)).T.astype(np.float32)


def patches(mel: np.ndarray, frames: int, stride: int) -> np.ndarray:
    """Overlapping patches of a (frames, mels) matrix; a short one is padded with zeros."""
    if len(mel) < frames:
        mel = np.pad(mel, ((0, frames - len(mel)), (0, 0)))
    return np.stack([mel[a : a + frames] for a in range(0, len(mel) - frames + 1, stride)]).astype(np.float32)


class Network:
    def __init__(self, config: NetworkConfig) -> None:
        self.config, self._session = config, None

    def __getstate__(self) -> dict:
        return {"config": self.config, "_session": None}

    def __call__(self, path: str) -> list[float]:
        c = self.config
        if self._session is None:
            if not Path(c.model_path).exists():
                raise FileNotFoundError(c.model_path)
            try:
                import onnxruntime
            except ImportError as error:
                raise RuntimeError("install onnxruntime to embed audio") from error
            self._session = onnxruntime.InferenceSession(c.model_path, providers=["CPUExecutionProvider"])
        try:
            import librosa
        except ImportError as error:
            raise RuntimeError("install librosa to decode audio") from error
        y, _ = librosa.load(path, sr=c.rate, mono=True, duration=c.seconds)
        if not len(y):
            return [0.0] * c.width
        power = librosa.feature.melspectrogram(y=y, sr=c.rate, n_fft=c.fft, hop_length=c.hop, n_mels=c.mels)
        return self.pooled(patches(log_bands(power), c.frames, c.stride))

    def pooled(self, batch: np.ndarray) -> list[float]:
        """The mean vector of patches, of unit length; zeros where that has no length."""
        found = self._session.run(None, {self._session.get_inputs()[0].name: batch})
        if len(found) < 2:
            raise RuntimeError("the network gives no embeddings beside its predictions")
        out = np.asarray(found[1], np.float64)
        if out.ndim != 2 or out.shape[1] != self.config.width:
            raise RuntimeError(f"embeddings of another shape: {out.shape}")
        mean = out.mean(axis=0)
        norm = float(np.linalg.norm(mean))
        return (mean / norm if np.isfinite(norm) and norm > 0 else np.zeros_like(mean)).tolist()


def embed_files(tracks: DataFrame, embed: Callable[[str], list[float]], *, limit: int | None = None) -> DataFrame:
    """``track_id, vector, issue`` of active local files, by id where there is a limit; a failure is an issue, not an error."""
    rows = active(tracks).filter(F.col("source_uri").startswith("file://")).select("track_id", "source_uri")
    if limit is not None:
        rows = rows.orderBy("track_id").limit(checks.positive(limit, "limit"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for track_id, uri in zip(part["track_id"], part["source_uri"], strict=True):
                path = local_path(uri)
                try:
                    if path is None or not Path(path).exists():
                        raise FileNotFoundError(uri)
                    out.append((track_id, list(map(float, embed(path))), None))
                except Exception as error:  # one broken file must not stop the others
                    out.append((track_id, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["track_id", "vector", "issue"])

    return rows.mapInPandas(run, "track_id string, vector array<double>, issue string")


class LearnedIndex:
    """Vectors of the catalog's audio, and the tracks nearest to one of them."""

    def __init__(self, index: VectorIndex, embed: Callable[[str], list[float]]) -> None:
        self.index, self.embed = index, embed

    def rebuild(self, tracks: DataFrame, *, limit: int | None = None) -> tuple[int, DataFrame]:
        """The number of stored vectors, and the issues."""
        found = embed_files(tracks, self.embed, limit=limit).cache()
        n = self.index.save(found.filter("vector IS NOT NULL").select("track_id", "vector"))
        issues = found.filter("issue IS NOT NULL").select("track_id", "issue")
        path = f"{self.index.path}/issues-{uuid.uuid4().hex}"
        issues.write.parquet(path)
        found.unpersist()
        return n, tracks.sparkSession.read.schema(issues.schema).parquet(path)

    def similar(self, tracks: DataFrame, track_id: str, *, limit: int = 10) -> DataFrame:
        """The nearest to a track of the catalog by its file's vector, without itself."""
        checks.positive(limit, "limit")
        row = tracks.filter(F.col("track_id") == track_id).limit(1).collect()
        if not row:
            raise KeyError(track_id)
        path = local_path(row[0]["source_uri"])
        if path is None or not Path(path).exists():
            raise FileNotFoundError(row[0]["source_uri"])
        found = self.index.search(self.embed(path), limit=limit + 1).filter(F.col("track_id") != track_id)
        return found.orderBy(F.round("score", 9).desc(), "track_id").limit(limit)
