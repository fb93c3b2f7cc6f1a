"""Vector search: live cosine, and persisted indexes with freshness checks."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import checks
from cadenza.operators.catalog import active, catalog_text, column


class StaleIndexError(ValueError):
    """An index that no longer belongs to its catalog, model or prefixes."""


class TextEmbeddingProvider(Protocol):
    """Anything that turns texts into vectors of one width; it travels to the executors."""

    def embed_documents(self, texts: list[str]) -> list: ...

    def embed_query(self, text: str) -> list: ...


@dataclass(frozen=True)
class TextEmbeddingProfile:
    model_name: str
    query_prefix: str = ""
    document_prefix: str = ""

    def __post_init__(self) -> None:
        checks.text(self.model_name, "model_name")


class HashingProvider:
    """A provider without a model: signed hashes of words, of unit length."""

    def __init__(self, width: int = 64, query_prefix: str = "", document_prefix: str = "") -> None:
        self.width, self.query_prefix, self.document_prefix = width, query_prefix, document_prefix

    def _embed(self, text: str) -> list[float]:
        import hashlib

        out = np.zeros(self.width)
        for word in text.casefold().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % self.width] += 1 if h >> 32 & 1 else -1
        norm = float(np.linalg.norm(out))
        return (out / norm if norm else out).tolist()

    def embed_documents(self, texts: list[str]) -> list:
        return [self._embed(self.document_prefix + t) for t in texts]

    def embed_query(self, text: str) -> list:
        return self._embed(self.query_prefix + text)


class FastEmbedProvider:
    """A provider on the optional fastembed package, loaded once in each worker."""

    def __init__(self, model_name: str, query_prefix: str = "", document_prefix: str = "") -> None:
        self.model_name, self.query_prefix, self.document_prefix = checks.text(model_name, "model_name"), query_prefix, document_prefix
        self._model = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def _run(self, texts: list[str]) -> list:
        if self._model is None:
            try:
                from fastembed import TextEmbedding
            except ImportError as error:
                raise RuntimeError("install fastembed to embed text") from error
            self._model = TextEmbedding(model_name=self.model_name)
        return [list(map(float, v)) for v in self._model.embed(texts)]

    def embed_documents(self, texts: list[str]) -> list:
        return self._run([self.document_prefix + t for t in texts])

    def embed_query(self, text: str) -> list:
        return self._run([self.query_prefix + text])[0]


def vector_of(values) -> list[float]:
    """A finite numeric sequence as doubles."""
    out = [float(v) for v in values if not isinstance(v, (bool, str))]
    if not out or len(out) != len(values) or not all(map(math.isfinite, out)):
        raise ValueError("a vector must hold finite numbers")
    return out


def _products(query: list[float], scale: Callable[[np.ndarray], np.ndarray]):
    """A column function: inner products with a query, times what ``scale`` says of the vectors."""
    asked = np.array(query, np.float64)

    @F.arrow_udf("double")
    def run(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors))
        known = vectors.drop_null() if vectors.null_count else vectors
        if len(known):
            flat = known.flatten()
            if (np.diff(known.offsets.to_numpy()) != len(asked)).any() or flat.null_count:
                raise ValueError("vectors differ in width")
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(asked))
            out[np.asarray(vectors.is_valid())] = scale(x) * (x @ asked)
        return pa.array(out, mask=np.asarray(vectors.is_null()))

    return run


def dot(vector: Column, query: list[float]) -> Column:
    """Inner product in double precision, a batch at a time."""
    return _products(query, lambda x: np.ones(len(x)))(vector)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a query; 0 for a zero vector, an error for another width."""
    size = math.sqrt(sum(q * q for q in query))

    def scale(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1)) * size
        return np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 0)

    return _products(query, scale)(vector)


def embed(texts: DataFrame, provider: TextEmbeddingProvider, batch: int = 256) -> DataFrame:
    """``track_id`` and ``vector`` of ``track_id, text`` rows, embedded in batches on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), batch):
                own = part.iloc[a : a + batch]
                vectors = provider.embed_documents(own["text"].tolist())
                if len(vectors) != len(own):
                    raise ValueError("the provider returned another number of vectors")
                yield pd.DataFrame({"track_id": own["track_id"].to_numpy(), "vector": [vector_of(v) for v in vectors]})

    return texts.select("track_id", "text").mapInPandas(run, "track_id string, vector array<double>")


def semantic_search(tracks: DataFrame, query: str, provider: TextEmbeddingProvider, *, limit: int = 10) -> DataFrame:
    """``track_id, score, title, artist, album`` by cosine with live embeddings of all active tracks."""
    checks.positive(limit, "limit")
    asked = vector_of(provider.embed_query(checks.text(query, "query").strip()))
    rows = active(tracks)
    scored = embed(catalog_text(rows), provider).select("track_id", cosine(F.col("vector"), asked).alias("score"))
    best = scored.orderBy(F.round("score", 9).desc(), "track_id").limit(limit)
    return with_names(best, tracks)


def with_names(found: DataFrame, tracks: DataFrame) -> DataFrame:
    """Titles of at most ``limit`` results; unknown and inactive ids drop out."""
    names = active(tracks).select("track_id", *(column(tracks, c).alias(c) for c in ("title", "artist", "album")))
    return names.join(F.broadcast(found), "track_id").select(*found.columns, "title", "artist", "album").orderBy(F.round("score", 9).desc(), "track_id")


def fingerprint_parts(texts: DataFrame) -> DataFrame:
    """A hash of all ids and texts that doesn't depend on their order, as one row: their number and four sums.

    Row hashes are added in parts, so no task or driver ever holds the catalog.
    """
    row = F.sha2(F.concat_ws("\0", "track_id", "text"), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    return texts.agg(F.count("*").alias("n"), *parts)


def fingerprint(texts: DataFrame) -> str:
    """The row of :func:`fingerprint_parts` as one text."""
    return "-".join(format(int(v or 0), "x") for v in fingerprint_parts(texts).head())


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    if not rows:
        raise FileNotFoundError(path)
    return rows[0][0]


_DIGITS = 12


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """The published versions of a small file, oldest first."""
    fs, p = _fs(spark, path)
    if not fs.exists(p.getParent()):
        return []
    head = f"{p.getName()}.v"
    names = [f.getPath().getName() for f in fs.listStatus(p.getParent())]
    return sorted(n for n in names if n.startswith(head) and len(n) == len(head) + _DIGITS and n[len(head) :].isdecimal())


def published(spark: SparkSession, path: str) -> str | None:
    """The text of the newest version, or None where there is none."""
    found = _pointers(spark, path)
    return read_text(spark, f"{path.rsplit('/', 1)[0]}/{found[-1]}") if found else None


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file as a new numbered version; readers take the highest.

    The file is moved to its name when it is whole, and older versions go afterwards (the last
    but one stays for readers under way), so there is never a moment without one.
    """
    found = _pointers(spark, path)
    number = int(found[-1][-_DIGITS:]) + 1 if found else 1
    fs, target = _fs(spark, f"{path}.v{number:0{_DIGITS}d}")
    _, part = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, target):
        raise RuntimeError(f"could not publish {path}")
    for name in found[:-1]:
        fs.delete(_fs(spark, f"{path.rsplit('/', 1)[0]}/{name}")[1], False)


class VectorIndex:
    """Vectors of unit length in Parquet, with a manifest that names the current version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, vectors: DataFrame, **facts) -> int:
        """Write ``track_id, vector`` rows as a new version and point the manifest to it; an empty table makes an empty index."""
        version = uuid.uuid4().hex
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        rows = vectors.select("track_id", F.col("vector").cast("array<double>").alias("vector")).withColumn("_n", norm)
        unit = F.when(F.col("_n") > 0, F.transform("vector", lambda x: x / F.col("_n"))).otherwise(F.col("vector"))
        rows.select("track_id", unit.alias("vector")).write.parquet(f"{self.path}/{version}")
        stored = self.spark.read.parquet(f"{self.path}/{version}")
        seen = stored.agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("ids"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.bool_and(F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))).alias("ok")).head()
        if seen.n and (seen.ids != seen.n or seen.low != seen.high or not seen.low or not seen.ok):
            raise ValueError("an index needs unique ids and finite vectors of one width")
        manifest = {"version": 1, "data": version, "count": seen.n, "dimension": seen.low or 0, "digest": self._digest(stored)} | facts
        publish(self.spark, f"{self.path}/manifest.json", json.dumps(manifest))
        return seen.n

    @staticmethod
    def _digest(rows: DataFrame) -> str:
        return fingerprint(rows.select("track_id", F.to_json("vector").alias("text")))

    def manifest(self) -> dict | None:
        """Null where there is no index; an error where it is broken."""
        text = published(self.spark, f"{self.path}/manifest.json")
        if text is None:
            return None
        try:
            got = json.loads(text)
        except ValueError as error:
            raise StaleIndexError("the index has an unreadable manifest") from error
        whole = lambda k: isinstance(got.get(k), int) and not isinstance(got[k], bool) and got[k] >= 0
        if not isinstance(got, dict) or got.get("version") != 1 or not whole("count") or not whole("dimension"):
            raise ValueError("the index has a manifest of another kind")
        return got

    def load(self, *, verify: bool = True) -> DataFrame:
        """``track_id, vector``; empty without an index, an error if the data isn't what the manifest says."""
        facts = self.manifest()
        if facts is None:
            return self.spark.createDataFrame([], "track_id string, vector array<double>")
        rows = self.spark.read.schema("track_id string, vector array<double>").parquet(f"{self.path}/{facts['data']}")
        if verify and self._digest(rows) != facts["digest"]:
            raise ValueError("the index doesn't hold what its manifest says")
        return rows

    def search(self, query: list[float], *, limit: int = 10, verify: bool = True) -> DataFrame:
        """``track_id, score``; nothing for a query that is zero, not finite or of another width.  Damaged data is an error unless ``verify`` is off."""
        checks.positive(limit, "limit")
        facts = self.manifest()
        rows = self.load(verify=verify)
        ok = all(not isinstance(q, bool) and math.isfinite(q) for q in query) and any(query)
        if facts is None or not ok or len(query) != facts["dimension"]:
            return rows.select("track_id", F.lit(0.0).alias("score")).limit(0)
        size = math.sqrt(sum(q * q for q in query))
        scored = rows.select("track_id", dot(F.col("vector"), [float(q) / size for q in query]).alias("score"))
        return scored.orderBy(F.round("score", 9).desc(), "track_id").limit(limit)

    def scores(self, track_id: str) -> DataFrame:
        """``track_id, score`` of all stored tracks against one of them."""
        rows = self.load()
        seed = rows.filter(F.col("track_id") == track_id).limit(1).collect()
        if not seed:
            raise KeyError(track_id)
        return rows.select("track_id", dot(F.col("vector"), list(seed[0]["vector"])).alias("score"))

    def similar(self, track_id: str, *, limit: int = 10) -> DataFrame:
        """The nearest to a stored track, without it."""
        checks.positive(limit, "limit")
        seed = self.load().filter(F.col("track_id") == track_id).limit(1).collect()
        if not seed:
            raise KeyError(track_id)
        return self.search(list(seed[0]["vector"]), limit=limit + 1, verify=False).filter(F.col("track_id") != track_id).orderBy(F.round("score", 9).desc(), "track_id").limit(limit)


class SemanticTextIndex:
    """A vector index over catalog texts that refuses to answer once the catalog has changed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.index = VectorIndex(spark, path)

    def rebuild(self, tracks: DataFrame, provider: TextEmbeddingProvider, profile: TextEmbeddingProfile) -> int:
        texts = catalog_text(active(tracks))
        checks.distinct_rows(texts)
        return self.index.save(embed(texts, provider), model=profile.model_name, query_prefix=profile.query_prefix, document_prefix=profile.document_prefix, fingerprint=fingerprint(texts))

    def search(self, tracks: DataFrame, query: str, provider: TextEmbeddingProvider, profile: TextEmbeddingProfile, *, limit: int = 10) -> DataFrame:
        checks.positive(limit, "limit")
        facts = self.index.manifest()
        if facts is None:
            raise FileNotFoundError(self.index.path)
        for key, now in (("model", profile.model_name), ("query_prefix", profile.query_prefix), ("document_prefix", profile.document_prefix)):
            if facts.get(key) != now:
                raise StaleIndexError(f"the index was built with another {key}")
        if facts.get("fingerprint") != fingerprint(catalog_text(active(tracks))):
            raise StaleIndexError("the catalog has changed since the index was built")
        asked = vector_of(provider.embed_query(checks.text(query, "query").strip()))
        return with_names(self.index.search(asked, limit=limit), tracks)
