"""Labelled rows that a model may learn from, and small optimisers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.frames import take

#: The most labelled rows that a model is fitted on: those with the least hash of their id.
SAMPLE = 20_000


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    """Whether a row's label is out of bounds; a null id has no label and is held out."""
    return F.coalesce(fold(doc_id, parts) == rest, F.lit(True))


def least_hashed(rows: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` different rows (equal ones count once), those with the least hash.  The hashes choose, so that no text is sorted.

    ``rows`` has a column ``h`` that names a row.
    """
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).head()[0]
    own = [F.first(c).alias(c) for c in rows.columns if c != "h"]
    return rows.filter(F.col("h") <= F.lit(last)).groupBy("h").agg(*own)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, rest: int, sample: int) -> DataFrame:
    """``text`` and ``y`` of at most ``sample`` labelled rows outside the held-out fold.

    The labels are few by construction (``sample`` rows of two numbers), so they are
    sent to the documents.  An id that many rows share counts once for each different text,
    and rows beyond ``sample`` are left out by a hash.
    """
    own = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), parts, rest))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = take(docs, "doc_id", "text").join(F.broadcast(own), "doc_id").select(F.xxhash64(F.lit(3), "doc_id", "text").alias("h"), "text", F.col("y").cast("int").alias("y"))
    return least_hashed(met, sample).select("text", "y")


def adam(gradient: Callable[[np.ndarray, int], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimise by Adam with a rate that falls to a tenth; ``gradient`` takes the parameters and the step's number."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x, t)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
