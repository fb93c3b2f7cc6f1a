"""A quality classifier from positive and unlabelled texts.

Trusted positives are labelled rows with quality 1 outside the held-out fold, at
most ``sample`` of them; unlabelled text is a sample of the rows of the whole
corpus, at most ``sample`` too, those with the least hash of id and text (equal
rows count once).  Labels of bad texts are not used.  The features are centred and scaled by their median and
spread over every row, from counts of the values rounded to ``_GRAIN``.

The class prior is estimated from positives and unlabelled text alone: a classifier
that tells the two apart is fitted to one half of each, and on the other half the
share of unlabelled text above a cut can't be less than the prior times the share
of positives above it.  The cut with the least upper bound of that ratio gives the
prior (the median of ``SPLITS`` random halvings).  A network with one hidden layer is then fitted to the non-negative unbiased risk

    prior * E+[loss(+)] + max(0, Eu[loss(-)] - prior * E+[loss(-)])

where, once the second term goes below zero, its gradient is followed upwards.  A
text is good where the network says that this is likelier than not.

A text is described by the shares of kinds of characters, words, lines and
repeated five-word windows.  Scoring is a function of one row.

Defined results
---------------
Null and empty texts are described by zeros and get a score like any other.  Very
long texts are described whole.  Without trusted positives every score is 1, so that nothing is rejected unjudged.
Repeated rows score alike.  An empty table gives an empty one.  Other columns stay as they are; columns of the names added give way to the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.bpe import blocks
from cadenza.llm.frames import hidden_fields, hide, place, restored, take
from cadenza.llm.training import SAMPLE, adam, held_out, least_hashed, sigmoid, training_rows
from cadenza.llm.words import window_hashes, words_of

PARTS, REST, CUT = 3, 1, 0.5
HIDDEN, STEPS, RATE, DECAY = 16, 1500, 0.02, 1e-4
PRIOR_STEPS, LEAST_SHARE, CONFIDENCE, SPLITS = 600, 0.5, 1.64, 5
_TEXT_BYTES = 3_000_000
_GRAIN, _MOST = 1e-4, 4.0
_SLICE = 500
_WINDOW = 5


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_KINDS = np.stack(
    [_kind(b"#*$%&<>@^~="), _kind(b"|"), _kind(b"!"), _kind(b".?"), _kind(b",;:"), _kind(b"0123456789"), _kind(bytes(range(65, 91))), _kind(bytes(range(97, 123))), _kind(b"{}[]()\\/_\"`"), _kind(b"-+")],
    1,
)
_ENDS = _kind(b".!?\"')") > 0


def describe(texts: list[str | None]) -> np.ndarray:
    """A row of numbers for each text."""
    out = np.zeros((len(texts), _KINDS.shape[1] + 9))
    for a, b in blocks(texts, _TEXT_BYTES):
        w = words_of(texts[a:b])
        grams = window_hashes(w.hash, _WINDOW)
        for i, text in enumerate(texts[a:b]):
            if not text:
                continue
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            counts = np.bincount(raw, minlength=256)
            low, high = int(w.first[i]), int(w.first[i + 1])
            n = high - low
            solid = max(1, len(raw) - counts[32] - counts[9:14].sum())
            windows = grams[low : max(low, high - _WINDOW + 1)]
            repeated = 1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0
            distinct = len(np.unique(w.hash[low:high]))
            breaks = np.flatnonzero(raw == 10)
            before = raw[breaks[breaks > 0] - 1]
            ended = (_ENDS[before].sum() + _ENDS[raw[-1]]) / (len(before) + 1)
            echo = (w.hash[low + 1 : high] == w.hash[low : high - 1]).mean() if n > 1 else 0.0
            out[a + i] = [
                *(counts @ _KINDS / solid),
                (counts[128:].sum()) / solid,
                min(1.0, np.log1p(n) / 10),
                solid / max(1, n) / 20,
                repeated,
                echo,
                distinct / max(1, n),
                ended,
                min(1.0, len(breaks) / max(1, n)),
                1.0,
            ]
    return out


def _sliced(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text; few of them are Python objects at a time."""
    return np.concatenate([describe(texts.slice(a, _SLICE).to_pylist()) for a in range(0, max(1, len(texts)), _SLICE)])


@dataclass
class Model:
    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        return forward(self.weights, self.normal(x))[0]

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def _unpack(w: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    a = d * HIDDEN
    return w[:a].reshape(d, HIDDEN), w[a : a + HIDDEN], w[a + HIDDEN : a + 2 * HIDDEN], w[-1]


def forward(w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inner, shift, outer, bias = _unpack(w, x.shape[1])
    h = np.maximum(x @ inner + shift, 0)
    return h @ outer + bias, h


def _backward(w: np.ndarray, x: np.ndarray, h: np.ndarray, dz: np.ndarray) -> np.ndarray:
    outer = _unpack(w, x.shape[1])[2]
    dh = np.outer(dz, outer) * (h > 0)
    return np.concatenate([(x.T @ dh).ravel(), dh.sum(0), h.T @ dz, [dz.sum()]])


def risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two terms of the risk under the logistic loss, and their gradients."""
    zp, hp = forward(w, xp)
    zu, hu = forward(w, xu)
    # loss(+) = log(1 + exp(-z)), loss(-) = log(1 + exp(z))
    good = prior * np.logaddexp(0, -zp).mean()
    bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    plus = _backward(w, xp, hp, -prior * sigmoid(-zp) / len(zp))
    minus = _backward(w, xu, hu, sigmoid(zu) / len(zu)) - _backward(w, xp, hp, prior * sigmoid(zp) / len(zp))
    return good, bad, plus, minus


def _start(d: int, rng: np.random.Generator) -> np.ndarray:
    return np.concatenate([rng.normal(0, (2 / d) ** 0.5, d * HIDDEN), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), [0.0]])


def class_prior(p: np.ndarray, u: np.ndarray, seed: int = 5) -> float:
    """The share of positives in ``u``, from descriptions of positives and unlabelled texts (centred and scaled)."""
    return float(np.median([_prior_by_halves(p, u, seed + i) for i in range(SPLITS)]))


def _prior_by_halves(p: np.ndarray, u: np.ndarray, seed: int) -> float:
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    (p1, p2), (u1, u2) = np.array_split(p, 2), np.array_split(u, 2)
    if not len(p2) or not len(u2):
        return 0.5

    def gradient(w: np.ndarray, _: int) -> np.ndarray:
        xp, xu = p1[rng.integers(0, len(p1), 512)], u1[rng.integers(0, len(u1), 512)]
        zp, hp = forward(w, xp)
        zu, hu = forward(w, xu)
        return _backward(w, xp, hp, -sigmoid(-zp) / len(zp)) + _backward(w, xu, hu, sigmoid(zu) / len(zu)) + DECAY * w

    w = adam(gradient, _start(p.shape[1], rng), PRIOR_STEPS, RATE)
    zp, zu = np.sort(forward(w, p2)[0]), np.sort(forward(w, u2)[0])
    cuts = zp[: max(1, int(len(zp) * (1 - LEAST_SHARE)))]
    share_p = 1 - np.searchsorted(zp, cuts) / len(zp)
    share_u = 1 - np.searchsorted(zu, cuts) / len(zu)
    doubt = CONFIDENCE * (np.sqrt(share_u * (1 - share_u) / len(zu)) + np.sqrt(share_p * (1 - share_p) / len(zp)))
    best = int(np.argmin((share_u + doubt) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, middle: np.ndarray, spread: np.ndarray, seed: int = 5) -> Model:
    """Estimate the prior and minimise the non-negative risk, by mini-batches."""
    model = Model(middle, np.maximum(spread, 1e-3), np.zeros(0))
    p, u = model.normal(positive), model.normal(unlabelled)
    model.prior = class_prior(p, u, seed)
    rng = np.random.default_rng(seed)

    def gradient(w: np.ndarray, _: int) -> np.ndarray:
        xp, xu = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 1024)]
        _, bad, plus, minus = risk(w, xp, xu, model.prior)
        return (plus + minus if bad >= 0 else -minus) + DECAY * w

    model.weights = adam(gradient, _start(p.shape[1], rng), STEPS, RATE)
    return model


def _described(rows: DataFrame) -> np.ndarray:
    """Descriptions of the texts of a bounded table, made where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _sliced(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64()))], names=["x"])

    got = rows.select("text").mapInArrow(run, "x array<double>").toArrow()
    return got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, _KINDS.shape[1] + 9)


def median_and_spread(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature over every row; only counts of rounded values leave the rows, so the order of rows can't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.rint(np.minimum(_sliced(batch.column(0)), _MOST) / _GRAIN).astype(np.int64)
            for i in range(x.shape[1]):
                values, counts = np.unique(x[:, i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i)), pa.array(values), pa.array(counts)], names=["i", "value", "n"])

    counted = take(docs, "text").mapInArrow(run, "i long, value long, n long")
    got = counted.groupBy("i", "value").agg(F.sum("n").alias("n")).toArrow().sort_by([("i", "ascending"), ("value", "ascending")])  # at most _MOST / _GRAIN + 1 rows a feature
    feature, value, n = (got[c].to_numpy() for c in ("i", "value", "n"))
    middle, spread = [], []
    for i in range(int(feature[-1]) + 1):
        v, w = value[feature == i] * _GRAIN, n[feature == i]
        middle.append(v[np.searchsorted(np.cumsum(w), w.sum() / 2)])
        spread.append(np.sqrt(np.average((v - np.average(v, weights=w)) ** 2, weights=w)))
    return np.array(middle), np.array(spread)


def unlabelled_rows(docs: DataFrame, sample: int) -> DataFrame:
    """The texts of at most ``sample`` different rows of the corpus, by a hash of id and text."""
    return least_hashed(take(docs, "doc_id", "text").select(F.xxhash64(F.lit(3), "doc_id", "text").alias("h"), "text"), sample)


def _sorted(x: np.ndarray) -> np.ndarray:
    """In an order that doesn't depend on how the rows arrived: it decides which of them a mini-batch gets."""
    return x[np.lexsort(x.T)]


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    positive = _described(training_rows(docs, labels.filter("quality = 1"), "quality", PARTS, REST, sample))
    if not len(positive):
        return None
    return fit(_sorted(positive), _sorted(_described(unlabelled_rows(docs, sample))), *median_and_spread(docs))


def quality_model(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs`` and ``held_out``, ``score``, ``predicted``."""
    model = learn(docs, labels, sample=sample)
    text = place(docs, "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(_sliced(batch.column(text))) if model and batch.num_rows else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "_score"])

    done = hide(docs).mapInArrow(score, T.StructType([*hidden_fields(docs), T.StructField("_score", T.DoubleType())]))
    add = {
        "held_out": held_out(F.col(place(docs, "doc_id")), PARTS, REST),
        "score": F.col("_score"),
        "predicted": (F.col("_score") >= CUT).cast("int"),
    }
    return restored(done, docs, add=add)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, from the columns that a score may depend on."""
    return quality_model(take(docs, "doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
