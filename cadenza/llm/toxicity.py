"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults, threats, targets, negations, reporting words, others.
Five weighted transducers rewrite the symbols of a clause one by one:

* ``INSULT`` makes a hit of each insult; further ones of a clause weigh more;
* ``THREAT`` makes a hit where a target follows a threatening verb within three words;
* ``NEGATION`` denies hits in the three words after a negation;
* ``REPORT`` marks hits after a reporting verb;
* ``TARGET`` marks the hits left as aimed, in a clause with a target anywhere, or plain.

``GRAMMAR`` is their composition.  ``TARGET`` guesses at the start of a clause
whether a target will come, and a wrong guess ends in no final state, so each clause has
exactly one accepted path.  What that path emits under the four headings, times the
weights of its arcs and of the words, is the clause's evidence; a text's evidence is the sum over its
matched clauses.

The words of address, negation, report and threat are fixed values.  Insults are stems
(words and beginnings of words) learned from at most ``sample`` labelled rows by
a likelihood-ratio test, and so are the weights of the four headings, which start
from a prior: aimed evidence counts more, denied and reported evidence less.

Everything is a function of one row apart from the counts of stems in the sample,
which are summed in parts; the driver gets the best ``LEXICON`` stems of the bounded sample.

Defined results
---------------
Null and empty texts have no evidence and get the score of such texts.  Very long
texts are read whole.  Without
usable labels every text gets that score from the prior.  Repeated rows score
alike.  An empty table gives an empty one.  Other columns stay as they are; columns of the names added give way to the new ones.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.frames import hidden_fields, hide, place, restored, take
from cadenza.llm.training import SAMPLE, adam, held_out, sigmoid, training_rows

PARTS, REST, CUT = 4, 2, 0.3
LEXICON = 2000
SHORTEST, LONGEST = 3, 10
MIN_DOCS, MIN_G2, MIN_PRECISION = 5, 20.0, 0.5
CERTAIN, SAME = 0.75, 0.8
END, TWICE = "$", "2 "

# Words of address, negation, reporting and threat.
TARGETS = frozenset("you your yours yourself u he she they them him her du dich dir ihr euch dein tu te toi vous ton vos tú usted ustedes te ti él ella".split())
NEGATIONS = frozenset("not no never none nobody cannot don't isn't aren't wasn't won't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says say told reported claimed called quoted wrote alleged sagte sagt schrieb dit disait écrit dijo dice escribió".split())
THREATS = frozenset("kill murder hurt destroy strangle töten umbringen tuer frapper matar golpear".split())
THREAT_WEIGHT = 2.0

_WORD = re.compile(r"[\w']+")
_CLAUSE = re.compile(r"[.!?;:\n]+")
HEADINGS = ("plain", "aimed", "denied", "reported")
_HEADING = {h: i for i, h in enumerate(HEADINGS)}


SYMBOLS = ("insult", "threat", "target", "negation", "report", "other", "hit", "threatened", "denied", "reported", "aimed", "plain")
Arc = tuple[str, float, int]


@dataclass(frozen=True)
class Transducer:
    """Arcs lead from (state, symbol) to (symbol, weight, state); states are numbers, 0 the first."""

    arcs: dict[tuple[int, str], tuple[Arc, ...]]
    final: frozenset[int]

    def paths(self, symbols: list[str]) -> list[list[tuple[str, float]]]:
        """What each accepted path emits."""
        now: list[tuple[int, list[tuple[str, float]]]] = [(0, [])]
        for symbol in symbols:
            now = [(to, [*done, (out, w)]) for state, done in now for out, w, to in self.arcs.get((state, symbol), ())]
        return [done for state, done in now if state in self.final]


def transducer(states: int, rules: dict[tuple[int, str], tuple[Arc, ...]], rest: dict[int, int], final: set[int]) -> Transducer:
    """Symbols without a rule pass on unchanged, to the state that ``rest`` names or the same one."""
    arcs = {(s, x): rules.get((s, x), ((x, 1.0, rest.get(s, s)),)) for s in range(states) for x in SYMBOLS}
    return Transducer({k: v for k, v in arcs.items() if v}, frozenset(final))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that applies ``second`` to what ``first`` emits; its states are the pairs that can be reached."""
    number, todo = {(0, 0): 0}, [(0, 0)]
    arcs: dict[tuple[int, str], tuple[Arc, ...]] = {}
    while todo:
        pair = todo.pop()
        for symbol in SYMBOLS:
            found = []
            for middle, w1, a in first.arcs.get((pair[0], symbol), ()):
                for out, w2, b in second.arcs.get((pair[1], middle), ()):
                    if (a, b) not in number:
                        number[a, b] = len(number)
                        todo.append((a, b))
                    found.append((out, w1 * w2, number[a, b]))
            if found:
                arcs[number[pair], symbol] = tuple(found)
    return Transducer(arcs, frozenset(n for (a, b), n in number.items() if a in first.final and b in second.final))


INSULT = transducer(2, {(0, "insult"): (("hit", 1.0, 1),), (1, "insult"): (("hit", 1.25, 1),)}, {}, {0, 1})
THREAT = transducer(
    4,
    {(s, "threat"): (("other", 1.0, 3),) for s in range(4)} | {(s, "target"): (("threatened", THREAT_WEIGHT, 0),) for s in (1, 2, 3)},
    {3: 2, 2: 1, 1: 0},
    {0, 1, 2, 3},
)
NEGATION = transducer(
    4,
    {(s, "negation"): (("negation", 1.0, 3),) for s in range(4)} | {(s, x): (("denied", 1.0, s - 1),) for s in (1, 2, 3) for x in ("hit", "threatened")},
    {3: 2, 2: 1, 1: 0},
    {0, 1, 2, 3},
)
REPORT = transducer(2, {(0, "report"): (("report", 1.0, 1),)} | {(1, x): (("reported", 1.0, 1),) for x in ("hit", "threatened")}, {}, {0, 1})
#: State 1 expects a target, 2 has seen one, 3 expects none.
TARGET = transducer(
    4,
    {(0, x): ((x, 1.0, 1), (x, 1.0, 3)) for x in SYMBOLS}
    | {(0, "hit"): (("aimed", 1.0, 1), ("plain", 1.0, 3))}
    | {(s, "hit"): (("aimed", 1.0, s),) for s in (1, 2)}
    | {(3, "hit"): (("plain", 1.0, 3),)}
    | {(s, "target"): (("target", 1.0, 2),) for s in (0, 1, 2)}
    | {(s, "threatened"): (("aimed", 1.0, 2),) for s in (0, 1, 2)}
    | {(3, x): () for x in ("target", "threatened")},
    {},
    {0, 2, 3},
)
GRAMMAR = functools.reduce(compose, (INSULT, THREAT, NEGATION, REPORT, TARGET))


def clause_evidence(symbols: list[tuple[str, float]], grammar: Transducer = GRAMMAR) -> np.ndarray:
    """What the accepted path of one clause emits, by heading, weighted by arcs and words."""
    now: dict[int, np.ndarray] = {0: np.zeros(len(HEADINGS))}
    for symbol, weight in symbols:
        then: dict[int, np.ndarray] = {}
        for state, seen in now.items():
            for out, w, to in grammar.arcs.get((state, symbol), ()):
                at = _HEADING.get(out)
                if at is not None:
                    grown = seen.copy()
                    grown[at] += w * weight
                else:
                    grown = seen
                then[to] = grown  # one path leads to each state
        now = then
    return sum((seen for state, seen in now.items() if state in grammar.final), np.zeros(len(HEADINGS)))


class Grammar:
    """The composed transducers with a lexicon of stems."""

    def __init__(self, stems: dict[str, float]) -> None:
        self.stems = stems
        self.finder = ahocorasick.Automaton()
        for word in {*(s.removesuffix(END) for s in stems), *THREATS}:
            self.finder.add_word(word, word)
        if len(self.finder):
            self.finder.make_automaton()
        self.symbol = functools.lru_cache(maxsize=200_000)(self._symbol)

    def _symbol(self, word: str) -> tuple[str, float]:
        weight = max(self.stems.get(s, 0.0) for s in stems_of_word(word))
        if weight:
            return "insult", weight
        for name, words in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)):
            if word in words:
                return name, 1.0
        return "other", 1.0

    def evidence(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(HEADINGS))
        if not text or not len(self.finder):
            return out
        low = text.lower()
        ends = [end for end, word in self.finder.iter(low) if not (low[end - len(word)].isalnum() if end >= len(word) else False)]
        if not ends:
            return out
        done = -1
        for end in ends:  # only clauses that hold a stem are read
            if end < done:
                continue
            left = max((low.rfind(c, 0, end) for c in ".!?;:\n"), default=-1) + 1
            mark = _CLAUSE.search(low, end)
            done = mark.start() if mark else len(low)
            out += clause_evidence([self.symbol(w) for w in _WORD.findall(low, left, done)])
        return out


def stems_of_word(word: str) -> list[str]:
    """The whole word, marked by its end, and the proper beginnings of a longer one."""
    return [word + END, *(word[:n] for n in range(SHORTEST, min(LONGEST + 1, len(word))))]


def stems_of(text: str) -> set[str]:
    """The stems of a text; those of two words or more also marked by ``TWICE``."""
    n = Counter(s for w in _WORD.findall(text.lower()) for s in stems_of_word(w))
    return {*n, *(TWICE + s for s, k in n.items() if k > 1)}


def _count_stems(rows: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):  # bounds the counter
                part = batch.slice(a, 500)
                n, p = Counter(), Counter()
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = stems_of(text or "")
                    n.update(found)
                    if y:
                        p.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64()), pa.array([p[w] for w in n], pa.int64())], names=["stem", "n", "p"])

    return rows.mapInArrow(count, "stem string, n long, p long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))


def learn_stems(rows: DataFrame) -> dict[str, float]:
    """Stems that toxic rows hold more often than chance, with the logarithm of how much more often.

    A stem may count by its presence or by two words that have it; the latter is how
    beginnings tell that clean texts hold once by accident.
    """
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).head()
    if not 0 < toxic < total:
        return {}
    base = toxic / total
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    n, p = F.col("n"), F.col("p")
    g2 = 2 * (part(p, n * base) + part(n - p, n * (1 - base)))
    weight = F.log(((p + 0.5) / (toxic + 1)) / ((n - p + 0.5) / (total - toxic + 1)))
    z2 = 1.64**2  # Wilson's lower bound of the share of toxic rows among those with the stem
    sure = (p / n + z2 / (2 * n) - 1.64 * F.sqrt(p / n * (1 - p / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    best = _count_stems(rows).select("stem", g2.alias("g2"), weight.alias("w"), "p", sure.alias("sure")).filter((p >= MIN_DOCS) & (F.col("sure") >= MIN_PRECISION) & (F.col("g2") >= MIN_G2))
    # of stems in the same rows the longest stands for all: it says least about other words
    found = best.orderBy(F.desc(F.round("g2", 6)), F.desc(F.length("stem")), "stem").limit(LEXICON).collect()
    place_of = {r["stem"]: i for i, r in enumerate(found)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [[place_of[s] for s in stems_of(t or "") & place_of.keys()] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column(1)], names=["hits", "y"])

    seen = rows.mapInArrow(held, "hits array<int>, y int").toArrow()  # ``sample`` rows
    rows_of = np.repeat(np.arange(seen.num_rows), np.diff(seen["hits"].combine_chunks().offsets.to_numpy()))
    has = np.zeros((seen.num_rows, len(found)), bool)
    has[rows_of, seen["hits"].combine_chunks().flatten().to_numpy()] = True
    stems: dict[str, float] = {}
    for i in cover(has, seen["y"].to_numpy() == 1, np.array([r["sure"] >= CERTAIN for r in found], bool)):
        stem, w = found[i]["stem"], found[i]["w"]
        name, w = (stem.removeprefix(TWICE), w / 2) if stem.startswith(TWICE) else (stem, w)
        stems[name] = max(w, stems.get(name, 0.0))
    return stems


def _g2(k: np.ndarray, e: np.ndarray) -> np.ndarray:
    return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0.0)


def cover(has: np.ndarray, toxic: np.ndarray, certain: np.ndarray) -> list[int]:
    """Certain stems that say something new, then stems that explain rows which no stronger stem explains.

    The columns come by falling strength.  A certain stem whose rows are all but the
    same as a chosen one's adds nothing; words that only come along in long toxic
    texts explain no row of their own and stay out.
    """
    chosen: list[int] = []
    sizes = has.sum(0)
    sure = np.flatnonzero(certain)
    held = has[has.any(1)][:, sure].astype(np.float32)
    together = held.T @ held
    kept: list[int] = []
    for i, column in enumerate(sure):
        if not (together[i, kept] > SAME * np.maximum(sizes[sure[kept]], sizes[column])).any():
            kept.append(i)
    chosen += sure[kept].tolist()
    open_ = ~has[:, chosen].any(1)
    while len(chosen) < has.shape[1]:
        n, p = has[open_].sum(0).astype(float), has[open_ & toxic].sum(0).astype(float)
        base = toxic[open_].mean() if open_.any() else 0.0
        if not 0 < base < 1:
            break
        g2 = 2 * (_g2(p, n * base) + _g2(n - p, n * (1 - base)))
        g2[(p < MIN_DOCS) | (p < MIN_PRECISION * n)] = 0
        best = int(np.argmax(g2))
        if g2[best] < MIN_G2:
            break
        chosen.append(best)
        open_ &= ~has[:, best]
    return chosen


PRIOR = np.array([1.0, 1.2, 0.4, 0.6, -4.0])


def features(evidence: np.ndarray) -> np.ndarray:
    return np.column_stack([evidence, np.ones(len(evidence))])


def fit_headings(evidence: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of the headings and the constant, drawn to the prior; those of the headings stay positive."""
    x = features(evidence)
    pull = np.array([2.0, 2.0, 2.0, 2.0, 0.05]) / max(len(y), 1)

    def gradient(w: np.ndarray, _: int) -> np.ndarray:
        return x.T @ (sigmoid(x @ w) - y) / max(len(y), 1) + pull * (w - PRIOR)

    w = adam(gradient, PRIOR, 800, 0.05)
    return np.append(np.maximum(w[:-1], 0.05), w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    rows = training_rows(docs, labels, "toxic", PARTS, REST, sample)
    stems = learn_stems(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for batch in batches:
            seen = np.array([grammar.evidence(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(HEADINGS))
            yield pa.RecordBatch.from_arrays([*map(pa.array, seen.T.copy()), batch.column(1)], names=[*HEADINGS, "y"])

    seen = rows.mapInArrow(measure, ", ".join(f"{h} double" for h in HEADINGS) + ", y int").toArrow()  # ``sample`` rows of five numbers
    return stems, fit_headings(np.column_stack([seen[h].to_numpy() for h in HEADINGS]), seen["y"].to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs`` and ``held_out``, ``score``, ``predicted``, ``evidence`` (one number a heading)."""
    stems, weights = fit(docs, labels, sample=sample)
    text = place(docs, "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for batch in batches:
            seen = np.array([grammar.evidence(t) for t in batch.column(text).to_pylist()]).reshape(-1, len(HEADINGS))
            own = [pa.array(sigmoid(features(seen) @ weights)), pa.array(list(seen), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "_score", "_evidence"])

    fields = [*hidden_fields(docs), T.StructField("_score", T.DoubleType()), T.StructField("_evidence", T.ArrayType(T.DoubleType()))]
    done = hide(docs).mapInArrow(score, T.StructType(fields))
    add = {
        "held_out": held_out(F.col(place(docs, "doc_id")), PARTS, REST),
        "score": F.col("_score"),
        "predicted": (F.col("_score") >= CUT).cast("int"),
        "evidence": F.col("_evidence"),
    }
    return restored(done, docs, add=add)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, from the columns that a score may depend on."""
    return toxicity(take(docs, "doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
