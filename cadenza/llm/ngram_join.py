"""Similarity join on the Jaccard coefficient of word n-grams, by a MinHash LSH forest.

Each distinct set of n-grams has a full-length signature in every tree: ``DEEPEST``
minima.  A tree's signatures form a prefix trie.  Its subtrees below the shortest useful
prefix are the units of work: in each, the signatures are sorted, and the matched
prefix is shortened level by level, from the whole signature until the recall is reached that the
trees have together for a pair at the threshold, or until every document of
the unit has met all others.  A pair counts in the first tree where it meets.

Pairs that meet are verified inside their unit, in two steps.  The signatures of all
trees estimate the coefficient: a pair whose estimate lies ``DEVIATIONS`` standard
deviations below the threshold is no link.  Documents with a pair left
bring their texts, and the sets of n-grams decide exactly.

How it is distributed
---------------------
Documents with the same set of n-grams are one node, found by partial aggregation
on a 128-bit fingerprint of the set, so copies are never compared or multiplied.
A subtree with many nodes is cut into blocks of about ``BLOCK`` nodes or
``BLOCK_GRAMS`` n-grams, and each pair of blocks is a unit of its own.  Units are dealt to bins of
bounded size.  A bin returns counts of links and a spanning forest, never the
pairs.  Components are searched over verified links alone, so documents
that only share a prefix never join.  The count of links among g different, similar texts
takes g * g / 2 comparisons, spread over (g / BLOCK) ** 2 / 2 units.

Defined results
---------------
Every row gets ``class_id``, the least doc_id of its connected class (null only if
all are), and ``n_links``, the number of other rows at or above the threshold.
Texts shorter than n words count as one n-gram of all their words.  Texts without
a word and null texts are alone in their class, named by their own id.  Very long texts
take part whole.  Rows equal in every column are linked.  An empty table gives an empty one.
Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.bpe import blocks
from cadenza.llm.components import components
from cadenza.llm.frames import hide, place, restored, take
from cadenza.llm.storage import cut
from cadenza.llm.words import mix, window_hashes, words_of

NGRAM, THRESHOLD = 5, 0.8
TREES, DEEPEST, RECALL = 20, 6, 0.9999
BLOCK, BLOCK_GRAMS = 256, 400_000
DEVIATIONS = 6.0
_TEXT_BYTES = 3_000_000
_COLUMNS = 4096
_SLICE = 500
_BIN_ROWS, _BIN_GRAMS = 2048, 400_000


def forest_depth(threshold: float, trees: int, recall: float, deepest: int) -> int:
    """The longest prefix at which documents at the threshold meet with the target recall."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("no prefix reaches the recall; plant more trees")


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    w = words_of(texts)
    grams = window_hashes(w.hash, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(window_hashes(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], trees: int, deepest: int) -> np.ndarray:
    """The minima of each non-empty set: set, tree, level."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    seeds = mix(np.arange(1, 2 * trees * deepest + 1, dtype=np.uint64)).reshape(-1, 2)
    out = np.empty((len(sets), trees * deepest), np.uint64)
    for i, (salt, odd) in enumerate(seeds):
        out[:, i] = np.minimum.reduceat((flat ^ salt) * (odd | np.uint64(1)), at)
    return out.reshape(len(sets), trees, deepest)


def prefixes(minima: np.ndarray, depth: int) -> np.ndarray:
    """The key of each set's subtree in each tree: its prefix of that depth."""
    keys = np.broadcast_to(np.arange(1, minima.shape[1] + 1, dtype=np.uint64), minima.shape[:2])
    for level in range(depth):
        keys = mix(keys ^ minima[:, :, level])
    return keys


def _described(docs: DataFrame, n: int, trees: int, depth: int, deepest: int) -> DataFrame:
    """Row key, id, size and fingerprint of the set, subtree keys and signature (a byte a minimum) of each document."""
    kind = docs.schema["doc_id"].dataType

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                piece = batch.slice(at, _SLICE)
                texts = piece.column(3).to_pylist()
                for a, b in blocks(texts, _TEXT_BYTES):
                    sets = ngram_sets(texts[a:b], n)
                    sizes = np.array([len(s) for s in sets], np.int64)
                    some = np.flatnonzero(sizes)
                    prints, keys = np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), trees), np.uint64)
                    marks = np.zeros((len(sets), trees * deepest), np.uint8)
                    if len(some):
                        full = [sets[i] for i in some]
                        first = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                        flat = np.concatenate(full)
                        prints[some, 0] = np.add.reduceat(mix(flat), first)
                        prints[some, 1] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), first)
                        minima = signatures(full, trees, deepest)
                        keys[some] = prefixes(minima, depth)
                        marks[some] = (mix(minima) >> np.uint64(56)).astype(np.uint8).reshape(len(some), -1)
                    ends = pa.array(np.arange(0, (len(sets) + 1) * trees, trees, dtype=np.int32))
                    listed = pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64)))
                    part = piece.slice(a, b - a)
                    own = [pa.array(sizes), pa.array(prints[:, 0].copy().view(np.int64)), pa.array(prints[:, 1].copy().view(np.int64)), listed, pa.array([m.tobytes() for m in marks], pa.binary())]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *own], names=["k1", "k2", "id", "n", "f1", "f2", "keys", "sig"])

    longs = lambda *names: [T.StructField(x, T.LongType()) for x in names]
    schema = T.StructType([*longs("k1", "k2"), T.StructField("id", kind), *longs("n", "f1", "f2"), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
    return _keyed(docs).select("k1", "k2", "id", "text").mapInArrow(describe, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    return take(docs, "doc_id", "text").select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"), F.col("doc_id").alias("id"), F.col("text").alias("text"))


def _members(first: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(member, column) of the n-grams that occur twice or more, columns numbered from 0."""
    flat = np.concatenate(sets)
    who = np.repeat(first, [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    start = np.append(True, flat[1:] != flat[:-1])
    group = np.cumsum(start) - 1
    twice = np.bincount(group)[group] > 1
    number = np.cumsum(start & twice) - 1
    return who[twice], number[twice], int(number[-1] + 1) if len(number) else 0


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, in slices of columns that bound the matrices."""
    sets = left + right
    who, column, width = _members(np.arange(len(sets)), sets)
    out = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, width, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        part = np.zeros((len(sets), min(_COLUMNS, width - low)), np.float32)
        part[who[a:b], column[a:b] - low] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def _units(table: pa.Table) -> Iterator[tuple[pa.Table, int, np.ndarray, np.ndarray]]:
    """The units of a bin, their members sorted by side and number: rows, tree, and the members of the two sides."""
    table = table.sort_by([(c, "ascending") for c in ("key", "p", "q", "side", "rid")])
    unit = np.stack([table[c].to_numpy() for c in ("key", "p", "q")], 1)
    starts = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]).any(1)))
    side, tree, p, q = (table[c].to_numpy() for c in ("side", "tree", "p", "q"))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(unit)], strict=True):
        here = np.arange(a, b)
        left = here[side[a:b] == 0]
        yield int(tree[a]), left, left if p[a] == q[a] else here[side[a:b] == 1]


def first_met(keys: np.ndarray, tree: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left x right: whether the pair shares a subtree in no earlier tree; a block with itself has each pair once."""
    new = np.ones((len(left), len(right)), bool)
    for t in range(tree):
        new &= keys[left, t, None] != keys[None, right, t]
    return np.triu(new, 1) if left is right else new


def by_level(marks: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int, open_: np.ndarray) -> Iterator[np.ndarray]:
    """left x right, for each length of the matched prefix from the whole signature to ``depth``: the open pairs that meet there first.

    Prefixes stop being shortened when no open pair is left.  All members share the
    prefix of ``depth`` (they are one subtree), so the last level takes the rest.
    """
    shared = [np.ones(open_.shape, bool)]
    for level in range(marks.shape[1]):
        shared.append(shared[-1] & (marks[left, level, None] == marks[None, right, level]))
    open_ = open_.copy()
    for length in range(marks.shape[1], depth - 1, -1):
        met = open_ & shared[length] if length > depth else open_.copy()
        if met.any():
            yield met
            open_ &= ~met
        if not open_.any():
            return


def _sifter(threshold: float, trees: int, depth: int):
    def sift(table: pa.Table) -> pa.Table:
        """Members of each unit that have a pair which the signatures don't rule out."""
        table = table.sort_by([(c, "ascending") for c in ("key", "p", "q", "side", "rid")])
        keys = _lists(table["keys"], trees)
        marks = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        deepest = marks.shape[1] // trees
        least = (threshold - DEVIATIONS * (threshold * (1 - threshold) / marks.shape[1]) ** 0.5) * marks.shape[1]
        stay = np.zeros(table.num_rows, bool)
        for tree, left, right in _units(table):
            own = marks[:, tree * deepest : (tree + 1) * deepest]
            for met in by_level(own, left, right, depth, first_met(keys, tree, left, right)):
                i, j = np.nonzero(met)
                for a in range(0, len(i), 8192):  # bounds the scratch matrix
                    x, y = left[i[a : a + 8192]], right[j[a : a + 8192]]
                    like = (marks[x] == marks[y]).sum(1) >= least
                    stay[x[like]] = stay[y[like]] = True
        return table.filter(pa.array(stay)).select(["key", "tree", "p", "q", "side", "rid"])

    return sift


def _lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections, left x right."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left], np.float64).reshape(len(left), len(right))
    return overlaps([sets[i] for i in left], [sets[j] for j in right])


def _verifier(threshold: float, n: int, trees: int):
    def verify(table: pa.Table) -> pa.Table:
        """Weighted link counts of the members of each unit, and a spanning forest of its links."""
        table = table.sort_by([(c, "ascending") for c in ("key", "p", "q", "side", "rid")])
        rid, copies, keys = table["rid"].to_numpy(), table["copies"].to_numpy(), _lists(table["keys"], trees)
        texts = table["text"].to_pylist()
        sets: list[np.ndarray] = []
        for a, b in blocks(texts, _TEXT_BYTES):
            sets += ngram_sets(texts[a:b], n)
        sizes = np.array([len(s) for s in sets], np.float64)
        counts = np.zeros(len(sets), np.int64)
        ends: list[tuple[int, int]] = []
        for tree, left, right in _units(table):
            new = first_met(keys, tree, left, right)
            if not new.any():
                continue
            both = _shared(sets, left, right)
            linked = new & (both / np.maximum(sizes[left][:, None] + sizes[right][None, :] - both, 1) >= threshold)
            counts[left] += linked @ copies[right]
            counts[right] += linked.T @ copies[left]
            i, j = np.nonzero(linked)
            ends += _forest(left[i], right[j])
        some = np.flatnonzero(counts)
        a = [*rid[some].tolist(), *(int(rid[i]) for i, _ in ends)]
        b = [*rid[some].tolist(), *(int(rid[j]) for _, j in ends)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array([*counts[some].tolist(), *[0] * len(ends)], pa.int64())})

    return verify


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The edges that join trees, in a graph given by its edges' ends."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _binned(units: DataFrame, weight: int) -> DataFrame:
    """Units are dealt to bins: ``weight`` bins in all."""
    return units.withColumn("bin", F.pmod(F.xxhash64("key", "p", "q"), F.lit(weight)))


def classes(docs: DataFrame, *, threshold: float = THRESHOLD, n: int = NGRAM, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> DataFrame:
    """``k1, k2, id, class_id, n_links, keeper, empty`` for every row; k1 and k2 are hashes of the row."""
    depth = forest_depth(threshold, trees, recall, deepest)
    rows = cut(_described(docs, n, trees, depth, deepest))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "n", "keys", "sig")
    nodes = rows.filter("n > 0").groupBy("f1", "f2").agg(F.count("*").alias("copies"), F.min(order).alias("own"))
    nodes = cut(nodes.select("f1", "f2", F.xxhash64("f1", "f2").alias("rid"), "copies", F.struct("own.none", "own.id", "own.k1", "own.k2").alias("first"), "own.n", "own.keys", "own.sig"))
    spots = nodes.select("rid", "n", F.posexplode("keys").alias("tree", "key"))
    subtrees = spots.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("grams")).filter("size > 1")
    # as a table of their own the subtrees have a known size, and the join's other side can be split where one is hot
    subtrees = cut(subtrees.select("key", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).alias("nb")))
    live = spots.join(subtrees, "key").withColumn("block", F.pmod(F.xxhash64("rid", F.lit(7)), "nb"))
    units = live.select("key", "tree", "rid", "n", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("other"))
    units = cut(units.select("key", "tree", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).cast("int").alias("side"), "rid", "n"))
    bins = units.count() // _BIN_ROWS + 1
    fields = "key long, tree int, p long, q long, side int, rid long"
    signed = _binned(units.drop("n").join(nodes.select("rid", "keys", "sig"), "rid"), bins)
    left = cut(signed.groupBy("bin").applyInArrow(_sifter(threshold, trees, depth), fields))
    members = nodes.select("rid", "n", "copies", "keys", "first.k1", "first.k2")
    # one row of equal rows stands for them all: the texts are the same
    needed = left.select("rid").distinct().join(members, "rid")
    texts = needed.join(_keyed(docs).select("k1", "k2", "text"), ["k1", "k2"]).dropDuplicates(["rid"]).select("rid", "copies", "keys", "text")
    weight = left.join(members.select("rid", "n"), "rid").agg(F.count("*"), F.sum("n")).head()
    bins = int(max(weight[0] // _BIN_ROWS, (weight[1] or 0) // _BIN_GRAMS)) + 1
    found = cut(_binned(left.join(texts, "rid"), bins).groupBy("bin").applyInArrow(_verifier(threshold, n, trees), "a long, b long, links long"))
    counts = found.filter("a = b").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("a != b").select("a", "b"))
    named = nodes.select("f1", "f2", "rid", "copies", "first").join(joined, F.col("rid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rid"))
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    facts = named.join(heads, "label").join(counts, "rid", "left").select("f1", "f2", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    met = rows.drop("keys", "sig").join(facts, ["f1", "f2"], "left")
    empty = F.col("n") == 0
    return met.select(
        "k1", "k2", "id",
        F.when(empty, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.when(empty, F.lit(0).cast("long")).otherwise(F.col("links")).alias("n_links"),
        (empty | ((F.col("head.k1") == F.col("k1")) & (F.col("head.k2") == F.col("k2")))).alias("keeper"),
        empty.alias("empty"),
    )


def ngram_join(docs: DataFrame, **options) -> DataFrame:
    """The contract's result: ``doc_id, class_id, n_links``."""
    return classes(docs, **options).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``; of each class the row with the least id stays (one of them, if rows are equal in id and text), and every row without a word."""
    stay = classes(docs, **options).filter("keeper").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("empty").alias("empty"))
    stay = cut(stay)
    text, doc_id = place(docs, "text"), place(docs, "doc_id")
    own = hide(docs).select("*", F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), doc_id, text).alias("k2"))
    once = own.join(stay.filter("n = 1 OR empty"), ["k1", "k2"], "left_semi")
    # copies are combined where they lie, so a row stored very often is no burden
    several = own.join(stay.filter("n > 1 AND NOT empty"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return restored(once.unionByName(several), docs)
