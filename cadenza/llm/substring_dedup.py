"""Removal of word passages that occur more than once, by level-wise doubling.

A window is a run of consecutive words of one document.  Windows repeated at one
length alone are extended to twice that length (the last step stops at the target
length), and only windows repeated at the target length remove words.

The first level looks at one window in about fourteen: inside every run of target
length the window with the least hash stands for it.  Equal runs have equal
least windows, so a run whose least window occurs once cannot repeat, and nothing
is lost.  Each further level looks at every window of its length inside the runs left,
and drops the runs that hold a window without a twin.

How it is distributed
---------------------
Documents are dealt to chunks by a hash of the row.  A chunk sends each distinct
hash once, packed by hash range with a flag for "twice in this chunk", so a
passage shared by a third of all documents costs one entry a chunk and no task
gets more of it.  The tasks that own a range of hashes send back bitmaps, never
positions or texts.  The exchange that deals the texts is the same in each level
and Spark reuses it.

Defined results
---------------
Null and empty texts have no words and keep the empty text.  Texts shorter than a
window keep everything; very long ones take part whole.  An empty table gives an empty one.  Rows that are equal in every column are documents of
their own, so all their windows repeat.  Null document ids are kept as they are.
Columns beyond ``doc_id`` and ``text`` don't take part and may have any name.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.frames import hidden_fields, hide, place, restored, take
from cadenza.llm.storage import parallelism
from cadenza.llm.words import Words, sliding_max, sliding_min, window_hashes, words_of

TARGET = 35
START = 9
CHUNK_BYTES = 6_000_000
RANGE_BYTES = 8_000_000
#: Bytes of packed hashes that a byte of text makes at most, at the first level and at later ones.
_SHARE = 0.4
_LEAST_RANGES = 16
_NONE = np.uint64((1 << 64) - 1)


def lengths(start: int, target: int) -> list[int]:
    """The lengths of the levels: each twice the one before, the last the target."""
    if not 1 <= start <= target:
        raise ValueError("start must lie between 1 and the target length")
    out = [start]
    while out[-1] < target:
        out.append(min(2 * out[-1], target))
    return out


def _inside(w: Words, length: int) -> np.ndarray:
    """Whether the window of that length at each word ends in the word's document."""
    n = max(0, len(w.hash) - length + 1)
    return (np.arange(n) + length) <= w.stop()[:n]


def _least(w: Words, start: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of target length by first word, their least window's hash, the windows that are least in some run, and all windows' hashes."""
    runs = np.flatnonzero(_inside(w, target))
    base = np.maximum(window_hashes(w.hash, start), 1)  # 0 stands for no run below
    width = target - start + 1
    least = sliding_min(base, width)[runs]
    # a window is least in some run if the greatest minimum of the runs that hold it is its own hash
    held = np.zeros(len(base) + width - 1, np.uint64)
    held[runs + (width - 1)] = least
    return runs, least, np.flatnonzero(sliding_max(held, width) == base), base


def _level(w: Words, steps: list[int], level: int, flags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows to look at, given the repeated ones of each level before.

    ``flags[i]`` says of level i's sorted distinct hashes which are repeated.
    """
    target = steps[-1]
    runs, least, spots, base = _least(w, steps[0], target)
    if level == 0 or not len(runs):
        # neighbouring runs with the same least window stand for one occurrence of it
        return spots, base[spots]
    hashes = base[spots]
    spots = spots[flags[0][np.searchsorted(np.unique(hashes), hashes)]]
    # a run is alive if its least window is repeated: no hash in it lies below that of its least repeated window
    twin = np.full(len(base), _NONE)
    twin[spots] = base[spots]
    runs = runs[sliding_min(twin, target - steps[0] + 1)[runs] == least]
    for i in range(1, level):
        # each window of this length inside the run has to be repeated
        h = window_hashes(w.hash, steps[i])
        seen = _inside_runs(len(h), runs, steps[i], target)
        known = np.unique(h[seen])
        ok = np.zeros(len(h), bool)
        ok[seen] = flags[i][np.searchsorted(known, h[seen])]
        runs = runs[_all_ok(ok, runs, target - steps[i] + 1)]
    h = window_hashes(w.hash, steps[level])
    seen = runs if steps[level] == target else _inside_runs(len(h), runs, steps[level], target)
    return seen, h[seen]


def _inside_runs(windows: int, runs: np.ndarray, length: int, target: int) -> np.ndarray:
    """The windows of a length that lie in a run, marked in one pass however the runs overlap."""
    edge = np.zeros(windows + 1, np.int32)
    np.add.at(edge, runs, 1)
    np.add.at(edge, runs + (target - length + 1), -1)
    return np.flatnonzero(np.cumsum(edge)[:-1] > 0)


def _all_ok(ok: np.ndarray, runs: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(ok)])
    return total[runs + width] - total[runs] == width


def _ordered(table: pa.Table, text: str) -> pa.Table:
    """A chunk's rows in an order that doesn't depend on how they arrived."""
    keys = table["_key"].to_numpy()
    order = np.argsort(keys, kind="stable")
    if len(keys) and (np.diff(keys[order]) == 0).any():
        order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], table[text][i].as_py() or "")), np.int64)
    return table.take(pa.array(order))


def _unpack(marks: pa.Table, levels: int) -> list[np.ndarray]:
    out = []
    rows = sorted(zip(*(marks[c].to_pylist() for c in ("_level", "_range", "_n", "_bits")), strict=True))
    for level in range(levels):
        parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for at, _, n, b in rows if at == level]
        out.append(np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool))
    return out


_SENT = "_range long, _chunk long, _hashes binary, _twice binary"
_MARKS = "_chunk long, _range long, _level int, _n long, _bits binary"


def _packed(chunk: int, hashes: np.ndarray, ranges: int) -> pa.Table:
    """A row for each hash range: the sorted distinct hashes, and which came twice."""
    values, counts = np.unique(hashes, return_counts=True)
    width = np.uint64((1 << 64) // ranges + 1)
    owner = (values // width).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    parts = [(v, c) for v, c in zip(np.split(values, cuts), np.split(counts > 1, cuts), strict=True) if len(v)]
    return pa.table(
        {
            "_range": pa.array(owner[np.concatenate([[0], cuts])] if len(owner) else owner, pa.int64()),
            "_chunk": pa.array([chunk] * len(parts), pa.int64()),
            "_hashes": pa.array([v.tobytes() for v, _ in parts], pa.binary()),
            "_twice": pa.array([np.packbits(c).tobytes() for _, c in parts], pa.binary()),
        }
    )


def _marker(level: int):
    def marks(table: pa.Table) -> pa.Table:
        """Which hashes of one range occur twice or more, for each chunk that sent some."""
        sent = [np.frombuffer(b, np.uint64) for b in table["_hashes"].to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(h)) for b, h in zip(table["_twice"].to_pylist(), sent, strict=True)])
        sizes = [len(h) for h in sent]
        values, place, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        repeated = counts > 1
        repeated[place[twice == 1]] = True
        bits = np.split(repeated[place], np.cumsum(sizes)[:-1])
        return pa.table(
            {
                "_chunk": table["_chunk"],
                "_range": table["_range"],
                "_level": pa.array([level] * len(sent), pa.int32()),
                "_n": pa.array(sizes, pa.int64()),
                "_bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()),
            }
        )

    return marks


def repeated_spans(w: Words, runs: np.ndarray, target: int) -> np.ndarray:
    """A flag for each word: whether one of the repeated windows covers it."""
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, runs, 1)
    np.add.at(edge, runs + target, -1)
    return np.cumsum(edge)[:-1] > 0


def substring_dedup(docs: DataFrame, *, target: int = TARGET, start: int = START) -> DataFrame:
    """The columns of ``docs`` with ``text`` replaced by the kept words, and ``n_words``, ``n_removed``, ``spans``.

    The kept words are joined by one space; ``spans`` has the removed ranges as
    [first word, end) in words of the input text.
    """
    steps = lengths(start, target)
    parts = parallelism(docs.sparkSession)
    text, doc_id = place(docs, "text"), place(docs, "doc_id")
    own = hide(docs)
    size = own.select(F.sum(F.octet_length(text))).head()[0] or 0
    chunks = max(parts, -(-int(size) // CHUNK_BYTES))
    # ranges follow the data alone: every chunk sends a row to each
    ranges = max(_LEAST_RANGES, -(-int(size * _SHARE) // RANGE_BYTES))
    dealt = own.select(F.xxhash64(doc_id, text).alias("_key"), F.pmod(F.xxhash64(doc_id, text), F.lit(chunks)).alias("_chunk"), "*").repartition(chunks, "_chunk")

    def send_first(key: tuple, table: pa.Table) -> pa.Table:
        w = words_of(_ordered(table, text)[text].to_pylist())
        return _packed(key[0].as_py(), _level(w, steps, 0, [])[1], ranges)

    def send(level: int):
        def f(key: tuple, table: pa.Table, marks: pa.Table) -> pa.Table:
            h = np.zeros(0, np.uint64)
            if len(table):
                w = words_of(_ordered(table, text)[text].to_pylist())
                h = _level(w, steps, level, _unpack(marks, level))[1]
            return _packed(key[0].as_py() or 0, h, ranges)

        return f

    def finish(table: pa.Table, marks: pa.Table) -> pa.Table:
        table = _ordered(table, text)
        w = words_of(table[text].to_pylist())
        flags = _unpack(marks, len(steps))
        runs, h = _level(w, steps, len(steps) - 1, flags)
        runs = runs[flags[-1][np.searchsorted(np.unique(h), h)]] if len(h) else runs
        gone = repeated_spans(w, runs, target)
        kept, spans, removed = [], [], []
        for t, a, b in zip(table[text].to_pylist(), w.first[:-1], w.first[1:], strict=True):
            flag = gone[a:b]
            words = (t or "").encode("utf-8", "surrogatepass").split()
            edges = np.flatnonzero(np.diff(flag.astype(np.int8), prepend=0, append=0))
            kept.append(b" ".join(compress(words, ~flag) if len(edges) else words).decode("utf-8", "surrogatepass"))
            spans.append(edges.reshape(-1, 2).tolist())
            removed.append(int(flag.sum()))
        own = {c: table[c] for c in table.column_names if c.startswith("_c") and c != "_chunk"}
        own[text] = pa.array(kept, pa.string())
        return pa.table(own | {"_n_words": pa.array(w.counts, pa.int64()), "_n_removed": pa.array(removed, pa.int64()), "_spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))})

    marks = dealt.groupBy("_chunk").applyInArrow(send_first, _SENT).groupBy("_range").applyInArrow(_marker(0), _MARKS)
    for level in range(1, len(steps)):
        sent = dealt.groupBy("_chunk").cogroup(marks.groupBy("_chunk")).applyInArrow(send(level), _SENT)
        marks = marks.unionByName(sent.groupBy("_range").applyInArrow(_marker(level), _MARKS))
    schema = T.StructType([*hidden_fields(docs), T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_spans", T.ArrayType(T.ArrayType(T.LongType())))])
    done = dealt.groupBy("_chunk").cogroup(marks.groupBy("_chunk")).applyInArrow(finish, schema)
    return restored(done, docs, add={k: F.col(f"_{k}") for k in ("n_words", "n_removed", "spans")})


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of a result of :func:`substring_dedup`."""
    return take(result, "doc_id", "n_words", "n_removed", "text").select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
