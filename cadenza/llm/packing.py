"""Packing documents into token windows by minimum bin slack.

A document's ids are cut into full windows and one remainder.  The remainders are
packed by a bitset subset-sum: the longest one left opens a window, and the
multiset of other lengths left whose sum comes closest to the capacity fills it;
counts are found by backtracking.  The same multiset is used for as many windows
as the counts allow.

How it is distributed
---------------------
Only the number of remainders of each length reaches the driver (``capacity``
numbers at most), so the plan costs the same for any corpus and its size depends
on the capacity alone.  A piece learns its rank among the pieces of its length
from its bucket's offset and its rank inside the bucket; a length that holds a
third of all pieces is cut over all buckets.  Token counts are written once to
the shared folder, so a lost executor can't change a cut.

Defined results
---------------
Null and empty texts have the end token alone.  Texts of any length are encoded
whole.  Rows that are equal in every column are packed each for itself.  An empty
table gives an empty one.  Other columns don't take part and may have any name.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.frames import take
from cadenza.llm.storage import cut, parallelism

CAPACITY, END = 2048, 1
_ROW = 200  # texts taken from Arrow at a time


@functools.lru_cache(maxsize=2)
def byte_encoding(path: str) -> tiktoken.Encoding:
    """The encoder of a byte-level BPE file whose merges rank as their ids do."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    made = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("merges and ids are ordered differently")
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte", pat_str=words, mergeable_ranks=ranks, special_tokens=special)


def document_ids(encoding: tiktoken.Encoding, text: str | None) -> np.ndarray:
    return np.append(encoding.encode_to_numpy(text or "", allowed_special="all").astype("<u4"), np.uint32(END)).astype("<u4")


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """Pieces of every document: start, length, checksum of the ids and the document's token count."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_encoding(tokenizer)
        for batch in batches:
            for a in range(0, batch.num_rows, _ROW):
                part = batch.slice(a, _ROW)
                take, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = document_ids(encoding, text)
                    for start in range(0, len(ids), capacity):
                        own = ids[start : start + capacity]
                        take.append(i)
                        rows.append((start, len(own), zlib.crc32(own.tobytes()), len(ids)))
                columns = np.array(rows, np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, pa.int32())), *map(pa.array, columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens"))])
    return take(docs, "doc_id", "text").mapInArrow(pieces, schema)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of one window: the longest length, and what brings the sum closest to the capacity."""
    first = max(counts)
    room = capacity - first
    left = {n: c - (n == first) for n, c in counts.items() if n <= room}
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for n in sorted(left, reverse=True):
        many, unit = min(left[n], room // n), 1
        while many > 0:  # counts as powers of two and a rest
            take = min(unit, many)
            grown = (reached | (reached << (n * take))) & mask
            if grown != reached:
                steps.append((n, take, reached))
                reached = grown
            many -= take
            unit *= 2
        if reached >> room & 1:
            break
    at = reached.bit_length() - 1
    chosen = {first: 1}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            at -= n * take
            chosen[n] = chosen.get(n, 0) + take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, pieces a window, first sequence, first offset)."""
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        chosen = fill(left, capacity)
        times = min(left[n] // k for n, k in chosen.items())
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            rows.append((n, used[n], used[n] + k * times, k, sequence, offset))
            used[n] += k * times
            left[n] -= k * times
            offset += n * k
            if not left[n]:
                del left[n]
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, tokenizer, capacity))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    steps = spark.createDataFrame(plan(counts, capacity), "_length long, _low long, _high long, _each long, _first long, _at long")
    buckets = parallelism(spark)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("_in", F.row_number().over(order) - 1)
    sizes = dealt.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = ranked.join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    met = ranked.join(F.broadcast(steps), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    j = F.col("_rank") - F.col("_low")
    whole = F.floor(j / F.col("_each"))
    return met.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + whole).alias("sequence_id"), (F.col("_at") + (j % F.col("_each")) * F.col("length")).alias("offset")
    )


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, *, capacity: int = CAPACITY) -> DataFrame:
    """The packed windows themselves: ``sequence_id`` and ``ids`` (without padding), for ids that name one document each."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_encoding(tokenizer)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = document_ids(encoding, text)
                cuts = range(0, len(own), capacity)
                parts = pa.array([own[a : a + capacity].tolist() for a in cuts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(cuts), pa.int32())), pa.array(list(cuts), pa.int64()), parts], names=["doc_id", "start", "ids"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])
    cutted = take(docs, "doc_id", "text").mapInArrow(ids, schema)
    met = cutted.join(placed, ["doc_id", "start"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return met.select("sequence_id", F.flatten("_parts.ids").alias("ids"))
