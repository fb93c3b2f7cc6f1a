"""BPE encoding and decoding with a pair occurrence index.

For a block of texts, each word not seen before is written as a run of symbols in
one array.  An index maps every adjacent pair that has a rank to all its places in
the block.  The active ranks are taken in ascending order; all places of the pair
are merged at once and the pairs that appear beside them join the lists of their
ranks.  In these vocabularies a merge only makes pairs of higher rank (checked
when the file is read), so one ascending pass gives each word the result of
merging its least pair first.

Words and their ids are remembered across blocks by each worker, up to a bounded
number; a forgotten word is encoded anew.  Blocks are bounded in bytes.

Defined results
---------------
Null and empty texts have no ids and decode to the empty text.  Texts of any
length are encoded whole.  Repeated rows are encoded alike.  Special tokens in a
text are recognised as the file says.  Letters and digits that entered Unicode
after version 15 follow Python's tables, which may differ from the library's.  An empty
table gives an empty one.  Other columns stay as they are; columns of the names added give way to the new ones.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.frames import hidden_fields, hide, place, restored, take

BLOCK_BYTES = 6_000_000
REMEMBERED = 300_000
_SHIFT = 20


class WordBPE:
    """A BPE whose words end in a marker, with lower-casing and without white space."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(visible)]
        char = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[char[b] + end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << _SHIFT | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.left, self.right = keys >> _SHIFT, keys & ((1 << _SHIFT) - 1)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(max(self.tokens) + 1, -1)
        born[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or (np.maximum(born[self.left], born[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge makes a pair of lower rank")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._word = regex.compile(split)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._space = regex.compile(r"\s+")
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Normalised words; special tokens stay as they are, in a list item of their own."""
        if self._cut and "<|" in text:
            out = []
            for part in self._cut.split(text):
                out += [part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        text = self._space.sub(" ", unicodedata.normalize("NFC", text)) if not text.isascii() else text
        # letter by letter where the last sigma of a word would get a form of its own
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return self._word.findall(text)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 for those that don't merge."""
        key = a << _SHIFT | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def learn(self, words: list[str]) -> None:
        """Encode words and remember their ids (little-endian unsigned 32-bit)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        ids, counts = self._merge(np.frombuffer(b"".join(raw), np.uint8), sizes)
        packed, at = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts)]) * 4
        self.known.update((w, packed[a:b]) for w, a, b in zip(words, at[:-1].tolist(), at[1:].tolist(), strict=True))

    def _merge(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        ends = np.cumsum(sizes) - 1
        sym = self.inner[raw]
        sym[ends] = self.last[raw[ends]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends] = n  # no neighbour: one place past the end, whose symbol merges with nothing
        before[ends - sizes + 1] = n
        sym, after, before = np.append(sym, (1 << _SHIFT) - 1), np.append(after, n), np.append(before, n)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(spots: np.ndarray) -> None:
            ranks = self.rank(sym[spots], sym[after[spots]])
            spots, ranks = spots[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            spots, ranks = spots[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else (), np.split(spots, cuts), strict=False):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(active, rank)

        enter(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            a, b = self.left[rank], self.right[rank]
            lists = index.pop(rank)
            spots = lists[0] if len(lists) == 1 else np.concatenate(lists)
            # places whose symbols have been merged meanwhile are out of date
            spots = spots[(sym[spots] == a) & (sym[after[spots]] == b)]
            if not len(spots):
                continue
            if a == b:  # in a run of equal symbols every second place, from the left
                spots = np.unique(spots)
                start = np.append(True, spots[1:] != after[spots[:-1]])
                nth = np.arange(len(spots)) - np.maximum.accumulate(np.where(start, np.arange(len(spots)), 0))
                spots = spots[nth % 2 == 0]
            gone = after[spots]
            sym[spots] = self.made[rank]
            sym[gone] = -1
            after[spots] = after[gone]
            follow = after[spots]
            before[follow[follow < n]] = spots[follow < n]
            lead = before[spots]
            enter(np.unique(np.concatenate([spots[follow < n], lead[lead < n]])))
        alive = sym[:n] >= 0
        counts = np.add.reduceat(alive, ends - sizes + 1) if n else np.zeros(0, np.int64)
        return sym[:n][alive], counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.words(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = {w for ws in split for w in ws}.difference(self.known)
        for w in new & self.special.keys():
            self.known[w] = np.uint32(self.special[w]).astype("<u4").tobytes()
        new -= self.special.keys()
        if new:
            self.learn(list(new))
        return [b"".join(map(self.known.__getitem__, ws)) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space: the file has no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def blocks(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _apply(docs: DataFrame, tokenizer: str, work, fields: list[T.StructField]) -> DataFrame:
    text = place(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in blocks(texts, BLOCK_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *work(bpe, texts[a:b])], names=[*part.schema.names, *(f.name for f in fields)])

    return hide(docs).mapInArrow(run, T.StructType([*hidden_fields(docs), *fields]))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The columns of ``docs`` and ``ids``."""

    def work(bpe: WordBPE, texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in bpe.encode(texts)], pa.list_(pa.int32()))]

    return restored(_apply(docs, tokenizer, work, [T.StructField("_ids", T.ArrayType(T.IntegerType()))]), docs, add={"ids": F.col("_ids")})


def decode(df: DataFrame, tokenizer: str, column: str = "ids") -> DataFrame:
    """The columns of ``df`` and ``decoded``, the text of an array of ids (null: empty)."""
    at = place(df, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            texts = [bpe.decode(np.array(i or [], np.int64)) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "_decoded"])

    done = hide(df).mapInArrow(run, T.StructType([*hidden_fields(df), T.StructField("_decoded", T.StringType())]))
    return restored(done, df, add={"decoded": F.col("_decoded")})


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the digests of ids and of the text decoded from them, without shipping either."""

    def work(bpe: WordBPE, texts: list[str | None]) -> list[pa.Array]:
        ids = bpe.encode(texts)
        decoded = [hashlib.sha256(bpe.decode(np.frombuffer(i, "<u4")).encode()).hexdigest() for i in ids]
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array(decoded)]

    fields = [T.StructField("_n", T.LongType()), T.StructField("_ids", T.StringType()), T.StructField("_decoded", T.StringType())]
    rows = take(docs, "doc_id", "text")
    return _apply(rows, tokenizer, work, fields).select(F.col("_c0").alias("doc_id"), F.col("_n").alias("n_tokens"), F.col("_ids").alias("ids_sha256"), F.col("_decoded").alias("decoded_sha256"))
