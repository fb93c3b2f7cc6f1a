"""Vectorised words, word hashes and window hashes of a block of texts.

A word is a maximal run of bytes other than ``[\\x20\\x09-\\x0D]``.  Hashes are 64
bit, the same in every process, and computed by array operations over a whole
block; only words over 64 bytes become Python objects.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

_U = np.uint64
_LONG = 64
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor, shift and multiply rounds)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: By number of bytes (0 to 8): the bits of a little-endian number that they take.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U)


def _power(base: np.uint64, n: int) -> np.uint64:
    return _U(pow(int(base), n, 1 << 64))


@dataclass
class Words:
    """The words of a block: byte offsets in ``blob``, hashes, and each document's range of words."""

    blob: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of document d: words first[d] to first[d + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def stop(self) -> np.ndarray:
        """For each word, the end of its document's range."""
        return np.repeat(self.first[1:], self.counts)


def words_of(texts: list[str | None]) -> Words:
    """Split and hash; null counts as the empty text."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    blob = b"\n".join(parts)
    raw = np.frombuffer(blob, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    outside = np.concatenate([[True], space, [True]])
    turns = np.flatnonzero(outside[1:] != outside[:-1])  # words begin and end in turn
    start, end = turns[::2], turns[1::2]
    offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]) if parts else np.zeros(1)
    first = np.searchsorted(start, offsets[: len(parts) + 1]).astype(np.int64)
    if len(parts):
        first[-1] = len(start)
    return Words(blob, start, end, _hashes(blob, start, end), first)


def _hashes(blob: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words are read eight bytes at a time, all words together; the few longer than ``_LONG`` bytes by blake2b."""
    # every byte offset as the start of a little-endian number; eight bytes more keep the last ones inside
    padded = np.frombuffer(blob + bytes(8), np.uint8)
    at = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(blob) + 1,), (1,))
    size = end - start
    out = mix((at[start] & _MASKS[np.minimum(size, 8)]) + size.astype(_U) * _BASE)
    for done in range(8, _LONG, 8):
        more = np.flatnonzero(size > done)
        block = at[start[more] + done] & _MASKS[np.minimum(size[more] - done, 8)]
        out[more] = mix(out[more] * _STEP + block)
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(blake2b(blob[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive hashes, by doubling; ends of documents are the caller's care."""
    now, size = hashes, 1
    if len(hashes) < length:
        return hashes[:0]
    for bit in bin(length)[3:]:
        now = now[:-size] * _power(_STEP, size) + now[size:]
        size *= 2
        if bit == "1":
            now = now[:-1] * _STEP + hashes[size:]
            size += 1
    return mix(now)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values, by doubling."""
    return _sliding(np.minimum, values, width)


def sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    """Maximum over each run of ``width`` values, by doubling."""
    return _sliding(np.maximum, values, width)


def _sliding(better: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    now, size = values, 1
    if len(values) < width:
        return values[:0]
    while size * 2 <= width:
        now = better(now[:-size], now[size:])
        size *= 2
    rest = width - size
    return better(now[: len(now) - rest], now[rest:]) if rest else now
