"""Vectorised word splitting and hashing over the raw UTF-8 bytes of an Arrow text column.

A word is a run of bytes 0-9, a-z (after lower-casing A-Z) or >= 0x80, which for valid UTF-8
is the same as the character class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_MULT = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1 << 20


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULT, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(256)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser of 64-bit hashes (xor-shift-multiply); wraps around silently."""
    h = h ^ U64(seed * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


class Words:
    """Words of a few whole documents: ``lower`` bytes, word ``starts``/``ends`` in them, 64-bit
    ``hashes``, and ``first`` (n_docs + 1): the words of document i are first[i]:first[i + 1]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.lower = _LOWER[raw]
        inside = _WORD[self.lower]
        n = len(raw)
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < n]
        start[edge] = inside[edge]
        edge = offsets[1:][offsets[1:] > 0] - 1
        end[edge] = inside[edge]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)
        lens = self.ends - self.starts
        if len(lens):
            at = np.cumsum(lens) - lens
            pow_ = _POW if lens.max() <= len(_POW) else _powers(int(lens.max()))
            k = np.arange(int(lens.sum())) - np.repeat(at, lens)
            parts = (self.lower[inside].astype(U64) + U64(1)) * pow_[k]
            self.hashes = mix(np.add.reduceat(parts, at) + lens.astype(U64))
        else:
            self.hashes = np.zeros(0, dtype=U64)

    def grams(self, size: int) -> np.ndarray:
        """A hash of each ``size`` consecutive words, by first word, across document borders too."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=U64)
        out = np.zeros(n, dtype=U64)
        for j in range(size):
            out = out * U64(_MULT) + self.hashes[j : j + n]
        return mix(out, size)

    def join(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by single spaces."""
        low = self.lower
        return b" ".join(low[s:e].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j], strict=True))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, their Words) over whole rows, in pieces of about ``most`` bytes."""
    raw, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
