"""Vectorised text primitives over Arrow buffers.

Every function works on the UTF-8 bytes of a whole Arrow string column, so no
Python string is made per token.  Hashes are 64-bit polynomials over the bytes
of a token (or over the hashes of a token window), finished with a mixer; they
depend on content alone and agree on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
#: Bytes of text that are worked on at once: bounds a Python worker's memory.
CHUNK_BYTES = 1 << 20
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Whitespace-separated words, punctuation kept.
RAW_WORD = ~SPACE
#: Letters and digits; every byte of a non-ASCII character counts as a letter.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(b), U)
            p[0] = U(1)
            out.append(np.multiply.accumulate(p))
        have = _powers[which] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Mixed polynomial hash of values[start:end] for each pair (start, end)."""
    up, down = powers(len(values) + 1, which)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(U) * GOLD)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) in pieces of about `limit` bytes and one row at least."""
    raw, offsets = buffers(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """The words of a chunk of rows: byte spans, hashes and row bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = RAW_WORD, dense: bool = False):
        """dense: each sign of U+3000 to U+9FFF - Chinese, Japanese - is a word, as nothing stands between words there."""
        inside = kind[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        if dense and len(sign := np.flatnonzero((data >= 0xE3) & (data <= 0xE9))):
            edge[sign] = True
            edge[sign + 3] = True
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(data):
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
        self.data = data
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: Words of row r are first[r]:first[r + 1].
        self.first = np.searchsorted(self.start, offsets)
        self.rows = len(offsets) - 1
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """The words' hashes, worked out over about CHUNK_BYTES of text at a time (and a word at least)."""
        out = np.empty(len(self.start), U)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + 2 * CHUNK_BYTES, "right")))
            low = self.start[a]
            out[a:b] = span_hash(self.data[low : self.end[b - 1]].astype(U) + U(1), self.start[a:b] - low, self.end[a:b] - low, 0)
            a = b
        return out

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, k: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of k words of one row."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return at, span_hash(self.hash, at, at + k, which)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every k-word shingle; a row of 1 to k - 1 words has one, of all its words."""
        at, h = self.windows(k)
        count = np.diff(self.first)
        short = np.flatnonzero((count > 0) & (count < k))
        if not len(short):
            return self.row[at], h
        more = span_hash(self.hash, self.first[short], self.first[short + 1], 1)
        return np.concatenate([self.row[at], short]), np.concatenate([h, more])
