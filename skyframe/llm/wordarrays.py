"""Words, lines and their hashes of many texts at once, as numpy arrays over one byte buffer.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit polynomial prefix
hashes over a fixed random byte table, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that a worker turns into arrays at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

_BYTE_CODES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next chunk."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class TextChunk:
    """Some texts in one byte buffer: `buf`, `off` (n + 1 text limits)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1
        self._prefix: np.ndarray | None = None

    @classmethod
    def of(cls, texts: list[bytes]) -> TextChunk:
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        return cls(np.frombuffer(b"".join(texts), np.uint8), off)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the maximal runs of bytes with `inside`, within texts."""
        if not len(inside):
            e = np.zeros(0, np.int64)
            return e, e, e
        full = self.off[:-1] < self.off[1:]
        before = np.empty(len(inside), bool)
        before[0], before[1:] = False, inside[:-1]
        before[self.off[:-1][full]] = False
        after = np.empty(len(inside), bool)
        after[-1], after[:-1] = False, inside[1:]
        after[self.off[1:][full] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(self.off, starts, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~SPACE[self.buf])

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(_BYTE_CODES[self.buf] * powers(_BASE, len(self.buf)), out=self._prefix[1:])
        return self._prefix

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each byte range."""
        p = self.prefix()
        return mix((p[ends] - p[starts]) * powers(_INVERSE, len(p))[starts])

    def hashes_of_length(self, n: int) -> np.ndarray:
        """The hashes of the n bytes from each place on."""
        p = self.prefix()
        return mix((p[n:] - p[:-n]) * powers(_INVERSE, len(p) - n))

    def per_text(self, index: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(index, weights, self.n).astype(np.int64)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The byte buffer and limits of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off if len(off) else np.zeros(1, np.int64)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, lower: bool = False) -> Iterator[tuple[int, int, TextChunk]]:
    """(first row, row after the last, TextChunk) over a string column, at most `limit` bytes unless one text has more."""
    buf, off = text_bytes(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        own = buf[off[i] : off[j]]
        yield i, j, TextChunk(LOWER[own] if lower else own, off[i : j + 1] - off[i])
        i = j
