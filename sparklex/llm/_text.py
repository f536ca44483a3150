"""Vectorised words and hashes over Arrow string columns (numpy, no per-row loop).

A word is a maximal run of bytes other than space and U+0009-U+000D. All of those
are ASCII, so splitting UTF-8 bytes equals splitting code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def release() -> None:
    """Give memory that Arrow and the C library keep for later back to the machine, as idle workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with release() when a task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def _mix_scalar(x: int) -> int:
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: is white space; lower case of A-Z with white space as 0x20; a random 64-bit value."""
    ws = np.zeros(256, bool)
    ws[[9, 10, 11, 12, 13, 32]] = True
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    low[ws] = 32
    return ws, low, np.array([_mix_scalar(i + 1) for i in range(256)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (BASE is odd, so it has an inverse)."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Words:
    """Words of some rows: word i is buf[starts[i]:ends[i]]; row r has words first[r] to first[r+1]."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.buf, self.starts, self.ends, self.first = buf, starts, ends, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, block: int = 1 << 18) -> np.ndarray:
        """A 64-bit Karp-Rabin hash of each word, by blocks of bounded size."""
        rand = tables()[2]
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            a = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, a + block, "right")))
            s, e = self.starts[i:j] - a, self.ends[i:j] - a
            up, down = powers(int(e[-1]) + 1)
            p = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(rand[self.buf[a : a + int(e[-1])]] * up[:-1], out=p[1:])
            out[i:j] = mix((p[e] - p[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
        return out

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words with one space after each, and the new starts and ends."""
        keep = np.zeros(len(self.buf) + 1, np.int8)
        np.add.at(keep, self.starts, 1)
        np.add.at(keep, self.ends + 1, -1)
        size = self.ends - self.starts + 1
        ends = np.cumsum(size)
        return self.buf[np.cumsum(keep[:-1]).astype(bool)].tobytes(), ends - size, ends - 1


def slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about `most` bytes of text; a longer text stands alone."""
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    total, start = 0, 0
    for i, n in enumerate(size):
        if total + n > most and i > start:
            yield start, i
            total, start = 0, i
        total += n
    if len(size) > start:
        yield start, len(size)


def words(col: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """Words of each text; null counts as empty. White space becomes 0x20 if lower is set.

    plain: ASCII punctuation and control characters split words too.
    """
    ws, low, _ = tables()
    if plain:
        ws = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
    text = pc.binary_join_element_wise(pc.fill_null(col.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    n = len(text)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), z, z, np.zeros(1, np.int64))
    off = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
    buf = np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    ink = np.zeros(len(buf) + 1, np.int8)
    ink[1:] = ~ws[buf]
    step = np.diff(ink)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return Words(low[buf] if lower else buf, starts, ends, np.searchsorted(starts, off))


def windows(h: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all windows of `length` words that lie within one row."""
    n = len(h)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=p[1:])
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + length <= last)
    return at, mix((p[at + length] - p[at]) * down[at] + np.uint64(length))


def distinct_pairs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, h), sorted, and how often each occurs."""
    order = np.lexsort((h, row))
    r, g = row[order], h[order]
    at = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (g[1:] != g[:-1])])[: len(r)])
    return r[at], g[at], np.diff(np.concatenate([at, [len(r)]]))
