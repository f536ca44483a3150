"""Arrow batches in slices of bounded bytes, and white-space words without a loop over them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .chars import SPACES

#: Bytes of a batch that a function gets at once.
SLICE_BYTES = 1 << 20


def release() -> None:
    """Give memory that Arrow and the C library keep for later back to the machine, as idle workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _bytes(x: pa.Array) -> np.ndarray:
    """About the bytes of each row's value."""
    if pa.types.is_list(x.type) or pa.types.is_large_list(x.type):
        n = pc.multiply(pc.list_value_length(x), 16 if pa.types.is_string(x.type.value_type) else 8)
    else:
        n = pc.binary_length(x)
    return np.asarray(pc.fill_null(n, 0)).astype(np.int64)


def slices(cols: tuple[pa.Array, ...], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about `most` (SLICE_BYTES) bytes; a longer row stands alone."""
    total = np.cumsum(sum(_bytes(x) for x in cols))
    i = 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (most or SLICE_BYTES), "right")))
        yield i, j
        i = j


def bounded(run: Callable[..., pa.Array], returns: str, columns: int = 1):
    """An Arrow UDF of run, which gets a slice of a batch at a time: what a worker holds does not grow with the rows of a batch."""

    def parts(batches: Iterator) -> Iterator[pa.Array]:
        try:
            for b in batches:
                cols = b if isinstance(b, tuple) else (b,)
                for i, j in slices(cols):
                    yield run(*(c.slice(i, j - i) for c in cols))
        finally:
            release()

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return parts(batches)

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return parts(batches)

    return F.arrow_udf(one if columns == 1 else many, returns)


_BLANK = np.zeros(256, bool)
_BLANK[[c for c in SPACES if c < 128]] = True
_TWO, _THREE = ([c for c in sorted(SPACES) if a <= c < b] for a, b in ((0x80, 0x800), (0x800, 0x10000)))


def inked(buf: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text are of characters other than Unicode White_Space."""
    ink = ~_BLANK[buf]
    for wide, lead in ((_TWO, buf[:-1] == 0xC2), (_THREE, (buf[:-2] >= 0xE1) & (buf[:-2] <= 0xE3))):
        at = np.flatnonzero(lead)
        if len(at):
            code = (buf[at] & 0x0F if wide is _THREE else buf[at] & 0x1F).astype(np.int32)
            for k in range(1, 2 + (wide is _THREE)):
                code = (code << 6) | (buf[at + k] & 0x3F)
            at = at[np.isin(code, wide)]
            for k in range(2 + (wide is _THREE)):
                ink[at + k] = False
    return ink


class Words:
    """White-space words of some texts (null: none): word k is `distinct[which[k]]`, at bytes starts[k] of its text; text r has words first[r] to first[r+1]."""

    def __init__(self, x: pa.Array):
        x = pc.fill_null(x.cast(pa.string()), "") if x.null_count else x.cast(pa.string())
        off = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, x.offset * 4).astype(np.int64)
        buf = np.frombuffer(x.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off -= off[0]
        ink = inked(buf)
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        before = np.concatenate([[False], ink[:-1]]) if len(ink) else ink
        after = np.concatenate([ink[1:], [False]]) if len(ink) else ink
        begin, end = np.flatnonzero(ink & (~before | edge[:-1])), np.flatnonzero(ink & (~after | edge[1:])) + 1
        self.first = np.searchsorted(begin, off)
        self.size = end - begin
        self.starts = begin - np.repeat(off[:-1], np.diff(self.first))
        packed = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(begin), pa.py_buffer(packed), pa.py_buffer(np.ascontiguousarray(buf[ink]))).dictionary_encode()
        self.which, self.distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def gathered(n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values of n[i] items each, laid end to end: the places of the items of which[0], which[1], ..., and where each of these begins (and the end)."""
    first = np.concatenate([[0], np.cumsum(n)])
    size = n[which]
    edge = np.concatenate([[0], np.cumsum(size)])
    return np.arange(edge[-1]) + np.repeat(first[:-1][which] - edge[:-1], size), edge
