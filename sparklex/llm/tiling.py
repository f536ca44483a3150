"""Benchmark decontamination by greedy string tiling.

Runs of `seed` equal tokens join benchmark items with documents; each item's longest
non-overlapping matches with a document are marked again and again (longest first, runs
found by their running Karp-Rabin hashes), and the share of the item's tokens that the
tiles cover decides. Tiles may stand in any order, so reordered passages count.

The benchmark goes to the workers in blocks of at most BLOCK_BYTES of text, one pass over
the documents each, so a benchmark of any size is handled and no broadcast outgrows that.

Tokens: maximal runs of letters and digits (ASCII punctuation splits; A-Z lowered).
Defined results: items of fewer than `seed` tokens say too little and match nothing; null
texts have no tokens; null ids are carried along; repeated rows each give their own rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, tidy, windows, words

BLOCK_BYTES = 4 << 20


def tiles(pairs: list[tuple[int, int]], n_item: int, n_doc: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, document position, length) from the positions of equal runs of `least` tokens."""
    found: list[tuple[int, int, int]] = []
    heap = []
    order = sorted((j - i, i) for i, j in set(pairs))
    k = 0
    while k < len(order):
        d, i = order[k]
        m = k + 1
        while m < len(order) and order[m] == (d, i + m - k):
            m += 1
        heap.append((-(m - k + least - 1), i, i + d))
        k = m
    heapq.heapify(heap)
    used_i, used_j = np.zeros(n_item, bool), np.zeros(n_doc, bool)
    while heap:
        size, i, j = heapq.heappop(heap)
        size = -size
        busy = used_i[i : i + size] | used_j[j : j + size]
        if not busy.any():
            used_i[i : i + size] = used_j[j : j + size] = True
            found.append((i, j, size))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], busy, [True]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(heap, (-(b - a), i + a, j + a))
    return found


class Benchmark:
    """Seeds of one block of items, ready to be matched."""

    def __init__(self, ids: list, texts: list, seed: int):
        w = words(pa.array(texts, pa.string()), lower=True, plain=True)
        self.ids, self.n, self.seed = ids, w.counts, seed
        at, g = windows(w.hashes(), w.first, seed)
        row = w.rows()[at] if len(at) else at
        order = np.argsort(g, kind="stable")
        self.g, self.item, self.pos = g[order], row[order], (at - w.first[row])[order]

    def matches(self, col: pa.Array, least: float) -> Iterator[tuple[int, int, int, list]]:
        """(row, item number, covered tokens, tiles) of each item covered to `least` by a text of col."""
        for a, b in slices(col):
            w = words(col[a:b], lower=True, plain=True)
            at, g = windows(w.hashes(), w.first, self.seed)
            lo = np.searchsorted(self.g, g, "left")
            hi = np.searchsorted(self.g, g, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            rows = w.rows()[at[hit]]
            for r in np.unique(rows).tolist():
                by_item: dict[int, list[tuple[int, int]]] = {}
                for h in hit[rows == r].tolist():
                    j = int(at[h] - w.first[r])
                    for s in range(lo[h], hi[h]):
                        by_item.setdefault(int(self.item[s]), []).append((int(self.pos[s]), j))
                for item, pairs in by_item.items():
                    n = int(self.n[item])
                    may = np.zeros(n + 1, np.int64)  # what any shared seed covers: tiles cannot cover more
                    i = np.unique([p for p, _ in pairs])
                    np.add.at(may, i, 1)
                    np.add.at(may, i + self.seed, -1)
                    if (np.cumsum(may[:-1]) > 0).sum() < least * n:
                        continue
                    t = tiles(pairs, n, int(w.counts[r]), self.seed)
                    got = sum(x[2] for x in t)
                    if got >= least * n:
                        yield a + r, item, got, t


def blocks(benchmark: DataFrame, seed: int) -> Iterator[Benchmark]:
    """The benchmark (item_id, text) in blocks of about BLOCK_BYTES, one on the driver at a time."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // BLOCK_BYTES))
    for k in range(n):
        got = (b if n == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).toArrow()
        if got.num_rows:
            yield Benchmark(got["item_id"].to_pylist(), got["text"].to_pylist(), seed)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_covered, coverage, n_tiles, tiles) for each item that a document covers."""
    out = "doc_id long, item_id long, n_tokens long, n_covered long, coverage double, n_tiles long, tiles array<struct<item_pos:long,doc_pos:long,length:long>>"
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("item_pos", pa.int64()), ("doc_pos", pa.int64()), ("length", pa.int64())]))
    made = None
    for block in blocks(benchmark, seed):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bench = held.value
            for b in batches:
                ids = b.column(0).to_pylist()
                got = [(ids[r], bench.ids[i], int(bench.n[i]), n, n / int(bench.n[i]), len(t), [dict(zip(("item_pos", "doc_pos", "length"), x)) for x in t]) for r, i, n, t in bench.matches(b.column(1), coverage)]
                cols = list(zip(*got)) if got else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), kind))], ["doc_id", "item_id", "n_tokens", "n_covered", "coverage", "n_tiles", "tiles"])

        one = src.mapInArrow(tidy(run), out)
        made = one if made is None else made.union(one)
    return docs.sparkSession.createDataFrame([], out) if made is None else made


def clean_of(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.8) -> DataFrame:
    """docs without the rows that cover some item; no shuffle."""
    at = docs.columns.index("text")
    for block in blocks(benchmark, seed):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                ok[[m[0] for m in held.value.matches(b.column(at), coverage)]] = False
                yield b.filter(pa.array(ok))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
