"""Substring dedup by level-wise doubling of repeated word windows.

Levels: runs of 7 words (an anchor in each 13-word window), then windows of 13, 26, 52, ...
words. Only what repeats at one level is looked at in the next: a 13-word window is built
only around a repeated anchor, and a window of twice the length only where both its halves
repeat; the levels end when no candidate survives.

Level 7 takes anchors only: of the 7-word runs inside each 13-word window the one with the
least hash. Equal windows have equal anchors, so a window that repeats has a repeating
anchor; about a quarter of all runs are anchors.

Exact copies come first: a document whose whole text also stands under a smaller doc_id (by
MD5) loses all windows there and then, and puts no anchors or windows into the levels. The
repeated anchors are cut off as a checkpoint, so the shuffles of anchors and of windows are
never on disk together; each side's joins with texts read one exchange of them by doc_id.

Hashes have 64 bits. A wrong hit needs a collision of both the anchor and the window.

Defined results: a null text has no words (digest of the empty string); rows with a null
doc_id neither remove nor lose words; rows sharing a doc_id are one document with several
texts, and don't remove from each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import by_key
from ._store import cut
from ._text import distinct_pairs, slices, tidy, windows, words


def anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window positions, their anchors' positions, their anchors' hashes) of all windows of `window` words."""
    k = (window + 1) // 2
    at, g = windows(h, first, k)
    full = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    full[at] = g
    last = np.repeat(first[1:], np.diff(first))
    pos = np.flatnonzero(np.arange(len(h)) + window <= last)
    if not len(pos):
        return pos, pos, np.zeros(0, np.uint64)
    best, where = full[pos], pos.copy()
    for d in range(1, window - k + 1):
        x = full[pos + d]
        less = x < best
        best = np.where(less, x, best)
        where = np.where(less, pos + d, where)
    return pos, where, best


def covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in a window of `length` words that starts at one of `at`."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _pairs(doc: list, row: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """Distinct (hash, doc_id) of a slice."""
    row, g, _ = distinct_pairs(row, h.view(np.int64))
    ids = np.array([0 if x is None else x for x in doc], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(ids[row])], ["h", "d"])


def _copies(src: DataFrame) -> DataFrame:
    """(doc_id, copies): MD5s of those texts of a document that also stand under a smaller doc_id."""
    rows = src.select("doc_id", F.md5("text").alias("m")).where("m is not null")
    low = rows.groupBy("m").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    return by_key(rows, low, "m", src.count()).where("doc_id > low").groupBy("doc_id").agg(F.collect_set("m").alias("copies"))


def _anchor_rows(originals: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1)):
                w = words(b.column(1)[i:j])
                _, where, g = anchors(w.hashes(), w.first, window)
                where, one = np.unique(where, return_index=True)
                yield _pairs(b.column(0)[i:j].to_pylist(), w.rows()[where], g[one])

    return originals.select("doc_id", "text").mapInArrow(tidy(run), "h long, d long")


def _repeated(rows: DataFrame) -> DataFrame:
    """Of rows (h, d) those whose h occurs again, with `low`, the least document that has it."""
    low = rows.groupBy("h").agg(F.min("d").alias("low"), F.count("*").alias("c")).where("c > 1").select("h", "low")
    return rows.join(low, "h").select("d", "h", "low")


def _member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x


def _window_rows(marked: DataFrame, window: int) -> DataFrame:
    """(h, d) of the windows whose anchor is in the document's array `hs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1)):
                w = words(b.column(1)[i:j])
                h = w.hashes()
                pos, _, g = anchors(h, w.first, window)
                if not len(pos):
                    continue
                row = w.rows()[pos]
                hs = b.column(2)[i:j]
                ok = np.zeros(len(pos), bool)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(j - i):
                    ok[edge[r] : edge[r + 1]] = _member(np.sort(np.asarray(hs[r].values)), g[edge[r] : edge[r + 1]].view(np.int64))
                _, full = windows(h, w.first, window)
                yield _pairs(b.column(0)[i:j].to_pylist(), row[ok], full[ok])

    return marked.select("doc_id", "text", "hs").mapInArrow(tidy(run), "h long, d long")


def doubled(dup: np.ndarray, length: int) -> int:
    """The greatest length 13, 26, 52, ... at which some window is still a candidate: both halves of it were."""
    while len(dup):
        nxt = dup[_member(dup, dup + length)]
        if not len(nxt):
            return length
        dup, length = nxt, length * 2
    return 0


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, longest, kept): each word covered by a window of
    `window` words whose sequence also starts in a document with a smaller doc_id is removed.

    kept is the remaining words joined by one space; longest is the greatest doubled length
    (window, 2*window, ...) of which every part repeats, 0 if nothing does.
    """
    every = _source(docs)
    src = every.where("doc_id is not null")
    copied = src.join(_copies(src), "doc_id", "left").withColumn("copy", F.coalesce(F.array_contains("copies", F.md5("text")), F.lit(False))).select("doc_id", "text", "copy")
    # cut: the anchors' shuffles, the largest here, are gone before the windows are written
    cand = cut(_repeated(_anchor_rows(copied.where("not copy"), window)).groupBy("d").agg(F.collect_set("h").alias("hs")))
    marked = src.join(cand.withColumnRenamed("d", "doc_id"), "doc_id")
    late = _repeated(_window_rows(marked, window)).where("d > low").groupBy("d").agg(F.collect_set("h").alias("hs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1)):
                w = words(b.column(1)[i:j])
                at, g = windows(w.hashes(), w.first, window)
                hs, copy = b.column(2)[i:j], b.column(3)[i:j].to_pylist()
                edge = np.searchsorted(at, w.first)
                n, gone_n, sha, longest, text = w.counts, [], [], [], []
                for r in range(j - i):
                    gone = np.zeros(n[r], bool)
                    far = 0
                    if copy[r] and n[r] >= window:
                        gone[:] = True
                        far = doubled(np.arange(n[r] - window + 1), window)
                    elif hs[r].is_valid and edge[r + 1] > edge[r]:
                        hit = at[edge[r] : edge[r + 1]][_member(np.sort(np.asarray(hs[r].values)), g[edge[r] : edge[r + 1]].view(np.int64))] - w.first[r]
                        gone = covered(int(n[r]), hit, window)
                        far = doubled(hit, window)
                    a, z = w.first[r], w.first[r + 1]
                    if n[r] and not gone.any() and (w.starts[a + 1 : z] - w.ends[a : z - 1] == 1).all() and (w.buf[w.ends[a : z - 1]] == 32).all():
                        buf = w.buf[w.starts[a] : w.ends[z - 1]].tobytes()  # already joined by one space
                    else:
                        ok = ~gone
                        buf = b" ".join([w.buf[s:e].tobytes() for s, e in zip(w.starts[a:z][ok].tolist(), w.ends[a:z][ok].tolist())])
                    gone_n.append(int(gone.sum()))
                    sha.append(hashlib.sha256(buf).hexdigest())
                    longest.append(far)
                    text.append(buf.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(n.astype(np.int64)), pa.array(gone_n, pa.int64()), pa.array(sha), pa.array(longest, pa.int64()), pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "longest", "kept"])

    found = copied.join(late.withColumnRenamed("d", "doc_id"), "doc_id", "left").select("doc_id", "text", "hs", "copy")
    nameless = every.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("hs"), F.lit(False).alias("copy"))
    return found.union(nameless).mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string, longest long, kept string")
