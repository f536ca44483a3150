"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: presence of its lower-cased words, their stems (first STEM bytes), word
pairs, and pairs with one word left out, hashed to 2**BITS slots. Each coordinate has its own learning rate; L1 keeps most
weights at zero, so what is broadcast is two short arrays (at most 2**BITS entries).

Fit on a bounded sample of labelled rows: at most `max_rows`, those with the least hash of
doc_id, of texts up to `max_bytes` bytes. Everything else runs over all rows and whole texts.

Defined results: null or empty texts have only the bias; labels that are null, or given
twice with different values, are left out; without labels every score is 0.5 less a hair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Words, mix, release, slices, tidy, words

BITS, MAX_CHARS, STEM = 20, 200_000, 6


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) pairs, each once, sorted by row; slot 0 of every row is the bias."""
    w = words(col, lower=True, plain=True)
    h, row = w.hashes(), w.rows()
    parts, rows = [np.zeros(len(col), np.uint64)], [np.arange(len(col))]
    shift = np.uint64(64 - BITS)
    stem = mix(Words(w.buf, w.starts, np.minimum(w.ends, w.starts + STEM), w.first).hashes() + np.uint64(0x7F4A7C15))
    parts.append((stem >> shift) | np.uint64(1))
    rows.append(row)
    for gap, salt in ((0, 0), (1, 0x51ED270B), (2, 0x2545F491)):
        if gap == 0:
            g, r = h, row
        else:
            ok = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
            g, r = mix(h[:-gap][ok] * np.uint64(3) + h[gap:][ok] + np.uint64(salt)), row[gap:][ok]
        parts.append((g >> shift) | np.uint64(1))  # slots of features are odd, so the bias has its own
        rows.append(r)
    key = np.unique((np.concatenate(rows).astype(np.uint64) << np.uint64(BITS)) | np.concatenate(parts))
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def fit(col: pa.Array, y: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.1, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) that are not zero, by follow-the-regularised-leader with per-coordinate rates."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    each = []
    for a, b in slices(col):
        r, s = features(col[a:b])
        edge = np.searchsorted(r, np.arange(b - a + 1))
        s = s.astype(np.int32)
        each += [s[edge[i] : edge[i + 1]] for i in range(b - a)]

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(each)):
            s = each[i]
            zi, ni = z[s], n[s]
            wi = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(wi.sum(), -35, 35))) - y[i]
            z[s] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[s] = ni + g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at]


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 5, max_rows: int = 8_000, max_bytes: int = MAX_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Fit on labelled documents with crc32(doc_id as text) mod held_out not 0."""
    lab = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    lab = lab.where(F.crc32(F.col("_id").cast("string")) % held_out != 0).groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    lab = lab.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    src = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    got = src.where(F.octet_length("text") <= max_bytes).join(F.broadcast(lab), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.max("_y").alias("_y")).toArrow()
    order = np.argsort(np.asarray(got["_id"]), kind="stable") if got.num_rows else []
    got = got.take(pa.array(order, pa.int64())).combine_chunks()
    if not got.num_rows:
        return np.zeros(0, np.int64), np.zeros(0)
    made = fit(got["text"].chunk(0), np.asarray(got["_y"], np.float64))
    del got
    release()
    return made


def scores(col: pa.Array, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    dense = np.zeros(1 << BITS)
    dense[at] = w
    out = np.zeros(len(col))
    for a, b in slices(col):
        r, s = features(col[a:b])
        out[a:b] = np.bincount(r, dense[s], b - a)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 5, max_rows: int = 8_000, max_bytes: int = MAX_CHARS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, held_out, max_rows, max_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = scores(b.column(1), *model.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(F.col("doc_id").cast("string")) % held_out == 0).alias("held_out"))
    return src.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: int = 5, max_rows: int = 8_000, max_bytes: int = MAX_CHARS) -> DataFrame:
    """docs without the rows whose score is 0.5 or more; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, held_out, max_rows, max_bytes))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at), *model.value) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
