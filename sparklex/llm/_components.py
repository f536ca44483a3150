"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut
from ._text import tidy


CHUNK, HUBS = 1 << 20, 4096


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that span the same components: each CHUNK of a partition's edges becomes a forest of stars."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = forest(at[: len(u)], at[len(u) :], len(nodes))
        child = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((np.asarray(b.column(0)), np.asarray(b.column(1))))
            n += b.num_rows
            if n >= CHUNK:
                yield stars(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield stars(*map(np.concatenate, zip(*held)))

    return edges.select("u", "v").mapInArrow(tidy(run), "u long, v long")


def by_key(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to groups (key, n: its number of rows, ...). rows are at most `total`; keys with so many of them
    that one task would hold them (fewer than HUBS such keys) are broadcast, and their rows stay where they are."""
    many = F.col("n") > max(64, total // HUBS)
    more = [c for c in groups.columns if c != key]
    hubs = groups.where(many).select(key, F.struct(*more).alias("_hub"))
    e = rows.join(F.broadcast(hubs), key, "left")
    rest = e.where("_hub is null").drop("_hub").join(groups.where(~many), key).select(*rows.columns, *more)
    return e.where("_hub is not null").select(*rows.columns, *[F.col("_hub")[c].alias(c) for c in more]).union(rest)


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (u, v), at most `total`. Large: every larger neighbour of u joins the least of u and its neighbours; small: the smaller ones do."""
    if large:
        e = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if large:
        out = by_key(e.where("v > u"), low, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = by_key(e, low, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of edges (u, v longs): root is the least node it reaches.

    Partitions contract what they hold, then stars meet in rounds of a few shuffles; about log(nodes) rounds. No links, no rows.
    """
    edges = cut(contracted(edges.where("u <> v")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == seen:
            return edges.select("u", F.col("v").alias("root")).union(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        seen = now
        edges = cut(_star(_star(edges, True, now[0]), False, now[0]))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and links (a, b): the least node each one reaches (min label with pointer jumps)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root
