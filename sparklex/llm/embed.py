"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are laid on a grid of cell width epsilon (the chord of the cosine threshold)
over their leading principal directions, and sorted by (label, cell, cell, ...): the epsilon
grid order. The order is cut into blocks of BLOCK vectors, so a dense cell is many blocks.
Pairs of blocks whose boxes come within epsilon are joined by splitting their intervals again
and again; intervals provably farther apart than epsilon are skipped, small ones compared in
double precision.

Equal vectors (same label and components) are one vector with a multiplicity, so copies never
meet; a block pair hands back each vector's number of links and a spanning forest, so rows
follow the vectors, not the pairs. Principal directions are fitted on SAMPLE vectors with the
least hash; they only affect speed, as every vector is placed and distances are bounds.

Defined results: null labels, null or zero vectors and vectors with null or non-finite parts
link with nothing; vectors of different lengths are not compared; repeated rows count as
copies; a null vec_id names no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, forest
from ._store import cut, partitions
from ._text import tidy

DIMS, BLOCK, LEAF, SAMPLE, SLACK = 6, 2048, 256, 8192, 1e-9


def matrix(col: pa.Array, n: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, n)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Grid:
    """Leading principal directions by vector length; other lengths use their first components."""

    def __init__(self, axes: dict[int, np.ndarray], eps: float):
        self.axes, self.eps = axes, eps

    def project(self, unit: np.ndarray) -> np.ndarray:
        n = unit.shape[1]
        ax = self.axes[n] if n in self.axes else np.eye(n)[:, :DIMS]
        p = unit @ ax
        return np.pad(p, ((0, 0), (0, DIMS - p.shape[1])))


def fit_grid(reps: DataFrame, eps: float) -> Grid:
    axes = {}
    got = reps.orderBy("h").limit(SAMPLE).select("n", "vec").toArrow().combine_chunks()
    for n in set(got["n"].to_pylist()):
        x = np.array(got.filter(pc.equal(got["n"], n))["vec"].to_pylist(), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        axes[n] = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(n))[1][:, ::-1][:, :DIMS].reshape(n, -1) if n > 1 else np.eye(1)
    return Grid(axes, eps)


def joined(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, least: float, eps: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b (unit vectors in grid order) with cosine at least `least`; with same, i < j."""
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        if same and k < i:
            continue
        gap = np.maximum(0, np.maximum(pa_[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa_[i:j].max(0)))
        if (gap * gap).sum() > (eps + SLACK) ** 2:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            c = a[i:j] @ b[k:m].T
            x, y = np.nonzero(c >= least - 1e-12)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
        elif same and i == k:
            h = (i + j) // 2
            stack += [(i, h, i, h), (i, h, h, j), (h, j, h, j)]
        elif j - i >= m - k:
            h = (i + j) // 2
            stack += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            stack += [(i, j, k, h), (i, j, h, m)]


def _reps(emb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with h, the hash of label and vector (null: links with nothing); and the distinct vectors (label, n, vec, h, times, low)."""
    ok = F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    ok = ok & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    kind = "float" if emb.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # moved as given, compared in double
    rows = emb.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast(f"array<{kind}>").alias("vec"))
    rows = rows.withColumn("h", F.when(ok, F.xxhash64("label", "vec")))
    reps = rows.where("h is not null").groupBy("h").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("times"), F.min("vec_id").alias("low"))
    return rows.select("vec_id", "h"), cut(reps.withColumn("n", F.size("vec")))


def _blocks(reps: DataFrame, grid: Grid) -> DataFrame:
    """(bid, label, n, size, lo, hi, h, times, vec): blocks of at most BLOCK vectors in epsilon grid order."""
    held = reps.sparkSession.sparkContext.broadcast(grid)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value
        for b in batches:
            n_ = np.asarray(b.column(1))
            for n in np.unique(n_):
                x = b.filter(pa.array(n_ == n))
                v = matrix(x.column(2), int(n))
                cells = np.floor(g.project(unit(v)) / g.eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*x.columns, *[pa.array(cells[:, k]) for k in range(DIMS)]], [*x.schema.names, *[f"c{k}" for k in range(DIMS)]])

    label, vec = (reps.schema[c].dataType.simpleString() for c in ("label", "vec"))
    cells = [f"c{k}" for k in range(DIMS)]
    order = ["label", "n", *cells, "h"]
    placed = reps.select("label", "n", "vec", "h", "times").mapInArrow(tidy(place), f"label {label}, n int, vec {vec}, h long, times long, " + ", ".join(f"{c} int" for c in cells))
    placed = placed.repartitionByRange(partitions(reps), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, part, made = held.value, TaskContext.get().partitionId(), 0
        for b in batches:
            n_ = np.asarray(b.column(1))
            lab = b.column(0).to_pylist()
            edge = [0, *[i for i in range(1, b.num_rows) if lab[i] != lab[i - 1] or n_[i] != n_[i - 1]], b.num_rows]
            for i, j in zip(edge[:-1], edge[1:]):
                for s in range(i, j, BLOCK):
                    x = b.slice(s, min(BLOCK, j - s))
                    p = g.project(unit(matrix(x.column(2), int(n_[s]))))
                    v = np.asarray(x.column(2).flatten())
                    one = [[(part << 32) | made], [lab[s]], [int(n_[s])], [x.num_rows], [p.min(0).tolist()], [p.max(0).tolist()], [np.asarray(x.column(3)).tobytes()], [np.asarray(x.column(4)).tobytes()], [v.tobytes()]]
                    made += 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, (pa.int64(), b.schema.field(0).type, pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()))], ["bid", "label", "n", "size", "lo", "hi", "h", "times", "vec"])

    return cut(placed.mapInArrow(tidy(pack), f"bid long, label {label}, n int, size int, lo array<double>, hi array<double>, h binary, times binary, vec binary"))


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: block pairs of one label whose boxes come within eps; found by the cells of the first direction."""
    cell = lambda c: F.floor(F.col(c)[0] / F.lit(eps))
    meta = blocks.select("bid", "label", "n", "lo", "hi")
    a = meta.withColumn("c", F.explode(F.sequence(cell("lo"), cell("hi"))))
    b = meta.select(F.col("bid").alias("b"), F.col("label"), F.col("n"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(cell("lo") - 1, cell("hi") + 1)).alias("c"))
    gap = F.zip_with(F.zip_with("lo", "hi2", lambda x, y: x - y), F.zip_with("lo2", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    far = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    first = F.greatest(cell("lo"), F.floor(F.col("lo2")[0] / F.lit(eps)) - 1) == F.col("c")  # each pair once
    return a.join(b, ["label", "n", "c"]).where((F.col("bid") <= F.col("b")) & first & (far <= (eps + SLACK) ** 2)).select(F.col("bid").alias("a"), "b")


def near(emb: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of emb (vec_id, embedding, label)."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    rows, reps = _reps(emb)
    grid = fit_grid(reps, eps)
    blocks = _blocks(reps, grid)
    right = blocks.select(F.col("bid").alias("b"), F.col("h").alias("h2"), F.col("times").alias("times2"), F.col("vec").alias("vec2"))
    work = _block_pairs(blocks, eps).join(blocks.select(F.col("bid").alias("a"), "n", "h", "times", "vec"), "a").join(right, "b")
    held = emb.sparkSession.sparkContext.broadcast(grid)
    moved = np.dtype(np.float32 if reps.schema["vec"].dataType.simpleString() == "array<float>" else np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value
        for batch in batches:
            for r in batch.to_pylist():
                same, n = r["a"] == r["b"], r["n"]
                v, w = (unit(np.frombuffer(r[c], moved).astype(np.float64).reshape(-1, n)) for c in ("vec", "vec" if same else "vec2"))
                h = np.frombuffer(r["h"], np.int64)
                t = np.frombuffer(r["times"], np.int64)
                if not same:
                    h, t = np.concatenate([h, np.frombuffer(r["h2"], np.int64)]), np.concatenate([t, np.frombuffer(r["times2"], np.int64)])
                root, got = np.arange(len(h)), np.zeros(len(h), np.int64)
                for x, y in joined(v, w, g.project(v), g.project(w), cosine, eps, same):
                    y = y if same else y + len(v)
                    np.add.at(got, x, t[y])
                    np.add.at(got, y, t[x])
                    root = forest(np.concatenate([np.arange(len(h)), root[x]]), np.concatenate([root, root[y]]), len(h))
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(got[at]), pa.array(h[root[at]])], ["h", "links", "to"])

    found = cut(work.select("a", "b", "n", "h", "times", "vec", "h2", "times2", "vec2").repartition(partitions(emb), "a", "b").mapInArrow(tidy(run), "h long, links long, to long"))
    comp = components(found.select(F.col("h").alias("u"), F.col("to").alias("v")))
    links = found.groupBy("h").agg(F.sum("links").alias("links"))
    named = reps.select("h", "times", "low").join(links, "h", "left").join(comp.withColumnRenamed("u", "h"), "h", "left")
    named = named.select("h", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "low", F.coalesce("root", "h").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("least"))
    named = named.join(least, "root").select("h", "n_links", "least")
    out = rows.join(named, "h", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
