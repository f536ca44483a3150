"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: XXH64 (seed 42) of word shingles; a bit is 1 if set in over half of them.
Self-join: two fingerprints within `radius` bits agree on at least blocks - radius of
`blocks` bit blocks, so each distinct fingerprint goes to one trie per choice of those
blocks (the trie's top levels). Inside a trie, node pairs are walked together from the
root, differing bits add up, and a pair whose sum exceeds the budget is dropped.
Copies share one fingerprint and so never meet; a trie hands back a spanning forest of
its links, not the links, so dense groups cost rows in proportion to their members.

Defined results: null and empty texts have fingerprint 0 and link like any other; texts
with fewer words than a shingle are one shingle; a null doc_id never names a component;
an empty table gives an empty result; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import by_key, components, forest
from ._store import cut
from ._text import slices, tidy, words


def bit_majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run first[r]:first[r+1] of hashes: the bits set in over half of them (none: 0)."""
    out = np.zeros(len(first) - 1, np.uint64)
    n = np.diff(first)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[:-1][full], axis=0, dtype=np.int32)
        out[full] = np.packbits(ones * 2 > n[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def simhash_texts(col: pa.Array, shingle: int = 3) -> np.ndarray:
    out = []
    for a, b in slices(col, 1 << 20):
        w = words(col[a:b], lower=True)
        buf, s, e = w.joined()
        n = w.counts
        per = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
        first = np.concatenate([[0], np.cumsum(per)])
        row = np.repeat(np.arange(len(n)), per)
        at = np.arange(first[-1]) - first[row] + w.first[row]
        stop = np.minimum(at + shingle, w.first[row + 1]) - 1
        f = xxhash.xxh64_intdigest
        h = np.fromiter((f(buf[x:y], 42) for x, y in zip(s[at].tolist(), e[stop].tolist())), np.uint64, len(at))
        out.append(bit_majority(h, first))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3, longs: list[str] = []) -> DataFrame:  # noqa: B006
    """(doc_id, fp, *longs) with fp the fingerprint as a signed long; one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhash_texts(b.column(1), shingle).view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *longs])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *longs).mapInArrow(tidy(run), ", ".join(f"{c} long" for c in ("doc_id", "fp", *longs)))


def trie_links(key: np.ndarray, fp: np.ndarray, radius: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within `radius` bits and one key; rows are sorted by (key, fp), distinct in each key.

    A trie node is a range of rows. All tries of a batch are walked at once, one bit a
    level; a frontier above `most` pairs is cut in two, so memory stays bounded.
    """
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    lo, hi = edge[:-1], edge[1:]
    big = hi - lo > 1
    z = np.zeros(int(big.sum()), np.int64)
    stack = [(63, lo[big], hi[big], lo[big], hi[big], z)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if len(al) > most:
            h = len(al) // 2
            stack += [(bit, *(x[:h] for x in (al, ah, bl, bh, err))), (bit, *(x[h:] for x in (al, ah, bl, bh, err)))]
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            a, b = al[single], bl[single]
            near = (np.bitwise_count(fp[a] ^ fp[b]) <= radius) & (a != b)
            if near.any():
                yield a[near], b[near]
            al, ah, bl, bh, err = (x[~single] for x in (al, ah, bl, bh, err))
        if not len(al) or bit < 0:
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        c = ones[bit]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = al == bl
        other = ~same
        nxt = [np.concatenate(x) for x in zip(
            (al, am, bl, bm, err), (am, ah, bm, bh, err),
            (al, am, bm, bh, err + 1),
            (am[other], ah[other], bl[other], bm[other], err[other] + 1),
        )]
        go = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= radius) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
        if go.any():
            stack.append((bit - 1, *(x[go] for x in nxt)))


def trie_forest(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links found in the tries of one batch."""
    root = np.arange(len(fp))
    a_, b_, held = [], [], 0
    for a, b in trie_links(key, fp, radius):
        a_.append(root[a])
        b_.append(root[b])
        held += len(a)
        if held > 1 << 20:
            root = forest(np.concatenate([np.arange(len(fp)), *a_]), np.concatenate([root, *b_]), len(fp))
            a_, b_, held = [], [], 0
    root = forest(np.concatenate([np.arange(len(fp)), *a_]), np.concatenate([root, *b_]), len(fp))
    child = np.flatnonzero(root != np.arange(len(fp)))
    return child, root[child]


def block_masks(blocks: int, radius: int) -> list[int]:
    """One mask of bits for each choice of blocks - radius of the blocks."""
    cut_ = [64 * i // blocks for i in range(blocks + 1)]
    part = [sum(1 << k for k in range(cut_[i], cut_[i + 1])) for i in range(blocks)]
    return [sum(part[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def links(fps: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that span the same components as all links."""
    if not 0 <= radius < blocks:
        raise ValueError("blocks must exceed radius")
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, radius)]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("x")).select("x.t", "x.k", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(t: np.ndarray, k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            key = np.cumsum(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]))
            u = fp.view(np.uint64)
            order = np.lexsort((u, key))
            child, root = trie_forest(key[order], u[order], radius)
            v = fp[order]
            return pa.RecordBatch.from_arrays([pa.array(v[child]), pa.array(v[root])], ["u", "v"])

        for b in batches:
            new = [np.asarray(c) for c in b.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            t, k, fp = held
            if not len(t):
                continue
            start = int(np.argmax((t == t[-1]) & (k == k[-1])))
            if start:  # the last key may go on in the next batch
                yield out(t[:start], k[:start], fp[:start])
                held = [x[start:] for x in held]
        if held is not None and len(held[0]):
            yield out(*held)

    return keyed.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(tidy(run), "u long, v long")


def by_fingerprint(d: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(fp, root, component_id) for each fp of d (doc_id, fp): root names its component, component_id is its least doc_id."""
    fps = cut(d.groupBy("fp").agg(F.min("doc_id").alias("low")))
    comp = components(links(fps.select("fp"), radius, blocks))
    named = fps.join(comp.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links of at most `radius` bits."""
    d = cut(fingerprints(docs, shingle))
    return d.join(by_fingerprint(d, radius, blocks), "fp").select("doc_id", "fp", "component_id")


ROW = "__row_key__"


def row_key(docs: DataFrame) -> Column:
    """A hash of the whole row."""
    return F.xxhash64(*[docs[c] for c in docs.columns])


def keep_rows(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of each component in grouped (doc_id, rk, component) the row of docs with the least (doc_id, rk) stays.

    One of fully equal rows stays; rows without a doc_id all stay.
    """
    rows = cut(grouped.where("doc_id is not null").groupBy("component", "doc_id", "rk").agg(F.count("*").alias("times")))
    best = rows.groupBy("component").agg(F.min(F.struct("doc_id", "rk")).alias("best"), F.count("*").alias("n"))
    fate = by_key(rows, best, "component", rows.count()).select(F.col("rk").alias("_rk"), ((F.col("doc_id") == F.col("best.doc_id")) & (F.col("rk") == F.col("best.rk"))).alias("_stays"), "times")
    fate = cut(fate.where("times > 1 or not _stays").select("_rk", "_stays"))
    keyed = docs.withColumn(ROW, row_key(docs))
    alone = keyed.join(fate.select("_rk").distinct(), F.col(ROW) == F.col("_rk"), "left_anti")
    twins = keyed.join(fate.where("_stays").select("_rk"), F.col(ROW) == F.col("_rk"), "left_semi").dropDuplicates([ROW])
    return alone.union(twins).drop(ROW)


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """docs without all but one row of each component: the one with the least doc_id, then row hash, stays.

    One of fully equal rows stays; documents without a doc_id all stay.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key(docs).alias("rk"))
    d = cut(fingerprints(keyed, shingle, ["rk"]))
    return keep_rows(docs, d.join(by_fingerprint(d, radius, blocks), "fp").select("doc_id", "rk", F.col("root").alias("component")))
