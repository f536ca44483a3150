"""Language-model scores from a log-frequency Bloom filter.

All training tokens and all pairs of adjacent tokens are counted. A count c is kept as its
level 1 + floor(log2 c): the filter holds the n-gram once for each level up to its own, and
a reader probes levels 1, 2, ... until one is missing. The filter is cut into blocks of
BLOCK_BITS bits (an n-gram lives in one block) and takes about BITS_EACH bits per entry.

The filter grows with the corpus, so it is never gathered: it is cut into parts, one for
each PART_BYTES of text. What is to be probed goes to the part of its n-gram in one shuffle,
the part counts its own training n-grams, fills its share of the filter, and sends sums of
logarithms back, one for each document it saw. Tokens and pairs that are so frequent that one
part would gather them from everywhere (the HEAD most frequent tokens, pairs of over HOT of a
batch) are counted beforehand and their exact counts broadcast; they stay with their document.

P(w) = (c(w)+0.1) / (sum of c + 0.1 (V+1)); for the first token of a text that is all, after v
P(w|v) = (c(v,w) + MU P(w)) / (c(v) + MU). c are the counts that levels stand for.

base_score is exact: counts of the rare tokens are taken from the part that holds them.

Defined results: a null or empty text is the end token alone; rows with a null doc_id are
not learned from and have a null held_out; repeated rows count as often as they occur.
Tokens are 64-bit Karp-Rabin hashes of A-Z-lowered words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut
from ._text import mix, slices, tidy, words

HEAD, HOT, MU = 1 << 17, 1 / 4096, 2000.0
BLOCK_BITS, BITS_EACH, K = 1 << 16, 10, 4
PART_BYTES = 16 << 20
END = np.uint64(0x0123456789ABCDEF)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the tokens of each row: its words, then END."""
    w = words(col, lower=True)
    first = w.first + np.arange(len(w.first))
    h = np.full(first[-1], END, np.uint64)
    at = np.ones(len(h), bool)
    at[first[1:] - 1] = False
    h[at] = w.hashes()
    return h, first


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def member(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is in, position) of x in a sorted array."""
    at = np.minimum(np.searchsorted(sorted_, x), max(len(sorted_) - 1, 0))
    return (sorted_[at] == x if len(sorted_) else np.zeros(len(x), bool)), at


def _source(docs: DataFrame, held_out: int) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (F.crc32(F.col("doc_id").cast("string")) % held_out == 0).alias("held_out"))


def pairs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the second token, hashes) of all adjacent tokens of one row."""
    second = np.ones(len(h), bool)
    second[first[:-1]] = False
    at = np.flatnonzero(second)
    return at, pair_hash(h[at - 1], h[at])


def _count(src: DataFrame, of: str = "tokens", only: np.ndarray | None = None) -> DataFrame:
    """(h, c) over all rows of src: exact counts of tokens or of pairs (of those in `only`, sorted), or pairs of over HOT of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for i, j in slices(b.column(0)):
                h, first = tokens(b.column(0)[i:j])
                if of != "tokens":
                    h = pairs(h, first)[1]
                if only is not None:
                    h = h[member(only, h)[0]]
                got.append(np.unique(h, return_counts=True))
            if got:
                h, c = (np.concatenate(x) for x in zip(*got))
                one, back = np.unique(h, return_inverse=True)
                c = np.bincount(back, c, len(one)).astype(np.int64)
                if of == "hot":
                    ok = c > max(32, HOT * c.sum())
                    one, c = one[ok], c[ok]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(c)], ["h", "c"])

    return src.select("text").mapInArrow(tidy(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def level(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)


def value(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    return np.where(q <= 0, 0.0, np.where(q == 1, 1.0, 1.5 * np.exp2(np.maximum(q, 1) - 1)))


def cells(g: np.ndarray, q: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit positions in its block of n-gram g at level q."""
    a = mix(g + np.asarray(q).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    for k in range(K):
        yield (a >> np.uint64(16 * k)) & np.uint64(BLOCK_BITS - 1)


class CountFilter:
    def __init__(self, log2_blocks: int, bits: np.ndarray):
        self.log2_blocks, self.bits = log2_blocks, bits

    @classmethod
    def of(cls, g: np.ndarray, q: np.ndarray) -> CountFilter:
        """The filter of distinct n-grams and their levels, as large as they need."""
        out = cls(max(0, int(np.ceil(np.log2(max(1, int(q.sum()) * BITS_EACH / BLOCK_BITS))))), np.zeros(0, np.uint8))
        m = np.zeros(BLOCK_BITS << out.log2_blocks, bool)
        x = 1
        while len(g):
            base = out.block(g) * BLOCK_BITS
            for cell in cells(g, x):
                m[base + cell.astype(np.int64)] = True
            x += 1
            g, q = g[q >= x], q[q >= x]
        out.bits = np.packbits(m, bitorder="little")
        return out

    def block(self, g: np.ndarray) -> np.ndarray:
        return (g >> np.uint64(64 - self.log2_blocks)).astype(np.int64) if self.log2_blocks else np.zeros(len(g), np.int64)

    def levels(self, g: np.ndarray) -> np.ndarray:
        """The level of each n-gram: probes go on until one misses."""
        out = np.zeros(len(g), np.int64)
        base = self.block(g) * (BLOCK_BITS // 8)
        alive = np.arange(len(g))
        q = 1
        while len(alive):
            ok = np.ones(len(alive), bool)
            for c in cells(g[alive], q):
                ok &= (self.bits[base[alive] + (c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[ok]
            out[alive] = q
            q += 1
        return out


def build_filter(counts: DataFrame, entries: dict[int, int]) -> CountFilter:
    """One filter of the counts (h, c) of a single part; entries: how many n-grams have each level."""
    rows = counts.select("h", "c").toArrow()
    q = level(np.asarray(rows["c"]))
    assert entries == dict(zip(*(x.tolist() for x in np.unique(q, return_counts=True))))
    return CountFilter.of(np.asarray(rows["h"]).view(np.uint64), q)


class Model:
    """What goes to all workers: totals, and exact counts of the frequent tokens and pairs."""

    def __init__(self, total: float, n: int, v: int, head: np.ndarray, head_c: np.ndarray, hot: np.ndarray, hot_c: np.ndarray):
        self.total, self.n, self.v, self.head, self.head_c, self.hot, self.hot_c = total, n, v, head, head_c, hot, hot_c

    def single(self, q: np.ndarray) -> np.ndarray:
        """P(w) of tokens of level q."""
        return (value(q) + 0.1) / (self.total + 0.1 * (self.v + 1))

    def after(self, h: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What tokens h of level q add to the score as the v of the next token; nothing follows END."""
        return np.where(h == END, 0.0, -np.log10(value(q) + MU))

    def pair(self, q: np.ndarray, q2: np.ndarray) -> np.ndarray:
        """What w of level q adds as the second of a pair of level q2 (at most q, as the pair holds w)."""
        return np.log10(value(np.minimum(q, q2)) + MU * self.single(q))


def _sorted(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = counts.toArrow()
    h, c = np.asarray(got["h"]).view(np.uint64), np.asarray(got["c"])
    order = np.argsort(h)
    return h[order], c[order]


def learn(src: DataFrame) -> Model:
    train = src.where("held_out = false")
    counts = cut(_count(train))
    lev = (F.floor(F.log2("c") + F.lit(1e-12)) + 1).cast("int")
    hist = {r["q"]: (r["n"], r["s"]) for r in counts.groupBy(lev.alias("q")).agg(F.count("*").alias("n"), F.sum("c").alias("s")).collect()}
    head, head_c = _sorted(counts.orderBy(F.desc("c"), "h").limit(HEAD))
    hot = _sorted(_count(src, "hot").orderBy(F.desc("c"), "h").limit(HEAD))[0]
    hot, hot_c = hot, np.zeros(len(hot), np.int64)
    if len(hot):
        h, c = _sorted(_count(train, "pairs", hot))
        hot_c[member(hot, h)[1]] = c
    total = float(sum(n * value(np.array([q]))[0] for q, (n, _) in hist.items()))
    return Model(total, sum(s for _, s in hist.values()), sum(n for n, _ in hist.values()), head, head_c, hot, hot_c)


def _keys(docs: DataFrame, parts: int) -> np.ndarray:
    """One number for each part that a hash partitioning by it deals to a partition of its own."""
    k = docs.sparkSession.range(32 * parts).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"))
    own = {r["p"]: r["id"] for r in k.groupBy("p").agg(F.min("id").alias("id")).collect()}
    spare = iter(range(32 * parts, 33 * parts))
    return np.array([own[p] if p in own else next(spare) for p in range(parts)], np.int32)


HOME = np.dtype([("id", "<i8"), ("has_id", "?"), ("held", "i1"), ("n", "<i8"), ("known", "<i8"), ("logs", "<f8"), ("score", "<f8")])
BACK = np.dtype([("row", "<i4"), ("score", "<f8")])
RARE = np.dtype([("row", "<i4"), ("known", "<i4"), ("logs", "<f8"), ("score", "<f8")])
PACKED = "to int, slice long, kind int, train binary, head_row binary, head_q binary, head_g binary, rare_row binary, rare_g binary, rare_w binary"


def lm_scores(docs: DataFrame, held_out: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    src = _source(docs, held_out)
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-size // PART_BYTES))
    keys = _keys(docs, parts)
    held = docs.sparkSession.sparkContext.broadcast(learn(src))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each slice of rows: what the rows know by themselves (kind 0), and what each part has to look up (kind 1)."""
        m = held.value
        log, head_q = np.log10(m.head_c + 0.1), level(m.head_c) if len(m.head) else np.zeros(1, np.int64)
        hot_q = np.where(m.hot_c > 0, level(m.hot_c), 0) if len(m.hot) else np.zeros(1, np.int64)
        here, number = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for i, j in slices(b.column(1)):
                h, first = tokens(b.column(1)[i:j])
                rows = j - i
                row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(first))
                known, at = member(m.head, h)
                q = np.where(known, head_q[at], 0)
                g = np.zeros(len(h), np.uint64)
                at2, g2 = pairs(h, first)
                g[at2] = g2
                lone = np.ones(len(h), bool)  # the first of a row: no pair
                lone[at2] = False
                hot, at3 = member(m.hot, g)
                hot &= ~lone
                home = np.zeros(rows, HOME)
                home["n"], home["known"] = np.diff(first), np.bincount(row[known], minlength=rows)
                if len(m.head):
                    home["logs"] = np.bincount(row[known], log[at[known]], rows)
                s = np.where(known, m.after(h, q), 0.0)
                s[lone & known] += np.log10(m.single(q[lone & known]))
                x = hot & known
                s[x] += m.pair(q[x], hot_q[at3[x]])
                home["score"] = np.bincount(row, s, rows)
                ids, out = b.column(0)[i:j], b.column(2)[i:j]
                home["id"], home["has_id"] = np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid())
                home["held"] = np.where(np.asarray(out.is_valid()), np.asarray(out.fill_null(False)).astype(np.int8), -1)
                train = np.packbits(home["held"] == 0).tobytes()
                a = np.flatnonzero(known & ~lone & ~hot)
                r = np.flatnonzero(~known)
                pa_, pr = (((z & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64) for z in (g[a], h[r]))
                a, r = a[np.argsort(pa_, kind="stable")], r[np.argsort(pr, kind="stable")]
                ea, er = (np.concatenate([[0], np.cumsum(np.bincount(z, minlength=parts))]) for z in (pa_, pr))
                columns = [row[a], q[a].astype(np.uint8), g[a]], [row[r], g[r], h[r]]
                made = [(int(keys[0]), here + number, 0, home.tobytes(), b"", b"", b"", b"", b"", b"")]
                for p in range(parts):
                    if ea[p + 1] > ea[p] or er[p + 1] > er[p]:
                        made.append((int(keys[p]), here + number, 1, train, *(z[ea[p] : ea[p + 1]].tobytes() for z in columns[0]), *(z[er[p] : er[p + 1]].tobytes() for z in columns[1])))
                made[0] = (int(keys[number % parts]), *made[0][1:])
                number += 1
                types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(z, t) for z, t in zip(zip(*made), types)], [z.split()[0] for z in PACKED.split(", ")])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each part: counts of the training rows, their filter, and the sums that go back to each slice."""
        m = held.value
        asked: dict[int, list] = {}
        for b in batches:
            for to, number, kind, *x in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    yield _sent(number, -1, x[0], b"")
                else:
                    asked.setdefault(to, []).append((number, *x))
        for to in sorted(asked):
            got = sorted(asked.pop(to))
            row, q, g, rrow, rg, rw = (np.concatenate([np.frombuffer(x[k + 2], t) for x in got]) for k, t in enumerate((np.int32, np.uint8, np.uint64, np.int32, np.uint64, np.uint64)))
            train = [np.unpackbits(np.frombuffer(x[1], np.uint8)).astype(bool) for x in got]
            na, nr = ([len(x[k]) // 4 for x in got] for k in (2, 5))
            ea, er = (np.concatenate([[0], np.cumsum(n)]) for n in (na, nr))
            ta, tr = (np.concatenate([t[r[e[k] : e[k + 1]]] for k, t in enumerate(train)]) for r, e in ((row, ea), (rrow, er)))
            pg, pback = np.unique(np.concatenate([g, rg]), return_inverse=True)
            pc = np.bincount(pback, np.concatenate([ta, tr]), len(pg)).astype(np.int64)
            wg, wback = np.unique(rw, return_inverse=True)
            wc = np.bincount(wback, tr, len(wg)).astype(np.int64)
            pc[pg == 0] = 0  # 0: no pair
            made = CountFilter.of(np.concatenate([pg[pc > 0], wg[wc > 0]]), np.concatenate([level(pc[pc > 0]), level(wc[wc > 0])]))
            pq, wq = made.levels(pg)[pback], made.levels(wg)[wback]
            hot, at = member(m.hot, rg)
            if len(m.hot):  # a rare token may still end a hot pair
                pq[len(g) :][hot] = np.where(m.hot_c > 0, level(m.hot_c), 0)[at[hot]]
            s = m.pair(q.astype(np.int64), pq[: len(g)])
            rs = np.where(rg == 0, np.log10(m.single(wq)), m.pair(wq, pq[len(g) :])) + m.after(rw, wq)
            logs, seen = np.log10(wc + 0.1)[wback], (wc > 0)[wback]
            for k, x in enumerate(got):
                i, j = ea[k], ea[k + 1]
                one, back = np.unique(row[i:j], return_inverse=True)
                a = np.zeros(len(one), BACK)
                a["row"], a["score"] = one, np.bincount(back, s[i:j], len(one))
                i, j = er[k], er[k + 1]
                one, back = np.unique(rrow[i:j], return_inverse=True)
                r = np.zeros(len(one), RARE)
                r["row"], r["score"] = one, np.bincount(back, rs[i:j], len(one))
                r["known"], r["logs"] = np.bincount(back, seen[i:j], len(one)), np.bincount(back, logs[i:j], len(one))
                yield _sent(x[0], to, a.tobytes(), r.tobytes())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each slice with all that came back for them."""
        m = held.value
        floor = np.log10(m.n + 0.1 * (m.v + 1))
        all_: dict[int, list] = {}
        for b in batches:
            for number, *x in zip(*(c.to_pylist() for c in b.columns)):
                all_.setdefault(number, []).append(x)
        for number in sorted(all_):
            (_, home, _), *back = sorted(all_.pop(number))
            d = np.frombuffer(home, HOME).copy()
            for _, a, r in back:
                a, r = np.frombuffer(a, BACK), np.frombuffer(r, RARE)
                d["score"][a["row"]] += a["score"]
                for c in ("score", "known", "logs"):
                    d[c][r["row"]] += r[c]
            base = d["logs"] - d["n"] * floor
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["id"], mask=~d["has_id"]), pa.array(d["held"] == 1, mask=d["held"] < 0), pa.array(d["n"]), pa.array(d["known"]), pa.array(np.full(len(d), m.n, np.int64)), pa.array(base), pa.array(d["score"])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    dealt = src.select("doc_id", "text", "held_out").mapInArrow(tidy(deal), PACKED).repartition(parts, "to")
    sent = dealt.mapInArrow(tidy(answer), "slice long, part int, rows binary, rare binary").repartition(parts, "slice")
    return sent.mapInArrow(tidy(whole), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _sent(number: int, part: int, rows: bytes, rare: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part], pa.int32()), pa.array([rows], pa.binary()), pa.array([rare], pa.binary())], ["slice", "part", "rows", "rare"])
