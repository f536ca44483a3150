"""Language identification by bit-sliced Bloom filters of character n-grams.

Every cell of the filter holds one bit per language, so probing an n-gram's K cells and
AND-ing them returns the mask of all languages that contain it. A text's hits per language
(popcounts of the masks' bits) are corrected for that language's false-positive rate, and
the language with the largest corrected share of n-grams wins.

Fit on a bounded sample of labelled rows: per language about `per_lang` texts of at most
`max_bytes` bytes, drawn by hash. A language's filter takes the n-grams (N bytes of lower-cased
text, digits and ASCII punctuation as spaces) that occur in enough of its sample texts.

Defined results: `und` with score 0 for null texts, texts without a letter, and when nothing
was learned; no hit at all gives the first language by name with score 0; ties go to the
first by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import distinct_pairs, mix, release, slices, tidy

N, K, MAX_CHARS = (3, 4, 5), 3, 50_000


def _plain(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows): lower case, runs of anything but letters as one space, a space around each text."""
    text = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), "")), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    off = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    table = np.arange(256, dtype=np.uint8)
    table[[c for c in range(128) if not chr(c).isalpha()]] = 32
    raw = table[np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]]]
    off = off - off[0]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    keep[off[:-1]] = True  # each row has its two spaces
    size = np.add.reduceat(keep.view(np.uint8), off[:-1], dtype=np.int64) if len(col) else np.zeros(0, np.int64)
    return raw[keep], np.concatenate([[0], np.cumsum(size)])


def ngram_blocks(col: pa.Array, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all n-grams of all texts, in blocks of bounded size however long a text is."""
    raw, off = _plain(col)
    for a in range(0, len(raw), block):
        b = min(a + block, len(raw))
        part = raw[a : b + max(N) - 1].astype(np.uint64)
        at = np.arange(a, b)
        row = np.searchsorted(off, at, "right") - 1
        left = off[row + 1] - at
        for n in N:
            ok = np.flatnonzero(left >= n)
            g = np.zeros(len(ok), np.uint64)
            for k in range(n):
                g |= part[ok + k] << np.uint64(8 * k)
            yield row[ok], mix(g + np.uint64(n << 60))


def ngrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all n-grams of all texts at once."""
    got = list(ngram_blocks(col))
    return (np.concatenate([r for r, _ in got]), np.concatenate([g for _, g in got])) if got else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


class LanguageFilter:
    def __init__(self, langs: list[str], sets: list[np.ndarray]):
        self.langs = langs
        most = max([len(s) for s in sets], default=0)
        self.bits = max(10, int(np.ceil(np.log2(max(1, most) * 8))))
        self.planes = (len(langs) + 63) // 64
        self.cells = np.zeros((self.planes, 1 << self.bits), np.uint64)
        for k, s in enumerate(sets):
            for c in self._cells(s):
                np.bitwise_or.at(self.cells[k // 64], c, np.uint64(1 << (k % 64)))
        self.false = np.array([np.mean((self.cells[k // 64] >> np.uint64(k % 64)) & np.uint64(1)) ** K for k in range(len(langs))])

    def _cells(self, g: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(K):
            yield (mix(g + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def masks(self, g: np.ndarray) -> np.ndarray:
        """Per plane and n-gram, the languages that contain it."""
        out = np.full((self.planes, len(g)), np.iinfo(np.uint64).max, np.uint64)
        for c in self._cells(g):
            out &= self.cells[:, c]
        return out

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(col)
        share = np.zeros((n, len(self.langs)))
        for a, b in slices(col, 1 << 20):
            total, hits = np.zeros(b - a, np.int64), np.zeros((b - a, len(self.langs)), np.int64)
            for row, g in ngram_blocks(col[a:b]):
                m = self.masks(g)  # three probes of a small table cost less than sorting repeated n-grams out
                total += np.bincount(row, minlength=b - a)
                for k in range(len(self.langs)):
                    hit = ((m[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(bool)
                    hits[:, k] += np.bincount(row[hit], minlength=b - a)
            share[a:b] = np.maximum(0, (hits / np.maximum(total, 1)[:, None] - self.false) / np.maximum(1e-9, 1 - self.false))
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(col.cast(pa.large_string()), r"\p{L}"), False))
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        best = share.argmax(1)
        top = share[np.arange(n), best] ** 4
        score = np.where(letters & (top > 0), top / np.maximum((share**4).sum(1), 1e-300), 0.0)
        return [self.langs[k] if ok else "und" for k, ok in zip(best, letters)], score


def build(langs: list[str], texts: list[pa.Array], share: float = 0.02) -> LanguageFilter:
    """A filter whose sets hold the n-grams found in at least `share` of a language's sample texts (two at least, if it has more than four)."""
    sets = []
    for col in texts:
        seen = []
        for a, b in slices(col):
            row, g = ngrams(col[a:b])
            seen.append(distinct_pairs(row, g)[1])
        g, c = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        sets.append(g[c >= max(2 if len(col) > 4 else 1, share * len(col))])
    return LanguageFilter(langs, sets)


def learn(docs: DataFrame, per_lang: int = 600, max_bytes: int = MAX_CHARS) -> LanguageFilter:
    """Fit on rows with a lang whose crc32(doc_id as text) mod 4 is not 2."""
    src = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    src = src.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes) & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    n = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(n)
    grain = 1 << 40
    pick = F.lit(False)
    for k in langs:
        pick = pick | ((F.col("lang") == k) & (F.pmod("h", F.lit(grain)) < int(grain * min(1.0, per_lang / n[k]))))
    got = src.where(pick).select("lang", "text").toArrow().combine_chunks() if langs else None
    made = build(langs, [got["text"].filter(pc.equal(got["lang"], k)).combine_chunks() if got.num_rows else pa.array([], pa.string()) for k in langs])
    del got
    release()
    return made


def language(docs: DataFrame, per_lang: int = 600, max_bytes: int = MAX_CHARS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs; only text decides."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, per_lang, max_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = held.value.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"))
    return src.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")
