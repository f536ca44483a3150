"""Vocabulary training: corpus counts in DataFrames, merge decisions on the driver over the word table.

The word table that a merge loop needs is collected only after its frequency cut, and only up
to MAX_WORDS distinct words; a larger one raises, with the advice to raise min_frequency. BpeTrainer
leaves a table of more than LOCAL_WORDS where it is and has its pairs counted there.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..functions.columns import bytes_to_chars, find_all
from ..operators.models import BPE, Unigram, WordPiece
from ..operators.normalizers import Form, Lowercase, Normalizer, Sequence
from ..operators.pretokenizers import ByteLevel, Metaspace, PreTokenizer

MAX_WORDS, LOCAL_WORDS = 5_000_000, 100_000
#: So many of the most frequent pairs come to the driver in a round.
TOP_PAIRS = 4096
Words = list[tuple[str, int]]


def word_counts(texts: DataFrame, pieces: Column, min_chars: int = 0, min_frequency: int = 0) -> DataFrame:
    """(word, freq): how often each piece occurs; counted before the shuffle and after."""
    w = texts.select(F.explode(pieces).alias("word"))
    if min_chars:
        w = w.where(F.char_length("word") >= min_chars)
    out = w.groupBy("word").agg(F.count("*").alias("freq"))
    return out.where(F.col("freq") >= min_frequency) if min_frequency else out


def add_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """The incremental protocol: counts of two batches as one."""
    return a.unionByName(b).groupBy("word").agg(F.sum("freq").alias("freq"))


def alphabet(words: DataFrame) -> DataFrame:
    """(ch, freq) over a word table."""
    return words.select(F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("ch"), "freq").groupBy("ch").agg(F.sum("freq").alias("freq"))


def pair_counts(words: DataFrame, symbols: Column | None = None) -> DataFrame:
    """(left, right, freq) of adjacent symbols (characters by default) weighted by word frequency."""
    s = F.filter(F.split("word", ""), lambda c: c != "") if symbols is None else symbols
    w = words.select(s.alias("s"), "freq").where(F.size("s") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.struct(F.get("s", i).alias("left"), F.get("s", i + 1).alias("right")))
    return w.select(F.explode(pairs).alias("p"), "freq").groupBy("p.left", "p.right").agg(F.sum("freq").alias("freq"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """One row: the most frequent pair; of equals the greatest by (left, right)."""
    return pairs.agg(F.max(F.struct("freq", "left", "right")).alias("p")).select("p.left", "p.right", "p.freq")


def score_adjusted(pairs: DataFrame, symbols: DataFrame, beta: float = 0.3, gate: float = 0.5, mu_target: float = 0.01, vmax: float = 10.0, beta_max: float = 2.0) -> DataFrame:
    """pairs with the adjusted score freq - gate * (v_left + v_right), v = clamp(-beta (f - mu), -vmax, vmax), mu = mu_target * total.

    symbols: (ch, freq). Velocities stay zero throughout training, so no momentum term appears.
    """
    b = min(max(beta, 0.0), beta_max)
    total = symbols.agg(F.sum("freq").alias("total"))
    v = symbols.join(F.broadcast(total)).select("ch", F.least(F.greatest(-F.lit(b) * (F.col("freq") - F.lit(mu_target) * F.col("total")), F.lit(-vmax)), F.lit(vmax)).alias("v"))
    l, r = v.select(F.col("ch").alias("left"), F.col("v").alias("vl")), v.select(F.col("ch").alias("right"), F.col("v").alias("vr"))
    return pairs.join(l, "left").join(r, "right").select("left", "right", "freq", (F.col("freq") - F.lit(gate) * (F.col("vl") + F.col("vr"))).alias("score"))


def collected(words: DataFrame) -> Words:
    """The word table on the driver, sorted; refused beyond MAX_WORDS."""
    n = words.count()
    if n > MAX_WORDS:
        raise ValueError(f"{n} distinct words; raise min_frequency so that at most {MAX_WORDS} remain")
    return sorted((r["word"], r["freq"]) for r in words.collect())


class _Pairs:
    """Symbols of all words with pair frequencies kept up to date merge by merge."""

    def __init__(self, split: list[tuple[list[str], int]]):
        self.words, self.freq, self.where = split, Counter(), defaultdict(set)
        self.symbols: Counter = Counter()
        for k, (s, f) in enumerate(split):
            for x in s:
                self.symbols[x] += f
            for p in zip(s, s[1:]):
                self.freq[p] += f
                self.where[p].add(k)

    def merge(self, p: tuple[str, str], new: str) -> set[tuple[str, str]]:
        changed = set()
        for k in self.where.pop(p, ()):
            s, f = self.words[k]
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == p:
                    out.append(new)
                    self.symbols[p[0]] -= f
                    self.symbols[p[1]] -= f
                    self.symbols[new] += f
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            for q in zip(s, s[1:]):
                self.freq[q] -= f
                changed.add(q)
            for q in zip(out, out[1:]):
                self.freq[q] += f
                self.where[q].add(k)
                changed.add(q)
            self.words[k] = (out, f)
        self.freq.pop(p, None)
        return changed


def merged_symbols(sym: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    """sym with each (a, b) replaced by its third, merge by merge, leftmost first. No merge has the symbol before each word, -1."""
    for a, b, new in merges:
        hit = np.flatnonzero((sym[:-1] == a) & (sym[1:] == b))
        if a == b and len(hit):  # in a run, every other one
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))) % 2 == 0]
        if len(hit):
            sym[hit] = new
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym = sym[keep]
    return sym


def symbol_pairs(words: DataFrame, symbols: list[str], lead: str, merges: list[tuple[int, int, int]]) -> DataFrame:
    """(a, b, freq): adjacent symbols, by their places in `symbols`, of the word table after merges. Words of a slice are handled at once."""
    place = {s: i for i, s in enumerate(symbols)}
    codes = sorted({ord(c) for c in symbols if len(c) == 1})
    first, rest = (np.array([place.get(x + chr(c), -1) for c in codes], np.int32) for x in ("", lead))
    many = len(symbols)

    def run(batches):
        rows = lambda key, n: pa.RecordBatch.from_arrays([pa.array(key // many), pa.array(key % many), pa.array(n.astype(np.int64))], ["a", "b", "freq"])
        small, total = many <= 1024, np.zeros(many * many if many <= 1024 else 0, np.int64)
        lut = np.zeros(codes[-1] + 1 if codes else 1, np.int32)
        lut[codes] = np.arange(len(codes))
        for batch in batches:
            for i, j in slices((batch.column(0),)):
                x, f = batch.column(0).slice(i, j - i).cast(pa.string()), np.asarray(batch.column(1).slice(i, j - i))
                off = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, x.offset * 4).astype(np.int64)
                buf = np.frombuffer(x.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
                starts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off - off[0]]
                at = lut[np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
                sym = np.full(len(at) + len(x), -1, np.int32)
                body = np.ones(len(sym), bool)
                body[starts[:-1] + np.arange(len(x))] = False
                sym[body] = rest[at]
                if lead:
                    begins = np.flatnonzero(np.diff(starts) > 0)
                    sym[starts[begins] + begins + 1] = first[at[starts[begins]]]
                sym = merged_symbols(sym, merges)
                ok = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
                key, n = sym[ok].astype(np.int64) * many + sym[ok + 1], f[np.cumsum(sym < 0)[ok] - 1]
                if small:
                    total += np.bincount(key, n, many * many).astype(np.int64)
                    continue
                key, back = np.unique(key, return_inverse=True)
                yield rows(key, np.bincount(back, n, len(key)))
        if small:
            key = np.flatnonzero(total)
            yield rows(key, total[key])

    words = words.coalesce(words.sparkSession.sparkContext.defaultParallelism)  # a task has costs of its own
    return words.select("word", "freq").mapInArrow(run, "a long, b long, freq long").groupBy("a", "b").agg(F.sum("freq").alias("freq"))


class _Greatest:
    """Order of heap entries: larger frequency, then greater pair first."""

    __slots__ = ("key",)

    def __init__(self, key: tuple):
        self.key = key

    def __lt__(self, other: "_Greatest") -> bool:
        return self.key > other.key


@dataclass
class BpeTrainer:
    vocab_size: int = 30000
    min_frequency: int = 2
    special_tokens: tuple[str, ...] = ("<unk>", "<pad>", "<s>", "</s>")
    limit_alphabet: int | None = None
    initial_alphabet: tuple[str, ...] = ()
    continuing_subword_prefix: str | None = None
    end_of_word_suffix: str | None = None

    def count(self, texts: DataFrame, text: str = "text") -> DataFrame:
        w = word_counts(texts, find_all(F.col(text), "(?U)\\S+"))
        return w if not self.end_of_word_suffix else w.select(F.concat("word", F.lit(self.end_of_word_suffix)).alias("word"), "freq")

    def train(self, texts: DataFrame, text: str = "text") -> tuple[dict[str, int], list[tuple[str, str]]]:
        return self.train_table(self.count(texts, text))

    def train_table(self, words: DataFrame) -> tuple[dict[str, int], list[tuple[str, str]]]:
        """train_words over a table (word, freq); one of more than LOCAL_WORDS words is not collected."""
        words = words.cache()
        try:
            return self.train_words(collected(words)) if words.count() <= LOCAL_WORDS else self._train_large(words)
        finally:
            words.unpersist()

    def _train_large(self, words: DataFrame) -> tuple[dict[str, int], list[tuple[str, str]]]:
        """The same merges in rounds, each of which counts all pairs once.

        A merge of (a, b) changes only counts of pairs that begin with b, end with a, or are (a, b); what it makes is no more frequent than
        such a pair was. So a round goes on, in order, up to the first pair that an earlier merge of the round has to do with.
        """
        chars = {r["ch"]: r["freq"] for r in alphabet(words).collect()}
        vocab = self._start(chars)
        lead = self.continuing_subword_prefix or ""
        symbols = list(dict.fromkeys([*chars, *(lead + c for c in chars)]))
        place = {x: i for i, x in enumerate(symbols)}
        merges: list[tuple[str, str]] = []
        done: list[tuple[int, int, int]] = []
        top, least = TOP_PAIRS, max(self.min_frequency, 1)
        while len(vocab) < self.vocab_size:
            got = symbol_pairs(words, symbols, lead, done).where(F.col("freq") >= least).orderBy(F.desc("freq")).limit(top).collect()
            order = sorted(((r["freq"], symbols[r["a"]], symbols[r["b"]]) for r in got), reverse=True)
            if not order:
                break
            if len(order) == top:  # of the last frequency some may be missing
                order = [x for x in order if x[0] > order[-1][0]]
                if not order:
                    top *= 4
                    continue
            touched: set[str] = set()
            for k, (f, a, b) in enumerate(order):
                # a later pair of the same frequency, or one that a merge may have made of it, could come first
                if touched and (a in touched or b in touched or any(x[0] == f and (x[1] in touched or x[2] in touched) for x in order[k + 1 :])) or len(vocab) >= self.vocab_size:
                    break
                merges.append((a, b))
                vocab.setdefault(a + b, len(vocab))
                known = a + b in place
                if not known:
                    place[a + b] = len(symbols)
                    symbols.append(a + b)
                done.append((place[a], place[b], place[a + b]))
                touched |= {a, b, a + b}
                if known or a == b:  # pairs may have become more frequent than those they came of
                    break
        return vocab, merges

    def _start(self, chars: dict[str, int]) -> dict[str, int]:
        """The vocabulary before the first merge."""
        vocab: dict[str, int] = {}
        add = lambda t: vocab.setdefault(t, len(vocab))
        for t in (*self.special_tokens, *self.initial_alphabet):
            add(t)
        for c, _ in sorted(chars.items(), key=lambda x: (-x[1], x[0]))[: self.limit_alphabet]:
            add(c)
        return vocab

    def train_words(self, words: Words) -> tuple[dict[str, int], list[tuple[str, str]]]:
        chars: Counter = Counter()
        for w, f in words:
            for c in w:
                chars[c] += f
        vocab = self._start(chars)
        add = lambda t: vocab.setdefault(t, len(vocab))
        lead = self.continuing_subword_prefix or ""
        state = _Pairs([([c if i == 0 else lead + c for i, c in enumerate(w)], f) for w, f in words])
        heap = [_Greatest((f, *p)) for p, f in state.freq.items()]
        heapq.heapify(heap)
        merges: list[tuple[str, str]] = []
        while len(vocab) < self.vocab_size and heap:
            f, *p = heapq.heappop(heap).key
            p = tuple(p)
            now = state.freq.get(p, 0)
            if now != f:
                continue
            if f < max(self.min_frequency, 1):
                break
            merges.append(p)
            add(p[0] + p[1])
            for q in state.merge(p, p[0] + p[1]):
                if state.freq.get(q, 0) > 0:
                    heapq.heappush(heap, _Greatest((state.freq[q], *q)))
        return vocab, merges


@dataclass
class Trainer:
    """BPE with score-adjusted pairs: scores are rebuilt every 100 merges, best first in between."""

    vocab_size: int = 32000
    min_frequency: int = 2
    special_tokens: tuple[str, ...] = ("</s>", "<pad>", "<s>", "<unk>")
    alpha: float = 0.9  # kept for compatibility: velocities are never updated, so it has no effect
    beta: float = 0.3
    gate: float = 0.5
    mu_target: float = 0.01
    vmax: float = 10.0
    beta_max: float = 2.0
    min_word_length: int = 1
    normalizer: Normalizer | None = field(default_factory=lambda: Form("NFC"))
    pre_tokenizer: PreTokenizer | None = field(default_factory=ByteLevel)
    every: int = 100

    def pieces(self, c: Column) -> Column:
        c = c if self.normalizer is None else self.normalizer.expr(c)
        if self.pre_tokenizer is not None:
            return self.pre_tokenizer.expr(c)
        return F.transform(find_all(c, "(?U)\\S+"), lambda w: bytes_to_chars(F.concat(F.lit("Ġ"), w)))

    def count(self, texts: DataFrame, text: str = "text") -> DataFrame:
        return word_counts(texts, self.pieces(F.col(text)), self.min_word_length)

    def save(self, path: str, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        """A tokenizer.json of fixed layout: BPE, byte-level splitting and decoding, the special tokens by their place."""
        flags = {"special": True, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
        made = {
            "version": "1.0",
            "model": {"type": "BPE", "vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]},
            "added_tokens": [{"id": i, "content": t, **flags} for i, t in enumerate(self.special_tokens)],
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
            "decoder": {"type": "ByteLevel"},
        }
        Path(path).write_text(json.dumps(made, ensure_ascii=False, indent=2), encoding="utf-8")

    def finish(self, counts: DataFrame) -> tuple[dict[str, int], list[tuple[str, str]]]:
        return self.train_words(collected(counts.where(F.col("freq") >= self.min_frequency)))

    def train(self, texts: DataFrame, text: str = "text") -> tuple[dict[str, int], list[tuple[str, str]]]:
        return self.finish(self.count(texts, text))

    def train_words(self, words: Words) -> tuple[dict[str, int], list[tuple[str, str]]]:
        vocab = {t: i for i, t in enumerate(self.special_tokens)}
        for c in sorted({c for w, _ in words for c in w}):
            vocab.setdefault(c, len(vocab))
        state = _Pairs([(list(w), f) for w, f in words])
        merges: list[tuple[str, str]] = []
        f32 = np.float32
        beta = f32(min(max(self.beta, 0.0), self.beta_max))
        while len(vocab) < self.vocab_size:
            mu = f32(self.mu_target) * f32(sum(state.symbols.values()))
            v = {s: min(max(-beta * (f32(f) - mu), f32(-self.vmax)), f32(self.vmax)) for s, f in state.symbols.items()}
            scored = [((f32(f) - f32(self.gate) * (v[p[0]] + v[p[1]])), *p) for p, f in state.freq.items() if f >= self.min_frequency]
            if not scored:
                break
            done = 0
            scored = [_Greatest(x) for x in scored]
            heapq.heapify(scored)
            while scored:
                _, *p = heapq.heappop(scored).key
                p = tuple(p)
                if state.freq.get(p, 0) <= 0:
                    continue
                merges.append(p)
                vocab.setdefault(p[0] + p[1], len(vocab))
                state.merge(p, p[0] + p[1])
                done += 1
                if done >= self.every or len(vocab) >= self.vocab_size:
                    break
            if not done:
                break
        return vocab, merges


@dataclass
class WordPieceTrainer:
    vocab_size: int = 30000
    min_frequency: int = 2
    special_tokens: tuple[str, ...] = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
    prefix: str = "##"
    max_chars: int = 100

    def count(self, texts: DataFrame, text: str = "text") -> DataFrame:
        c = Sequence((Form("NFC"), Lowercase())).expr(F.col(text))
        return word_counts(texts, find_all(c, "(?U)\\S+"), min_frequency=self.min_frequency)

    def train(self, texts: DataFrame, text: str = "text") -> WordPiece:
        return self.train_words(collected(self.count(texts, text)))

    def train_words(self, words: Words) -> WordPiece:
        """The most frequent pair of neighbours whose join is new becomes a piece; words that hold its text are split anew."""
        vocab = {t: i for i, t in enumerate(self.special_tokens)}
        for c in sorted({c for w, _ in words for c in w}):
            vocab.setdefault(c, len(vocab))
        model = WordPiece(vocab, self.prefix, "[UNK]", self.max_chars)
        join = lambda p: p[0] + (p[1].removeprefix(self.prefix))

        def split(w: str) -> list[str]:
            at, tokens = 0, []
            for p in model.pieces(w):  # an unknown character still counts as itself
                tokens.append(p if p is not None else (self.prefix if at else "") + w[at])
                at += 1 if p is None else len(p) - (len(self.prefix) if at else 0)
            return tokens

        now = [split(w) for w, _ in words]
        freq: Counter = Counter()
        holds: defaultdict = defaultdict(set)  # words by two neighbouring characters
        for k, tokens in enumerate(now):
            for p in zip(tokens, tokens[1:]):
                freq[p] += words[k][1]
            for p in zip(words[k][0], words[k][0][1:]):
                holds[p].add(k)
        heap = [_Greatest((f, *p)) for p, f in freq.items()]
        heapq.heapify(heap)
        while len(model.vocab) < self.vocab_size and heap:
            f, *best = heapq.heappop(heap).key
            best = tuple(best)
            if freq.get(best, 0) != f or f <= 0 or join(best) in model.vocab:
                continue
            model.add(join(best))
            changed = set()
            text = join(best).removeprefix(self.prefix)
            for k in sorted(min((holds.get(p, set()) for p in zip(text, text[1:])), key=len)):
                if text not in words[k][0] or (new := split(words[k][0])) == now[k]:
                    continue
                for p in zip(now[k], now[k][1:]):
                    freq[p] -= words[k][1]
                    changed.add(p)
                for p in zip(new, new[1:]):
                    freq[p] += words[k][1]
                    changed.add(p)
                now[k] = new
            for p in changed:
                if freq[p] > 0:
                    heapq.heappush(heap, _Greatest((freq[p], *p)))
        return WordPiece(model.vocab, self.prefix, "[UNK]", self.max_chars)


@dataclass
class UnigramTrainer:
    vocab_size: int = 8000
    special_tokens: tuple[str, ...] = ("<unk>", "<s>", "</s>")
    initial_vocab_size: int = 1_000_000
    shrinking_factor: float = 0.75
    n_iterations: int = 16
    max_piece_length: int = 16

    def sentences(self, texts: DataFrame, text: str = "text") -> DataFrame:
        return word_counts(texts, Metaspace().expr(Form("NFC").expr(F.col(text))))

    def seed(self, words: DataFrame) -> DataFrame:
        """(piece, freq) of all substrings up to max_piece_length, counted over distinct pieces and their frequencies."""
        n = F.char_length("word")
        starts = F.sequence(F.lit(1), n)
        subs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(self.max_piece_length), n - i + 1)), lambda k: F.substr("word", i, k))))
        return words.where(n > 0).select(F.explode(subs).alias("piece"), "freq").groupBy("piece").agg(F.sum("freq").alias("freq"))

    def _scored(self, counts: list[tuple[str, float]]) -> list[tuple[str, float]]:
        total = sum(c for _, c in counts)
        return [(p, max(math.log(c / total), -100.0) if c > 0 else -100.0) for p, c in counts]

    def train(self, texts: DataFrame, text: str = "text") -> Unigram:
        words = self.sentences(texts, text).cache()
        top = self.seed(words).orderBy(F.desc("freq"), "piece").limit(self.initial_vocab_size).collect()
        counts = [(t, 1) for t in self.special_tokens] + [(r["piece"], r["freq"]) for r in top if r["piece"] not in self.special_tokens]
        pieces = self._scored(counts[: self.initial_vocab_size])
        for _ in range(self.n_iterations):
            if len(pieces) <= self.vocab_size:
                break
            got = dict(self._expected(words, Unigram(pieces)))
            size = max(int(len(pieces) * self.shrinking_factor), self.vocab_size)
            special = [(p, max(got.get(p, 0), 1)) for p in self.special_tokens]
            rest = sorted(((p, got.get(p, 0)) for p, _ in pieces if p not in self.special_tokens), key=lambda x: (-x[1], x[0]))
            pieces = self._scored((special + rest)[:size])
        words.unpersist()
        return Unigram(pieces)

    def _expected(self, words: DataFrame, model: Unigram) -> list[tuple[str, int]]:
        """Counts of the pieces on the best paths of all words."""

        def run(batches):
            total: Counter = Counter()
            for b in batches:
                for w, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for i in model.encode_text(w):
                        total[model.pieces[i][0]] += f
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["piece", "freq"])

        return [(r["piece"], r["freq"]) for r in words.select("word", "freq").mapInArrow(run, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq")).collect()]


def bpe_model(vocab: dict[str, int], merges: list[tuple[str, str]]) -> BPE:
    return BPE(vocab, merges)
