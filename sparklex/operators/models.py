"""Subword models. encode_word / encode_text work on one string inside Arrow UDFs; encoder() lifts a model to a Column.

The UDF looks at each distinct piece of an Arrow batch once and keeps a cache per worker, so
no shuffle is needed to profit from repeated words.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.batches import Words, bounded, gathered
from ..functions.chars import encode_bytes, split_spaces

CACHE, SHORT, NEVER = 1 << 18, 64, 1 << 60


def _merge_short(s: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same for a few symbols: the ranks of all neighbours in a list."""
    get = ranks.get
    r = [get(p, NEVER) for p in zip(s, s[1:])]
    while r and (least := min(r)) != NEVER:
        i = r.index(least)
        x = s[i] + s[i + 1]
        s[i : i + 2] = [x]
        del r[i]
        if i:
            r[i - 1] = get((s[i - 1], x), NEVER)
        if i < len(r):
            r[i] = get((x, s[i + 1]), NEVER)
    return s


def merge_symbols(symbols: list[str], ranks: dict[tuple[str, str], int], skip: Callable[[], bool] | None = None) -> list[str]:
    """Merge the lowest-ranked adjacent pair, leftmost on ties, until none is left (linked list and heap)."""
    n = len(symbols)
    if n <= SHORT and skip is None:
        return _merge_short(list(symbols), ranks)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    sym: list[str | None] = list(symbols)
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if sym[i] != a or j >= n or sym[j] != b or (skip is not None and skip()):
            continue
        sym[i], sym[j] = a + b, None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for x, y in ((prv[i], i), (i, nxt[i])):
            if x >= 0 and y < n and (r := ranks.get((sym[x], sym[y]))) is not None:
                heapq.heappush(heap, (r, x, sym[x], sym[y]))
    return [s for s in sym if s is not None]


class Model:
    vocab: dict[str, int]

    def by_chunks(self) -> bool:
        """Whether a text may be cut before each single space between two other characters."""
        return False

    def encode_text(self, text: str) -> list[int]:
        raise NotImplementedError

    def decode_expr(self, tokens: Column) -> Column:
        raise NotImplementedError

    def token_to_id(self, token: str) -> int | None:
        return self.vocab.get(token)

    def id_to_token(self, i: int) -> str | None:
        return self.names().get(i)

    def names(self) -> dict[int, str]:
        return {i: t for t, i in self.vocab.items()}

    def vocab_size(self) -> int:
        return len(self.vocab)


class BPE(Model):
    """Byte-pair encoding over characters; those not in the vocabulary are dropped.

    A merge counts if both parts and the result are in the vocabulary; of equal pairs the last rank holds.
    """

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], dropout: float = 0.0, seed: int = 12345):
        self.vocab, self.dropout, self.seed = dict(vocab), dropout, seed
        self.merges = [(a, b) for a, b in merges if a in vocab and b in vocab and a + b in vocab]
        self.ranks = {p: r for r, p in enumerate(self.merges)}

    def encode_text(self, text: str) -> list[int]:
        skip = None
        if self.dropout > 0:  # seeded by the text, so results don't depend on scheduling
            rng = np.random.default_rng([self.seed, *text.encode("utf-8")])
            skip = lambda: rng.random() < self.dropout
        return [self.vocab[s] for s in merge_symbols([c for c in text if c in self.vocab], self.ranks, skip)]

    def decode_expr(self, tokens: Column) -> Column:
        return F.array_join(tokens, "")


class ByteLevelBPE(Model):
    """Optional leading space, pieces that start at spaces, bytes as characters, merges by strings, unknown -> unk (0 if it has no entry)."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], unk: str = "<unk>", add_prefix_space: bool = False):
        self.vocab, self.unk, self.add_prefix_space = dict(vocab), unk, add_prefix_space
        self.merges = list(merges)
        self.ranks = {p: r for r, p in enumerate(self.merges)}

    def by_chunks(self) -> bool:
        return not self.add_prefix_space

    def encode_text(self, text: str) -> list[int]:
        if self.add_prefix_space and not text.startswith(" "):
            text = " " + text
        unk = self.vocab.get(self.unk, 0)
        first, *rest = text.split(" ")
        pieces = [*([first] if first else []), *(" " + r for r in rest)]
        return [self.vocab.get(s, unk) for p in pieces for s in merge_symbols(list(encode_bytes(p)), self.ranks)]

    def decode_expr(self, tokens: Column) -> Column:
        from .decoders import ByteLevel

        return ByteLevel().expr(tokens)


class CharBPE(Model):
    """White-space words whose last character carries the suffix; unknown -> unk (0 if it has no entry)."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], unk: str = "<unk>", suffix: str = "</w>"):
        self.vocab, self.unk, self.suffix = dict(vocab), unk, suffix
        self.merges = list(merges)
        self.ranks = {p: r for r, p in enumerate(self.merges)}

    def by_chunks(self) -> bool:
        return True

    def encode_text(self, text: str) -> list[int]:
        unk = self.vocab.get(self.unk, 0)
        return [self.vocab.get(s, unk) for w in split_spaces(text) for s in merge_symbols([*w[:-1], w[-1] + self.suffix], self.ranks)]

    def decode_expr(self, tokens: Column) -> Column:
        from .decoders import BPE as Joined

        return Joined(self.suffix).expr(tokens)


class WordPiece(Model):
    """Longest prefix first; where nothing fits, unk for one character and on. Overlong words are one unk."""

    def __init__(self, vocab: dict[str, int], prefix: str = "##", unk: str = "[UNK]", max_chars: int = 100):
        self.vocab, self.prefix, self.unk, self.max_chars = dict(vocab), prefix, unk, max_chars
        self.lengths: dict[str, list[int]] = {}  # by first character, word starts and the rest apart: lengths that occur, longest first
        for p in sorted(vocab, key=len):
            self._note(p)

    def _note(self, p: str) -> None:
        for lead in {"", self.prefix}:
            n = len(p) - len(lead)
            if p.startswith(lead) and n > 0 and n not in (known := self.lengths.setdefault(lead + p[len(lead)], [])):
                known.append(n)
                known.sort(reverse=True)

    def add(self, piece: str) -> None:
        """One more piece, with the next id."""
        self.vocab[piece] = len(self.vocab)
        self._note(piece)

    def pieces(self, word: str) -> list[str | None]:
        out: list[str | None] = []
        i, n = 0, len(word)
        while i < n:
            lead = self.prefix if i else ""
            j = next((i + k for k in self.lengths.get(lead + word[i], ()) if i + k <= n and lead + word[i : i + k] in self.vocab), None)
            out.append(None if j is None else lead + word[i:j])
            i = i + 1 if j is None else j
        return out

    def by_chunks(self) -> bool:
        return True

    def encode_text(self, text: str) -> list[int]:
        out, unk = [], self.vocab.get(self.unk)
        for w in split_spaces(text):
            for p in [None] if len(w) > self.max_chars else self.pieces(w):
                i = unk if p is None else self.vocab[p]
                out += [] if i is None else [i]
        return out

    def decode_expr(self, tokens: Column) -> Column:
        from .decoders import WordPiece as Joined

        return Joined(self.prefix, False).expr(tokens)


class Unigram(Model):
    """Viterbi over the whole text; the earliest start wins ties; an unknown character costs the least score less 10."""

    def __init__(self, pieces: list[tuple[str, float]], unk_id: int = 0):
        self.pieces, self.unk_id = [(p, max(s, -100.0) if s == -math.inf else s) for p, s in pieces], unk_id
        self.vocab = {p: i for i, (p, _) in enumerate(self.pieces)}
        self.score = {p: s for p, s in self.pieces}
        self.longest = max([len(p) for p, _ in pieces], default=1) or 1
        self.ending: dict[str, list[int]] = {}  # by last character: lengths of the pieces of two or more that end so, longest first
        for p in sorted(self.vocab, key=len, reverse=True):
            if len(p) > 1 and len(p) not in (known := self.ending.setdefault(p[-1], [])):
                known.append(len(p))
        self.unknown = min([s for _, s in self.pieces], default=0.0) - 10

    def by_chunks(self) -> bool:
        """Exact if no piece but the space itself holds one: then every path has a border on both sides of a space."""
        return all(p == " " or " " not in p for p in self.vocab)

    def encode_text(self, text: str) -> list[int]:
        n = len(text)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        score, none = self.score, ()
        for end in range(1, n + 1):
            for size in self.ending.get(text[end - 1], none):
                s = score.get(text[end - size : end]) if size <= end else None
                if s is not None and best[end - size] + s > best[end]:
                    best[end], back[end] = best[end - size] + s, end - size
            s = best[end - 1] + score.get(text[end - 1], self.unknown)
            if s > best[end]:
                best[end], back[end] = s, end - 1
        out = []
        while n > 0:
            out.append(self.vocab.get(text[back[n] : n], self.unk_id))
            n = back[n]
        return out[::-1]

    def decode_expr(self, tokens: Column) -> Column:
        return F.array_join(tokens, "")


class WordLevel(Model):
    def __init__(self, vocab: dict[str, int], unk: str = "<unk>"):
        self.vocab, self.unk = dict(vocab), unk

    def by_chunks(self) -> bool:
        return True

    def encode_text(self, text: str) -> list[int]:
        unk = self.vocab.get(self.unk, 0)
        return [self.vocab.get(w, unk) for w in split_spaces(text)]

    def decode_expr(self, tokens: Column) -> Column:
        return F.array_join(tokens, " ")


def _lists(values: list[list[int]], which: np.ndarray, offsets: np.ndarray, valid: list[bool] | None) -> pa.Array:
    """Concatenate values[which[k]] over each row's range of k."""
    size = np.array([len(v) for v in values], np.int64)
    flat = np.array([x for v in values for x in v], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    n = size[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1] - start[:-1][which], n)
    off = ends[offsets].astype(np.int32)
    mask = None if valid is None else pa.array([not v for v in valid])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat[at]), mask=mask)


def encoder(encode: Callable[[str], list[int]], pieces: bool = True) -> Callable[[Column], Column]:
    """A Column function: array<string> (or string, without pieces) -> array<bigint> by encode of each piece. Null stays null."""
    cache: dict[str, list[int]] = {}

    def known(words: list[str]) -> list[list[int]]:
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for w in words:
            got = cache.get(w)
            if got is None:
                got = cache[w] = encode(w)
            out.append(got)
        return out

    def run(x: pa.Array) -> pa.Array:
        valid = x.is_valid().to_pylist()
        if pieces:
            n = np.array([len(v) if ok else 0 for v, ok in zip(x, valid)], np.int64) if x.null_count else np.diff(np.asarray(x.offsets))
            flat = x.flatten()
            offsets = np.concatenate([[0], np.cumsum(n)])
        else:
            flat = x.drop_null()
            offsets = np.concatenate([[0], np.cumsum(np.array(valid, np.int64))])
        coded = flat.dictionary_encode()
        return _lists(known(coded.dictionary.to_pylist()), np.asarray(coded.indices).astype(np.int64), offsets, valid if x.null_count else None)

    return bounded(run, "array<bigint>")


class _Known(dict):
    """What encode gives for lead + chunk, worked out once for each chunk."""

    def __init__(self, encode: Callable[[str], list[int]], lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, chunk: str) -> list[int]:
        got = self[chunk] = self.encode(self.lead + chunk)
        return got


#: A single space between two characters that are not white space; and signs that a text has others.
_BORDER, _OTHER = re.compile(r"(?<!\s) (?!\s|$)"), re.compile(r"[^\S ] | [^\S ]")


def text_encoder(encode: Callable[[str], list[int]], by_chunks: bool = True) -> Callable[[Column], Column]:
    """A Column function: string -> array<bigint> by encode. Null stays null.

    by_chunks: encode may be applied to each chunk from one single space to the next; chunks are looked up in
    a cache that lives as long as the worker, so a repeated word costs one look-up.
    """
    first, later = _Known(encode, ""), _Known(encode, " ")

    def ids(text: str) -> Iterable[list[int]]:
        words = text.split(" ")
        if "" in words or _OTHER.search(text):
            words = _BORDER.split(text)
        return chain((first[words[0]],), map(later.__getitem__, words[1:]))

    def run(x: pa.Array) -> pa.Array:
        size, flat = [0], array("q")
        for text in x.to_pylist():
            if text is not None:
                flat.extend(chain.from_iterable(ids(text) if by_chunks else (encode(text),)))
            size.append(len(flat))
            if len(first) + len(later) > CACHE:
                first.clear()
                later.clear()
        mask = pa.array(np.asarray(x.is_null())) if x.null_count else None
        return pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.frombuffer(flat, np.int64)), mask=mask)

    return bounded(run, "array<bigint>")


class WordIds(dict):
    """What encode gives for each word; emptied when it holds more than CACHE words."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> list[int]:
        got = self[word] = self.encode(word)
        return got

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n, ids): how many ids each word has, and all of them."""
        if len(self) > CACHE:
            self.clear()
        got = [self[w] for w in words]
        return np.fromiter(map(len, got), np.int64, len(got)), np.fromiter(chain.from_iterable(got), np.int64)


def word_encoder(encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """A Column function: string -> array<bigint> by encode of each white-space word. Null stays null."""
    known = WordIds(encode)

    def run(x: pa.Array) -> pa.Array:
        w = Words(x)
        n, ids = known.of(w.distinct)
        at, edge = gathered(n, w.which)
        mask = pa.array(np.asarray(x.is_null())) if x.null_count else None
        return pa.ListArray.from_arrays(pa.array(edge[w.first].astype(np.int32)), pa.array(ids[at]), mask=mask)

    return bounded(run, "array<bigint>")


def byte_level_bpe(vocab: dict[str, int], merges: Iterable[tuple[str, str]], unk: str = "<unk>", add_prefix_space: bool = False) -> ByteLevelBPE:
    return ByteLevelBPE(vocab, merges, unk, add_prefix_space)


def char_bpe(vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = "</w>", unk: str = "<unk>") -> CharBPE:
    return CharBPE(vocab, merges, unk, suffix)


def wordpiece(vocab: dict[str, int], prefix: str = "##", unk: str = "[UNK]") -> WordPiece:
    return WordPiece(vocab, prefix, unk)


def unigram(pieces: list[tuple[str, float]], unk: str = "<unk>") -> Unigram:
    return Unigram(pieces, next((i for i, (p, _) in enumerate(pieces) if p == unk), 0))


def word_level(vocab: dict[str, int], unk: str = "<unk>") -> WordLevel:
    return WordLevel(vocab, unk)


def bpe_fold(pieces: Column, merges: list[tuple[str, str]]) -> Column:
    """Tokens of each piece, joined by U+0001, by applying all merges in rank order; JVM-side, for short causal merge lists.

    Symbols stand between U+0001 and U+0002, so neighbours share no mark and a literal replace is
    left-to-right without overlap.
    """
    if not causal(merges):
        raise ValueError("a merge uses a symbol that no earlier merge made; use BPE")

    def fold(w: Column) -> Column:
        c = F.regexp_replace(w, "(?s)(.)", "\u0001$1\u0002")
        for a, b in merges:
            c = F.replace(c, F.lit(f"\u0001{a}\u0002\u0001{b}\u0002"), F.lit(f"\u0001{a}{b}\u0002"))
        return F.replace(F.regexp_replace(c, "^\u0001|\u0002$", ""), F.lit("\u0002\u0001"), F.lit("\u0001"))

    return F.transform(pieces, fold)


def causal(merges: list[tuple[str, str]]) -> bool:
    made: set[str] = set()
    for a, b in merges:
        if any(len(x) > 1 and x not in made for x in (a, b)):
            return False
        made.add(a + b)
    return True
