"""Pre-tokenizers: string -> array<string>, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.chars import CJK_SPLIT, GPT2, PUNCT, encode_bytes, gpt2_pieces, scripts_pattern, split_spaces
from ..functions.columns import bytes_to_chars, find_all, full, let, linear_regex, matches_empty, quote


def byte_pieces(text: str) -> list[str]:
    return [encode_bytes(p) for p in gpt2_pieces(text)]


class PreTokenizer:
    def expr(self, c: Column) -> Column:
        raise NotImplementedError

    def scalar(self) -> Callable[[str], list[str]] | None:
        """The same for one string, if a text may be cut before each single space between two other characters."""
        return None


@dataclass(frozen=True)
class Whitespace(PreTokenizer):
    def expr(self, c: Column) -> Column:
        return find_all(c, "(?U)\\S+")

    def scalar(self) -> Callable[[str], list[str]] | None:
        return split_spaces


WhitespaceSplit = Whitespace


@dataclass(frozen=True)
class Gpt2(PreTokenizer):
    def expr(self, c: Column) -> Column:
        return find_all(c, "(?U)" + GPT2)

    def scalar(self) -> Callable[[str], list[str]] | None:
        return gpt2_pieces


@dataclass(frozen=True)
class ByteLevel(PreTokenizer):
    add_prefix_space: bool = False

    def expr(self, c: Column) -> Column:
        if self.add_prefix_space:
            c = F.when((c != "") & ~F.startswith(c, F.lit(" ")), F.concat(F.lit(" "), c)).otherwise(c)
        return F.transform(Gpt2().expr(c), bytes_to_chars)

    def scalar(self) -> Callable[[str], list[str]] | None:
        return None if self.add_prefix_space else byte_pieces


@dataclass(frozen=True)
class Metaspace(PreTokenizer):
    replacement: str = "\u2581"
    add_prefix_space: bool = True

    def expr(self, c: Column) -> Column:
        if self.add_prefix_space:
            c = F.concat(F.lit(self.replacement), c)
        return find_all(F.replace(c, F.lit(" "), F.lit(self.replacement)), "(?U)\\S+")


@dataclass(frozen=True)
class Punctuation(PreTokenizer):
    def expr(self, c: Column) -> Column:
        return find_all(c, f"[{PUNCT}]|[^{PUNCT}]+")


@dataclass(frozen=True)
class Digits(PreTokenizer):
    individual: bool = False

    def expr(self, c: Column) -> Column:
        return find_all(c, "[0-9]|[^0-9]+" if self.individual else "[0-9]+|[^0-9]+")


@dataclass(frozen=True)
class Split(PreTokenizer):
    """Matches of pattern, or with invert the gaps between them. A pattern that is not of the dialect of linear_regex leaves the text whole.

    Patterns that match the empty string are refused: engines differ on them.
    """

    pattern: str
    behavior: str | None = None  # None: plain; Removed, Isolated, MergedWithPrevious, MergedWithNext, Contiguous
    invert: bool = False

    def expr(self, c: Column) -> Column:
        p = linear_regex(self.pattern)
        whole = F.when(c.isNotNull(), F.array(c))
        if p is None or matches_empty(p):
            return whole
        gaps = lambda q: F.split(c, q, -1)
        if self.behavior in (None, "Removed"):
            got = full(gaps(p)) if self.invert else find_all(c, p)
            return got if self.behavior is None else F.when(F.regexp_like(c, F.lit(p)), got).otherwise(whole)
        run = p if self.behavior in ("Isolated", "MergedWithNext") else f"{p[:5]}(?:{p[5:]})+"

        def parts(both: Column) -> Column:
            """both: hits, and gaps, of which there is one more."""
            hit = lambda i: F.coalesce(F.get(both["hits"], i), F.lit(""))
            if self.behavior == "MergedWithPrevious":
                return F.transform(both["gaps"], lambda g, i: F.concat(g, hit(i)))
            if self.behavior == "MergedWithNext":
                return F.transform(both["gaps"], lambda g, i: F.concat(hit(i - 1), g))
            return F.flatten(F.transform(both["gaps"], lambda g, i: F.array(g, hit(i))))

        made = let(F.struct(find_all(c, run).alias("hits"), gaps(run).alias("gaps")), lambda both: full(parts(both)))
        return F.when(F.regexp_like(c, F.lit(p)), made).otherwise(whole)


@dataclass(frozen=True)
class Bert(PreTokenizer):
    def expr(self, c: Column) -> Column:
        return find_all(c, f"(?U)[{CJK_SPLIT}]|[{PUNCT}&&[^\\s]]|[^\\s{CJK_SPLIT}{PUNCT}]+")


@dataclass(frozen=True)
class CharDelimiter(PreTokenizer):
    delimiter: str = " "

    def expr(self, c: Column) -> Column:
        return full(F.split(c, quote(self.delimiter), -1))


@dataclass(frozen=True)
class UnicodeScripts(PreTokenizer):
    def expr(self, c: Column) -> Column:
        return find_all(c, scripts_pattern(True))


@dataclass(frozen=True)
class Sequence(PreTokenizer):
    parts: tuple[PreTokenizer, ...] = ()

    def expr(self, c: Column) -> Column:
        out = F.array(c)
        for p in self.parts:
            out = F.flatten(F.transform(out, p.expr))
        return out
