"""Decoders: array<string> of tokens -> string."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import chars_to_bytes, quote

#: Marks that lose the space before them; quotes lose the space on both sides.
_CLOSERS = ".,!?:;"


def literal(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clean_up(c: Column) -> Column:
    """Detokenization clean-up; also folds white space, so line breaks go."""
    tight = [(f" {x}", x) for x in _CLOSERS]
    both = [p for q in "\"'" for p in ((f"{q} ", q), (f" {q}", q))]
    paired = [p for a, b in ("()", "[]") for p in ((f"{a} ", a), (f" {b}", b))]
    c = literal(c, [*tight, *both, *paired, (" - ", "-")])
    return F.regexp_replace(F.regexp_replace(c, "(?U)\\s+", " "), "^ | $", "")


class Decoder:
    def expr(self, tokens: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Fuse(Decoder):
    def expr(self, tokens: Column) -> Column:
        return F.array_join(tokens, "")


@dataclass(frozen=True)
class ByteLevel(Decoder):
    def expr(self, tokens: Column) -> Column:
        return chars_to_bytes(F.array_join(tokens, ""))


@dataclass(frozen=True)
class Metaspace(Decoder):
    replacement: str = "\u2581"
    add_prefix_space: bool = True

    def expr(self, tokens: Column) -> Column:
        c = F.replace(F.array_join(tokens, ""), F.lit(self.replacement), F.lit(" "))
        return F.regexp_replace(c, "^ ", "") if self.add_prefix_space else c


@dataclass(frozen=True)
class WordPiece(Decoder):
    prefix: str = "##"
    cleanup: bool = True

    def expr(self, tokens: Column) -> Column:
        n = len(self.prefix)
        parts = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit(self.prefix)), F.substr(t, F.lit(n + 1))).otherwise(F.concat(F.lit(" "), t)))
        joined = F.array_join(parts, "")
        # a space only stands where something came before it
        lead = F.when(~F.startswith(F.coalesce(F.get(tokens, F.lit(0)), F.lit("")), F.lit(self.prefix)), F.substr(joined, F.lit(2))).otherwise(joined)
        c = F.when(F.size(tokens) > 0, lead).otherwise(F.lit(""))
        return literal(c, [*[(f" {x}", x) for x in _CLOSERS], (" '", "'"), ("' ", "'")]) if self.cleanup else c


@dataclass(frozen=True)
class BPE(Decoder):
    suffix: str = "</w>"

    def expr(self, tokens: Column) -> Column:
        return F.regexp_replace(F.replace(F.array_join(tokens, ""), F.lit(self.suffix), F.lit(" ")), "(?U)\\s+$", "")


@dataclass(frozen=True)
class Replace(Decoder):
    pattern: str
    content: str

    def expr(self, tokens: Column) -> Column:
        return F.replace(F.array_join(tokens, ""), F.lit(self.pattern), F.lit(self.content))


@dataclass(frozen=True)
class CTC(Decoder):
    """Repeats fold into one; the pad token and the delimiter end a run."""

    pad: str = "<pad>"
    delimiter: str | None = "|"

    def expr(self, tokens: Column) -> Column:
        shifted = F.concat(F.array(F.lit(None).cast("string")), tokens)
        pairs = F.arrays_zip(tokens.alias("t"), F.slice(shifted, 1, F.size(tokens)).alias("p"))

        def shown(x: Column) -> Column:
            t = x["t"]
            out = F.when(t == self.pad, F.lit(""))
            if self.delimiter is not None:
                out = out.when(t == self.delimiter, F.lit(" "))
            return out.when(t == F.coalesce(x["p"], F.lit("\u0000\u0000")), F.lit("")).otherwise(t)

        return F.array_join(F.transform(pairs, shown), "")


@dataclass(frozen=True)
class Strip(Decoder):
    content: str = " "
    start: int = 0
    stop: int = 0

    def expr(self, tokens: Column) -> Column:
        x = quote(self.content)
        c = F.regexp_replace(F.array_join(tokens, ""), f"^(?:{x}){{0,{self.start}}}", "")
        return F.regexp_replace(c, f"(?:{x}){{0,{self.stop}}}\\z", "") if self.stop else c


@dataclass(frozen=True)
class Sequence(Decoder):
    parts: tuple[Decoder, ...] = ()

    def expr(self, tokens: Column) -> Column:
        for p in self.parts:
            tokens = F.array(p.expr(tokens))
        return F.array_join(tokens, "")
