"""Post-processors, truncation and padding: array<bigint> -> array<bigint>."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ids(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<bigint>")


class PostProcessor:
    def expr(self, a: Column, b: Column | None = None) -> Column:
        raise NotImplementedError

    def added(self, pair: bool) -> int:
        return 0


@dataclass(frozen=True)
class Template(PostProcessor):
    """$A and $B stand for the sequences, <...> and [...] for special tokens; anything else is skipped."""

    single: str = "<s> $A </s>"
    pair: str | None = None
    specials: tuple[tuple[str, int], ...] = ()

    def expr(self, a: Column, b: Column | None = None) -> Column:
        table, parts = dict(self.specials), []
        for piece in re.findall(r"\$A|\$B|<[^>]*>|\[[^\]]*\]", self.pair if b is not None and self.pair else self.single):
            if piece == "$A":
                parts.append(a)
            elif piece == "$B":
                parts += [b] if b is not None else []
            elif piece in table:
                parts.append(ids(table[piece]))
        return F.concat(*parts) if parts else ids()

    def added(self, pair: bool) -> int:
        text = self.pair if pair and self.pair else self.single
        return sum(t in text for t, _ in self.specials)


@dataclass(frozen=True)
class BertProcessing(PostProcessor):
    cls: int = 101
    sep: int = 102

    def expr(self, a: Column, b: Column | None = None) -> Column:
        return F.concat(ids(self.cls), a, ids(self.sep), *([] if b is None else [b, ids(self.sep)]))

    def added(self, pair: bool) -> int:
        return 3 if pair else 2


@dataclass(frozen=True)
class RobertaProcessing(PostProcessor):
    bos: int = 0
    eos: int = 2

    def expr(self, a: Column, b: Column | None = None) -> Column:
        return F.concat(ids(self.bos), a, ids(self.eos), *([] if b is None else [ids(self.eos), b, ids(self.eos)]))

    def added(self, pair: bool) -> int:
        return 4 if pair else 2


@dataclass(frozen=True)
class Sequence(PostProcessor):
    """The pair is used up by the first processor."""

    parts: tuple[PostProcessor, ...] = ()

    def expr(self, a: Column, b: Column | None = None) -> Column:
        for p in self.parts:
            a, b = p.expr(a, b), None
        return a

    def added(self, pair: bool) -> int:
        return sum(p.added(pair) for p in self.parts)


def default_postprocessor() -> PostProcessor:
    return Template("<s> $A </s>", "<s> $A </s> $B </s>", (("<s>", 0), ("</s>", 2)))


def truncate(a: Column, b: Column | None, most: int, strategy: str = "longest_first") -> tuple[Column, Column | None]:
    """only_first, only_second or longest_first (A shrinks while it is at least as long as B), in closed form."""
    n, m = F.size(a), F.lit(0) if b is None else F.size(b)
    if strategy == "only_first":
        na, nb = F.greatest(F.lit(0), F.least(n, F.lit(most) - m)), m
    elif strategy == "only_second":
        na, nb = n, F.greatest(F.lit(0), F.least(m, F.lit(most) - n))
    elif strategy == "longest_first":
        over = F.greatest(F.lit(0), n + m - most)
        first = F.least(over, F.abs(n - m))  # the longer one shrinks alone until both are level
        left = over - first
        ca, cb = F.when(n >= m, first).otherwise(0), F.when(n < m, first).otherwise(0)
        na, nb = F.greatest(F.lit(0), n - ca - F.ceil(left / 2).cast("int")), F.greatest(F.lit(0), m - cb - F.floor(left / 2).cast("int"))
    else:
        raise ValueError(f"unknown truncation strategy {strategy!r}")
    return F.slice(a, F.lit(1), na), None if b is None else F.slice(b, F.lit(1), nb)


@dataclass(frozen=True)
class Padding:
    """Fixed(length), or without a length to the longest of the batch: of the whole table, here."""

    length: int | None = None

    def target(self, df: DataFrame, ids: Column) -> int:
        if self.length is not None:
            return self.length
        return df.agg(F.max(F.size(ids))).first()[0] or 0


def pad(a: Column, to: int | Column, pad_id: int = 0, left: bool = False) -> Column:
    to = F.lit(to) if isinstance(to, int) else to
    fill = F.array_repeat(F.lit(pad_id).cast("long"), F.greatest(F.lit(0), to - F.size(a)).cast("int"))
    return F.concat(fill, a) if left else F.concat(a, fill)
