"""Normalizers: string -> string. expr() builds a Column, apply() is the same rule for one string."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.chars import CJK_NORM, MARKS, SPACES, is_space

_MARKS_PY = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")


class Normalizer:
    def expr(self, c: Column) -> Column:
        raise NotImplementedError

    def apply(self, text: str) -> str:
        raise NotImplementedError


def _form(c: Column, form: str) -> Column:
    """Normal forms by an Arrow UDF; ASCII is unchanged by all of them, so only other rows reach it."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in x.to_pylist()], pa.string())

    other = F.when(F.regexp_like(c, F.lit("[^\\x{0}-\\x{7f}]")), c)
    return F.coalesce(bounded(run, "string")(other), c)


@dataclass(frozen=True)
class Form(Normalizer):
    """NFC, NFD, NFKC or NFKD."""

    name: str = "NFC"

    def expr(self, c: Column) -> Column:
        return _form(c, self.name)

    def apply(self, text: str) -> str:
        return unicodedata.normalize(self.name, text)


@dataclass(frozen=True)
class Lowercase(Normalizer):
    def expr(self, c: Column) -> Column:
        return F.lower(c)

    def apply(self, text: str) -> str:
        return text.lower()


@dataclass(frozen=True)
class Strip(Normalizer):
    def expr(self, c: Column) -> Column:
        return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")

    def apply(self, text: str) -> str:
        return text.strip("".join(map(chr, SPACES)))


@dataclass(frozen=True)
class StripAccents(Normalizer):
    """Decompose, drop combining marks, leave the rest decomposed."""

    def expr(self, c: Column) -> Column:
        return F.regexp_replace(_form(c, "NFD"), f"[{MARKS}]", "")

    def apply(self, text: str) -> str:
        return _MARKS_PY.sub("", unicodedata.normalize("NFD", text))


@dataclass(frozen=True)
class Replace(Normalizer):
    pattern: str
    replacement: str

    def expr(self, c: Column) -> Column:
        if not self.pattern:  # between all characters, and at both ends
            return F.concat(F.lit(self.replacement), F.regexp_replace(c, "(?s)(.)", "$1" + self.replacement.replace("\\", "\\\\").replace("$", "\\$")))
        return F.replace(c, F.lit(self.pattern), F.lit(self.replacement))

    def apply(self, text: str) -> str:
        return text.replace(self.pattern, self.replacement)


@dataclass(frozen=True)
class Prepend(Normalizer):
    text: str

    def expr(self, c: Column) -> Column:
        return F.concat(F.lit(self.text), c)

    def apply(self, text: str) -> str:
        return self.text + text


@dataclass(frozen=True)
class Append(Normalizer):
    text: str

    def expr(self, c: Column) -> Column:
        return F.concat(c, F.lit(self.text))

    def apply(self, text: str) -> str:
        return text + self.text


@dataclass(frozen=True)
class Bert(Normalizer):
    clean_text: bool = True
    handle_chinese_chars: bool = True
    strip_accents: bool | None = None
    lowercase: bool = True

    def _strip(self) -> bool:
        return self.lowercase if self.strip_accents is None else self.strip_accents

    def expr(self, c: Column) -> Column:
        if self.clean_text:
            c = F.regexp_replace(F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]", ""), "(?U)\\s", " ")
        if self.handle_chinese_chars:
            c = F.regexp_replace(c, f"([{CJK_NORM}])", " $1 ")
        c = StripAccents().expr(_form(c, "NFC")) if self._strip() else _form(c, "NFC")
        return F.lower(c) if self.lowercase else c

    def apply(self, text: str) -> str:
        if self.clean_text:
            text = "".join(" " if is_space(x) else x for x in text if x in "\t\n\r" or not (ord(x) < 32 or 127 <= ord(x) <= 159))
        if self.handle_chinese_chars:
            text = re.sub("([" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), CJK_NORM) + "])", r" \1 ", text)
        text = unicodedata.normalize("NFC", text)
        text = StripAccents().apply(text) if self._strip() else text
        return text.lower() if self.lowercase else text


@dataclass(frozen=True)
class Precompiled(Normalizer):
    """Literal replacements, one after the other."""

    pairs: tuple[tuple[str, str], ...] = ()

    def expr(self, c: Column) -> Column:
        for a, b in self.pairs:
            c = Replace(a, b).expr(c)
        return c

    def apply(self, text: str) -> str:
        for a, b in self.pairs:
            text = text.replace(a, b)
        return text


@dataclass(frozen=True)
class Sequence(Normalizer):
    parts: tuple[Normalizer, ...] = ()

    def expr(self, c: Column) -> Column:
        for p in self.parts:
            c = p.expr(c)
        return c

    def apply(self, text: str) -> str:
        for p in self.parts:
            text = p.apply(text)
        return text


def default_normalizer() -> Normalizer:
    return Form("NFC")


def bert_normalizer() -> Normalizer:
    return Sequence((Form("NFC"), Lowercase(), StripAccents(), Strip()))
