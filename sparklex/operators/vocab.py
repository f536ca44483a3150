"""Vocabulary lookups: as joins on tables, or as a Column function for a model's own vocabulary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.chars import token_bytes

#: A vocabulary table up to this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class SpecialTokens:
    unk: str | None = "<unk>"
    bos: str | None = "<s>"
    eos: str | None = "</s>"
    pad: str | None = "<pad>"
    sep: str | None = None
    cls: str | None = None
    mask: str | None = None

    def named(self) -> dict[str, str]:
        return {k: v for k, v in self.__dict__.items() if v is not None}


@dataclass(frozen=True)
class AddedToken:
    content: str
    id: int = 0
    special: bool = False
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = False


def vocab_table(spark: SparkSession, vocab: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(t, i) for t, i in sorted(vocab.items(), key=lambda x: x[1])], "token string, id long")


def _small(df: DataFrame, rows: int | None) -> DataFrame:
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def token_to_id(tokens: DataFrame, vocab: DataFrame, unk: int | None = None, rows: int | None = None) -> DataFrame:
    """tokens (..., token) with id; misses get unk. rows: the known size of vocab."""
    out = tokens.join(_small(vocab.select("token", "id"), rows), "token", "left")
    return out if unk is None else out.withColumn("id", F.coalesce("id", F.lit(unk).cast("long")))


def id_to_token(ids: DataFrame, vocab: DataFrame, rows: int | None = None) -> DataFrame:
    return ids.join(_small(vocab.select("id", "token"), rows), "id", "left")


def out_of_vocabulary(tokens: DataFrame, vocab: DataFrame, rows: int | None = None) -> DataFrame:
    return tokens.join(_small(vocab.select("token"), rows), "token", "left_anti")


def tokens_of(names: dict[int, str], skip: frozenset[int] = frozenset(), drop: bool = False) -> Callable[[Column], Column]:
    """array<bigint> -> array<string>; unknown or skipped ids become null, or go if drop is set."""

    def run(x: pa.Array) -> pa.Array:
        flat, n = x.flatten(), np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64)
        coded = flat.dictionary_encode()  # each id of a batch is looked up once
        known = pa.array([None if i in skip else names.get(i) for i in coded.dictionary.to_pylist()], pa.string())
        out = known.take(coded.indices)
        edge = np.concatenate([[0], np.cumsum(n)])
        if drop:
            ok = np.asarray(out.is_valid())
            edge = np.concatenate([[0], np.cumsum(ok)])[edge]
            out = out.drop_null()
        return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), out, mask=pa.array(np.asarray(x.is_null())) if x.null_count else None)

    return bounded(run, "array<string>")


def byte_texts(names: dict[int, str], skip: frozenset[int] = frozenset()) -> Callable[[Column], Column]:
    """array<bigint> -> string: the bytes that byte-level tokens stand for, read as UTF-8; unknown and skipped ids vanish."""
    table = {i: token_bytes(t) for i, t in names.items() if i not in skip}
    known = np.array(sorted(table), np.int64)
    values = pa.array([*(table[i] for i in known.tolist()), b""], pa.binary())

    def run(x: pa.Array) -> pa.Array:
        ids = np.asarray(pc.fill_null(x.flatten(), -1))
        at = np.searchsorted(known, ids)
        hit = known[np.minimum(at, len(known) - 1)] == ids if len(known) else np.zeros(len(ids), bool)
        flat = values.take(pa.array(np.where(hit, at, len(known))))
        edge = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64))])
        off = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, flat.offset * 4)[edge] if len(flat) else np.zeros(len(edge), np.int32)
        out = pa.StringArray.from_buffers(len(x), pa.py_buffer(np.ascontiguousarray(off)), flat.buffers()[2] or pa.py_buffer(b""))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # some row is not UTF-8
            out = pa.array([r.decode("utf-8", "replace") for r in out.view(pa.binary()).to_pylist()], pa.string())
        return pc.if_else(x.is_valid(), out, pa.scalar(None, pa.string())) if x.null_count else out

    return bounded(run, "string")


def special_mask(ids: Column, specials: list[int]) -> Column:
    return F.transform(ids, lambda i: F.when(F.array_contains(F.array(*[F.lit(s).cast("long") for s in specials]) if specials else F.array().cast("array<bigint>"), i), 1).otherwise(0).cast("long"))
