"""The Encoding record as a struct of arrays, its operators, and its flat form (one row per token)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let

FIELDS = ("ids", "type_ids", "tokens", "attention_mask", "special_tokens_mask", "offsets", "word_ids", "sequence_ids")
SCHEMA = "struct<ids:array<bigint>,type_ids:array<bigint>,tokens:array<string>,attention_mask:array<bigint>,special_tokens_mask:array<bigint>,offsets:array<struct<start:bigint,end:bigint>>,word_ids:array<bigint>,sequence_ids:array<bigint>>"


def _fill(n: Column, value: int | None) -> Column:
    return F.array_repeat(F.lit(value).cast("long"), n.cast("int"))


TYPES = dict(zip(FIELDS, ("array<bigint>", "array<bigint>", "array<string>", "array<bigint>", "array<bigint>", "array<struct<start:bigint,end:bigint>>", "array<bigint>", "array<bigint>")))


def build(**fields: Column) -> Column:
    """The struct; it remembers its parts, so that an operator on it does not repeat the whole struct for each field."""
    parts = {f: fields[f].cast(TYPES[f]) for f in FIELDS}
    out = F.struct(*[parts[f].alias(f) for f in FIELDS])
    out.__dict__["_parts"] = parts
    return out


def part(e: Column, f: str) -> Column:
    """Field f of an Encoding."""
    return e.__dict__["_parts"][f] if "_parts" in e.__dict__ else e[f]


def from_ids(ids: Column, tokens: Column) -> Column:
    n = F.size(ids)
    empty = F.array().cast("array<bigint>")
    return build(ids=ids, type_ids=_fill(n, 0), tokens=tokens, attention_mask=_fill(n, 1), special_tokens_mask=_fill(n, 0), offsets=F.array().cast("array<struct<start:bigint,end:bigint>>"), word_ids=empty, sequence_ids=_fill(n, 0))


def with_fields(e: Column, **fields: Column) -> Column:
    return build(**{f: fields.get(f, part(e, f)) for f in FIELDS})


def set_type_ids(e: Column, start: int, end: int, value: int) -> Column:
    return with_fields(e, type_ids=F.transform(part(e, "type_ids"), lambda x, i: F.when((i >= start) & (i < end), F.lit(value).cast("long")).otherwise(x)))


def mark_special_tokens(e: Column, specials: list[int]) -> Column:
    s = F.array(*[F.lit(x).cast("long") for x in specials])
    return with_fields(e, special_tokens_mask=F.transform(F.arrays_zip(part(e, "ids").alias("a"), part(e, "special_tokens_mask").alias("b")), lambda x: F.when(F.array_contains(s, x["a"]), F.lit(1).cast("long")).otherwise(x["b"])))


def pad(e: Column, to: int | Column, pad_id: int = 0, pad_token: str = "<pad>", left: bool = False) -> Column:
    """Offsets and word ids are not padded."""
    to = F.lit(to) if isinstance(to, int) else to
    n = F.greatest(F.lit(0), to - F.size(part(e, "ids"))).cast("int")
    put = lambda c, fill: F.concat(fill, c) if left else F.concat(c, fill)
    values = {"ids": pad_id, "type_ids": 0, "attention_mask": 0, "special_tokens_mask": 1, "sequence_ids": None}
    return with_fields(e, tokens=put(part(e, "tokens"), F.array_repeat(F.lit(pad_token), n)), **{f: put(part(e, f), _fill(n, v)) for f, v in values.items()})


def _window(e: Column, start: Column, n: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    cut = {f: F.slice(part(e, f), (start + 1).cast("int"), F.greatest(F.lit(0), F.least(n, F.size(part(e, f)) - start)).cast("int")) for f in fields}
    return build(**cut) if fields == FIELDS else F.struct(*[c.cast(TYPES[f]).alias(f) for f, c in cut.items()])


def truncate(e: Column, most: int) -> Column:
    return _window(e, F.lit(0), F.lit(most))


def overflow(e: Column, most: int, stride: int = 0, fields: tuple[str, ...] = FIELDS) -> Column:
    """array of the windows (only `fields` of them) beyond the first `most` tokens; without a stride they are one remainder."""
    n = F.size(part(e, "ids"))
    none = F.array().cast("array<struct<" + ",".join(f"{f}:{TYPES[f]}" for f in fields) + ">>")
    if stride == 0:
        return F.when(n > most, F.array(_window(e, F.lit(most), n - most, fields))).otherwise(none)
    if stride >= most:
        raise ValueError("stride must be less than max_length")
    # window k >= 1 starts at most + (k-1)(most-stride) - stride while that is less than n - stride
    starts = F.sequence(F.lit(most - stride), F.greatest(F.lit(most - stride), n - stride - 1), F.lit(most - stride))
    return F.when(n > most, let(F.struct(*[part(e, f).alias(f) for f in fields]), lambda x: F.transform(starts, lambda s: _window(x, s, F.lit(most), fields)))).otherwise(none)


def merge(a: Column, b: Column, type_id: int) -> Column:
    return build(**{f: F.concat(part(a, f), _fill(F.size(part(b, f)), type_id) if f == "type_ids" else part(b, f)) for f in FIELDS})


def token_to_chars(e: Column, i: Column) -> Column:
    return F.get(part(e, "offsets"), i)


def token_to_word(e: Column, i: Column) -> Column:
    return F.get(part(e, "word_ids"), i)


def token_to_sequence(e: Column, i: Column) -> Column:
    return F.get(part(e, "sequence_ids"), i)


def _at(hits: Column) -> Column:
    """Index of the first true; null if there is none."""
    return F.nullif(F.array_position(hits, F.lit(True)), F.lit(0).cast("long")) - 1


def char_to_token(e: Column, pos: Column, sequence: int | None = None) -> Column:
    here = lambda o: (o["start"] <= pos) & (pos < o["end"])
    if sequence is None:
        return _at(F.transform(part(e, "offsets"), here))
    return _at(F.zip_with(part(e, "offsets"), part(e, "sequence_ids"), lambda o, s: here(o) & (s == sequence)))


def word_token_indices(e: Column, word: Column) -> Column:
    """Indices of all tokens of a word, whatever their sequence."""
    return F.filter(F.transform(part(e, "word_ids"), lambda w, i: F.when(w == word, i.cast("long"))), lambda i: i.isNotNull())


def _span(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def word_to_tokens(e: Column, word: Column, sequence: int = 0) -> Column:
    """{start, end} of a word's tokens, end exclusive; null if the sequence has no such word."""
    hits = F.zip_with(part(e, "word_ids"), part(e, "sequence_ids"), lambda w, s: (w == word) & (s == sequence))
    return let(hits, lambda h: _span(_at(h), F.size(h) - _at(F.reverse(h))))


def word_to_chars(e: Column, word: Column, sequence: int = 0) -> Column:
    """{start, end} of the characters under a word's tokens; null if there are none."""
    under = lambda s: F.slice(part(e, "offsets"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return let(word_to_tokens(e, word, sequence), lambda s: F.when(s.isNotNull(), let(under(s), lambda u: _span(F.array_min(u["start"]), F.array_max(u["end"])))))


def n_words(e: Column) -> Column:
    return F.coalesce(F.array_max(part(e, "word_ids")) + 1, F.lit(0).cast("long"))


FLAT = {"ids": "id", "tokens": "token", "type_ids": "type_id", "attention_mask": "attention", "special_tokens_mask": "special", "offsets": "", "word_ids": "word_id", "sequence_ids": "seq_id"}


def to_flat(df: DataFrame, key: str, encoding: str = "encoding", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, pos, id, token, type_id, attention, special, start, end, word_id, seq_id), or only what comes of `fields`."""
    e, t = F.col(encoding), F.col("t")
    z = df.select(key, F.posexplode(F.arrays_zip(*[e[f].alias(f) for f in fields])).alias("pos", "t"))
    cols = [[t[f]["start"].alias("start"), t[f]["end"].alias("end")] if f == "offsets" else [t[f].alias(n)] for f, n in FLAT.items() if f in fields]
    return z.select(key, F.col("pos").cast("long").alias("pos"), *[c for x in cols for c in x])


def to_nested(flat: DataFrame, key: str) -> DataFrame:
    cols = ("id", "type_id", "token", "attention", "special", "start", "end", "word_id", "seq_id")
    g = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("t"))
    pick = lambda c: F.transform("t", lambda x: x[c])
    offsets = F.filter(F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), lambda o: o["start"].isNotNull())
    return g.select(key, build(ids=pick("id"), type_ids=pick("type_id"), tokens=pick("token"), attention_mask=pick("attention"), special_tokens_mask=pick("special"), offsets=offsets, word_ids=pick("word_id"), sequence_ids=pick("seq_id")).alias("encoding"))


def word_spans(flat: DataFrame, key: str) -> DataFrame:
    """For each word: its tokens [first, last) and characters [start, end)."""
    return flat.where("word_id is not null").groupBy(key, "seq_id", "word_id").agg(F.min("pos").alias("first_token"), (F.max("pos") + 1).alias("end_token"), F.min("start").alias("first_char"), F.max("end").alias("end_char"))
