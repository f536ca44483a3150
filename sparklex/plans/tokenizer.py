"""The tokenizer facade: an immutable spec whose methods build Columns and DataFrames."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encoding as E
from ..operators.decoders import ByteLevel as ByteDecoder
from ..operators.decoders import Decoder, Fuse, clean_up
from ..functions.batches import Words, bounded, gathered
from ..operators.models import BPE, CACHE, WordIds, encoder, text_encoder, word_encoder
from ..operators.normalizers import Form, Normalizer
from ..operators.postprocessors import PostProcessor
from ..operators.pretokenizers import ByteLevel, PreTokenizer, Whitespace
from ..operators.vocab import AddedToken, byte_texts, special_mask, tokens_of
from ..sources import tokenizer_json as J
from .chat import apply_template
from .training import BpeTrainer

#: Which name a special token has, by what its lower-cased text contains; the first that fits.
_NAMED = (("unk", ("unk",)), ("bos", ("<s>", "bos")), ("eos", ("</s>", "eos")), ("pad", ("pad",)), ("sep", ("sep",)), ("cls", ("cls",)), ("mask", ("mask",)))


def name_specials(added: list[AddedToken]) -> dict[str, str]:
    out: dict[str, str] = {}
    for t in added:
        if t.special:
            low = t.content.lower()
            name = next((n for n, marks in _NAMED if any(m in low for m in marks)), None)
            if name:
                out[name] = t.content
    return out


class AddedMatcher:
    """Splits a piece at added tokens: the longest that fits at the front, else the model up to the next one."""

    def __init__(self, added: tuple[AddedToken, ...]):
        self.added = sorted(added, key=lambda t: (-len(t.content), t.content))

    @staticmethod
    def find(text: str, t: AddedToken) -> int | None:
        """The first occurrence, if its flags allow it there."""
        i = text.find(t.content)
        if i < 0 or not t.content:
            return None
        j = i + len(t.content)
        before, after = text[i - 1 : i], text[j : j + 1]
        if t.single_word and (before.isalnum() or after.isalnum()):
            return None
        if (t.lstrip and before and not before.isspace()) or (t.rstrip and after and not after.isspace()):
            return None
        return i

    def encode(self, text: str, model: Callable[[str], list[int]]) -> list[int]:
        out: list[int] = []
        while text:
            at = [(i, t) for t in self.added if (i := self.find(text, t)) is not None]
            here = next((t for i, t in at if i == 0), None)
            if here is not None:
                out.append(here.id)
                text = text[len(here.content) :]
                continue
            cut = min((i for i, _ in at), default=len(text))
            out += model(text[:cut])
            text = text[cut:]
        return out


_ALIGNED = "struct<ids:array<bigint>,tokens:array<string>,offsets:array<struct<start:bigint,end:bigint>>,word_ids:array<bigint>>"


@dataclass(frozen=True)
class Tokenizer:
    model: BPE
    normalizer: Normalizer | None = field(default_factory=lambda: Form("NFC"))
    pre_tokenizer: PreTokenizer | None = field(default_factory=ByteLevel)
    post_processor: PostProcessor | None = None
    decoder: Decoder | None = field(default_factory=ByteDecoder)
    added: tuple[AddedToken, ...] = ()
    named: tuple[tuple[str, str], ...] = ()
    model_max_length: int = 512
    padding_side: str = "right"
    truncation_side: str = "right"
    chat_template: str | None = None
    padding: tuple | None = None
    truncation: tuple | None = None

    # ---- loading and saving

    @classmethod
    def from_str(cls, text: str | bytes) -> "Tokenizer":
        v = json.loads(text)
        m = v["model"]
        model = BPE(J.vocab_of(m["vocab"]), J.merges_of(m.get("merges") or []))
        added = J.read_added(v.get("added_tokens") or [])
        specials = {t.content: t.id for t in added if t.special}
        return cls(model, J.read_normalizer(v.get("normalizer")), J.read_pretokenizer(v.get("pre_tokenizer")), J.read_postprocessor(v.get("post_processor"), specials), J.read_decoder(v.get("decoder")), tuple(added), tuple(sorted(name_specials(added).items())))

    @classmethod
    def from_file(cls, path: str) -> "Tokenizer":
        return cls.from_str(Path(path).read_text(encoding="utf-8"))

    @classmethod
    def from_pretrained(cls, where: str, hub, revision: str = "main", local_files_only: bool = False) -> "Tokenizer":
        at = hub.resolve(where, revision, local_files_only)
        t, config = cls.from_file(str(at)), at.parent / "tokenizer_config.json"
        if config.exists():
            c = json.loads(config.read_text(encoding="utf-8"))
            t = replace(t, model_max_length=int(c.get("model_max_length") or 512), chat_template=c.get("chat_template"))
        return t

    def to_json(self) -> dict:
        return {
            "version": "1.0",
            "added_tokens": [{f: getattr(t, f) for f in ("id", "content", "single_word", "lstrip", "rstrip", "normalized", "special")} for t in self.added],
            "normalizer": J.write_normalizer(self.normalizer),
            "pre_tokenizer": J.write_pretokenizer(self.pre_tokenizer),
            "post_processor": J.write_postprocessor(self.post_processor),
            "decoder": J.write_decoder(self.decoder),
            "model": {"type": "BPE", "vocab": self.model.vocab, "merges": [f"{a} {b}" for a, b in self.model.merges]},
        }

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_json(), ensure_ascii=False, indent=2), encoding="utf-8")

    def save_pretrained(self, folder: str) -> None:
        top = Path(folder)
        top.mkdir(parents=True, exist_ok=True)
        self.save(str(top / "tokenizer.json"))
        named = {f"{k}_token": v for k, v in self.named}
        (top / "special_tokens_map.json").write_text(json.dumps(named, ensure_ascii=False), encoding="utf-8")
        (top / "tokenizer_config.json").write_text(json.dumps({"model_max_length": self.model_max_length, "chat_template": self.chat_template, **named}, ensure_ascii=False), encoding="utf-8")

    # ---- vocabulary

    def get_vocab(self) -> dict[str, int]:
        return self.model.vocab | {t.content: t.id for t in self.added}

    @property
    def vocab_size(self) -> int:
        return len(self.get_vocab())

    @property
    def special_tokens(self) -> dict[str, int]:
        return {t.content: t.id for t in self.added if t.special}

    @property
    def all_special_tokens(self) -> list[str]:
        return [t for t, _ in sorted(self.special_tokens.items(), key=lambda x: x[1])]

    @property
    def all_special_ids(self) -> list[int]:
        return sorted(self.special_tokens.values())

    @property
    def is_fast(self) -> bool:
        return True

    def special(self, name: str) -> tuple[str, int] | None:
        """(token, id) of bos, eos, pad, unk, sep, cls or mask."""
        t = dict(self.named).get(name)
        return None if t is None else (t, self.get_vocab()[t])

    def token_to_id(self, token: str) -> int | None:
        return self.get_vocab().get(token)

    def id_to_token(self, i: int) -> str | None:
        return {v: k for k, v in self.get_vocab().items()}.get(i)

    def add_tokens(self, tokens: list[AddedToken | str], special: bool = False) -> "Tokenizer":
        """New tokens get consecutive ids; known ones keep theirs."""
        have, out = self.get_vocab(), list(self.added)
        nxt = max(have.values(), default=-1) + 1
        for t in tokens:
            t = AddedToken(t, special=special) if isinstance(t, str) else t
            if t.content in have:
                i = have[t.content]
            else:
                i, nxt = nxt, nxt + 1
            have[t.content] = i
            out = [x for x in out if x.content != t.content] + [replace(t, id=i)]
        return replace(self, added=tuple(out), named=tuple(sorted(name_specials(out).items())))

    def with_parts(self, **parts) -> "Tokenizer":
        return replace(self, **parts)

    # ---- columns

    def pieces(self, c: Column) -> Column:
        c = c if self.normalizer is None else self.normalizer.expr(c)
        return F.array(c) if self.pre_tokenizer is None else self.pre_tokenizer.expr(c)

    def encode(self, c: Column) -> Column:
        """ids of a text, added tokens taken whole; no post-processor."""
        match, model = AddedMatcher(self.added), self.model
        return self._encoder((lambda w: match.encode(w, model.encode_text)) if self.added else model.encode_text)(c)

    def _encoder(self, encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
        """Texts to ids by encode of each piece; pieces are cut in the UDF where the pre-tokenizer has a form for that."""
        if isinstance(self.pre_tokenizer, Whitespace):
            words = word_encoder(encode)
            return lambda c: words(c if self.normalizer is None else self.normalizer.expr(c))
        split = None if self.pre_tokenizer is None else self.pre_tokenizer.scalar()
        if split is None:
            return lambda c: encoder(encode)(self.pieces(c))
        whole = text_encoder(lambda t: [i for p in split(t) for i in encode(p)])
        return lambda c: whole(c if self.normalizer is None else self.normalizer.expr(c))

    def tokenize(self, c: Column) -> Column:
        return tokens_of(self.model.names())(self._encoder(self.model.encode_text)(c))

    def decode(self, ids: Column, skip_special_tokens: bool = True, clean: bool = True) -> Column:
        """Text of ids; ids outside the model's vocabulary vanish."""
        skip = frozenset(self.special_tokens.values()) if skip_special_tokens else frozenset()
        if isinstance(self.decoder, ByteDecoder):
            text = byte_texts(self.model.names(), skip)(ids)
        else:
            text = (self.decoder or Fuse()).expr(tokens_of(self.model.names(), skip, drop=True)(ids))
        return clean_up(text) if clean else text

    def convert_ids_to_tokens(self, ids: Column, skip_special_tokens: bool = False) -> Column:
        names = {i: t for t, i in self.get_vocab().items()}
        return tokens_of(names, frozenset(self.special_tokens.values()) if skip_special_tokens else frozenset())(ids)

    def convert_tokens_to_ids(self, tokens: Column) -> Column:
        have = self.get_vocab()

        def run(x: pa.Array) -> pa.Array:
            return pa.array([None if r is None else [have.get(t) for t in r] for r in x.to_pylist()], pa.list_(pa.int64()))

        return bounded(run, "array<bigint>")(tokens)

    def convert_tokens_to_string(self, tokens: Column) -> Column:
        return (self.decoder or Fuse()).expr(tokens)

    def special_tokens_mask(self, ids: Column, already_has_special_tokens: bool = True) -> Column:
        return special_mask(ids, sorted(self.special_tokens.values()) if already_has_special_tokens else [])

    def num_special_tokens_to_add(self, pair: bool = False) -> int:
        return 0 if self.post_processor is None else self.post_processor.added(pair)

    def post_process(self, ids: Column, pair: Column | None = None) -> Column:
        if self.post_processor is None:
            return ids if pair is None else F.concat(ids, pair)
        return self.post_processor.expr(ids, pair)

    def encoding(self, text: Column, pair: Column | None = None, add_special_tokens: bool = True, aligned: bool = False) -> Column:
        """The Encoding of a text or pair; added tokens are not looked for.

        As in the reference behaviour, masks of specials grow at the tail and tokens and offsets do not
        grow; with aligned, every array follows the ids instead (specials have null word and sequence).
        """
        e = self._one(text, 0)
        if pair is not None:
            e = E.merge(e, self._one(pair, 1), 1)
        if not add_special_tokens or self.post_processor is None:
            return e
        ids = self.post_processor.expr(E.part(e, "ids"))
        n = F.size(ids) - F.size(E.part(e, "ids"))
        if aligned:
            mark = -(1 << 40)
            index = self.post_processor.expr(F.transform(E.part(e, "ids"), lambda _, i: (i + mark).cast("long")))
            first = F.array_position(self.post_processor.expr(F.array(F.lit(mark).cast("long"))), F.lit(mark).cast("long"))  # a constant
            before = F.when((first > 0) & (F.size(E.part(e, "ids")) > 0), first - 1).otherwise(n).cast("int")

            def around(f: str, kind: str, value: int | None = None) -> Column:
                put = lambda k: F.array_repeat(F.lit(value).cast(kind), k)
                return F.concat(put(before), E.part(e, f), put(n - before))

            special = F.transform(index, lambda i: (i >= 0).cast("long"))
            return E.build(ids=ids, type_ids=around("type_ids", "bigint", 0), tokens=self.convert_ids_to_tokens(ids), attention_mask=F.array_repeat(F.lit(1).cast("long"), F.size(ids)), special_tokens_mask=special, offsets=around("offsets", "struct<start:bigint,end:bigint>"), word_ids=around("word_ids", "bigint"), sequence_ids=around("sequence_ids", "bigint"))
        grown = lambda f, v: F.concat(E.part(e, f), F.array_repeat(F.lit(v).cast("long"), n))
        specials = F.array(*[F.lit(x).cast("long") for x in self.special_tokens.values()]) if self.special_tokens else F.array().cast("array<bigint>")
        mask = F.zip_with(grown("special_tokens_mask", 1), ids, lambda m, i: F.greatest(m, F.array_contains(specials, i).cast("long")))
        return E.with_fields(e, ids=ids, attention_mask=grown("attention_mask", 1), type_ids=grown("type_ids", 0), special_tokens_mask=mask)

    def _length(self, text: Column, pair: Column | None, add_special_tokens: bool) -> Column:
        """How many ids the Encoding of a text or pair has, without the Encoding."""
        count = self._encoder(self.model.encode_text)
        ids = count(text) if pair is None else F.concat(count(text), count(pair))
        return F.size(self.post_processor.expr(ids) if add_special_tokens and self.post_processor is not None else ids)

    def _one(self, text: Column, seq: int) -> Column:
        plain = self.normalizer is None and isinstance(self.pre_tokenizer, Whitespace)
        if "_made" not in self.__dict__:  # one function, so that a text is encoded once however often it is asked for
            self.__dict__["_made"] = self._of_words() if plain else self._of_pieces()
        got = self.__dict__["_made"](text) if plain else self.__dict__["_made"](self.pieces(text), text)
        all_ = lambda v: F.array_repeat(F.lit(v).cast("long"), F.size(got["ids"]))
        return E.build(ids=got["ids"], type_ids=all_(0), tokens=got["tokens"], attention_mask=all_(1), special_tokens_mask=all_(0), offsets=got["offsets"], word_ids=got["word_ids"], sequence_ids=all_(seq))

    def _of_words(self) -> Callable[[Column], Column]:
        """What _of_pieces gives for white-space words of the text as it is, by whole slices: words are where they stand."""
        names = self.model.names()
        top = max(names, default=-1) + 1
        tokens = pa.array([names.get(i) for i in range(top)], pa.string())
        length = np.array([len((names.get(i) or "").encode("utf-8")) for i in range(top)], np.int64)
        known = WordIds(self.model.encode_text)

        def run(x: pa.Array) -> pa.Array:
            w = Words(x)
            n, ids = known.of(w.distinct)
            # of each distinct word: where its tokens end after its marked lead, which is not looked for
            word = np.repeat(np.arange(len(n)), n)
            size = np.zeros(len(n), np.int64)
            size[w.which] = w.size
            lead = np.array([0 if d[0] not in "Ġ▁" else len(d.encode("utf-8")) - len((d.lstrip("Ġ▁") or d).encode("utf-8")) for d in w.distinct], np.int64)
            run_ = np.cumsum(length[ids])
            base = np.concatenate([[0], run_])[np.cumsum(n) - n]
            core = (size - lead)[word]
            ends = np.minimum(run_ - base[word], core) + lead[word]
            starts = np.minimum(run_ - length[ids] - base[word], core) + lead[word]
            at, edge = gathered(n, w.which)
            which = np.repeat(np.arange(len(w.which)), n[w.which])
            place = w.starts[which]
            number = np.arange(len(w.which)) - np.repeat(w.first[:-1], np.diff(w.first))
            flat = {"ids": pa.array(ids[at]), "tokens": tokens.take(pa.array(ids[at])), "offsets": pa.StructArray.from_arrays([pa.array(place + starts[at]), pa.array(place + ends[at])], ["start", "end"]), "word_ids": pa.array(number[which])}
            off = pa.array(edge[w.first].astype(np.int32))
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(off, v) for v in flat.values()], list(flat), mask=pa.array(np.asarray(x.is_null())))

        return bounded(run, _ALIGNED)

    def _of_pieces(self) -> Callable[[Column, Column], Column]:
        """Pieces are looked for one after the other in the original's bytes; a changed piece takes its own length."""
        model = self.model
        names = model.names()
        known: dict[str, tuple] = {}

        def look(p: str) -> tuple:
            """(what of p to look for, ids, tokens, bytes of each token, bytes of p); kept for the worker's life."""
            if p not in known:
                if len(known) > CACHE:
                    known.clear()
                ids = model.encode_text(p)
                tokens = [names[i] for i in ids]
                known[p] = (p.lstrip("Ġ▁") or p).encode("utf-8"), ids, tokens, [len(t.encode("utf-8")) for t in tokens], len(p.encode("utf-8"))
            return known[p]

        def run(pieces: pa.Array, original: pa.Array) -> pa.Array:
            size, ids, tokens, starts, ends, words = [0], array("q"), [], array("q"), array("q"), array("q")
            absent = []
            for ps, t in zip(pieces.to_pylist(), original.to_pylist()):
                absent.append(ps is None or t is None)
                raw, at = b"" if t is None else t.encode("utf-8"), 0
                for k, p in enumerate(() if absent[-1] else ps):
                    core, mine, text, sizes, length = look(p)
                    i = raw.find(core, at)
                    start, end = (i, i + len(core)) if i >= 0 else (at, min(at + length, len(raw)))
                    ids.extend(mine)
                    tokens += text
                    words.extend([k] * len(mine))
                    pos = start
                    for n in sizes:
                        starts.append(min(pos, end))
                        pos += n
                        ends.append(min(pos, end))
                    at = end
                size.append(len(ids))
            off, mask = pa.array(size, pa.int32()), pa.array(absent)
            long = lambda x: pa.array(np.frombuffer(x, np.int64))
            flat = {"ids": long(ids), "tokens": pa.array(tokens, pa.string()), "offsets": pa.StructArray.from_arrays([long(starts), long(ends)], ["start", "end"]), "word_ids": long(words)}
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(off, x) for x in flat.values()], list(flat), mask=mask)

        return bounded(run, _ALIGNED, 2)

    def _pad_id(self) -> int:
        have = self.special_tokens
        return have.get("[PAD]", have.get("<pad>", 0))

    def prepare_for_model(self, ids: Column, pair: Column | None = None, add_special_tokens: bool = True, padding: str | None = None, truncation: bool = False, max_length: int | None = None) -> Column:
        """longest, left and right pad to max_length like max_length does."""
        names = tokens_of(self.model.names(), drop=True)
        e = E.from_ids(ids, names(ids))
        e = e if pair is None else E.merge(e, E.from_ids(pair, names(pair)), 1)
        if add_special_tokens and self.post_processor is not None:
            out = self.post_processor.expr(E.part(e, "ids"))
            n = F.size(out) - F.size(E.part(e, "ids"))
            more = lambda f, v: F.concat(E.part(e, f), F.array_repeat(F.lit(v).cast("long"), n))
            e = E.with_fields(e, ids=out, attention_mask=more("attention_mask", 1), special_tokens_mask=more("special_tokens_mask", 1), type_ids=more("type_ids", 0))
        most = self.model_max_length if max_length is None else max_length
        e = E.truncate(e, most) if truncation else e
        if padding in ("max_length", "longest", "left", "right"):
            pid = self._pad_id()
            e = E.pad(e, most, pid, self.model.id_to_token(pid) or "<pad>", padding == "left" or self.padding_side == "left")
        return e

    # ---- tables

    def __call__(self, df: DataFrame, text: str = "text", pair: str | None = None, add_special_tokens: bool = True, padding: bool | str = False, truncation: bool = False, max_length: int | None = None, stride: int = 0, fields: tuple[str, ...] = E.FIELDS) -> DataFrame:
        """df with column encoding and, with truncation, overflowing (only `fields` of them)."""
        most = self.model_max_length if max_length is None else max_length
        if truncation and stride >= most:
            raise ValueError("stride must be less than max_length")
        out = df.withColumn("encoding", self.encoding(F.col(text), None if pair is None else F.col(pair), add_special_tokens))
        if truncation:
            out = out.withColumn("overflowing", E.overflow(F.col("encoding"), most, stride, fields)).withColumn("encoding", E.truncate(F.col("encoding"), most))
        if padding:
            to: int | Column = most
            if padding in (True, "longest") and max_length is None:
                longest = df.agg(F.max(self._length(F.col(text), None if pair is None else F.col(pair), add_special_tokens)).alias("_to"))  # one row
                out, to = out.crossJoin(F.broadcast(longest.select(F.least("_to", F.lit(most)).alias("_to") if truncation else "_to"))), F.col("_to")
            pid = self._pad_id()
            out = out.withColumn("encoding", E.pad(F.col("encoding"), to, pid, self.model.id_to_token(pid) or "<pad>", self.padding_side == "left")).drop("_to")
        return out if fields == E.FIELDS else out.withColumn("encoding", F.struct(*[F.col("encoding")[f].alias(f) for f in fields]))

    def apply_chat_template(self, chats: DataFrame, add_generation_prompt: bool = False, tokenize: bool = False) -> DataFrame:
        if self.chat_template is None:
            raise ValueError("no chat template is set")
        bos, eos = ((self.special(n) or (d,))[0] for n, d in (("bos", "<s>"), ("eos", "</s>")))
        out = apply_template(chats, self.chat_template, add_generation_prompt, bos, eos)
        return out.withColumn("ids", self.encode(F.col("rendered"))) if tokenize else out

    def train_new_from_iterator(self, texts: DataFrame, vocab_size: int, text: str = "text", min_frequency: int = 2) -> "Tokenizer":
        """The same components over a vocabulary learned from texts; pieces are split at white space once more."""
        words = texts.select(F.explode(self.pieces(F.col(text))).alias("text"))
        trainer = BpeTrainer(vocab_size, min_frequency, tuple(t.content for t in self.added if t.special) or BpeTrainer.special_tokens)
        vocab, merges = trainer.train(words)
        added = tuple(AddedToken(t, vocab[t], True) for t in trainer.special_tokens)
        return replace(self, model=BPE(vocab, merges), added=added, named=tuple(sorted(name_specials(list(added)).items())))

    def register(self, spark: SparkSession, prefix: str = "tok") -> None:
        """SQL functions <prefix>_encode(pieces) and <prefix>_tokens(ids), and the table function <prefix>_rows(pieces): (pos, id, token)."""
        from pyspark.sql.functions import udtf

        model, names = self.model, self.model.names()

        class Rows:
            def eval(self, pieces: list):
                for pos, i in enumerate(i for p in pieces or [] for i in model.encode_text(p)):
                    yield pos, i, names.get(i)

        spark.udf.register(f"{prefix}_encode", encoder(model.encode_text))
        spark.udf.register(f"{prefix}_tokens", tokens_of(names))
        spark.udtf.register(f"{prefix}_rows", udtf(Rows, returnType="pos int, id long, token string"))
