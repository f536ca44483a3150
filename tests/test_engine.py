"""Stages, models, encodings, trainers and the facade: literal cases and scalar-against-Column checks."""

import collections
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparklex.functions.chars import ALPHABET, decode_bytes, encode_bytes, split_spaces
from sparklex.functions.columns import bytes_to_chars, chars_to_bytes, find_all
from sparklex.operators import decoders as D
from sparklex.operators import encoding as E
from sparklex.operators import models as M
from sparklex.operators import normalizers as N
from sparklex.operators import postprocessors as P
from sparklex.operators import pretokenizers as T
from sparklex.operators.vocab import AddedToken
from sparklex.plans import training as R
from sparklex.plans.batch import BatchEncoding
from sparklex.plans.chat import apply_template
from sparklex.plans.tokenizer import AddedMatcher, Tokenizer
from sparklex.sources.corpus import read_lines
from sparklex.sources.hub import Hub
from sparklex.streaming.counts import start_counts

ODD = ["", " ", "a　b\u0085c", "a\u0000b", "é", "日本 x", "한글", "😀 hi", "ﬁle", "İΑΣ", "Hello, world!", "  CAFÉ  naïve ", "x\x1cy", "price $100 and $50", "\t a\r\n b"]


def one(spark, expr, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(expr(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


NORMALIZERS = [N.Form("NFC"), N.Form("NFD"), N.Form("NFKC"), N.Form("NFKD"), N.Lowercase(), N.Strip(), N.StripAccents(), N.Replace("l", "L"), N.Prepend("_"), N.Append("!"), N.Bert(), N.Bert(strip_accents=False), N.Precompiled((("ﬁ", "fi"),)), N.bert_normalizer(), N.default_normalizer(), N.Sequence((N.Lowercase(), N.Strip()))]


@pytest.mark.parametrize("n", NORMALIZERS, ids=lambda n: type(n).__name__ + str(getattr(n, "name", "")))
def test_normalizer_column_equals_scalar(spark, n):
    assert one(spark, n.expr, *ODD, None) == [*map(n.apply, ODD), None]


def test_normalizer_literals():
    assert N.StripAccents().apply("café naïve") == "cafe naive" and N.bert_normalizer().apply("  CAFÉ  ") == "cafe"
    assert N.Precompiled((("ﬁ", "fi"), ("ﬂ", "fl"))).apply("ﬁle") == "file" and " 世 " in N.Bert().apply("Hello世界")
    assert N.Replace("", "-").apply("ab") == "-a-b-"


def test_replace_of_nothing(spark):
    assert one(spark, N.Replace("", "-").expr, "ab", "") == ["-a-b-", "-"]


PRETOKENS = [
    (T.Whitespace(), "hello world", ["hello", "world"]), (T.Punctuation(), "hello, world!", ["hello", ",", " world", "!"]), (T.Digits(True), "hello123world", ["hello", "1", "2", "3", "world"]),
    (T.Digits(), "a12b", ["a", "12", "b"]), (T.Gpt2(), "Hello, world!", ["Hello", ",", " world", "!"]), (T.Metaspace(), "hello world", ["▁hello▁world"]),
    (T.Bert(), "Hello, world!", ["Hello", ",", "world", "!"]), (T.Bert(), "Hello世界", ["Hello", "世", "界"]), (T.CharDelimiter("_"), "hello_world__test", ["hello", "world", "test"]),
    (T.UnicodeScripts(), "Helloこんにちは", ["Hello", "こんにちは"]), (T.Split(r"\s", "Isolated"), "hello world test", ["hello", " ", "world", " ", "test"]),
    (T.Split("!", "MergedWithPrevious"), "hello! world!", ["hello!", " world!"]), (T.Split(r"\$", "MergedWithNext"), "price $100 and $50", ["price ", "$100 and ", "$50"]),
    (T.Split(r"\d", "Contiguous"), "abc123def456", ["abc", "123", "def", "456"]), (T.Split("z", "Removed"), "abc", ["abc"]), (T.Split("z"), "abc", []), (T.Split("b", None, True), "abc", ["a", "c"]),
    (T.Split("(", "Removed"), "a(b", ["a(b"]), (T.Sequence((T.Whitespace(), T.Punctuation())), "a,b c", ["a", ",", "b", "c"]), (T.ByteLevel(True), "hi é", ["Ġhi", "ĠÃ©"]), (T.ByteLevel(True), "", []),
]


@pytest.mark.parametrize("t,text,want", PRETOKENS)
def test_pretokenizers(spark, t, text, want):
    assert one(spark, t.expr, text, None) in ([want, None], [want, []])


def test_bytes(spark):
    assert len(set(ALPHABET)) == 256 and ALPHABET[32] == "Ġ"
    assert one(spark, bytes_to_chars, *ODD) == [*map(encode_bytes, ODD)]
    assert one(spark, lambda c: chars_to_bytes(bytes_to_chars(c)), *ODD) == ODD == [decode_bytes(encode_bytes(t)) for t in ODD]
    bad = ["Ãx", "âĤ", "日", "a b"]
    assert one(spark, chars_to_bytes, *bad) == [*map(decode_bytes, bad)]
    assert split_spaces("a　b\x1cc d") == ["a", "b\x1cc", "d"]


DECODES = [
    (D.Metaspace(), ["▁Hello", "▁world"], "Hello world"), (D.WordPiece(), ["Hello", "##world"], "Helloworld"), (D.WordPiece(), ["Hi", "there", "."], "Hi there."), (D.WordPiece(), ["##x", "y"], "x y"), (D.WordPiece(), [], ""),
    (D.ByteLevel(), ["ĠHello", "Ġworld"], " Hello world"), (D.CTC(), ["H", "H", "E", "<pad>", "L", "L", "O", "|", "W"], "HELO W"), (D.CTC(), ["L", "<pad>", "L"], "LL"), (D.Fuse(), ["Hello", " ", "World"], "Hello World"),
    (D.Strip("_", 1, 1), ["_Hello_"], "Hello"), (D.Strip("*", 1, 0), ["**a*"], "*a*"), (D.BPE(), ["hi</w>", "yo</w>"], "hi yo"), (D.Replace("a", "b"), ["ca", "ab"], "cbbb"), (D.Sequence((D.Fuse(), D.Strip("x", 1, 1))), ["xa", "x"], "a"),
]


@pytest.mark.parametrize("d,tokens,want", DECODES)
def test_decoders(spark, d, tokens, want):
    assert one(spark, d.expr, tokens, kind="array<string>") == [want]


def test_clean_up(spark):
    assert one(spark, D.clean_up, 'He said , " hi " !  \n ( yes ) a - b') == ['He said,"hi"! (yes) a-b']


POSTS = [(P.BertProcessing(), None, [101, 1, 2, 3, 102]), (P.RobertaProcessing(), None, [0, 1, 2, 3, 2]), (P.BertProcessing(), [7], [101, 1, 2, 3, 102, 7, 102]), (P.RobertaProcessing(), [7], [0, 1, 2, 3, 2, 2, 7, 2]), (P.default_postprocessor(), [7], [0, 1, 2, 3, 2, 7, 2]), (P.Template("[X] $A <y>", None, (("<y>", 5),)), None, [1, 2, 3, 5]), (P.Sequence((P.BertProcessing(), P.RobertaProcessing())), [7], [0, 101, 1, 2, 3, 102, 7, 102, 2])]


@pytest.mark.parametrize("p,pair,want", POSTS)
def test_postprocessors(spark, p, pair, want):
    assert one(spark, lambda c: p.expr(c, None if pair is None else P.ids(*pair)), [1, 2, 3], kind="array<bigint>") == [want]


def test_truncation_and_padding(spark):
    cut = lambda a, b, n, how: one(spark, lambda c: F.struct(*P.truncate(c, P.ids(*b), n, how)), a, kind="array<bigint>")[0]
    assert tuple(cut([1, 2, 3, 4, 5], [], 3, "only_first")) == ([1, 2, 3], [])
    assert tuple(cut([1, 2, 3], [4, 5, 6, 7, 8], 5, "only_second")) == ([1, 2, 3], [4, 5])
    for n in range(7):
        for m in range(7):
            for most in range(0, 12):
                if (n + m + most) % 5:
                    continue
                a, b = list(range(n)), list(range(m))
                x, y = list(a), list(b)
                while len(x) + len(y) > most:
                    (x if len(x) >= len(y) else y).pop()
                assert [list(v) for v in cut(a, b, most, "longest_first")] == [x, y]
    assert one(spark, lambda c: P.pad(c, 5), [1, 2, 3], kind="array<bigint>") == [[1, 2, 3, 0, 0]]
    assert one(spark, lambda c: P.pad(c, 5, 9, True), [1], kind="array<bigint>") == [[9, 9, 9, 9, 1]]


BPE_VOCAB = {t: i for i, t in enumerate(["h", "e", "l", "o", "he", "ll", "hel", "hell", "hello", "lo", "llo"])}
BPE_MERGES = [("h", "e"), ("he", "l"), ("hel", "l"), ("hell", "o"), ("l", "l"), ("l", "o"), ("l", "lo")]


def naive_bpe(symbols, ranks):
    s = list(symbols)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks), default=None)
        if best is None:
            return s
        i = best[1]
        s[i : i + 2] = [s[i] + s[i + 1]]


def test_models():
    assert M.BPE(BPE_VOCAB, BPE_MERGES).encode_text("hello") == [8] and M.BPE(BPE_VOCAB, BPE_MERGES).encode_text("hzello") == [8]
    wp = M.WordPiece({"[UNK]": 0, "hello": 1, "world": 2, "##ing": 3, "play": 4, "##ed": 5})
    assert wp.encode_text("hello world") == [1, 2] and wp.encode_text("playing played") == [4, 3, 4, 5] and wp.encode_text("plaxing") == [0] * 4 + [3] and wp.encode_text("a" * 101) == [0]
    uni = M.Unigram([("<unk>", -10.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -0.5), ("bc", -0.5), ("abc", -0.2)])
    assert uni.encode_text("abc") == [6] and uni.encode_text("zab") == [0, 4] and uni.encode_text("") == []
    assert M.WordLevel({"<unk>": 0, "hello": 1}).encode_text("hello unknown") == [1, 0]
    assert M.CharBPE({"<unk>": 0, "h": 1, "i</w>": 2, "hi</w>": 3}, [("h", "i</w>")]).encode_text("hi") == [3]
    assert M.ByteLevelBPE({"<unk>": 0, "Ġ": 1, "h": 2, "i": 3, "Ġh": 4, "hi": 5, "Ġhi": 6}, [("Ġ", "h"), ("h", "i"), ("Ġh", "i")], add_prefix_space=True).encode_text("hi") == [6]
    drop = M.BPE(BPE_VOCAB, BPE_MERGES, 0.5)
    assert drop.encode_text("hello") == drop.encode_text("hello") and M.BPE(BPE_VOCAB, BPE_MERGES, 1.0).encode_text("hello") == [0, 1, 2, 2, 3]


def test_bpe_forms_agree(spark, data):
    words = sorted({w for r in spark.read.parquet(f"{data}/documents.parquet").limit(20).collect() for w in r["text"].split()})[:800] + ["aaaa", "aaa"]
    _, merges = R.BpeTrainer(vocab_size=140, special_tokens=()).train_words([(w, 1 + len(w)) for w in words])
    ranks = {p: i for i, p in enumerate(merges)}
    assert M.causal(merges) and len(merges) > 30
    want = [naive_bpe(w, ranks) for w in words]
    assert [M.merge_symbols(list(w), ranks) for w in words] == want
    assert [x[0].split("\u0001") for x in one(spark, lambda c: M.bpe_fold(F.array(c), merges), *words)] == want
    with pytest.raises(ValueError):
        M.bpe_fold(F.lit("x"), [("ab", "c")])


def test_encoder_udf(spark):
    m = M.BPE(BPE_VOCAB, BPE_MERGES)
    assert one(spark, M.encoder(m.encode_text), ["hello", "lo", "hello"], [], None, ["hell"], kind="array<string>") == [[8, 9, 8], [], None, [7]]
    assert one(spark, M.encoder(m.encode_text, pieces=False), "hello", None, "", "hellolo") == [[8], None, [], [8, 9]]


def flat_encoding(n, offsets=None, words=None):
    return F.struct(
        P.ids(*range(1, n + 1)).alias("ids"), P.ids(*[0] * n).alias("type_ids"), F.array(*[F.lit(f"t{i}") for i in range(n)]).alias("tokens"), P.ids(*[1] * n).alias("attention_mask"), P.ids(*[0] * n).alias("special_tokens_mask"),
        (F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in offsets]) if offsets else F.array()).alias("offsets"), P.ids(*(words or [])).alias("word_ids"), P.ids(*[0] * n).alias("sequence_ids"),
    ).cast(E.SCHEMA)


def test_encoding_ops(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    p = row(E.pad(flat_encoding(2), 5))
    assert p["attention_mask"] == [1, 1, 0, 0, 0] and p["sequence_ids"] == [0, 0, None, None, None] and p["special_tokens_mask"] == [0, 0, 1, 1, 1] and p["tokens"][2:] == ["<pad>"] * 3
    assert row(E.truncate(flat_encoding(5), 3))["ids"] == [1, 2, 3] and [o["ids"] for o in row(E.overflow(flat_encoding(5), 3))] == [[4, 5]]
    e = flat_encoding(3, [(0, 5), (5, 6), (6, 11)], [0, 1, 2])
    assert [row(E.char_to_token(e, F.lit(k))) for k in (0, 4, 5, 6, 11)] == [0, 0, 1, 2, None]
    assert tuple(row(E.token_to_chars(e, F.lit(1)))) == (5, 6) and row(E.token_to_chars(e, F.lit(9))) is None and row(E.n_words(e)) == 3 and row(E.token_to_word(e, F.lit(2))) == 2
    assert row(E.merge(flat_encoding(2), flat_encoding(1), 1))["type_ids"] == [0, 0, 1] and row(E.set_type_ids(flat_encoding(3), 1, 2, 4))["type_ids"] == [0, 4, 0]
    assert row(E.mark_special_tokens(flat_encoding(3), [2]))["special_tokens_mask"] == [0, 1, 0]
    with pytest.raises(ValueError):
        E.overflow(flat_encoding(3), 2, 2)
    for n in (1, 7, 8, 9, 20, 31):
        for most, stride in ((8, 3), (5, 4), (8, 1)):
            want, pos = [], most
            while pos < n:
                s = pos - stride
                want.append(list(range(s + 1, min(s + most, n) + 1)))
                pos = min(s + most, n)
            assert [o["ids"] for o in row(E.overflow(flat_encoding(n), most, stride))] == want
    df = spark.range(1).select(F.lit(1).alias("k"), flat_encoding(4, [(0, 3), (3, 5), (6, 9), (9, 11)], [0, 0, 1, 1]).alias("encoding"))
    flat = E.to_flat(df, "k")
    assert sorted(tuple(r)[2:] for r in E.word_spans(flat, "k").collect()) == [(0, 0, 2, 0, 5), (1, 2, 4, 6, 11)]
    assert E.to_nested(flat, "k").first()["encoding"] == df.first()["encoding"]
    e = flat_encoding(4, [(0, 3), (3, 5), (6, 9), (9, 11)], [0, 0, 1, 1])
    look = lambda f, w, *seq: (x := row(f(e, F.lit(w), *seq))) and tuple(x)
    assert [look(E.word_to_tokens, w) for w in (0, 1, 2)] == [(0, 2), (2, 4), None] and look(E.word_to_tokens, 0, 1) is None
    assert [look(E.word_to_chars, w) for w in (0, 1, 2)] == [(0, 5), (6, 11), None] and row(E.word_token_indices(e, F.lit(1))) == [2, 3]


def texts(spark, *t):
    return spark.createDataFrame([(x,) for x in t], "text string")


def test_trainers(spark):
    hello = texts(spark, "hello world", "hello there", "world hello", "hello hello hello")
    vocab, merges = R.BpeTrainer(100, 1).train(hello)
    assert {"<unk>", "hello"} <= set(vocab) and M.BPE(vocab, merges).encode_text("hello") == [vocab["hello"]]
    vocab, _ = R.BpeTrainer(50, 1, end_of_word_suffix="</w>").train(hello)
    assert any("</w>" in t for t in vocab)
    for kw in ({}, {"beta": 0.0, "gate": 0.0}, {"pre_tokenizer": None}):
        vocab, merges = R.Trainer(50, 1, **kw).train(texts(spark, "hello world hello world", "hello hello hello"))
        assert len(vocab) > 10 and merges
    t = R.Trainer(60, 2)
    a, b = t.count(texts(spark, "aaa bbb aaa")), t.count(texts(spark, "aaa bbb", "ccc"))
    assert t.finish(R.add_counts(a, b)) == t.train(texts(spark, "aaa bbb aaa", "aaa bbb", "ccc"))
    wp = R.WordPieceTrainer(100, 1).train(texts(spark, "hello world", "hello there", "world peace"))
    assert len(wp.vocab) > 10 and "[UNK]" in wp.vocab
    uni = R.UnigramTrainer(vocab_size=50, initial_vocab_size=100, n_iterations=2).train(texts(spark, "hello world", "hello there", "world peace"))
    assert 3 < len(uni.pieces) <= 100 and all(math.isfinite(s) for _, s in uni.pieces)


def test_bpe_training_equals_recount(spark, data):
    words = R.collected(R.word_counts(spark.read.parquet(f"{data}/documents.parquet").limit(15), find_all(F.col("text"), "(?U)\\S+")))
    _, merges = R.BpeTrainer(vocab_size=80, special_tokens=()).train_words(words)
    split = [(list(w), f) for w, f in words]
    for p in merges:
        freq = {}
        for s, f in split:
            for q in zip(s, s[1:]):
                freq[q] = freq.get(q, 0) + f
        assert max((f, *q) for q, f in freq.items())[1:] == p
        split = [(R._Pairs([(s, f)]), f) for s, f in split]
        for state, _ in split:
            state.merge(p, p[0] + p[1])
        split = [(state.words[0][0], f) for state, f in split]


SPEC = {
    "model": {"type": "BPE", "vocab": {"Ġ": 11, **BPE_VOCAB, "w": 12, "Ġhello": 13}, "merges": ["h e", ["he", "l"], "hel l", "hell o", "l l", "bad", "Ġ hello"]},
    "added_tokens": [{"id": 20, "content": "<s>", "special": True}, {"id": 21, "content": "</s>", "special": True}, {"id": 22, "content": "<unk>", "special": True}, {"id": 23, "content": "[X]", "special": False, "single_word": True}],
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "??"}]}, "post_processor": {"type": "RobertaProcessing"}, "decoder": {"type": "Fuse"},
}


def test_facade(spark, tmp_path):
    t = Tokenizer.from_str(json.dumps(SPEC))
    assert t.special("bos") == ("<s>", 20) and t.special("unk") == ("<unk>", 22) and t.vocab_size == 18 and t.num_special_tokens_to_add(True) == 4 and t.token_to_id("[X]") == 23
    assert one(spark, t.encode, "hello [X] lo<s>", None) == [[8, 23, 2, 3, 20], None]
    assert one(spark, t.encode, "hello<s>hello", "")[:2] == [[8, 20, 8], []]
    assert one(spark, t.tokenize, "hello w") == [["hello", "w"]]
    assert one(spark, t.decode, [20, 8, 12, 99], kind="array<bigint>") == ["hellow"]
    assert one(spark, t.convert_ids_to_tokens, [20, 99], kind="array<bigint>") == [["<s>", None]] and one(spark, t.convert_tokens_to_ids, ["he", "?"], kind="array<string>") == [[4, None]]
    assert one(spark, t.special_tokens_mask, [20, 8], kind="array<bigint>") == [[1, 0]]
    e = one(spark, t.encoding, "hello  he")[0]
    assert e["ids"] == [20, 8, 4, 21] and [tuple(o) for o in e["offsets"]] == [(0, 5), (7, 9)] and e["word_ids"] == [0, 1] and e["attention_mask"] == [1] * 4 and e["special_tokens_mask"] == [1, 0, 1, 1]
    a = one(spark, lambda c: t.encoding(c, aligned=True), "hello  he")[0]
    assert a["tokens"] == ["<s>", "hello", "he", "</s>"] and a["word_ids"] == [None, 0, 1, None] and a["special_tokens_mask"] == [1, 0, 0, 1]
    pair = one(spark, lambda c: t.encoding(c, c, False), "he")[0]
    assert pair["ids"] == [4, 4] and pair["type_ids"] == [0, 1] and pair["sequence_ids"] == [0, 1]
    out = t(texts(spark, "hello he", "lo"), padding=True, truncation=True, max_length=None).collect()
    assert {len(r["encoding"]["ids"]) for r in out} == {len(out[0]["encoding"]["ids"])}
    with pytest.raises(ValueError):
        t(texts(spark, "x"), truncation=True, max_length=2, stride=2)
    p = one(spark, lambda c: t.prepare_for_model(c, padding="longest", truncation=True, max_length=4), [1, 2, 3, 4, 5], [1], kind="array<bigint>")
    assert p[0]["ids"] == [20, 1, 2, 3] and p[1]["ids"] == [20, 1, 21, 0]
    t.save_pretrained(str(tmp_path / "m"))
    again = Tokenizer.from_pretrained(str(tmp_path / "m"), Hub(str(tmp_path / "c")))
    assert again.get_vocab() == t.get_vocab() and again.model.merges == t.model.merges and again.post_processor == t.post_processor and again.decoder == t.decoder
    more = t.add_tokens(["<mask>", "hello"], special=True)
    assert more.token_to_id("<mask>") == 24 and more.special("mask") == ("<mask>", 24)
    chat = spark.createDataFrame([(1, 1, "user", "hello"), (1, 0, "system", "he"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["rendered"] for r in t.with_parts(chat_template="<|im_start|>").apply_chat_template(chat, True).collect()}
    assert got == {1: "<|im_start|>system\nhe<|im_end|>\n<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\n", 2: "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n"}
    assert {r["conv_id"]: r["rendered"] for r in apply_template(chat, "[INST]").collect()}[1] == "<s><<SYS>>\nhe\n<</SYS>>\n\n[INST] hello [/INST]"
    with pytest.raises(ValueError):
        t.apply_chat_template(chat)
    new = t.train_new_from_iterator(texts(spark, "he he lo lo", "lo he"), 30, min_frequency=1)
    assert "lo" in new.get_vocab() and new.special("bos")[0] == "<s>"
    t.register(spark, "demo")
    assert spark.sql("select demo_encode(array('hello')), demo_tokens(array(8L))").first()[0] == [8]
    assert [r["id"] for r in spark.sql("select * from demo_rows(array('hello'))").collect()] == [8]
    with pytest.raises(ValueError):
        Tokenizer.from_str(json.dumps({"model": {"vocab": [["a", 0.0]], "merges": []}}))


def test_added_token_flags():
    m = AddedMatcher((AddedToken("[X]", 1, single_word=True), AddedToken("ab", 2), AddedToken("abc", 3), AddedToken("_l", 4, lstrip=True)))
    enc = lambda s: m.encode(s, lambda x: [x])
    assert enc("abcab") == [3, 2] and enc("q[X]") == ["q[X]"] and enc("[X] z") == [1, " z"] and enc("zab") == ["z", 2] and enc("q_l") == ["q_l"] and enc(" _l") == [" ", 4]


def test_components_round_trip():
    from sparklex.sources import tokenizer_json as J

    for n in NORMALIZERS:
        if not isinstance(n, N.Precompiled):
            assert J.read_normalizer(J.write_normalizer(n)) == n
    for p in (T.ByteLevel(True), T.Metaspace("_", False), T.Whitespace(), T.Punctuation(), T.Bert(), T.CharDelimiter("/"), T.UnicodeScripts(), T.Digits(True), T.Split("x", "Isolated", True), T.Sequence((T.Whitespace(), T.Digits()))):
        assert J.read_pretokenizer(J.write_pretokenizer(p)) == p
    for d in (D.ByteLevel(), D.Metaspace("_", False), D.WordPiece("@@", False), D.BPE("x"), D.CTC("p", None), D.Fuse(), D.Strip("x", 1, 2), D.Replace("a", "b"), D.Sequence((D.Fuse(), D.Strip("y", 1, 0)))):
        assert J.read_decoder(J.write_decoder(d)) == d
    for p in (P.BertProcessing(101, 102), P.RobertaProcessing(0, 2)):
        assert J.read_postprocessor(J.write_postprocessor(p), {}) == p
    assert J.read_normalizer(None) == N.Form("NFC") and J.read_pretokenizer(None) == T.ByteLevel() and J.read_decoder(None) == D.ByteLevel() and J.read_postprocessor(None, {}) is None and J.read_normalizer({"type": "??"}) is None


def test_hub(tmp_path):
    h = Hub(str(tmp_path), lambda repo, name, rev: b"{}")
    assert h.timeout == 60 and "org--repo" in str(h.path("org/repo")) and not h.is_cached("org/repo")
    with pytest.raises(FileNotFoundError):
        h.resolve("org/repo", local_files_only=True)
    assert h.resolve("org/repo").read_bytes() == b"{}" and h.is_cached("org/repo")
    h.clear("org/repo")
    assert not h.is_cached("org/repo")
    old = {"vocab.json": b"{}", "merges.txt": b""}

    def fetch(repo, name, rev):
        if name not in old:
            raise FileNotFoundError(name)
        return old[name]

    h = Hub(str(tmp_path), fetch)
    assert h.resolve("org/old").name == "vocab.json" and h.is_cached("org/old", "merges.txt") and h.resolve(str(tmp_path)) == tmp_path
    h.clear_all()
    assert not tmp_path.exists()


def test_corpus_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_bytes(b"one two\r\ntwo\rthree\n")
    assert [r[0] for r in read_lines(spark, str(src)).collect()] == ["one two", "two\rthree"]
    spark.createDataFrame([("one two two",), ("two",)], "text string").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "p"))
    q = start_counts(stream, T.Whitespace().expr(N.Lowercase().expr(F.col("text"))), "live_counts", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {r["word"]: r["freq"] for r in spark.table("live_counts").collect()} == {"one": 1, "two": 3}


def test_models_without_an_unknown_entry():
    merges = [("a", "b")]
    assert M.ByteLevelBPE({"ab": 1}, merges).encode_text("abz") == [1, 0]
    assert M.CharBPE({"ab": 1, "z</w>": 2}, merges).encode_text("abz abq") == [1, 2, 1, 0]


def test_text_encoder_equals_the_model(spark):
    rnd = random.Random(4)
    made = ["".join(rnd.choice(["a", "b", " ", "  ", "\n", "é", "'s", "7", ".", "\t", "\u00a0", "\x1c"]) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    df = texts(spark, *made, None)
    vocab = {c: i for i, c in enumerate(sorted({*"".join(map(encode_bytes, made)), *"ab"}))} | {"ab": 900, "Ġa": 901}
    tok = Tokenizer(M.BPE(vocab, [("a", "b"), ("Ġ", "a")]), None, T.ByteLevel())
    a, b = F.col("text"), M.encoder(tok.model.encode_text)(T.ByteLevel().expr(F.col("text")))
    assert all(r[0] == r[1] for r in df.select(tok.encode(a), b).collect())
    for m in (M.ByteLevelBPE(vocab, tok.model.merges), M.CharBPE(vocab, []), M.WordPiece({"[UNK]": 0, "a": 1, "##b": 2}), M.Unigram([("<unk>", 0.0), ("a", -1.0), (" ", -2.0), ("ab", -1.5)])):
        assert m.by_chunks()
        got = df.select("text", M.text_encoder(m.encode_text, m.by_chunks())(a).alias("x")).collect()
        assert all(r["x"] == (None if r["text"] is None else m.encode_text(r["text"])) for r in got)


def test_split_with_unicode_classes(spark):
    def got(pattern, text, **how):
        return texts(spark, text).select(T.Split(pattern, **how).expr(F.col("text"))).first()[0]

    assert got(r"\w+", "café naïve x") == ["café", "naïve", "x"]
    assert got(r"\s+", "a\u00a0b", invert=True) == ["a", "b"]
    assert got(r"\p{Lu}\p{Ll}+", "Hello WorldÉté") == ["Hello", "World", "Été"]
    assert got(r"\p{Han}+", "ab漢字c") == ["漢字"]
    assert got(r"\p{Script=Greek}+", "abγδ") == ["γδ"] and got("[[:digit:]]+", "a1٣") == ["1"]
    assert got(r"a(?=b)", "ab") == ["ab"] and got(r"(a)\1", "aa") == ["aa"] and got("(", "x(") == ["x("]
    for how, want in {"Isolated": ["a\x01b", ",", "c"], "MergedWithPrevious": ["a\x01b,", "c"], "MergedWithNext": ["a\x01b", ",c"], "Contiguous": ["a\x01b", ",", "c"]}.items():
        assert got(",", "a\x01b,c", behavior=how) == want
    assert got(",", ",,a,,b", behavior="MergedWithPrevious") == [",,", "a,,", "b"]
    assert got(",", ",,a,,", behavior="MergedWithNext") == [",", ",a", ",", ","]
    assert got(",", ",,a,,", behavior="Contiguous") == [",,", "a", ",,"]
    assert got(",", "", behavior="Isolated") == [""] and got("a$", "a\n", behavior="Isolated") == ["a\n"]


def test_wordpiece_training_splits_only_what_changed():
    def slow(t, words):
        vocab = {x: i for i, x in enumerate(t.special_tokens)}
        for c in sorted({c for w, _ in words for c in w}):
            vocab.setdefault(c, len(vocab))
        while len(vocab) < t.vocab_size:
            model, pairs = M.WordPiece(vocab, t.prefix), collections.Counter()
            for w, f in words:
                at, tokens = 0, []
                for p in model.pieces(w):
                    tokens.append(p if p is not None else ("##" if at else "") + w[at])
                    at += 1 if p is None else len(p) - (2 if at else 0)
                for p in zip(tokens, tokens[1:]):
                    pairs[p] += f
            new = [(f, *p) for p, f in pairs.items() if p[0] + p[1].removeprefix("##") not in vocab]
            if not new:
                break
            _, a, b = max(new)
            vocab[a + b.removeprefix("##")] = len(vocab)
        return vocab

    rnd = random.Random(1)
    for _ in range(20):
        words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 8))): rnd.randint(1, 9) for _ in range(40)}.items())
        t = R.WordPieceTrainer(vocab_size=60)
        assert t.train_words(words).vocab == slow(t, words)


def test_trainer_save(tmp_path):
    R.Trainer().save(str(tmp_path / "t.json"), {"</s>": 0, "a": 1, "b": 2, "ab": 3}, [("a", "b")])
    t = Tokenizer.from_file(str(tmp_path / "t.json"))
    assert t.model.merges == [("a", "b")] and t.all_special_tokens[0] == "</s>" and t.all_special_ids[:1] == [0] and t.is_fast


def test_batch_encoding(spark):
    t = Tokenizer(M.BPE({"a": 0, "b": 1, "ab": 2}, [("a", "b")]), None, T.Whitespace())
    b = BatchEncoding(t(texts(spark, "ab a", "b"), padding=True))
    assert len(b) == 2 and b.keys()[0] == "input_ids" and b.numpy().tolist() == [[2, 0], [1, 0]] and b.numpy("attention_mask").tolist() == [[1, 1], [1, 0]]
    assert [r["token_type_ids"] for r in b.to_dict().collect()] == [[0, 0], [0, 0]] and b.get("none") is None
    with pytest.raises(KeyError):
        b["none"]
    with pytest.raises(ValueError):
        BatchEncoding(t(texts(spark, "ab a", "b"))).numpy()
    assert P.Padding(7).target(None, None) == 7 and P.Padding().target(b.rows, b["input_ids"]) == 2
    assert [type(f(x, [])).__name__ for f, x in ((M.byte_level_bpe, {}), (M.char_bpe, {}))] == ["ByteLevelBPE", "CharBPE"] and M.unigram([("a", 0.0), ("<unk>", -9.0)]).unk_id == 1
    assert M.wordpiece({"[UNK]": 0}).prefix == "##" and M.word_level({"a": 3}).encode_text("a b") == [3, 0]


def test_batches_come_in_slices(spark):
    """A batch of many rows is handed over by bounded slices, and its rows stay in order, nulls and long texts included."""
    from sparklex.functions import batches

    sizes = [5, 0, 3 << 20, None, 700_000, 700_000, 1, 2 << 20]
    df = spark.createDataFrame([(k, None if n is None else "x" * n) for k, n in enumerate(sizes)], "k long, t string").coalesce(1)

    def run(x):
        import pyarrow as pa

        held = sum(len(t) for t in x.to_pylist() if t is not None)
        assert held <= batches.SLICE_BYTES or len(x) == 1
        return pa.array([None if t is None else len(t) for t in x.to_pylist()], pa.int64())

    assert [r["n"] for r in df.select("k", batches.bounded(run, "bigint")(F.col("t")).alias("n")).orderBy("k").collect()] == sizes


def test_encoding_of_words_equals_that_of_pieces(spark):
    """Whole slices of white-space words against pieces looked for one by one."""
    from sparklex.queries import _word_tokenizer

    t = _word_tokenizer()
    odd = ["", None, " ", "a", "the quick brown fox\u0085jumps　", "Ġ Ġthe ▁▁of ĠĠ ▁", "é ée Ünd naïve x\x1cy", "日本 の the end", "word " * 700, "\nthe\tthe\r\n", "😀the the😀", "x"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "k long, text string").coalesce(1)
    a, b = t._of_words()(F.col("text")), t._of_pieces()(t.pieces(F.col("text")), F.col("text"))
    got = df.select("k", a.alias("a"), b.alias("b"), t.encode(F.col("text")).alias("ids")).collect()
    assert all(r["a"] == r["b"] and r["ids"] == (None if r["a"] is None else r["a"]["ids"]) for r in got)


def test_bpe_training_of_large_tables(spark, data, monkeypatch):
    """Merges by rounds over the table, beyond both bounds of a collected one, against those on the driver."""
    from sparklex.plans import training

    texts = spark.read.parquet(f"{data}/documents.parquet").select("text")
    odd = spark.createDataFrame([("aaaa aaaaa aa b", 3), ("日本日本 日 aab", 1), ("abab ababab ba 😀😀", 2), (10 * "xxxxxxxx " + 20 * "cd ", 4)], "text string, n long").select("text")
    for df, made in ((texts, dict(vocab_size=160)), (texts, dict(vocab_size=190, continuing_subword_prefix="##", min_frequency=3)), (odd, dict(vocab_size=60, min_frequency=1, end_of_word_suffix="</w>")), (odd, dict(vocab_size=60, min_frequency=2, limit_alphabet=2))):
        trainer = training.BpeTrainer(**made)
        want = trainer.train_words(training.collected(trainer.count(df)))
        with monkeypatch.context() as m:
            m.setattr(training, "LOCAL_WORDS", 0)
            m.setattr(training, "MAX_WORDS", 0)
            m.setattr(training, "TOP_PAIRS", 3)
            assert trainer.train(df) == want and want[1]
