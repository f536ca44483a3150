"""The registered queries of the tokenization engine, each with DuckDB SQL of the same rows.

Every query runs over a whole table. Strings and arrays are shown by length and MD5, so results
stay small rows (arrays: pieces joined by U+0001).
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chars import ALPHABET, CJK_SPLIT, GPT2, PUNCT, scripts_pattern
from .functions.columns import SEP, find_all
from .operators import decoders as D
from .operators import normalizers as N
from .operators import pretokenizers as T
from .operators import encoding as E
from .operators.encoding import word_spans
from .operators.models import BPE, ByteLevelBPE, CharBPE, Unigram, WordLevel, WordPiece, bpe_fold, text_encoder
from .operators.postprocessors import BertProcessing, RobertaProcessing, Template, pad, truncate
from .operators.vocab import AddedToken, id_to_token, out_of_vocabulary, special_mask, token_to_id, tokens_of, vocab_table
from .plans.chat import apply_template
from .plans.tokenizer import Tokenizer
from .sources.corpus import spread
from .plans.training import BpeTrainer, UnigramTrainer, alphabet, best_pair, pair_counts, score_adjusted, word_counts

Query = Callable[[SparkSession, str], DataFrame]

#: A fixed merge list, so that both sides of a check use the same one.
MERGES = [("t", "h"), ("e", "r"), ("th", "e"), ("i", "n"), ("a", "n"), ("o", "n"), ("e", "n"), ("r", "e"), ("in", "g"), ("a", "t"), ("e", "s"), ("o", "u"), ("t", "i"), ("ti", "on"), ("an", "d"), ("e", "d")]
PIECES = ["the", "and", "##ing", "##tion", "##er", "th", "##th", "in", "##in", "an", "##an", "on", "##on", "of", "##ed", *"abcdefghijklmnopqrstuvwxyz", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz")]
WORDS = ["the", "of", "and", "is", "to", "in", "that", "it", "le", "la", "de", "der", "die", "und", "el", "que"]
VOCAB = {"<unk>": 0} | {w: i + 1 for i, w in enumerate(WORDS)}
#: Where files of public tokenizers lie, and how many of their merges the subword queries take.
TOKENIZERS, N_MERGES = os.environ.get("SPARKLEX_TOKENIZERS", "/opt/tokenizers"), 8192


@cache
def _merges(file: str) -> list[tuple[str, str]]:
    """The first merges of a public byte-pair vocabulary; without the file, the short fixed list."""
    path = os.path.join(TOKENIZERS, file)
    if not os.path.exists(path):
        return MERGES
    with open(path, encoding="utf-8") as f:
        return [tuple(m) for m in json.load(f)["model"]["merges"][:N_MERGES]]


def _vocab(symbols: list[str], merges: list[tuple[str, str]], first: int = 0) -> dict[str, int]:
    return {t: first + i for i, t in enumerate(dict.fromkeys([*symbols, *(a + b for a, b in merges)]))}


@cache
def _byte_tokenizer() -> Tokenizer:
    """Byte-level BPE with the facade's own defaults."""
    merges = _merges("byte_bpe_50k.json")
    return Tokenizer(BPE(_vocab(ALPHABET, merges), merges))


_PRINTED = [chr(c) for c in range(33, 127)]


@cache
def _word_tokenizer() -> Tokenizer:
    """BPE over the printable ASCII characters of white-space words, so tokens are parts of the text; other characters are dropped."""
    merges: list[tuple[str, str]] = []
    made = set(_PRINTED)
    for a, b in _merges("byte_bpe_50k.json"):
        if a in made and b in made:
            merges.append((a, b))
            made.add(a + b)
    vocab = _vocab(_PRINTED, merges)
    n = len(vocab)
    added = (AddedToken("<s>", n, True), AddedToken("</s>", n + 1, True), AddedToken("<pad>", n + 2, True))
    return Tokenizer(BPE(vocab, merges), None, T.Whitespace(), Template("<s> $A </s>", "<s> $A </s> $B </s>", (("<s>", n), ("</s>", n + 1))), D.Fuse(), added)


@cache
def _char_bpe() -> CharBPE:
    merges = _merges("word_bpe_49k.json")
    return CharBPE(_vocab([*_PRINTED, *(c + "</w>" for c in _PRINTED)], merges, 1), merges)


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    return spread(df) if table == "documents" else df


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _all(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all({text}, {_q(pattern)})"


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _strings(name: str, expr: Callable[[Column], Column], sql: str | None, table: str = "documents", key: str = "doc_id") -> None:
    QUERIES[name] = lambda spark, sf: _read(spark, sf, table).select(key, expr(F.col("text")).alias("s")).select(key, F.char_length("s").cast("long").alias("n"), F.md5("s").alias("digest"))
    if sql is not None:
        ORACLE[name] = f"SELECT {key}, length(s)::BIGINT AS n, md5(s) AS digest FROM (SELECT {key}, {sql} AS s FROM {table})"


def _arrays(name: str, expr: Callable[[Column], Column], sql: str | None, table: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    QUERIES[name] = lambda spark, sf: _read(spark, sf, table).select(key, expr(F.col(text)).alias("a")).select(key, F.size("a").cast("long").alias("n"), F.md5(F.array_join("a", SEP)).alias("digest"))
    if sql is not None:
        ORACLE[name] = f"SELECT {key}, len(a)::BIGINT AS n, md5(array_to_string(a, chr(1))) AS digest FROM (SELECT {key}, {sql} AS a FROM {table})"


# ---- normalizers
_CLEAN = r"regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g'), '\s', ' ', 'g')"
_strings("norm_nfc", N.Form("NFC").expr, "nfc_normalize(text)")


@cache
def _decomposed(form: str) -> str:
    """The characters that a form takes apart (Hangul syllables aside), and their parts, as rows of SQL."""
    pairs = ((chr(c), unicodedata.normalize(form, chr(c))) for c in range(0x80, 0x30000) if not 0xAC00 <= c < 0xD7A4 and not 0xD800 <= c < 0xE000)
    return ", ".join(f"({_q(a)}, {_q(b)})" for a, b in pairs if a != b)


_APART = r"CASE WHEN regexp_matches(text, '[^\x00-\x7f]') THEN array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c < chr(128) THEN c ELSE coalesce(parts[c], c) END), '') ELSE text END"


def _form_sql(form: str, s: str) -> str:
    """s of each text in NFD or NFKD, as far as it holds no Hangul and no marks out of order."""
    seen = r"SELECT DISTINCT unnest(string_split(regexp_replace(text, '[\x00-\x7f]', '', 'g'), '')) AS c FROM documents"
    table = f"(SELECT map_from_entries(list((a, b))) AS parts FROM (VALUES {_decomposed(form)}) v(a, b) WHERE a IN ({seen}))"
    return f"SELECT doc_id, length(s)::BIGINT AS n, md5(s) AS digest FROM (SELECT doc_id, {s.format(_APART)} AS s FROM documents, {table})"


LATE: dict[str, Callable[[], str]] = {}
for _f, _from, _s in (("NFD", "NFD", "{}"), ("NFKD", "NFKD", "{}"), ("NFKC", "NFKD", "nfc_normalize({})")):
    _strings(f"norm_{_f.lower()}", N.Form(_f).expr, None)
    LATE[f"norm_{_f.lower()}"] = lambda form=_from, s=_s: _form_sql(form, s)
_strings("norm_lowercase", N.Lowercase().expr, "lower(text)")
_strings("norm_strip", N.Strip().expr, r"regexp_replace(text, '^\s+|\s+$', '', 'g')")
_strings("norm_strip_accents", N.StripAccents().expr, "strip_accents(text)")
_strings("norm_replace", N.Replace("th", "TH").expr, "replace(text, 'th', 'TH')")
_strings("norm_prepend", N.Prepend("▁").expr, "'▁' || text")
_strings("norm_append", N.Append("</d>").expr, "text || '</d>'")
_strings("norm_bert", N.Bert().expr, f"lower(strip_accents(nfc_normalize({_CLEAN})))")
_strings("norm_precompiled", N.Precompiled((("er", "3r"), ("on", "0n"))).expr, "replace(replace(text, 'er', '3r'), 'on', '0n')")
_strings("norm_sequence", N.bert_normalizer().expr, r"regexp_replace(strip_accents(lower(nfc_normalize(text))), '^\s+|\s+$', '', 'g')")

# ---- pre-tokenizers
_MAP = "MAP {" + ", ".join(f"{_q(chr(b))}: {_q(ALPHABET[b])}" for b in range(1, 128)) + ", " + ", ".join(f"{_q(chr(b))}: {_q(ALPHABET[x] + ALPHABET[y])}" for b in range(128, 256) for x, y in [chr(b).encode()]) + "}"
_BYTES = lambda s: f"array_to_string(list_transform(string_split({s}, ''), lambda c: coalesce({_MAP}[c], c)), '')"
_PUNCT_RE2 = "".join(["\\x{21}-\\x{2f}\\x{3a}-\\x{40}\\x{5b}-\\x{60}\\x{7b}-\\x{7e}\\x{a1}-\\x{bf}\\x{2010}-\\x{2027}\\x{2030}-\\x{205e}\\x{2e00}-\\x{2e7f}\\x{3001}-\\x{303f}"])
_parts = lambda s: f"list_filter(string_split({s}, chr(1)), lambda x: x <> '')"


def _shown_parts(behavior: str) -> Callable[[Column], Column]:
    """Split as its rows are shown, by parts between U+0001, the mark of shown arrays: a U+0001 of the text ends a part as well, and empty ones vanish."""
    return lambda c: F.flatten(F.transform(T.Split(r"[\p{P}é]", behavior).expr(c), T.CharDelimiter(SEP).expr))


_arrays("pretok_whitespace", T.Whitespace().expr, _all(r"\S+"))
_arrays("pretok_gpt2", T.Gpt2().expr, _all(GPT2))
_arrays("pretok_bytelevel", T.ByteLevel().expr, f"string_split({_BYTES('array_to_string(' + _all(GPT2) + ', chr(57344))')}, chr(57344))")
_arrays("pretok_bytelevel_prefix", T.ByteLevel(True).expr, f"string_split({_BYTES('array_to_string(' + _all(GPT2, '(CASE WHEN text <> chr(0) AND NOT starts_with(text, chr(32)) AND length(text) > 0 THEN chr(32) || text ELSE text END)') + ', chr(57344))')}, chr(57344))")
_arrays("pretok_metaspace", T.Metaspace().expr, _all(r"\S+", "'▁' || replace(text, ' ', '▁')"))
_arrays("pretok_punct", T.Punctuation().expr, _all(f"[{PUNCT}]|[^{PUNCT}]+"))
_arrays("pretok_punct_html", T.Punctuation().expr, _all(f"[{PUNCT}]|[^{PUNCT}]+", "html"), "pages", "page_id", "html")
_arrays("pretok_digits", T.Digits().expr, _all("[0-9]+|[^0-9]+", "html"), "pages", "page_id", "html")
_arrays("pretok_digits_individual", T.Digits(True).expr, _all("[0-9]|[^0-9]+", "html"), "pages", "page_id", "html")
_arrays("pretok_bert", T.Bert().expr, _all(f"[{CJK_SPLIT}]|[{_PUNCT_RE2}]|[^\\s{CJK_SPLIT}{PUNCT}]+"))
_arrays("pretok_char_delimiter", T.CharDelimiter("/").expr, "list_filter(string_split(url, '/'), lambda x: x <> '')", "pages", "page_id", "url")
_arrays("pretok_scripts", T.UnicodeScripts().expr, _all(scripts_pattern(False)))
_arrays("pretok_whitespace_split", T.WhitespaceSplit().expr, _all(r"\S+"))
_arrays("pretok_split_plain", T.Split(r"\w+").expr, _all(r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"))
_arrays("pretok_split_property", T.Split(r"\p{Lu}\p{Ll}+|\p{Latin}").expr, _all(r"\p{Lu}\p{Ll}+|\p{Latin}"))
_arrays("pretok_split_lookaround", T.Split("[a-z](?=e)").expr, "[text]")
_arrays("pretok_split_invert", T.Split(r"\W+", None, True).expr, _all(r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"))
_arrays("pretok_split_removed", T.Split(r"\p{Lu}\w+", "Removed").expr, r"CASE WHEN regexp_matches(text, '\p{Lu}[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+') THEN regexp_extract_all(text, '\p{Lu}[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+') ELSE [text] END")
_arrays("pretok_split_isolated", _shown_parts("Isolated"), _parts(r"regexp_replace(text, '([\p{P}é])', chr(1) || '\1' || chr(1), 'g')"))
_arrays("pretok_split_previous", _shown_parts("MergedWithPrevious"), _parts(r"regexp_replace(text, '((?:[\p{P}é])+)', '\1' || chr(1), 'g')"))
_arrays("pretok_split_next", _shown_parts("MergedWithNext"), _parts(r"regexp_replace(text, '([\p{P}é])', chr(1) || '\1', 'g')"))
_arrays("pretok_split_contiguous", _shown_parts("Contiguous"), _parts(r"regexp_replace(text, '((?:[\p{P}é])+)', chr(1) || '\1' || chr(1), 'g')"))
_arrays("pretok_sequence", T.Sequence((T.Whitespace(), T.Punctuation())).expr, f"flatten(list_transform({_all(chr(92) + 'S+')}, lambda w: {_all(f'[{PUNCT}]|[^{PUNCT}]+', 'w')}))")


# ---- vocabulary and word-level model
def _words(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", F.posexplode(find_all(F.col("text"), "(?U)\\S+")).alias("pos", "token"))


_WORDS_SQL = r"(SELECT doc_id, unnest(w) AS token, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents))"
_VOCAB_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({_q(t)}, {i}::BIGINT)" for t, i in VOCAB.items()) + ") v(token, id))"


def wordlevel_encode(spark: SparkSession, sf: str) -> DataFrame:
    got = token_to_id(_words(spark, sf), vocab_table(spark, VOCAB), 0, len(VOCAB))
    return got.groupBy("doc_id", "id").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("long")).alias("places"))


def vocab_id_to_token(spark: SparkSession, sf: str) -> DataFrame:
    ids = _read(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 20).alias("id"))
    return id_to_token(ids, vocab_table(spark, VOCAB), len(VOCAB)).select("doc_id", "id", "token")


def vocab_oov(spark: SparkSession, sf: str) -> DataFrame:
    return out_of_vocabulary(_words(spark, sf), vocab_table(spark, VOCAB), len(VOCAB)).groupBy("token").agg(F.count("*").alias("n"))


QUERIES |= {"wordlevel_encode": wordlevel_encode, "vocab_id_to_token": vocab_id_to_token, "vocab_oov": vocab_oov}
ORACLE |= {
    "wordlevel_encode": f"SELECT doc_id, coalesce(id, 0)::BIGINT AS id, count(*)::BIGINT AS n, sum(pos)::BIGINT AS places FROM {_WORDS_SQL} LEFT JOIN {_VOCAB_SQL} USING (token) GROUP BY ALL",
    "vocab_id_to_token": f"SELECT doc_id, n_chars % 20 AS id, token FROM documents LEFT JOIN {_VOCAB_SQL} ON id = n_chars % 20",
    "vocab_oov": f"SELECT token, count(*)::BIGINT AS n FROM {_WORDS_SQL} WHERE token NOT IN (SELECT token FROM {_VOCAB_SQL}) GROUP BY token",
}
_level = WordLevel(VOCAB)
_strings("wordlevel_decode", lambda c: _level.decode_expr(tokens_of(_level.names())(text_encoder(_level.encode_text, _level.by_chunks())(c))), r"array_to_string(list_transform(regexp_extract_all(text, '\S+'), lambda w: CASE WHEN w IN (" + ", ".join(map(_q, VOCAB)) + ") THEN w ELSE '<unk>' END), ' ')")

# ---- subword models
_fold_sql = lambda w: "replace(regexp_replace(" + "".join(["replace("] * len(MERGES)) + f"regexp_replace({w}, '((?s:.))', chr(1) || '\\1' || chr(2), 'g')" + "".join(f", chr(1) || {_q(a)} || chr(2) || chr(1) || {_q(b)} || chr(2), chr(1) || {_q(a + b)} || chr(2))" for a, b in MERGES) + ", '^' || chr(1) || '|' || chr(2) || '$', '', 'g'), chr(2) || chr(1), chr(1))"
_digest = lambda name: (F.size(name).cast("long").alias("n"), F.md5(F.array_join(F.col(name).cast("array<string>"), " ")).alias("digest"))
_joined = lambda x: f"md5(array_to_string(list_transform({x}, lambda i: i::VARCHAR), ' '))"


def _ids_of(name: str, expr: Callable[[], Callable[[Column], Column]], sql: Callable[[], str]) -> None:
    """A query of the ids that expr gives for each document; sql gives rows (doc_id, ids). Both are made when asked for."""
    QUERIES[name] = lambda spark, sf: _read(spark, sf, "documents").select("doc_id", expr()(F.col("text")).alias("a")).select("doc_id", *_digest("a"))
    LATE[name] = lambda: f"SELECT doc_id, len(ids)::BIGINT AS n, {_joined('ids')} AS digest FROM ({sql()})"


def _merged(pieces: str, start: str, merges: list[tuple[str, str]], vocab: dict[str, int], unknown: str = "") -> str:
    """WITH clauses. pieces: SQL of rows (doc_id, ps). Gives g (p, t): the tokens of each piece, and u (doc_id, k, p).

    Each step of the recursion merges the pair of least rank, leftmost first, in every piece that still has one.
    """
    return f"""WITH RECURSIVE u AS MATERIALIZED (SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS k FROM ({pieces})),
m AS MATERIALIZED (SELECT * FROM (VALUES {", ".join(f"({_q(a)}, {_q(b)}, {r})" for r, (a, b) in enumerate(merges))}) m(a, b, r)),
v AS MATERIALIZED (SELECT * FROM (VALUES {", ".join(f"({_q(t)}, {i})" for t, i in vocab.items())}) v(tok, id)),
f AS (SELECT p, {start} AS s, 0 AS step FROM (SELECT DISTINCT p FROM u)
  UNION ALL SELECT p, list_concat(list_append(s[:i - 1], s[i] || s[i + 1]), s[i + 2:]), step + 1
  FROM (SELECT p, any_value(s) AS s, any_value(step) AS step, arg_min(i, r::BIGINT * 1000000 + i) AS i FROM (SELECT p, s, step, unnest(range(1, len(s))) AS i FROM f) JOIN m ON a = s[i] AND b = s[i + 1] GROUP BY p)),
g AS MATERIALIZED (SELECT p, arg_max(s, step) AS t FROM f GROUP BY p),
h AS MATERIALIZED (SELECT p, list({unknown or 'id'} ORDER BY j) AS ids FROM (SELECT p, unnest(t) AS tok, unnest(range(0, len(t))) AS j FROM g) {"LEFT " if unknown else ""}JOIN v USING (tok) GROUP BY p)"""


_PER_DOC = "SELECT d.doc_id, coalesce(x.ids, []) AS ids FROM documents d LEFT JOIN (SELECT doc_id, flatten(list(ids ORDER BY k)) AS ids FROM u JOIN h USING (p) GROUP BY doc_id) x USING (doc_id)"
_bytes_sql = lambda parts: f"string_split({_BYTES('array_to_string(' + parts + ', chr(57344))')}, chr(57344))"
_CHARS_OF = "string_split(p, '')"


def _bpe_sql(last: str = _PER_DOC) -> str:
    t = _byte_tokenizer()
    return _merged(f"SELECT doc_id, {_bytes_sql(_all(GPT2, 'nfc_normalize(text)'))} AS ps FROM documents WHERE text <> ''", _CHARS_OF, t.model.merges, t.model.vocab) + " " + last


_ids_of("bpe_encode", lambda: _byte_tokenizer().encode, _bpe_sql)
_byte_model = cache(lambda: ByteLevelBPE(_byte_tokenizer().model.vocab, _byte_tokenizer().model.merges))
_ids_of("bytelevel_bpe_encode", lambda: text_encoder(_byte_model().encode_text, _byte_model().by_chunks()), lambda: _merged("SELECT doc_id, " + _bytes_sql("list_filter(list_transform(string_split(text, ' '), lambda x, i: CASE WHEN i = 1 THEN x ELSE ' ' || x END), lambda x: x <> '')") + " AS ps FROM documents WHERE text <> ''", _CHARS_OF, _byte_model().merges, _byte_model().vocab) + " " + _PER_DOC)
_ids_of("charbpe_encode", lambda: text_encoder(_char_bpe().encode_text, _char_bpe().by_chunks()), lambda: _merged(r"SELECT doc_id, regexp_extract_all(text, '\S+') AS ps FROM documents", "list_append(string_split(p, '')[:-2], string_split(p, '')[-1] || '</w>')", _char_bpe().merges, _char_bpe().vocab, "coalesce(id, 0)") + " " + _PER_DOC)


def _wordpiece() -> WordPiece:
    return WordPiece({"[UNK]": 0} | {p: i + 1 for i, p in enumerate(PIECES)})


def _alts(pieces: list[str]) -> str:
    return "|".join(sorted(pieces, key=lambda p: (-len(p), p)))


_first = _alts([p for p in PIECES if not p.startswith("##")])
_rest = _alts([p[2:] for p in PIECES if p.startswith("##")])
QUERIES["wordpiece_encode"] = lambda spark, sf: _read(spark, sf, "documents").select("doc_id", text_encoder(_wordpiece().encode_text)(F.lower("text")).alias("a")).select("doc_id", *_digest("a"))
ORACLE["wordpiece_encode"] = (
    rf"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS ws FROM documents), v AS (SELECT MAP {{" + ", ".join(f"{_q(p)}: {i + 1}" for i, p in enumerate(PIECES)) + "} AS m), "
    rf"p AS (SELECT doc_id, flatten(list_transform(ws, lambda x: CASE WHEN length(x) > 100 THEN ['?'] ELSE list_concat([regexp_extract(x, '^(?:{_first}|(?s:.))')], list_transform(regexp_extract_all(substr(x, 1 + length(regexp_extract(x, '^(?:{_first}|(?s:.))'))), '(?:{_rest})|(?s:.)'), lambda y: '##' || y)) END)) AS ps FROM w) "
    "SELECT doc_id, len(ps)::BIGINT AS n, md5(array_to_string(list_transform(ps, lambda x: coalesce(m[x], 0)::VARCHAR), ' ')) AS digest FROM p, v"
)
_UNIGRAM = [("<unk>", 0.0), *((c, -4.0 - k / 10) for k, c in enumerate("etaoinsrhldcumfpgwybvkxjqz ")), *((p, -5.0 - k / 10) for k, p in enumerate(["th", "the", "er", "on", "an", "tion", "ing", "and", "▁"]))]
_unigram = Unigram(_UNIGRAM)


def _unigram_sql() -> str:
    """Best paths of the parts between single spaces, which no piece but the space itself crosses; a step of the recursion adds one character."""
    unknown = _unigram.unknown
    longest = _unigram.longest
    score = lambda x: f"sc[{x}]"
    ways = ", ".join(f"{{'v': CASE WHEN e >= {n} AND {score(f'p[e - {n - 1}:e]')} IS NOT NULL THEN best[e - {n - 1}] + {score(f'p[e - {n - 1}:e]')} WHEN {n} = 1 THEN best[e] + {unknown} END, 'n': {n}}}" for n in range(longest, 0, -1))
    ids = "MAP {" + ", ".join(f"{_q(t)}: {i}" for t, i in _unigram.vocab.items()) + "}"
    scores = "MAP {" + ", ".join(f"{_q(t)}: {x}::DOUBLE" for t, x in _unigram.score.items()) + "}"
    return f"""WITH RECURSIVE u AS MATERIALIZED (SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS k FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda x, i: CASE WHEN i = 1 THEN x ELSE ' ' || x END) AS ps FROM documents)),
f AS (SELECT p, {scores} AS sc, 1 AS e, [0.0::DOUBLE] AS best, [[]::INTEGER[]] AS paths FROM (SELECT DISTINCT p FROM u WHERE p <> '')
  UNION ALL SELECT p, sc, e + 1, list_append(best, w.v), list_append(paths, list_append(paths[e - w.n + 1], coalesce(({ids})[p[e - w.n + 1:e]], 0))[:])
  FROM (SELECT p, sc, e, best, paths, list_reduce(list_filter([{ways}], lambda x: x.v IS NOT NULL), lambda x, y: CASE WHEN y.v > x.v THEN y ELSE x END) AS w FROM f WHERE e <= length(p))),
h AS MATERIALIZED (SELECT p, paths[e] AS ids FROM f WHERE e = length(p) + 1) {_PER_DOC}"""


_ids_of("unigram_encode", lambda: text_encoder(_unigram.encode_text, _unigram.by_chunks()), _unigram_sql)
_strings("unigram_decode", lambda c: _unigram.decode_expr(tokens_of(_unigram.names())(text_encoder(_unigram.encode_text)(c))), "regexp_replace(text, '[^a-z ▁]', '<unk>', 'g')")

# ---- decoders
_toks = lambda c: find_all(c, "(?U)\\S+")
_TOKS = r"regexp_extract_all(text, '\S+')"
_reps = lambda s, pairs: "".join(["replace("] * len(pairs)) + s + "".join(f", {_q(a)}, {_q(b)})" for a, b in pairs)
_tight = [(f" {x}", x) for x in ".,!?:;"]
_CLEANUP = [*_tight, *[p for q in "\"'" for p in ((f"{q} ", q), (f" {q}", q))], *[p for a, b in ("()", "[]") for p in ((f"{a} ", a), (f" {b}", b))], (" - ", "-")]
_strings("decode_cleanup", D.clean_up, f"regexp_replace(regexp_replace({_reps('text', _CLEANUP)}, '\\s+', ' ', 'g'), '^ | $', '', 'g')")
_strings("decode_fuse", lambda c: D.Fuse().expr(_toks(c)), f"array_to_string({_TOKS}, '')")
_strings("decode_bytelevel", lambda c: D.ByteLevel().expr(T.ByteLevel().expr(c)), "text")
_strings("decode_metaspace", lambda c: D.Metaspace().expr(T.Metaspace().expr(c)), r"array_to_string(regexp_extract_all(' ' || text, '[^\t\n\x0b\f\r]+'), '')[2:]")
_strings("decode_wordpiece", lambda c: D.WordPiece("##", True).expr(F.transform(_toks(c), lambda w: F.when(F.startswith(w, F.lit("t")), F.concat(F.lit("##"), w)).otherwise(w))), _reps(f"regexp_replace(array_to_string(list_transform({_TOKS}, lambda w: CASE WHEN starts_with(w, 't') THEN w ELSE ' ' || w END), ''), '^ ', '')", [*_tight, (" '", "'"), ("' ", "'")]))
_strings("decode_bpe", lambda c: D.BPE("</w>").expr(F.transform(_toks(c), lambda w: F.concat(w, F.lit("</w>")))), f"array_to_string({_TOKS}, ' ')")
_strings("decode_replace", lambda c: D.Replace("th", "þ").expr(_toks(c)), f"replace(array_to_string({_TOKS}, ''), 'th', 'þ')")
_strings("decode_strip", lambda c: D.Strip("E", 1, 2).expr(F.array(c)), "regexp_replace(regexp_replace(text, '^E{0,1}', ''), 'E{0,2}$', '')")
_strings("decode_ctc", lambda c: D.CTC("e", "t").expr(F.filter(F.split(c, ""), lambda x: x != "")), "array_to_string(list_transform(list_zip(string_split(text, ''), list_concat([''], string_split(text, '')[:-2])), lambda x: CASE WHEN x[1] = 'e' THEN '' WHEN x[1] = 't' THEN ' ' WHEN x[1] = x[2] THEN '' ELSE x[1] END), '')")
_strings("decode_sequence", lambda c: D.Sequence((D.Replace("o", "0"), D.Strip("T", 1, 0))).expr(_toks(c)), f"regexp_replace(replace(array_to_string({_TOKS}, ''), 'o', '0'), '^T', '')")

# ---- post-processing, truncation, padding, windows
_ids = lambda: F.transform(_toks(F.col("text")), lambda w: F.char_length(w).cast("long"))
_IDS = f"list_transform({_TOKS}, lambda w: length(w)::BIGINT)"


def _idlists(name: str, make: Callable[[Column, Column], Column], sql: str) -> None:
    QUERIES[name] = lambda spark, sf: _read(spark, sf, "documents").select("doc_id", _ids().alias("a")).withColumn("b", F.reverse("a")).select("doc_id", make(F.col("a"), F.col("b")).alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join(F.transform("x", lambda i: i.cast("string")), " ")).alias("digest"))
    ORACLE[name] = f"SELECT doc_id, len(x)::BIGINT AS n, md5(array_to_string(list_transform(x, lambda i: i::VARCHAR), ' ')) AS digest FROM (SELECT doc_id, {sql} AS x FROM (SELECT doc_id, a, list_reverse(a) AS b FROM (SELECT doc_id, {_IDS} AS a FROM documents)))"


_idlists("post_bert", lambda a, b: BertProcessing().expr(a), "list_concat([101::BIGINT], a, [102::BIGINT])")
_idlists("post_bert_pair", lambda a, b: BertProcessing().expr(a, b), "[101::BIGINT] || a || [102::BIGINT] || b || [102::BIGINT]")
_idlists("post_roberta_pair", lambda a, b: RobertaProcessing().expr(a, b), "[0::BIGINT] || a || [2::BIGINT, 2::BIGINT] || b || [2::BIGINT]")
_idlists("post_template", lambda a, b: Template("<s> $A </s>", "<s> $A </s> $B </s>", (("<s>", 900), ("</s>", 901))).expr(a, b), "[900::BIGINT] || a || [901::BIGINT] || b || [901::BIGINT]")
_idlists("trunc_only_first", lambda a, b: F.concat(*truncate(a, b, 500, "only_first")), "a[1:greatest(0, least(len(a), 500 - len(b)))] || b")
_idlists("trunc_only_second", lambda a, b: F.concat(*truncate(a, b, 500, "only_second")), "a || b[1:greatest(0, least(len(b), 500 - len(a)))]")
_idlists("trunc_longest_first", lambda a, b: F.concat(*truncate(a, b, 101, "longest_first")), "a[1:greatest(0, len(a) - ceil(greatest(0, 2 * len(a) - 101) / 2)::BIGINT)] || b[1:greatest(0, len(b) - floor(greatest(0, 2 * len(a) - 101) / 2)::BIGINT)]")
_idlists("pad_right", lambda a, b: pad(a, 400), "a || list_transform(range(0, greatest(0, 400 - len(a))), lambda i: 0::BIGINT)")
_idlists("pad_left", lambda a, b: pad(a, 400, 7, True), "list_transform(range(0, greatest(0, 400 - len(a))), lambda i: 7::BIGINT) || a")
_idlists("special_mask", lambda a, b: special_mask(a, [2, 3, 5]), "list_transform(a, lambda i: CASE WHEN i IN (2, 3, 5) THEN 1 ELSE 0 END::BIGINT)")


# ---- the facade and the Encoding operators, over tokens of white-space words
def _enc_sql(last: str) -> str:
    """e (doc_id, ids, toks, wids, sts, ens): the Encoding of each document; offsets are bytes."""
    t = _word_tokenizer()
    lists = ", ".join(f"list({x} ORDER BY k, j) AS {n}" for n, x in (("ids", "id::BIGINT"), ("toks", "tok"), ("wids", "k"), ("sts", "st"), ("ens", "st + strlen(tok)")))
    return (
        _merged(r"SELECT doc_id, regexp_extract_all(text, '\S+') AS ps FROM documents", "list_filter(string_split(p, ''), lambda c: c >= '!' AND c <= '~')", t.model.merges, t.model.vocab)
        + rf""", z AS (SELECT doc_id, k, p, sum(strlen(gap)) OVER (PARTITION BY doc_id ORDER BY k) + coalesce(sum(strlen(p)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS k, unnest(gaps[1:len(ps)]) AS gap FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS ps, string_split_regex(text, '\S+') AS gaps FROM documents))),
tk AS MATERIALIZED (SELECT doc_id, k, j, tok, (base + coalesce(sum(strlen(tok)) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS st
  FROM (SELECT doc_id, k, base, unnest(t) AS tok, unnest(range(0, len(t))) AS j FROM z JOIN g USING (p))),
e AS MATERIALIZED (SELECT d.doc_id, lang, coalesce(ids, []) AS ids, coalesce(toks, []) AS toks, coalesce(wids, []) AS wids, coalesce(sts, []) AS sts, coalesce(ens, []) AS ens
  FROM documents d LEFT JOIN (SELECT doc_id, {lists} FROM tk JOIN v USING (tok) GROUP BY doc_id) x ON x.doc_id = d.doc_id) """
        + last
    )


def _specials() -> tuple[int, int, int]:
    return tuple(_word_tokenizer().special_tokens[t] for t in ("<s>", "</s>", "<pad>"))


_total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
_shown = lambda a: F.md5(F.array_join(a.cast("array<string>"), " "))
_size = lambda a: F.size(a).cast("long")


def _facade(name: str, made: Callable[[Tokenizer, DataFrame], DataFrame], columns: Callable[[Column], dict[str, Column]], sql: Callable[[], str]) -> None:
    """made gives (doc_id, e) for documents; columns what is shown of e; sql selects the same from e."""
    QUERIES[name] = lambda spark, sf: made(_word_tokenizer(), _read(spark, sf, "documents")).select("doc_id", *[c.alias(n) for n, c in columns(F.col("e")).items()])
    LATE[name] = lambda: _enc_sql(f"SELECT doc_id, {sql()} FROM e")


def _on_text(make: Callable[[Tokenizer, Column], Column]) -> Callable[[Tokenizer, DataFrame], DataFrame]:
    return lambda t, docs: docs.select("doc_id", make(t, F.col("text")).alias("e"))


_ids_shown = lambda e: {"n": _size(e), "digest": _shown(e)}
_ids_sql = lambda ids: f"len({ids})::BIGINT AS n, {_joined(ids)} AS digest"
_framed = lambda ids="ids": "[{}::BIGINT] || {} || [{}::BIGINT]".format(_specials()[0], ids, _specials()[1])
_fields = lambda e: {"n": _size(e["ids"]), "digest": _shown(e["ids"]), "tokens": F.md5(F.array_join(e["tokens"], " ")), "types": _total(e["type_ids"]), "attention": _total(e["attention_mask"]), "special": _total(e["special_tokens_mask"])}


def _fields_sql(ids: str, toks: str, types: str, attention: str, special: str) -> str:
    return f"{_ids_sql(ids)}, md5(array_to_string({toks}, ' ')) AS tokens, ({types})::BIGINT AS types, ({attention})::BIGINT AS attention, ({special})::BIGINT AS special"


_TWICE = "ids || ids"
_padded = lambda ids, to, value: f"{ids} || list_transform(range(0, greatest(0, {to} - len({ids}))), lambda i: {value}::BIGINT)"
_facade("tok_encode", _on_text(lambda t, c: t.encode(c)), _ids_shown, lambda: _ids_sql("ids"))
_facade("tok_tokenize", _on_text(lambda t, c: t.tokenize(c)), lambda e: {"n": _size(e), "tokens": F.md5(F.array_join(e, " "))}, lambda: "len(toks)::BIGINT AS n, md5(array_to_string(toks, ' ')) AS tokens")
_facade("tok_convert_tokens", _on_text(lambda t, c: t.convert_tokens_to_ids(t.tokenize(c))), _ids_shown, lambda: _ids_sql("ids"))
_facade("tok_convert_ids", _on_text(lambda t, c: t.convert_ids_to_tokens(t.post_process(t.encode(c)), True)), lambda e: {"n": _size(e), "tokens": F.md5(F.array_join(e, " "))}, lambda: "len(toks) + 2 AS n, md5(array_to_string(toks, ' ')) AS tokens")
_facade("tok_tokens_to_string", _on_text(lambda t, c: t.convert_tokens_to_string(t.tokenize(c))), lambda e: {"n": F.char_length(e).cast("long"), "digest": F.md5(e)}, lambda: "length(array_to_string(toks, ''))::BIGINT AS n, md5(array_to_string(toks, '')) AS digest")
_facade("tok_post_process", _on_text(lambda t, c: t.post_process(t.encode(c))), _ids_shown, lambda: _ids_sql(_framed()))
_facade("tok_post_process_pair", _on_text(lambda t, c: t.post_process(t.encode(c), F.reverse(t.encode(c)))), _ids_shown, lambda: _ids_sql(f"({_framed()} || list_reverse(ids) || [{_specials()[1]}::BIGINT])"))
_facade("tok_special_mask", _on_text(lambda t, c: t.special_tokens_mask(t.post_process(t.encode(c)))), lambda e: {"n": _size(e), "special": _total(e)}, lambda: "len(ids) + 2 AS n, 2::BIGINT AS special")
_facade("tok_encode_single", _on_text(lambda t, c: t.encoding(c, None, False)), lambda e: _fields(e) | {"starts": _shown(e["offsets"]["start"]), "ends": _shown(e["offsets"]["end"]), "words": _shown(e["word_ids"]), "sequences": _total(e["sequence_ids"])}, lambda: _fields_sql("ids", "toks", "0", "len(ids)", "0") + f", {_joined('sts')} AS starts, {_joined('ens')} AS ends, {_joined('wids')} AS words, 0::BIGINT AS sequences")
_facade("tok_encoding", _on_text(lambda t, c: t.encoding(c)), _fields, lambda: _fields_sql(f"({_framed()})", "toks", "0", "len(ids) + 2", "CASE WHEN len(ids) > 0 THEN 3 ELSE 2 END"))
_facade("tok_encoding_aligned", _on_text(lambda t, c: t.encoding(c, None, True, True)), lambda e: _fields(e) | {"starts": _shown(F.filter(e["offsets"]["start"], lambda x: x.isNotNull())), "n_offsets": _size(e["offsets"])}, lambda: _fields_sql(f"({_framed()})", "['<s>'] || toks || ['</s>']", "0", "len(ids) + 2", "2") + f", {_joined('sts')} AS starts, len(ids) + 2 AS n_offsets")
_facade("tok_encode_pair", _on_text(lambda t, c: t.encoding(c, c)), lambda e: _fields(e) | {"sequences": _total(e["sequence_ids"])}, lambda: _fields_sql(f"({_framed('ids || ids')})", "toks || toks", "len(ids)", "2 * len(ids) + 2", "CASE WHEN len(ids) > 0 THEN 3 ELSE 2 END") + ", len(ids)::BIGINT AS sequences")
_facade("tok_prepare_for_model", _on_text(lambda t, c: t.prepare_for_model(t.encode(c), t.encode(c), padding="max_length", truncation=True, max_length=64)), lambda e: _ids_shown(e["ids"]), lambda: _ids_sql(f"({_padded(f'({_framed(_TWICE)})[:64]', 64, _specials()[2])})"))
_facade("tok_call", lambda t, docs: t(docs.select("doc_id", "text")).withColumnRenamed("encoding", "e"), lambda e: _ids_shown(e["ids"]), lambda: _ids_sql(f"({_framed()})"))
_facade("tok_call_padding", lambda t, docs: t(docs.select("doc_id", "text"), padding=True, truncation=True).withColumnRenamed("encoding", "e"), lambda e: _ids_shown(e["ids"]) | {"attention": _total(e["attention_mask"])}, lambda: _ids_sql(f"({_padded(f'({_framed()})[:512]', '(SELECT least(512, max(len(ids) + 2)) FROM e)', _specials()[2])})") + ", least(512, len(ids) + 2)::BIGINT AS attention")


def tok_call_overflow(spark: SparkSession, sf: str) -> DataFrame:
    """Truncation to 128 ids with overlapping overflow: one row a window."""
    made = _word_tokenizer()(_read(spark, sf, "documents").select("doc_id", "text"), truncation=True, max_length=128, stride=32, fields=("ids",))
    w = made.select("doc_id", F.posexplode(F.concat(F.array("encoding"), "overflowing")).alias("window", "e"))
    return w.select("doc_id", F.col("window").cast("long").alias("window"), _size("e.ids").alias("n"), _total(F.col("e.ids")).alias("total"))


def stride_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping windows of 128 tokens, 32 shared: one row each."""
    e, shown = F.col("e"), ("ids", "tokens")
    made = _read(spark, sf, "documents").select("doc_id", _word_tokenizer().encoding(F.col("text"), None, False).alias("e"))
    w = made.select("doc_id", F.posexplode(F.concat(F.array(F.struct(*[E.truncate(e, 128)[f].alias(f) for f in shown])), E.overflow(e, 128, 32, shown))).alias("window", "w"))
    return w.select("doc_id", F.col("window").cast("long").alias("window"), _size("w.ids").alias("n"), _total(F.col("w.ids")).alias("total"), F.md5(F.array_join("w.tokens", " ")).alias("tokens"))


def _windows_sql(ids: str, more: str = "") -> str:
    return f"SELECT doc_id, w AS \"window\", len(ids[96 * w + 1:96 * w + 128])::BIGINT AS n, coalesce(list_sum(ids[96 * w + 1:96 * w + 128]), 0)::BIGINT AS total{more} FROM (SELECT doc_id, ids, toks, unnest(range(0, 1 + CASE WHEN len(ids) > 128 THEN len(range(96, greatest(97, len(ids) - 32), 96)) ELSE 0 END)) AS w FROM (SELECT doc_id, {ids} AS ids, toks FROM e))"


QUERIES |= {"tok_call_overflow": tok_call_overflow, "stride_windows": stride_windows}
LATE["tok_call_overflow"] = lambda: _enc_sql(_windows_sql(_framed()))
LATE["stride_windows"] = lambda: _enc_sql(_windows_sql("ids", ", md5(array_to_string(toks[96 * w + 1:96 * w + 128], ' ')) AS tokens"))
_strings("tok_decode", lambda c: _byte_tokenizer().decode(_byte_tokenizer().encode(c)), f"regexp_replace(regexp_replace({_reps('nfc_normalize(text)', _CLEANUP)}, '\\s+', ' ', 'g'), '^ | $', '', 'g')")
_strings("tok_decode_raw", lambda c: _byte_tokenizer().decode(_byte_tokenizer().encode(c), clean=False), "nfc_normalize(text)")


def _aligned(name: str, columns: Callable[[Column], dict[str, Column]], sql: str) -> None:
    _facade(name, _on_text(lambda t, c: t.encoding(c, None, False)), columns, lambda: sql)


_none = lambda x: f"nullif(coalesce({x}, 0), 0)"
_word3 = "list_filter(range(0, len(ids)), lambda i: wids[i + 1] = 3)"
_aligned("enc_from_ids", lambda e: _fields(E.from_ids(e["ids"], e["tokens"])), _fields_sql("ids", "toks", "0", "len(ids)", "0"))
_aligned("enc_pad", lambda e: _fields(E.pad(e, 600, 7, "<p>")), _fields_sql(f"({_padded('ids', 600, 7)})", "toks || list_transform(range(0, greatest(0, 600 - len(ids))), lambda i: '<p>')", "0", "len(ids)", "greatest(0, 600 - len(ids))"))
_aligned("enc_pad_left", lambda e: _fields(E.pad(e, 600, 7, "<p>", True)), _fields_sql("(list_transform(range(0, greatest(0, 600 - len(ids))), lambda i: 7::BIGINT) || ids)", "list_transform(range(0, greatest(0, 600 - len(ids))), lambda i: '<p>') || toks", "0", "len(ids)", "greatest(0, 600 - len(ids))"))
_aligned("enc_truncate", lambda e: _fields(E.truncate(e, 100)) | {"ends": _shown(E.truncate(e, 100)["offsets"]["end"])}, _fields_sql("ids[:100]", "toks[:100]", "0", "least(100, len(ids))", "0") + f", {_joined('ens[:100]')} AS ends")
_aligned("enc_overflow_rest", lambda e: {"n_overflowing": _size(E.overflow(e, 100)), "rest": _total(F.transform(E.overflow(e, 100), lambda w: _size(w["ids"])))}, "CASE WHEN len(ids) > 100 THEN 1 ELSE 0 END::BIGINT AS n_overflowing, greatest(0, len(ids) - 100)::BIGINT AS rest")
_aligned("enc_merge", lambda e: _fields(E.merge(e, E.truncate(e, 5), 1)), _fields_sql("(ids || ids[:5])", "toks || toks[:5]", "least(5, len(ids))", "len(ids) + least(5, len(ids))", "0"))
_aligned("enc_set_type_ids", lambda e: _fields(E.set_type_ids(e, 2, 10, 3)), _fields_sql("ids", "toks", "3 * greatest(0, least(10, len(ids)) - 2)", "len(ids)", "0"))
_aligned("enc_mark_special", lambda e: _fields(E.mark_special_tokens(e, [65, 68, 80])), _fields_sql("ids", "toks", "0", "len(ids)", "len(list_filter(ids, lambda i: i IN (65, 68, 80)))"))
_aligned("enc_char_to_token", lambda e: {"token": E.char_to_token(e, F.lit(50)), "in_second": E.char_to_token(e, F.lit(50), 1)}, f"{_none('list_position(list_transform(list_zip(sts, ens), lambda x: x[1] <= 50 AND 50 < x[2]), true)')} - 1 AS token, NULL::BIGINT AS in_second")
_aligned("enc_token_to", lambda e: {"start": E.token_to_chars(e, F.lit(10))["start"], "end": E.token_to_chars(e, F.lit(10))["end"], "word": E.token_to_word(e, F.lit(10)), "sequence": E.token_to_sequence(e, F.lit(10))}, 'sts[11] AS start, ens[11] AS "end", wids[11]::BIGINT AS word, CASE WHEN len(ids) > 10 THEN 0 END::BIGINT AS sequence')
_aligned("enc_word_to_tokens", lambda e: {"at": _shown(E.word_token_indices(e, F.lit(3))), "start": E.word_to_tokens(e, F.lit(3))["start"], "end": E.word_to_tokens(e, F.lit(3))["end"]}, f'{_joined(_word3)} AS at, list_min({_word3}) AS start, list_max({_word3}) + 1 AS "end"')
_aligned("enc_word_to_chars", lambda e: {"start": E.word_to_chars(e, F.lit(3))["start"], "end": E.word_to_chars(e, F.lit(3))["end"]}, f'list_min(list_transform({_word3}, lambda i: sts[i + 1])) AS start, list_max(list_transform({_word3}, lambda i: ens[i + 1])) AS "end"')
_aligned("enc_n_words", lambda e: {"n_words": E.n_words(e), "n_tokens": _size(e["ids"])}, "coalesce(list_max(wids) + 1, 0)::BIGINT AS n_words, len(ids)::BIGINT AS n_tokens")


def enc_word_spans(spark: SparkSession, sf: str) -> DataFrame:
    made = _read(spark, sf, "documents").select("doc_id", _word_tokenizer().encoding(F.col("text"), None, False).alias("encoding"))
    return word_spans(E.to_flat(made, "doc_id", fields=("offsets", "word_ids", "sequence_ids")), "doc_id").drop("seq_id")


QUERIES["enc_word_spans"] = enc_word_spans
LATE["enc_word_spans"] = lambda: _enc_sql("SELECT doc_id, k::BIGINT AS word_id, min(pos)::BIGINT AS first_token, (max(pos) + 1)::BIGINT AS end_token, min(st) AS first_char, max(st + strlen(tok)) AS end_char FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS pos FROM tk) GROUP BY doc_id, k")


# ---- training
def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return word_counts(_read(spark, sf, "documents"), _toks(F.col("text")))


_COUNTS = f"(SELECT token AS word, count(*)::BIGINT AS freq FROM {_WORDS_SQL} GROUP BY 1)"
_CHARS = f"(SELECT ch, sum(freq)::BIGINT AS freq FROM (SELECT unnest(string_split(word, '')) AS ch, freq FROM {_COUNTS}) GROUP BY 1)"
_PAIRS = f"(SELECT cs[i] AS \"left\", cs[i + 1] AS \"right\", sum(freq)::BIGINT AS freq FROM (SELECT cs, freq, unnest(range(1, len(cs))) AS i FROM (SELECT string_split(word, '') AS cs, freq FROM {_COUNTS})) GROUP BY 1, 2)"
QUERIES |= {
    "train_word_counts": _counts,
    "train_word_counts_min": lambda spark, sf: word_counts(_read(spark, sf, "documents"), _toks(F.col("text")), 3, 5),
    "train_alphabet": lambda spark, sf: alphabet(_counts(spark, sf)),
    "train_pair_counts": lambda spark, sf: pair_counts(_counts(spark, sf)),
    "train_top_pair": lambda spark, sf: best_pair(pair_counts(_counts(spark, sf))),
    "train_unigram_seed": lambda spark, sf: UnigramTrainer().seed(_counts(spark, sf)),
    "train_inl_scores": lambda spark, sf: score_adjusted(pair_counts(_counts(spark, sf)), alphabet(_counts(spark, sf))).select("left", "right", "freq", F.round("score", 4).alias("score")),
    "train_merge_step": lambda spark, sf: pair_counts(_counts(spark, sf).withColumn("s", F.split(bpe_fold(F.array("word"), MERGES[:4])[0], SEP)), F.col("s")),
}
ORACLE |= {
    "train_word_counts": f"SELECT * FROM {_COUNTS}",
    "train_word_counts_min": f"SELECT * FROM {_COUNTS} WHERE length(word) >= 3 AND freq >= 5",
    "train_alphabet": f"SELECT * FROM {_CHARS}",
    "train_pair_counts": f"SELECT * FROM {_PAIRS}",
    "train_top_pair": f'SELECT "left", "right", freq FROM {_PAIRS} ORDER BY freq DESC, "left" DESC, "right" DESC LIMIT 1',
    "train_unigram_seed": f"SELECT word[i:i + k - 1] AS piece, sum(freq)::BIGINT AS freq FROM (SELECT word, freq, unnest(range(1, length(word) + 1)) AS i FROM {_COUNTS}), (SELECT unnest(range(1, 17)) AS k) WHERE i + k - 1 <= length(word) GROUP BY 1",
    "train_inl_scores": f"WITH c AS {_CHARS}, v AS (SELECT ch, least(greatest(-0.3 * (freq - 0.01 * (SELECT sum(freq) FROM c)), -10.0), 10.0)::DOUBLE AS v FROM c), p AS {_PAIRS} SELECT p.\"left\", p.\"right\", p.freq, round(p.freq - 0.5 * (a.v + b.v), 4)::DOUBLE AS score FROM p JOIN v a ON a.ch = p.\"left\" JOIN v b ON b.ch = p.\"right\"",
    "train_merge_step": "WITH c AS (SELECT string_split(" + _fold_sql("word").replace("".join(["replace("] * len(MERGES)), "".join(["replace("] * 4)).replace("".join(f", chr(1) || {_q(a)} || chr(2) || chr(1) || {_q(b)} || chr(2), chr(1) || {_q(a + b)} || chr(2))" for a, b in MERGES[4:]), "") + f", chr(1)) AS cs, freq FROM {_COUNTS}) SELECT cs[i] AS \"left\", cs[i + 1] AS \"right\", sum(freq)::BIGINT AS freq FROM (SELECT cs, freq, unnest(range(1, len(cs))) AS i FROM c) GROUP BY 1, 2",
}

N_TRAINED = 48


def train_bpe_merges(spark: SparkSession, sf: str) -> DataFrame:
    """The first merges that training learns from all words of documents."""
    words = _counts(spark, sf).cache()
    try:
        trainer = BpeTrainer(len(BpeTrainer.special_tokens) + alphabet(words).count() + N_TRAINED)
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(trainer.train_table(words)[1])], "step long, left string, right string")
    finally:
        words.unpersist()


QUERIES["train_bpe_merges"] = train_bpe_merges
_best = "(SELECT arg_max((a, b), (freq, a, b)) AS p FROM (SELECT cs[i] AS a, cs[i + 1] AS b, sum(freq) AS freq FROM (SELECT cs, freq, unnest(range(1, len(cs))) AS i FROM (SELECT string_split(s, chr(1)) AS cs, freq FROM {})) GROUP BY 1, 2))"
_joined_pair = "replace(trim(replace(chr(2) || replace(s, chr(1), chr(2) || chr(2)) || chr(2), chr(2) || p[1] || chr(2) || chr(2) || p[2] || chr(2), chr(2) || p[1] || p[2] || chr(2)), chr(2)), chr(2) || chr(2), chr(1))"
LATE["train_bpe_merges"] = lambda: f"""WITH RECURSIVE w AS MATERIALIZED (SELECT array_to_string(string_split(word, ''), chr(1)) AS s, freq FROM {_COUNTS}),
f AS (SELECT 0 AS step, s, freq, q.p FROM w, {_best.format('w')} AS q
  UNION ALL SELECT * FROM (WITH n AS (SELECT step + 1 AS step, {_joined_pair} AS s, freq FROM f WHERE step < {N_TRAINED - 1}) SELECT step, s, freq, q.p FROM n, {_best.format('n')} AS q))
SELECT DISTINCT step::BIGINT AS step, p[1] AS "left", p[2] AS "right" FROM f"""


# ---- chat templates
_TURN = {
    "chatml": "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)",
    "inst": "CASE role WHEN 'system' THEN '<<SYS>>' || chr(10) || text || chr(10) || '<</SYS>>' || chr(10) || chr(10) WHEN 'user' THEN '[INST] ' || text || ' [/INST]' WHEN 'assistant' THEN ' ' || text || '</s><s>' ELSE '' END",
    "alpaca": "CASE role WHEN 'system' THEN '### System:' || chr(10) || text || chr(10) || chr(10) WHEN 'user' THEN '### Human:' || chr(10) || text || chr(10) || chr(10) WHEN 'assistant' THEN '### Assistant:' || chr(10) || text || chr(10) || chr(10) ELSE '' END",
    "plain": "role || ': ' || text || chr(10)",
}
for _style, _mark, _open, _end in (("chatml", "<|im_start|>", "", "'<|im_start|>assistant' || chr(10)"), ("inst", "[INST]", "<s>", "''"), ("alpaca", "### ", "", "'### Assistant:' || chr(10)"), ("plain", "", "", "'assistant: '")):
    QUERIES[f"chat_{_style}"] = lambda spark, sf, mark=_mark: apply_template(_read(spark, sf, "conversations"), mark, True).select("conv_id", F.char_length("rendered").cast("long").alias("n"), F.md5("rendered").alias("digest"))
    ORACLE[f"chat_{_style}"] = f"SELECT conv_id, length(s)::BIGINT AS n, md5(s) AS digest FROM (SELECT conv_id, '{_open}' || string_agg({_TURN[_style]}, '' ORDER BY turn) || {_end} AS s FROM conversations GROUP BY 1)"


# ---- end to end
def tokens_per_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, characters and BPE tokens by language: normalize, split into byte-level pieces, merge."""
    d = _read(spark, sf, "documents").select("lang", F.char_length("text").alias("c"), F.size(_byte_tokenizer().encode(F.col("text"))).alias("t"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("c").cast("long").alias("n_chars"), F.sum("t").cast("long").alias("n_tokens")).withColumn("tokens_per_char", F.round(F.col("n_tokens") / F.col("n_chars"), 6))


QUERIES["e2e_tokens_per_lang"] = tokens_per_lang
LATE["e2e_tokens_per_lang"] = lambda: _bpe_sql(f"SELECT *, round(n_tokens / n_chars, 6) AS tokens_per_char FROM (SELECT lang, count(*)::BIGINT AS n_docs, sum(length(text))::BIGINT AS n_chars, sum(len(ids))::BIGINT AS n_tokens FROM documents JOIN ({_PER_DOC}) USING (doc_id) GROUP BY lang)")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLE | {name: make() for name, make in LATE.items()}
