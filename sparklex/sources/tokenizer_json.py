"""tokenizer.json: reading is lenient about components (an unknown type is none), strict about the vocabulary."""

from __future__ import annotations

from typing import Any

from ..operators import decoders as D
from ..operators import normalizers as N
from ..operators import postprocessors as P
from ..operators import pretokenizers as T
from ..operators.vocab import AddedToken

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def merges_of(raw: list) -> list[tuple[str, str]]:
    """Entries "a b" or ["a", "b"]; anything else is left out."""
    out = []
    for m in raw:
        parts = m.split(" ") if isinstance(m, str) else m if isinstance(m, list) else []
        if len(parts) == 2 and all(isinstance(x, str) for x in parts):
            out.append((parts[0], parts[1]))
    return out


def vocab_of(raw: Any) -> dict[str, int]:
    if not isinstance(raw, dict) or not all(isinstance(i, int) and i >= 0 for i in raw.values()):
        raise ValueError("model.vocab must map tokens to ids")
    return dict(raw)


def _kind(v: Any) -> str | None:
    return str(v.get("type") or "") if isinstance(v, dict) and "type" in v else None


def _parts(v: dict, name: str, read) -> tuple:
    return tuple(x for x in (read(p) for p in v.get(name) or []) if x is not None)


def read_normalizer(v: Any) -> N.Normalizer | None:
    kind = _kind(v)
    if kind is None:
        return N.Form("NFC")
    if kind in FORMS:
        return N.Form(kind)
    if kind == "Sequence":
        parts = _parts(v, "normalizers", read_normalizer)
        return N.Sequence(parts) if parts else None
    if kind == "BertNormalizer":
        return N.Bert(v.get("clean_text", True), v.get("handle_chinese_chars", True), v.get("strip_accents"), v.get("lowercase", True))
    made = {
        "Lowercase": lambda: N.Lowercase(),
        "Strip": lambda: N.Strip(),
        "StripAccents": lambda: N.StripAccents(),
        "Replace": lambda: N.Replace((v.get("pattern") or {}).get("String", ""), v.get("content", "")),
        "Prepend": lambda: N.Prepend(v.get("prepend", "")),
        "Append": lambda: N.Append(v.get("append", "")),
        "Precompiled": lambda: N.Precompiled(()),
    }
    return made[kind]() if kind in made else None


def write_normalizer(n: N.Normalizer | None) -> dict | None:
    match n:
        case N.Form(name):
            return {"type": name}
        case N.Bert(clean, cjk, accents, low):
            return {"type": "BertNormalizer", "clean_text": clean, "handle_chinese_chars": cjk, "strip_accents": accents, "lowercase": low}
        case N.Replace(a, b):
            return {"type": "Replace", "pattern": {"String": a}, "content": b}
        case N.Prepend(x):
            return {"type": "Prepend", "prepend": x}
        case N.Append(x):
            return {"type": "Append", "append": x}
        case N.Sequence(parts):
            return {"type": "Sequence", "normalizers": [write_normalizer(p) for p in parts]}
        case N.Lowercase() | N.Strip() | N.StripAccents() | N.Precompiled():
            return {"type": type(n).__name__}
    return None


def _char(v: Any, default: str) -> str:
    return v[0] if isinstance(v, str) and v else default


def read_pretokenizer(v: Any) -> T.PreTokenizer | None:
    kind = _kind(v)
    if kind is None:
        return T.ByteLevel(False)
    if kind == "Sequence":
        parts = _parts(v, "pretokenizers", read_pretokenizer)
        return T.Sequence(parts) if parts else None
    made = {
        "ByteLevel": lambda: T.ByteLevel(bool(v.get("add_prefix_space", False))),
        "Metaspace": lambda: T.Metaspace(_char(v.get("replacement"), "▁"), bool(v.get("add_prefix_space", True))),
        "Whitespace": lambda: T.Whitespace(),
        "WhitespaceSplit": lambda: T.Whitespace(),
        "Punctuation": lambda: T.Punctuation(),
        "BertPreTokenizer": lambda: T.Bert(),
        "CharDelimiterSplit": lambda: T.CharDelimiter(_char(v.get("delimiter"), " ")),
        "UnicodeScripts": lambda: T.UnicodeScripts(),
        "Digits": lambda: T.Digits(bool(v.get("individual_digits", False))),
        "Split": lambda: T.Split((v.get("pattern") or {}).get("Regex", ""), v["behavior"] if v.get("behavior") in ("Isolated", "MergedWithPrevious", "MergedWithNext", "Contiguous") else "Removed", bool(v.get("invert", False))),
    }
    return made[kind]() if kind in made else None


def write_pretokenizer(t: T.PreTokenizer | None) -> dict | None:
    match t:
        case T.ByteLevel(prefix):
            return {"type": "ByteLevel", "add_prefix_space": prefix}
        case T.Gpt2():
            return {"type": "ByteLevel", "add_prefix_space": False}
        case T.Metaspace(r, prefix):
            return {"type": "Metaspace", "replacement": r, "add_prefix_space": prefix}
        case T.Digits(one):
            return {"type": "Digits", "individual_digits": one}
        case T.CharDelimiter(d):
            return {"type": "CharDelimiterSplit", "delimiter": d}
        case T.Split(p, how, invert):
            return {"type": "Split", "pattern": {"Regex": p}, "behavior": how or "Removed", "invert": invert}
        case T.Sequence(parts):
            return {"type": "Sequence", "pretokenizers": [write_pretokenizer(p) for p in parts]}
        case T.Bert():
            return {"type": "BertPreTokenizer"}
        case T.Whitespace() | T.Punctuation() | T.UnicodeScripts():
            return {"type": type(t).__name__}
    return None


def _template(items: Any) -> str | None:
    if not isinstance(items, list):
        return None
    words = []
    for x in items:
        if isinstance(x, dict) and "SpecialToken" in x:
            words.append(x["SpecialToken"].get("id", ""))
        elif isinstance(x, dict) and "Sequence" in x:
            words.append("$" + x["Sequence"].get("id", ""))
    return " ".join(words)


def read_postprocessor(v: Any, specials: dict[str, int]) -> P.PostProcessor | None:
    match _kind(v):
        case "TemplateProcessing":
            single = _template(v.get("single"))
            return P.Template("<s> $A </s>" if single is None else single, _template(v.get("pair")), tuple(sorted(specials.items())))
        case "RobertaProcessing":
            return P.RobertaProcessing(specials.get("<s>", 0), specials.get("</s>", 2))
        case "BertProcessing":
            return P.BertProcessing(specials.get("[CLS]", 101), specials.get("[SEP]", 102))
    return None


def write_postprocessor(p: P.PostProcessor | None) -> dict | None:
    def items(text: str) -> list[dict]:
        return [{"Sequence": {"id": w[1:], "type_id": 0}} if w.startswith("$") else {"SpecialToken": {"id": w, "type_id": 0}} for w in text.split()]

    match p:
        case P.Template(single, pair, specials):
            return {"type": "TemplateProcessing", "single": items(single), "pair": items(pair) if pair else None, "special_tokens": {t: {"id": t, "ids": [i], "tokens": [t]} for t, i in specials}}
        case P.BertProcessing(c, s):
            return {"type": "BertProcessing", "sep": ["[SEP]", s], "cls": ["[CLS]", c]}
        case P.RobertaProcessing(b, e):
            return {"type": "RobertaProcessing", "sep": ["</s>", e], "cls": ["<s>", b]}
    return None


def read_decoder(v: Any) -> D.Decoder | None:
    kind = _kind(v)
    if kind is None:
        return D.ByteLevel()
    if kind == "Sequence":
        parts = _parts(v, "decoders", read_decoder)
        return D.Sequence(parts) if parts else None
    made = {
        "ByteLevel": lambda: D.ByteLevel(),
        "Metaspace": lambda: D.Metaspace(_char(v.get("replacement"), "▁"), bool(v.get("add_prefix_space", True))),
        "WordPiece": lambda: D.WordPiece(v.get("prefix", "##"), bool(v.get("cleanup", True))),
        "BPE": lambda: D.BPE(v.get("suffix", "</w>")),
        "CTC": lambda: D.CTC(v.get("pad_token", "<pad>"), v.get("word_delimiter_token")),
        "Fuse": lambda: D.Fuse(),
        "Strip": lambda: D.Strip(_char(v.get("content"), " "), int(v.get("start", 0)), int(v.get("stop", 0))),
        "Replace": lambda: D.Replace((v.get("pattern") or {}).get("String", ""), v.get("content", "")),
    }
    return made[kind]() if kind in made else None


def write_decoder(d: D.Decoder | None) -> dict | None:
    match d:
        case D.Metaspace(r, prefix):
            return {"type": "Metaspace", "replacement": r, "add_prefix_space": prefix}
        case D.WordPiece(p, clean):
            return {"type": "WordPiece", "prefix": p, "cleanup": clean}
        case D.BPE(s):
            return {"type": "BPE", "suffix": s}
        case D.CTC(p, w):
            return {"type": "CTC", "pad_token": p, "word_delimiter_token": w}
        case D.Strip(c, a, b):
            return {"type": "Strip", "content": c, "start": a, "stop": b}
        case D.Replace(a, b):
            return {"type": "Replace", "pattern": {"String": a}, "content": b}
        case D.Sequence(parts):
            return {"type": "Sequence", "decoders": [write_decoder(p) for p in parts]}
        case D.ByteLevel() | D.Fuse():
            return {"type": type(d).__name__}
    return None


def read_added(raw: list) -> list[AddedToken]:
    flags = ("special", "single_word", "lstrip", "rstrip", "normalized")
    return [AddedToken(t["content"], int(t["id"]), **{f: bool(t.get(f, False)) for f in flags}) for t in raw]
