"""Character classes as regex fragments, and the printable alphabet of bytes."""

from __future__ import annotations

from functools import cache


def cls(*ranges: tuple[int, int]) -> str:
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


#: Unicode White_Space.
SPACES = frozenset([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])

GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_ASCII_PUNCT = ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
PUNCT = cls(*_ASCII_PUNCT, (0xA1, 0xBF), (0x2000, 0x206F), (0x2E00, 0x2E7F), (0x3000, 0x303F))
HAN_CORE = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
CJK_NORM = cls(*HAN_CORE)
CJK_SPLIT = cls(*HAN_CORE, (0x2CEB0, 0x2EBEF), (0x30000, 0x3134F))
MARKS = cls((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))

SCRIPTS = {
    "latin": cls((0x41, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": cls((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": cls((0x400, 0x52F)),
    "arabic": cls((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "hebrew": cls((0x590, 0x5FF)),
    "han": cls((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF)),
    "hiragana": cls((0x3040, 0x309F)),
    "katakana": cls((0x30A0, 0x30FF), (0x31F0, 0x31FF)),
    "hangul": cls((0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F)),
    "thai": cls((0xE00, 0xE7F)),
}
COMMON = cls((0x0, 0x40), (0x7B, 0xBF), (0x2000, 0x206F), (0x3000, 0x303F))


def scripts_pattern(java: bool) -> str:
    """Runs of one script, with common characters joining the run they touch; white space ends a run.

    The non-Java form (RE2) spells the intersections out for text without non-ASCII white space.
    """
    space = "&&[^\\s]" if java else ""
    common = f"[{COMMON}{space}]" if java else "[" + cls((0x0, 0x8), (0xE, 0x1F), (0x21, 0x40), (0x7B, 0xBF), (0x2000, 0x206F), (0x3000, 0x303F)) + "]"
    rest = "[^\\s" + COMMON + "".join(SCRIPTS.values()) + "]"
    runs = [f"{common}*[{s}](?:[{s}]|{common})*" for s in SCRIPTS.values()]
    return ("(?U)" if java else "") + "|".join([*runs, f"{common}*{rest}(?:{rest}|{common})*", f"{common}+"])


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else U+0100 onwards."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


ALPHABET = byte_alphabet()
_FORTH = dict(enumerate(ALPHABET))
MOVED_FROM = "".join(chr(b) for b in range(256) if ALPHABET[b] != chr(b))
MOVED_TO = "".join(ALPHABET[b] for b in range(256) if ALPHABET[b] != chr(b))


def is_space(c: str) -> bool:
    return ord(c) in SPACES


def split_spaces(text: str) -> list[str]:
    """Split on Unicode White_Space only (str.split also splits on U+001C-U+001F)."""
    return [w for w in "".join("\x20" if is_space(c) else c for c in text).split("\x20") if w]


@cache
def _gpt2():
    import regex

    spaces = "".join(f"\\u{c:04x}" for c in sorted(SPACES))
    return regex.compile(GPT2.replace(r"|\s+", f"|[{spaces}]+").replace(r"\s", spaces))


def gpt2_pieces(text: str) -> list[str]:
    """Pieces of the byte-level pattern, as in the Column form."""
    return _gpt2().findall(text)


def encode_bytes(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(_FORTH)


_BACK = {c: b for b, c in enumerate(ALPHABET)}


def token_bytes(text: str) -> bytes:
    """The bytes that printable characters stand for; other ASCII stands for itself, other characters are dropped."""
    return bytes(b for c in text if (b := _BACK.get(c, ord(c))) < 256 and (c in _BACK or ord(c) < 128))


def decode_bytes(text: str) -> str:
    return token_bytes(text).decode("utf-8", "replace")
