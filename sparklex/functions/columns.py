"""Column helpers shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u0001"


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def full(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def quote(text: str) -> str:
    """A literal as a Java and RE2 regex."""
    return "".join(c if c.isalnum() or ord(c) > 127 or c == "_" else f"\\x{{{ord(c):x}}}" for c in text)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once: inside a lambda an outer expression is evaluated again at each step."""
    return F.transform(F.array(value), then)[0]


_ASCII = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7f", "blank": r"\t\x20", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t-\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}
_CATEGORY = re.compile(r"L[ultmo]?|M[nce]?|N[dlo]?|P[cdseifo]?|S[mcko]?|Z[slp]?|C[cfson]?")


def _property(name: str) -> str:
    name = name.strip()
    if "=" in name:
        kind, name = (x.strip() for x in name.split("=", 1))
        return f"sc={name}" if kind.lower() in ("sc", "script", "scx", "script_extensions") else f"gc={name}"
    return name if _CATEGORY.fullmatch(name) else f"Is{name}"


def linear_regex(pattern: str) -> str | None:
    """A pattern of the linear-time dialect (Unicode classes; no look-around, no back references) for Java; None if it is not one.

    There `.` and `^ $` know U+000A alone as the end of a line, and `$` is the end of the text.
    """
    out, i, depth = [], 0, 0
    multi = re.search(r"\(\?[a-z]*m", pattern) is not None
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "\\":
            e = pattern[i + 1 : i + 2]
            braced = re.compile(r"\{([^}]*)\}").match(pattern, i + 2)
            if e in ("p", "P"):
                name = braced.group(1) if braced else pattern[i + 2 : i + 3]
                negate = (e == "P") != name.startswith("^")
                out.append(f"\\{'P' if negate else 'p'}{{{_property(name.removeprefix('^'))}}}")
                i = braced.end() if braced else i + 3
                continue
            if e in ("x", "u", "U") and braced:
                out.append(f"\\x{{{braced.group(1)}}}")
                i = braced.end()
                continue
            if not e or (e.isalnum() and e not in "dDsSwWbBAzntrfvaxuU"):
                return None
            out.append(r"\x0B" if e == "v" else "\\" + e)
            i += 2
        elif depth and two == "[:" and (m := re.compile(r"\[:(\^?)(\w+):\]").match(pattern, i)):
            if m.group(2) not in _ASCII:
                return None
            out.append(f"[{m.group(1)}{_ASCII[m.group(2)]}]")
            i = m.end()
        elif c == "[":
            depth += 1
            start = re.compile(r"\[\^?\]?").match(pattern, i).group()
            out.append(start.replace("]", r"\]"))
            i += len(start)
        elif c == "]" and depth:
            depth -= 1
            out.append(c)
            i += 1
        elif not depth and pattern.startswith("(?", i):
            if re.compile(r"\(\?(<?[=!]|>)").match(pattern, i):
                return None
            if re.compile(r"\(\?[a-zA-Z]*U").match(pattern, i):
                raise ValueError("the swap-greed flag is not supported")
            named = pattern.startswith("(?P<", i)
            out.append("(?<" if named else "(?")
            i += 4 if named else 2
        else:
            out.append(r"\z" if c == "$" and not depth and not multi else c)
            i += 1
    made = "(?Ud)" + "".join(out)
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(made)
        except IllegalArgumentException:  # the JVM's PatternSyntaxException is one
            return None
    return made


def matches_empty(pattern: str) -> bool:
    """Whether a Java pattern matches the empty string."""
    context = SparkContext._active_spark_context
    return context is not None and bool(context._jvm.java.util.regex.Pattern.matches(pattern, ""))


def bytes_to_chars(c: Column) -> Column:
    """Each UTF-8 byte as its printable character."""
    from .chars import MOVED_FROM, MOVED_TO

    return F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), MOVED_FROM, MOVED_TO)


def chars_to_bytes(c: Column) -> Column:
    """The inverse: other ASCII stands for itself, other characters are dropped, bad UTF-8 becomes U+FFFD."""
    from .chars import ALPHABET, MOVED_FROM, MOVED_TO

    known = "[^\\x{0}-\\x{7f}" + "".join(quote(x) for x in ALPHABET if ord(x) > 127) + "]"
    x = F.regexp_replace(c, known, "")
    x = F.translate(x, MOVED_TO[1:], MOVED_FROM[1:])
    x = F.replace(x, F.lit(MOVED_TO[0]), F.lit(MOVED_FROM[0]))  # translate reads U+0000 as "delete"
    return F.make_valid_utf8(F.encode(x, "ISO-8859-1").cast("string"))
