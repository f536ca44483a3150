"""Secret scan over a trigram index, in DataFrame functions only.

Each rule's regex yields a Boolean query of trigrams that every match must contain. `postings`
inverts the texts: for each trigram of the queries the list of entries whose lower-cased text
holds it, cut into segments of the entries' hash so that no list grows with the corpus.
`candidates` intersects and unites the lists of a segment as each rule's query says. Candidates
are joined to their texts by hash and verified with the regex; a rule without a mandatory
trigram scans every text. Entries are hashes of (doc_id, text): should two rows share one, both
are verified, so a collision costs time and changes nothing.

Spans are counted in code points, end exclusive. Sums over a text's spans are kept by blocks,
so time grows with the text even where it holds tens of thousands of spans.
Defined results: a null text is empty; a row without spans has empty `spans`; null and
repeated doc_ids each keep their row; other columns are ignored (`redact` keeps them).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ._store import fresh, name

Query = tuple  # ("all",) | ("tri", t) | ("and", q...) | ("or", q...)


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
)
RULES = BASE + MORE
MOST_EXACT, SEGMENT, STRIDE, TEXT_BLOCK = 64, 4096, 256, 4096


def _and(*q: Query) -> Query:
    flat = [y for x in q for y in (x[1:] if x[0] == "and" else (x,)) if y[0] != "all"]
    flat = list(dict.fromkeys(flat))
    return ("all",) if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _or(*q: Query) -> Query:
    flat = list(dict.fromkeys(y for x in q for y in (x[1:] if x[0] == "or" else (x,))))
    return ("all",) if not flat or ("all",) in flat else flat[0] if len(flat) == 1 else ("or", *flat)


def _of_strings(strings: set[str]) -> Query:
    return _or(*(_and(*(("tri", s[i : i + 3]) for i in range(len(s) - 2))) for s in sorted(strings)))


def trigram_query(pattern: str) -> Query:
    """What trigrams (lower case) every match of pattern holds; ("all",) if none is certain."""
    from re import _parser as parser

    def seq(items: list) -> tuple[set[str] | None, Query]:
        exact: set[str] = {""}
        need: Query = ("all",)
        whole = True
        for op, arg in items:
            got, q = node(str(op), arg)
            need = _and(need, q)
            if got is not None and len(exact) * len(got) <= MOST_EXACT:
                exact = {a + b for a, b in product(exact, got)}
            else:
                need = _and(need, _of_strings(exact))
                exact, whole = (got if got is not None and len(got) <= MOST_EXACT else {""}), False
        return (exact, need) if whole else (None, _and(need, _of_strings(exact)))

    def node(op: str, arg) -> tuple[set[str] | None, Query]:
        if op == "LITERAL":
            return {chr(arg).lower()}, ("all",)
        if op == "SUBPATTERN":
            return seq(list(arg[-1]))
        if op == "BRANCH":
            got = [seq(list(x)) for x in arg[1]]
            if all(e is not None for e, _ in got):
                return set().union(*(e for e, _ in got)), ("all",)
            return None, _or(*(_and(q, _of_strings(e) if e is not None else ("all",)) for e, q in got))
        if op == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
            return {chr(v).lower() for _, v in arg}, ("all",)
        if op == "MAX_REPEAT":
            low, high, item = arg
            got, q = seq(list(item))
            if low == 0:
                return (got | {""}, ("all",)) if got is not None and high == 1 else (None, ("all",))
            if got is not None and low == high and len(got) ** low <= MOST_EXACT:
                return {"".join(x) for x in product(sorted(got), repeat=low)}, q
            return None, _and(q, _of_strings(got) if got is not None else ("all",))
        return None, ("all",)

    exact, need = seq(list(parser.parse(pattern)))
    return _and(need, _of_strings(exact)) if exact is not None else need


def trigrams(q: Query) -> set[str]:
    return {q[1]} if q[0] == "tri" else set().union(*(trigrams(x) for x in q[1:])) if q[0] in ("and", "or") else set()


def _vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))


def entry_key(docs: DataFrame) -> Column:
    """Under what number a row's text stands in the index; rows that share one are candidates together."""
    return F.xxhash64(docs["doc_id"], docs["text"].cast("string"))


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(segment, trigram, keys): the inverted index. A posting list holds the entries of one segment of the keys.

    There is a segment for every SEGMENT rows, so no list grows with the corpus.
    """
    bits = max(0, math.ceil(math.log2(max(1, docs.count()) / SEGMENT)))
    rows = docs.select(F.lower(F.col("text").cast("string")).alias("low"), entry_key(docs).alias("key")).where(F.length("low") > 2)
    segment = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary]), F.isnotnull)
    return rows.select(segment.alias("segment"), "key", F.explode(held).alias("trigram")).groupBy("segment", "trigram").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): entries whose postings satisfy the query of rule i, for each bit i of rules. Rules without a query are not asked."""
    none = F.array().cast("array<bigint>")
    queries = {i: q for i, q in enumerate(trigram_query(r.pattern) for r in rules) if q[0] != "all"}
    at = {t: f"t{k}" for k, t in enumerate(sorted(set().union(*map(trigrams, queries.values()))))}

    def ask(q: Query) -> Column:
        if q[0] == "tri":
            return F.col(at[q[1]])
        out = ask(q[1])
        for x in q[2:]:
            out = F.array_union(out, ask(x)) if q[0] == "or" else F.array_intersect(out, ask(x))
        return out

    if not queries:
        return index.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("rules")).limit(0)
    lists = index.groupBy("segment").agg(*[F.coalesce(F.first(F.when(F.col("trigram") == t, F.col("keys")), ignorenulls=True), none).alias(c) for t, c in at.items()])

    def named(keys: Column, rule: int) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(rule).alias("rule")))

    each = F.concat(*[named(ask(q), 1 << i) for i, q in queries.items()])
    return lists.select(F.explode(each).alias("x")).groupBy("x.key").agg(F.bit_or("x.rule").alias("rules"))


def running(a: Column, kind: str, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The running fold of an array, without the first value; by blocks, as appending to one array copies it each time."""
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(zero.cast(kind).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("out"))

    def block(values: Column, acc: Column, i: Column) -> Column:
        append = lambda got, x: F.concat(got, F.array(step(F.coalesce(F.try_element_at(got, F.lit(-1)), acc["last"]), x)))
        return let(F.aggregate(F.slice(values, i, F.lit(STRIDE)), none, append), lambda made: F.struct(F.try_element_at(made, F.lit(-1)).alias("last"), F.concat(acc["out"], F.array(made)).alias("out")))

    def fold(values: Column) -> Column:
        starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.aggregate(starts, start, lambda acc, i: block(values, acc, i))["out"])

    return let(a, fold)


def _spans(rule: Rule, no: int, text: Column) -> Column:
    """array<struct<start, no, end>> of a rule's matches in a candidate's text (null: none)."""
    pattern = F.lit(rule.pattern)
    empty, none = F.array().cast("array<string>"), F.array().cast("array<struct<start:bigint,no:int,end:bigint>>")
    found = lambda group: F.coalesce(F.regexp_extract_all(text, pattern, F.lit(group)), empty)

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.coalesce(F.split(text, rule.pattern, -1), empty), 1, F.size(hits))
        sizes = F.arrays_zip(F.transform(gaps, F.char_length).alias("g"), F.transform(hits, F.char_length).alias("h"), F.transform(found(rule.group) if rule.group else hits, F.char_length).alias("n"))
        return let(sizes, at)

    def at(sizes: Column) -> Column:
        ends = running(F.transform(sizes, lambda x: (x["g"] + x["h"]).cast("bigint")), "bigint", lambda s, x: s + x, F.lit(0))
        each = F.zip_with(ends, sizes, lambda z, x: F.struct((z - x["h"]).alias("start"), F.lit(no).alias("no"), z.alias("end"), x["n"].alias("n")))
        return F.transform(F.filter(each, lambda x: x["n"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["no"].alias("no"), x["end"].alias("end")))

    return let(found(0), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], mask: str, spans: list[str]) -> DataFrame:
    """docs with column `mask`, the rules that the index names for the row, and `spans`, one column of spans for each rule."""
    found = candidates(postings(docs, _vocabulary(rules)), rules).select(F.col("key").alias(f"{mask}key"), F.col("rules").alias(mask))
    d = docs.join(found, entry_key(docs) == found[f"{mask}key"], "left").drop(f"{mask}key")
    text = F.col("text").cast("string")
    asked = lambda i, r: text if trigram_query(r.pattern)[0] == "all" else F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, text)
    return d.withColumns({c: _spans(r, i, asked(i, r)) for i, (r, c) in enumerate(zip(rules, spans))})


def _shown(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", kinds[x["no"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs."""
    rules = BASE + more
    names = [f"s{i}" for i in range(len(rules))]
    d = _scanned(docs.select("doc_id", "text"), rules, "asked", names)
    return d.select("doc_id", *[F.size(f"s{i}").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)], F.sha2(_shown(F.concat(*names[: len(BASE)]), rules), 256).alias("base_sha256"), _shown(F.concat(*names), rules).alias("spans"))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping spans (sorted by start) replaced by `mark`.

    The text is cut into blocks first, as finding a character by its number walks from the start of the string.
    """
    size = F.lit(TEXT_BLOCK)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))

    def part(blocks: Column, p: Column, q: Column) -> Column:
        i, j = F.floor(p / size).cast("int"), F.floor(q / size).cast("int")
        first, last = F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, j), F.lit(""))
        a, b = (p % size).cast("int"), (q % size).cast("int")
        apart = F.concat(F.substr(first, a + 1), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(last, F.lit(1), b))
        return F.when(i == j, F.substr(first, a + 1, b - a)).otherwise(apart)

    def gaps(x: Column) -> Column:
        """x: spans and before, the end of all that comes before each span (and before the end of the text)."""
        each = F.transform(x["spans"], lambda y, i: F.struct(x["before"][i].alias("p"), y["start"].alias("q")))
        rest = F.struct(F.try_element_at(x["before"], F.lit(-1)).alias("p"), F.char_length(text).cast("bigint").alias("q"))
        return F.concat(F.filter(each, lambda y: y["q"] >= y["p"]), F.array(rest))

    before = F.concat(F.array(F.lit(0).cast("bigint")), running(F.transform(spans, lambda x: x["end"]), "bigint", F.greatest, F.lit(0)))
    kept = let(F.struct(spans.alias("spans"), before.alias("before")), gaps)
    return let(blocks, lambda b: F.array_join(F.transform(kept, lambda x: part(b, x["p"], x["q"])), mark))


def redact(docs: DataFrame, more: tuple[Rule, ...] = MORE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by `mark` (overlapping spans by one), and n_chars, if there, recounted."""
    rules = BASE + more
    own = fresh(docs, "secret_")
    names = [f"{own}{i}" for i in range(len(rules))]
    d = _scanned(docs, rules, own, names).withColumn(own, F.array_sort(F.concat(*names)))
    hit = F.size(own) > 0
    d = d.withColumn(names[0], F.when(hit, masked(F.col("text").cast("string"), F.col(own), mark)))
    new = {"text": F.col(names[0]), "n_chars": F.char_length(names[0])}
    return d.select(*[F.when(hit, new[c].cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else name(c).alias(c) for c in docs.columns])


def check_rules(rules: tuple[Rule, ...]) -> None:
    """Fail early on a pattern that Python cannot parse (Java and RE2 read the same subset)."""
    for r in rules:
        re.compile(r.pattern)
