"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. The key's leading bits cut each source into 4096
ranges in key order; sizes are summed per (source, range), running sums over the ranges give
each range its offset, and a running sum inside a range (sorted by key) does the rest: no
task ever sees a whole source. A source's budget is so many whole epochs plus the documents
whose running sum stays within the remainder; the one at the cut gives its first words.

Defined results: null texts have size 0 and give nothing; null sources form one source, last
in order; sources of no words get target 0; rows equal in doc_id and text share a key and may
swap places, which changes no row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut, name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, HALF = (5, 2, 1), 3, 64


def _keyed(docs: DataFrame) -> DataFrame:
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    key = F.xxhash64("doc_id", text, F.lit("mix"))
    d = docs.withColumns({"_n": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), "_k": key, "_s": F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))})
    top = F.shiftrightunsigned(F.col("_k"), 52)
    return d.withColumns({"_hi": (top / HALF).cast("int"), "_lo": (top % HALF).cast("int")})


def targets(sizes: DataFrame) -> DataFrame:
    """(_s, size) of all sources, one row each -> with target: weights 5, 2, 1, ... share the total, at most MOST times a source's size.

    Water filling: sources by the level at which they are full; the level of the others is what
    the full ones leave over the rest's weight.
    """
    everything, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("_full", "_s")
    name = F.when(F.col("_s") == "n", F.lit(None)).otherwise(F.expr("substr(_s, 2)"))
    no = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(name.asc_nulls_last())) - 1
    w = F.array(*map(F.lit, WEIGHTS))[(no % len(WEIGHTS)).cast("int")].cast("double")
    t = sizes.withColumn("_w", w).withColumn("_cap", (F.col("size") * MOST).cast("double")).withColumn("_full", F.col("_cap") / F.col("_w"))
    t = t.withColumn("_total", F.sum("size").over(everything).cast("double"))
    run = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("_total") - (F.sum("_cap").over(run) - F.col("_cap"))
    rest = F.sum("_w").over(everything) - (F.sum("_w").over(run) - F.col("_w"))
    t = t.withColumn("_level", left / rest)
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_s", "_level"))).over(everything)["_level"]
    return t.withColumn("target", F.least(F.col("_cap"), F.coalesce(level, F.lit(0.0)) * F.col("_w"))).select("_s", "size", "target")


def _taken(keyed: DataFrame) -> DataFrame:
    """keyed with source_size, target and taken."""
    ranges = cut(keyed.groupBy("_s", "_hi", "_lo").agg(F.sum("_n").alias("r")))
    halves = ranges.groupBy("_s", "_hi").agg(F.sum("r").alias("h"))
    upto = lambda *part: Window.partitionBy(*part).orderBy("_lo" if "_hi" in part else "_hi")
    halves = halves.withColumn("_a", F.sum("h").over(upto("_s")) - F.col("h"))
    ranges = ranges.withColumn("_b", F.sum("r").over(upto("_s", "_hi")) - F.col("r"))
    plan = targets(ranges.groupBy("_s").agg(F.sum("r").alias("size")))
    plan = plan.withColumn("_budget", F.round("target").cast("long"))
    plan = plan.withColumn("_epochs", F.when(F.col("size") > 0, F.expr("_budget div size")).otherwise(F.lit(0))).withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("size"))
    offsets = ranges.join(halves, ["_s", "_hi"]).join(plan, "_s").select("_s", "_hi", "_lo", (F.col("_a") + F.col("_b")).alias("_off"), F.col("size").alias("source_size"), "target", "_epochs", "_rest")
    inside = Window.partitionBy("_s", "_hi", "_lo").orderBy("_k", "doc_id", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = keyed.withColumn("_sum", F.sum("_n").over(inside) - F.col("_n")).join(offsets, ["_s", "_hi", "_lo"])
    extra = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_rest") - F.col("_off") - F.col("_sum")))
    return d.withColumn("_extra", extra).withColumn("taken", F.col("_epochs") * F.col("_n") + F.col("_extra"))


def mix_plan(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs."""
    keyed = cut(_keyed(docs.select("doc_id", "text", "source")).drop("text", "source"))
    return _taken(keyed).select("doc_id", F.col("_n").alias("size"), "source_size", "target", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: a row of docs for each epoch it is taken in, with column `epoch` from 0; the text at a cut is shortened."""
    d = _taken(_keyed(docs.select(F.struct(*[name(c) for c in docs.columns if c != "text"]).alias("_row"), "doc_id", "text", "source")))
    head = lambda n: F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, n.cast("int")), " ")
    whole = F.col("_epochs") + F.when(F.col("_extra") == F.col("_n"), 1).otherwise(0)
    times = F.when(F.col("_n") == 0, F.lit(0)).otherwise(whole + F.when((F.col("_extra") > 0) & (F.col("_extra") < F.col("_n")), 1).otherwise(0))
    d = d.where(times > 0).withColumn("_whole", whole).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times.cast("long") - 1)))
    part = F.col("epoch") >= F.col("_whole")
    cols: list[Column] = []
    for c in docs.columns:
        if c == "epoch":
            continue
        new = head(F.col("_extra")) if c in ("text", "n_chars") else None
        old = F.col("text") if c == "text" else F.col("_row")[c]
        cols.append((old if new is None else F.when(part, new if c == "text" else F.char_length(new).cast(docs.schema[c].dataType)).otherwise(old)).alias(c))
    return d.select(*cols, "epoch")
