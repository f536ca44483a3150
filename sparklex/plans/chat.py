"""Chat templates over a table of turns: one string per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def style_of(template: str) -> str:
    marks = (("<|im_start|>", "chatml"), ("[INST]", "inst"), ("### ", "alpaca"))
    return next((name for mark, name in marks if mark in template), "plain")


def turn(style: str, bos: str = "<s>", eos: str = "</s>") -> Column:
    """One turn's text; columns role and text."""
    role, text = F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))
    lit = F.lit
    if style == "chatml":
        return F.concat(lit("<|im_start|>"), role, lit("\n"), text, lit("<|im_end|>\n"))
    if style == "inst":
        forms = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", eos + bos)}
    elif style == "alpaca":
        forms = {r: (f"### {n}:\n", "\n\n") for r, n in (("system", "System"), ("user", "Human"), ("assistant", "Assistant"))}
    else:
        return F.concat(role, lit(": "), text, lit("\n"))
    out = lit("")
    for r, (a, b) in forms.items():
        out = F.when(role == r, F.concat(lit(a), text, lit(b))).otherwise(out)
    return out


PROMPT = {"chatml": "<|im_start|>assistant\n", "inst": "", "alpaca": "### Assistant:\n", "plain": "assistant: "}


def apply_template(chats: DataFrame, template: str, add_generation_prompt: bool = False, bos: str = "<s>", eos: str = "</s>", key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, rendered) of chats (key, order, role, text)."""
    style = style_of(template)
    parts = chats.select(key, F.struct(F.col(order).alias("o"), turn(style, bos, eos).alias("t")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "")
    made = F.concat(F.lit(bos if style == "inst" else ""), body, F.lit(PROMPT[style] if add_generation_prompt else ""))
    return parts.groupBy(key).agg(made.alias("rendered"))
