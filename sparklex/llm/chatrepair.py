"""Chat formatting with minimum-cost role repair.

A legal chat is an optional system turn, then user and assistant in turn, ending with the
assistant. Dynamic programming over that automaton picks for each row the cheapest of:
keep it as a turn (0), relabel it (2), merge it into the turn before (1, or 3 with another
role), each after inserting empty turns (3 apiece); empty turns may also close the chat.
Ties go to the automaton's first state, seen from the end of the chat.

Rows are range-sorted by (conv_id, turn, role, text) over all partitions. A step of the DP is
a (min, +) matrix; where a conversation spans partitions, its pieces' matrices (at most two
pieces a partition go to the driver) give each piece its costs on entry, and a second pass
its state on exit, so one conversation may be of any length. Each row carries its fragment of
the rendered chat; fragments in order of `pos` are the chat.

Defined results: roles other than system, user and assistant (null too) must be relabelled;
a null text is empty; rows without a conv_id are one conversation; a null turn comes first;
repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, partitions
from ._text import tidy

ROLES = ("system", "user", "assistant")
RELABEL, MERGE, INSERT = 2, 1, 3
INF = 1 << 50
#: Empty turns that must stand between state s (0: start, else 1 + role) and a new turn of role r; None: impossible.
BETWEEN = {(0, 0): (), (0, 1): (), (0, 2): (1,), (1, 1): (), (1, 2): (1,), (2, 1): (2,), (2, 2): (), (3, 1): (), (3, 2): (1,)}
CLOSE = {0: (), 1: (1, 2), 2: (2,), 3: ()}


def steps(role: int) -> dict[tuple[int, int], tuple[int, bool]]:
    """(state, next state) -> (cost, is a new turn) for a row of role 0-2, or 3 for any other."""
    out = {}
    for s in range(4):
        for r in range(3):
            wrong = RELABEL * (r != role)
            ways = [(INSERT * len(BETWEEN[s, r]) + wrong, True)] if (s, r) in BETWEEN else []
            if s == r + 1:
                ways.append((MERGE + wrong, False))
            if ways:
                out[s, r + 1] = min(ways, key=lambda w: (w[0], not w[1]))
    return out


STEPS = [steps(r) for r in range(4)]


def forward(roles: list[int], cost: list[int]) -> tuple[list[list[int]], list[int]]:
    """Back pointers per row and the costs of the four states after the rows."""
    back = []
    for role in roles:
        new, via = [INF] * 4, [0] * 4
        for (s, t), (c, _) in STEPS[role].items():
            x = cost[s] + c
            if x < new[t]:
                new[t], via[t] = x, s
        back.append(via)
        cost = new
    return back, cost


def path(back: list[list[int]], last: int) -> list[int]:
    """States before each row, and after the last."""
    out = [last]
    for via in reversed(back):
        out.append(via[out[-1]])
    return out[::-1]


def best_end(cost: list[int]) -> int:
    return min(range(1, 4), key=lambda s: (cost[s] + INSERT * len(CLOSE[s]), s))


def turns_made(roles: list[int], states: list[int]) -> int:
    return sum(1 + len(BETWEEN[s, t - 1]) for r, s, t in zip(roles, states, states[1:]) if STEPS[r][s, t][1])


START = [0, INF, INF, INF]


class Piece:
    """A part of a conversation that goes on in another partition."""

    def __init__(self, entry: list[int] | None = None):
        self.entry, self.exit, self.turn, self.pos, self.first, self.last = entry, None, 0, 0, True, True


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, object, list[dict]]]:
    """(part, number of run, conv_id, rows) of a partition; the last has number -1 too."""
    rows: list[dict] = []
    no = 0
    for b in batches:
        for r in b.to_pylist():
            if rows and rows[-1]["conv_id"] != r["conv_id"]:
                yield no, False, rows[0]["conv_id"], rows
                no, rows = no + 1, []
            rows.append(r)
    if rows:
        yield no, True, rows[0]["conv_id"], rows


def _role(r: dict) -> int:
    return ROLES.index(r["role"]) if r["role"] in ROLES else 3


def render(rows: list[dict], roles: list[int], states: list[int], p: Piece) -> Iterator[tuple]:
    turn, pos = p.turn, p.pos
    for k, (row, role) in enumerate(zip(rows, roles)):
        s, t = states[k], states[k + 1]
        cost, new = STEPS[role][s, t]
        empty = BETWEEN[s, t - 1] if new else ()
        text = "".join(f"<|im_start|>{ROLES[r]}\n<|im_end|>\n" for r in empty)
        if new:
            text = ("<|im_end|>\n" if s else "") + text + f"<|im_start|>{ROLES[t - 1]}\n"
            turn += 1 + len(empty)
        else:
            text = "\n\n"
        text += row["text"] or ""
        inserted = len(empty)
        if p.last and k == len(rows) - 1:
            text += "<|im_end|>\n" + "".join(f"<|im_start|>{ROLES[r]}\n<|im_end|>\n" for r in CLOSE[t])
            inserted += len(CLOSE[t])
            cost += INSERT * len(CLOSE[t])
        action = ("" if new else "merge") + ("" if role == t - 1 else "relabel")
        yield row["conv_id"], row["turn"], pos, row["role"], ROLES[t - 1], {"": "keep", "mergerelabel": "merge+relabel"}.get(action, action), inserted, turn - 1, cost, text
        pos += 1


OUT = "conv_id long, turn long, pos long, role string, new_role string, action string, inserted long, out_turn long, cost long, rendered string"


def repair(chats: DataFrame) -> DataFrame:
    """One row per row of chats (conv_id, turn, role, text), with its role and fragment in the repaired chat."""
    src = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    src = cut(src.repartitionByRange(partitions(chats), *order).sortWithinPartitions(*order))
    sc = chats.sparkSession.sparkContext

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for no, last, conv, rows in _runs(batches):
            if no == 0 or last:
                roles = [_role(r) for r in rows]
                m = [x for s in range(4) for x in forward(roles, [0 if k == s else INF for k in range(4)])[1]]
                yield pa.RecordBatch.from_pylist([{"part": part, "no": no, "last": last, "conv": conv, "n": len(rows), "m": m}], pa.schema([("part", pa.int64()), ("no", pa.int64()), ("last", pa.bool_()), ("conv", pa.int64()), ("n", pa.int64()), ("m", pa.list_(pa.int64()))]))

    ends = sorted(src.mapInArrow(tidy(first), "part long, no long, last boolean, conv long, n long, m array<long>").collect(), key=lambda r: (r["part"], r["no"]))
    chains: list[list] = []
    for r in ends:
        if chains and r["no"] == 0 and chains[-1][-1]["last"] and chains[-1][-1]["conv"] == r["conv"] and chains[-1][-1]["part"] != r["part"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    pieces: dict[tuple[int, int], Piece] = {}
    for chain in (c for c in chains if len(c) > 1):
        cost, pos = START, 0
        for k, r in enumerate(chain):
            p = pieces[r["part"], r["no"]] = Piece(cost)
            p.pos, p.first, p.last = pos, k == 0, k == len(chain) - 1
            pos += r["n"]
            cost = [min(INF, min(cost[s] + r["m"][4 * s + t] for s in range(4))) for t in range(4)]
        p.exit = best_end(cost)
    if pieces:
        held1 = sc.broadcast(pieces)

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            for no, _, _, rows in _runs(batches):
                p = held1.value.get((part, no))
                if p is not None:
                    roles = [_role(r) for r in rows]
                    back = forward(roles, p.entry)[0]
                    ways = [path(back, t) for t in range(4)]
                    yield pa.RecordBatch.from_pylist([{"part": part, "no": no, "entry": [w[0] for w in ways], "turns": [turns_made(roles, w) if t and all((s, x) in STEPS[r] for r, s, x in zip(roles, w, w[1:])) else 0 for t, w in enumerate(ways)]}], pa.schema([("part", pa.int64()), ("no", pa.int64()), ("entry", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64()))]))

        maps = {(r["part"], r["no"]): r for r in src.mapInArrow(tidy(second), "part long, no long, entry array<long>, turns array<long>").collect()}
        for chain in (c for c in chains if len(c) > 1):
            keys = [(r["part"], r["no"]) for r in chain]
            for k in range(len(keys) - 1, 0, -1):
                pieces[keys[k - 1]].exit = maps[keys[k]]["entry"][pieces[keys[k]].exit]
            turn = 0
            for k in keys:
                pieces[k].turn = turn
                turn += maps[k]["turns"][pieces[k].exit]
    held = sc.broadcast(pieces)

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        types = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.int64()] * 3 + [pa.string()]
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in OUT.split(", ")])

        for no, _, _, rows in _runs(batches):
            p = held.value.get((part, no)) or Piece(START)
            roles = [_role(r) for r in rows]
            back, cost = forward(roles, p.entry)
            out.extend(render(rows, roles, path(back, best_end(cost) if p.exit is None else p.exit), p))
            if len(out) >= 4096:
                yield flush()
        if out:
            yield flush()

    return src.mapInArrow(tidy(third), OUT)
