"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the assistant.
Dynamic programming over that automaton chooses for each source turn, in order of (turn, hash of role and text), the
cheapest way into a legal sequence: keep it, give it another role, merge it into the turn before, or insert an empty turn
ahead of it; an empty assistant turn may close the conversation. Costs are ``COSTS``; ties go to the action named first
there, then to the role named first in ``ROLES``.

The result holds one row per source turn with the piece of text that it adds to the rendered conversation; pieces put
together in order of ``position`` give it whole. Conversations are cut into segments by a range partitioning. A segment's
effect is a small matrix of least costs between automaton states; matrices meet per conversation, which fixes the state
at each segment's ends, and segments are then repaired apart from each other. So a conversation of any length is spread
over tasks.

Rows that repeat a turn exactly count once. A null role or one not in ``ROLES`` is an unknown role, to be relabelled. Null
text is empty. Null turns come first. Rows with a null conversation form one conversation. A table without rows gives an
empty result; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROLES = ("system", "user", "assistant")
#: Costs of the actions; unknown: of giving a role to a turn that has none of ROLES.
COSTS = {"keep": 0, "merge": 1, "relabel": 3, "unknown": 1, "merge_other": 4, "insert": 2}
START, FAR = 3, 10**9  # states 0 to 2: the role of the last turn; 3: nothing yet
#: Roles that may follow each state.
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


def paths() -> dict[tuple[int, int], tuple[tuple[int, ...], int]]:
    """For each state and role of the next turn: the empty turns to insert ahead of it, and the cost."""
    out = {}
    for state in (0, 1, 2, START):
        for role in range(3):
            for inserted in ((), (0,), (1,), (2,), (0, 1), (1, 2), (2, 1), (0, 1, 2)):
                at, legal = state, True
                for r in (*inserted, role):
                    legal = legal and r in NEXT[at]
                    at = r
                if legal:
                    out[state, role] = inserted, COSTS["insert"] * len(inserted)
                    break
    return out


PATHS = paths()
#: Cost of ending in each state, and the empty turns that close the conversation.
ENDS = {2: (0, ()), 1: (COSTS["insert"], (2,)), 0: (2 * COSTS["insert"], (1, 2)), START: (FAR, ())}


def moves(role: int) -> list[tuple[int, int, int, str]]:
    """``(state before, state after, cost, action)`` for a source turn of a role (-1: unknown), cheapest action names first."""
    out = []
    for (state, new), (inserted, cost) in PATHS.items():
        base = COSTS["keep"] if new == role else COSTS["unknown"] if role < 0 else COSTS["relabel"]
        action = ("keep" if new == role else "relabel") + ("+insert" if inserted else "")
        out.append((state, new, base + cost, action))
    for state in range(3):
        same = state == role
        out.append((state, state, COSTS["merge"] if same else COSTS["merge_other"], "merge"))
    rank = {"keep": 0, "keep+insert": 1, "relabel": 2, "relabel+insert": 3, "merge": 4}
    return sorted(out, key=lambda m: (m[2], rank[m[3]], m[1]))


MOVES = {role: moves(role) for role in (-1, 0, 1, 2)}


def step(costs: list[int], role: int) -> tuple[list[int], dict[int, tuple[int, str]]]:
    """Least costs after a turn, and the move into each state."""
    out, back = [FAR] * 4, {}
    for before, after, cost, action in MOVES[role]:
        if costs[before] + cost < out[after]:
            out[after], back[after] = costs[before] + cost, (before, action)
    return out, back


def matrix_of(roles: list[int]) -> list[list[int]]:
    """Least costs from each state to each over the turns."""
    return [_run(entry, roles) for entry in range(4)]


def _run(entry: int, roles: list[int]) -> list[int]:
    costs = [FAR] * 4
    costs[entry] = 0
    for r in roles:
        costs, _ = step(costs, r)
    return costs


def trace(roles: list[int], entry: int, leave: int) -> list[tuple[int, int, str]]:
    """``(state before, state after, action)`` of every turn on the cheapest way between two states."""
    costs = [FAR] * 4
    costs[entry] = 0
    backs = []
    for r in roles:
        costs, back = step(costs, r)
        backs.append(back)
    out, at = [], leave
    for back in reversed(backs):
        before, action = back[at]
        out.append((before, at, action))
        at = before
    return out[::-1]


def piece(before: int, after: int, action: str, text: str) -> tuple[str, int]:
    """What a turn adds to the rendered conversation, and how many empty turns it has inserted."""
    if action == "merge":
        return JOIN + text, 0
    inserted, _ = PATHS[before, after]
    out = "" if before == START else CLOSE
    for r in inserted:
        out += OPEN.format(ROLES[r]) + CLOSE
    return out + OPEN.format(ROLES[after]) + text, len(inserted)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches, group by group; a group is one segment, which one range partition bounds."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row)
    if held:
        yield now, held


def batched(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]], size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield flush()
            held = []
    if held:
        yield flush()


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``position``, ``action``, ``new_role``, ``inserted`` and ``rendered`` of every source turn."""
    name = F.lower(F.trim(F.coalesce(F.col(f"`{role}`"), F.lit(""))))
    known = F.when(name == "system", 0).when(name == "user", 1).when(name == "assistant", 2).otherwise(-1)
    rows = turns.select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), known.alias("code"),
    ).distinct().withColumn("hash", F.xxhash64("role", "text"))
    order = ["conv", "turn", "hash"]
    cut = stored(rows.repartitionByRange(*order).withColumn("segment", F.spark_partition_id()), "segments")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((*key, len(held), *(c for row in matrix_of([r[2] for r in held]) for c in row)) for key, held in groups(batches, 2))
        yield from batched(found, [("conv", pa.int64()), ("segment", pa.int32()), ("n", pa.int64()), *((f"c{i}", pa.int64()) for i in range(16))])

    names = [f"c{i}" for i in range(16)]
    matrices = (
        cut.select("conv", "segment", "code", "turn", "hash").repartition("conv", "segment").sortWithinPartitions("conv", "segment", "turn", "hash")
        .mapInArrow(costs, "conv long, segment int, n long, " + ", ".join(f"{c} long" for c in names))
    )
    matrices = stored(matrices, "matrices")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        # one row per segment of one conversation: as many as range partitions at most
        pdf = pdf.sort_values("segment")
        steps = pdf[names].to_numpy().reshape(-1, 4, 4)
        reach = [np.array([FAR, FAR, FAR, 0])]
        for m in steps:
            reach.append(np.minimum((reach[-1][:, None] + m).min(axis=0), FAR))
        at = min((0, 1, 2), key=lambda s: (reach[-1][s] + ENDS[s][0], s != 2, s))
        last, entry, leave = at, [], []
        for k in range(len(steps) - 1, -1, -1):
            leave.append(at)
            at = int((reach[k] + steps[k][:, at]).argmin())
            entry.append(at)
        first = np.concatenate(([0], np.cumsum(pdf["n"].to_numpy())[:-1]))
        return pd.DataFrame({"conv": pdf["conv"], "segment": pdf["segment"], "entry": entry[::-1], "leave": leave[::-1], "first": first, "end": [-1] * (len(pdf) - 1) + [last]})

    # nearly every conversation is one segment, whose end is the cheapest state; only the others are chained
    counted = matrices.groupBy("conv").agg(F.count("*").alias("segments"), F.first(F.struct("segment", "n", *names)).alias("m"))
    ends = F.array_min(F.array(*[F.struct((F.col(f"m.c{4 * START + s}") + ENDS[s][0]).alias("cost"), F.lit(int(s != 2)).alias("late"), F.lit(s).alias("state")) for s in range(3)]))
    alone = counted.where("segments = 1").select("conv", "m.segment", F.lit(START).alias("entry"), ends["state"].alias("leave"), F.lit(0).cast("long").alias("first"), ends["state"].alias("end"))
    several = counted.where("segments > 1").select(F.col("conv").alias("of"))
    chained = matrices.join(several, F.col("conv").eqNullSafe(F.col("of")), "left_semi").groupBy("conv").applyInPandas(chain, "conv long, segment int, entry int, leave int, first long, end int")
    fixed = alone.unionByName(chained)
    ready = cut.join(fixed, cut["conv"].eqNullSafe(fixed["conv"]) & (cut["segment"] == fixed["segment"]))
    ready = ready.select(cut["conv"], cut["segment"], "turn", "hash", "code", "role", "text", "entry", "leave", "first", "end")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (c, _), held in groups(batches, 2):
                *_, entry, leave, first, end = held[0]
                done = trace([r[4] for r in held], entry, leave)
                for k, (row, (before, after, action)) in enumerate(zip(held, done, strict=True)):
                    out, inserted = piece(before, after, action, row[6])
                    if end >= 0 and k == len(held) - 1:
                        closing = ENDS[end][1]
                        out += CLOSE + "".join(OPEN.format(ROLES[r]) + CLOSE for r in closing)
                        inserted += len(closing)
                    yield c, row[2], row[5], first + k, action, ROLES[after], inserted, out

        kinds = [("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("position", pa.int64()), ("action", pa.string()), ("new_role", pa.string()), ("inserted", pa.int32()), ("rendered", pa.string())]
        yield from batched(made(), kinds)

    out = ready.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "turn", "hash").mapInArrow(
        render, "conv long, turn long, role string, position long, action string, new_role string, inserted int, rendered string"
    )
    return out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "position", "action", "new_role", "inserted", "rendered")
