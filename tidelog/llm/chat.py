"""Conversations repaired to a legal order of roles at least cost, and rendered.

A legal conversation has at most one system turn, at its start, then user and
assistant in turn, and ends with the assistant.  Every given turn is kept, given
another role, or merged into the turn before it; empty turns may be put in
between.  The cheapest such repair is the shortest path through the automaton's
states.

A turn is a matrix of costs from state to state, and matrices compose; so a
conversation is cut into chunks of at most ``CHUNK`` turns, whose matrices are found
independently.  A conversation then only gathers one small matrix per chunk to
choose the states between chunks, and each chunk traces its own path between
them.  No task holds the texts of a long conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch

CHUNK = 512
MERGE, RELABEL, GUESS, INSERT = 1, 2, 1, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
ALIASES = {
    "system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
    "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT,
}
#: Empty turns put in between so that the second state's turn may follow the first.
BETWEEN = {
    (START, SYSTEM): [], (START, USER): [], (START, ASSISTANT): [USER], (SYSTEM, USER): [], (SYSTEM, ASSISTANT): [USER],
    (USER, ASSISTANT): [], (USER, USER): [ASSISTANT], (ASSISTANT, USER): [], (ASSISTANT, ASSISTANT): [USER],
}
#: Empty turns put at the end.
CLOSING = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
INF = 1 << 40


def role_of(role: str | None) -> int:
    """The state of a role name, START for an unknown one."""
    return ALIASES.get((role or "").strip().lower(), START)


def relabel(given: int, role: int) -> int:
    return 0 if given == role else GUESS if given == START else RELABEL


def moves(given: int, state: int) -> list[tuple[int, int, str]]:
    """``(next state, cost, action)`` of a turn with a given role, preferred ones first."""
    out = []
    for role in (SYSTEM, USER, ASSISTANT):
        if (state, role) in BETWEEN:
            cost = relabel(given, role)
            out.append((role, cost + INSERT * len(BETWEEN[state, role]), "relabel" if cost else "keep"))
    if state != START:
        out.append((state, MERGE + relabel(given, state), "merge"))
    return out


def trace(given: list[int], entry: int, exit_state: int | None = None) -> tuple[list[int], list[tuple[int, str]]]:
    """Least costs to each state from ``entry``, and the path to ``exit_state`` as ``(state, action)``."""
    cost = [0 if s == entry else INF for s in range(4)]
    back: list[list[tuple[int, str]]] = []
    for role in given:
        after, via = [INF] * 4, [(START, "")] * 4
        for state in range(4):
            if cost[state] < INF:
                for to, price, action in moves(role, state):
                    if cost[state] + price < after[to]:
                        after[to], via[to] = cost[state] + price, (state, action)
        cost = after
        back.append(via)
    path = []
    if exit_state is not None:
        state = exit_state
        for via in reversed(back):
            path.append((state, via[state][1]))
            state = via[state][0]
        path.reverse()
    return cost, path


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for roles in batch.column("roles"):
            given = [role_of(r) for r in roles.as_py()]
            out.append([c for entry in range(4) for c in trace(given, entry)[0]])
        yield pa.record_batch([batch.column("conv_id"), batch.column("part"), batch.column("sub"), batch.column("n"), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "part", "sub", "n", "matrix"])


def _order(chunk: dict) -> tuple:
    return (chunk["part"] is not None, chunk["part"], chunk["sub"])


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States before and after each chunk on the cheapest path of its conversation."""
    for batch in batches:
        rows: list[tuple] = []
        for conv, chunks in zip(batch.column("conv_id"), batch.column("chunks"), strict=True):
            parts = sorted(chunks.as_py(), key=_order)
            cost, back = [0, INF, INF, INF], []
            for chunk in parts:
                m = chunk["matrix"]
                ways = [min((cost[s] + m[4 * s + t], s) for s in range(4)) for t in range(4)]
                cost = [c for c, _ in ways]
                back.append([s for _, s in ways])
            total, state = min((cost[s] + INSERT * len(CLOSING[s]), s) for s in range(4) if cost[s] < INF)
            found, end = [], sum(p["n"] for p in parts)
            for i in reversed(range(len(parts))):
                end -= parts[i]["n"]
                found.append((conv.as_py(), parts[i]["part"], parts[i]["sub"], back[i][state], state, end, i == len(parts) - 1, total))
                state = back[i][state]
            rows += found
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
        names = ["conv_id", "part", "sub", "entry", "exit", "offset", "last", "cost"]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _opened(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


_CLOSED = "<|im_end|>\n"
_CONTROL = re.compile(r"<(\\*)\|im_")


def escaped(text: str) -> str:
    """``text`` without control tokens: each, and each that is escaped already, gets one more backslash behind its ``<``."""
    return _CONTROL.sub(r"<\1\\|im_", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|im_", r"<\1|im_", text)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            turns, state = row["turns"], row["entry"]
            _, path = trace([role_of(t["role"]) for t in turns], state, row["exit"])
            for i, (turn, (role, action)) in enumerate(zip(turns, path, strict=True)):
                text = escaped(turn["text"] or "")
                if action == "merge":
                    before, piece = [], "\n\n" + text
                else:
                    before = BETWEEN[state, role]
                    piece = (_CLOSED if state != START else "") + "".join(_opened(r) + _CLOSED for r in before) + _opened(role) + text
                after = CLOSING[role] if row["last"] and i == len(turns) - 1 else None
                if after is not None:
                    piece += _CLOSED + "".join(_opened(r) + _CLOSED for r in after)
                out.append((row["conv_id"], row["offset"] + i, turn["turn"], ROLES[role], action, len(before) + len(after or []), row["cost"], piece))
                state = role
        columns = list(zip(*out, strict=True)) or [[]] * 8
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
        names = ["conv_id", "position", "turn", "role", "action", "inserted", "conv_cost", "rendered"]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    r"""One row per turn of ``turns (conv_id, turn, role, text, ...)``, in the repaired conversation.

    ``position`` orders the turns of a conversation from 0; ``role`` is the repaired
    role, ``action`` keep, relabel or merge, ``inserted`` the empty turns put in before
    it (after the last turn also those at the end), ``conv_cost`` the cost of the
    whole conversation, ``rendered`` what the turn adds to the rendered text: the
    pieces of a conversation in order are its rendering.  Control tokens inside a text are escaped
    (``<\|im_start|>``), so no text opens or closes a turn; ``unescaped`` gives the text back.

    Turns are ordered by number, role and text, nulls first; rows that agree in all
    four columns count once.  A null conversation id is a conversation like any
    other, an unknown or null role takes any role at a small cost, a null text is
    empty.  Other columns are ignored.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    rows = turns.select("conv_id", F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).distinct()
    rows = rows.withColumn("part", F.floor(F.col("turn") / chunk).cast("long"))
    number = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text"))
    rows = rows.withColumn("number", number.cast("long")).withColumn("sub", F.expr(f"(number - 1) div {chunk}"))
    chunks = rows.groupBy("conv_id", "part", "sub").agg(F.array_sort(F.collect_list(F.struct("number", "turn", "role", "text"))).alias("turns"), F.count("*").alias("n"))
    chunks = scratch.write(chunks, "chunks")

    kind = chunks.schema["conv_id"].dataType.simpleString()
    roles = chunks.select("conv_id", "part", "sub", "n", F.transform("turns", lambda t: t["role"]).alias("roles"))
    matrices = roles.mapInArrow(_matrices, f"conv_id {kind}, part long, sub long, n long, matrix array<long>")
    gathered = matrices.groupBy("conv_id").agg(F.collect_list(F.struct("part", "sub", "n", "matrix")).alias("chunks"))
    states = gathered.mapInArrow(_boundaries, f"conv_id {kind}, part long, sub long, entry int, exit int, offset long, last boolean, cost long")
    states = scratch.write(states, "states")

    keys = ["conv_id", "part", "sub"]
    joined = chunks.join(states.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return joined.select(*keys, "turns", "entry", "exit", "offset", "last", "cost").mapInArrow(
        _repaired, f"conv_id {kind}, position long, turn long, role string, action string, inserted int, conv_cost long, rendered string"
    )
