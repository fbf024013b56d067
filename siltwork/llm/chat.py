"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, ending with the assistant. Every turn is kept under its role, merged
into the turn before it, or relabelled, and empty turns may be inserted before it
or at the end; the cheapest sequence of such choices is found by dynamic
programming over the automaton's states. A turn is a 4 by 4 matrix of costs between
states, and such matrices combine associatively, so a conversation of any length is
repaired in pieces: rows are range-partitioned by (conversation, turn), each piece
gives its matrix, the few matrices of a conversation fix the states at its pieces'
edges, and each piece is then traced on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

MERGE, INSERT, RELABEL, GUESS = 1, 2, 3, 1
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
# Other names of the roles.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
UNKNOWN = 0
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
FAR = 1 << 40


def _paths(state: int, to: int) -> tuple[int, ...] | None:
    """The fewest empty turns that make a turn ``to`` legal after ``state``."""
    for n in range(3):
        for mid in product((USER, ASSISTANT), repeat=n):
            steps = (state, *mid, to)
            if all(p in LEGAL for p in zip(steps, steps[1:], strict=False)):
                return mid
    return None


def _choices() -> dict[int, dict[tuple[int, int], tuple[int, tuple[int, ...], int, str]]]:
    """By role and (state, next state): the cheapest (cost, inserted, role, action); equal costs take keep, merge, relabel in that order."""
    out = {}
    for role in range(4):
        best = {}
        for state, to in product(range(4), range(1, 4)):
            change = 0 if role == to else GUESS if role == UNKNOWN else RELABEL
            name = "keep" if role == to else "relabel"
            options = []
            if (mid := _paths(state, to)) is not None:
                options.append((change + INSERT * len(mid), mid, to, name))
            if state == to:
                options.append((change + MERGE, (), to, "merge" if name == "keep" else "relabel_merge"))
            if options:
                best[state, to] = min(options, key=lambda o: o[0])
        out[role] = best
    return out


CHOICES = _choices()
STEP = {r: np.array([[c[s, t][0] if (s, t) in c else FAR for t in range(4)] for s in range(4)], dtype=np.int64) for r, c in CHOICES.items()}
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
END_COST = np.array([INSERT * len(CLOSING[s]) for s in range(4)], dtype=np.int64)


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def traced(roles: list[int], first: int, last: int) -> list[tuple[tuple[int, ...], int, str, int]]:
    """The cheapest choices (inserted, role, action, cost) that lead from one state to another."""
    cost = np.full(4, FAR, dtype=np.int64)
    cost[first] = 0
    back = []
    for r in roles:
        total = cost[:, None] + STEP[r]
        back.append(total.argmin(axis=0))
        cost = np.minimum(total.min(axis=0), FAR)
    out = []
    for r, b in zip(reversed(roles), reversed(back), strict=True):
        state = int(b[last])
        c, inserted, role, action = CHOICES[r][state, last]
        out.append((inserted, role, action, c))
        last = state
    return out[::-1]


_TURNS = "conv_id long, seg int, pos long, turn long, role int, text string, costs array<long>"
_TURNS_ARROW = pa.schema([("conv_id", pa.int64()), ("seg", pa.int32()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.int32()), ("text", pa.string()), ("costs", pa.list_(pa.int64()))])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns numbered within their partition, and a row with the matrix of each conversation's part of it."""
    seg, pos, conv, matrix, open_ = TaskContext.get().partitionId(), 0, None, None, False

    def summary() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, seg, None, None, None, None, matrix.ravel().tolist()), _TURNS_ARROW.types, strict=True)], schema=_TURNS_ARROW)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        roles = [NAMES.get((r or "").strip().lower(), UNKNOWN) for r in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, seg, np.int32)), pa.array(pos + np.arange(n)), batch.column(1), pa.array(roles, pa.int32()), batch.column(3), pa.nulls(n, pa.list_(pa.int64()))], schema=_TURNS_ARROW)
        pos += n
        for c, r in zip(batch.column(0).to_pylist(), roles, strict=True):
            if open_ and c == conv:
                matrix = combined(matrix, STEP[r])
            else:
                if open_:
                    yield summary()
                conv, matrix, open_ = c, STEP[r], True
    if open_:
        yield summary()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's matrices in order give the states at its pieces' edges."""
    for batch in batches:
        rows = []
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cost, back = np.array([0, FAR, FAR, FAR], dtype=np.int64), []
            for p in parts:
                total = cost[:, None] + np.array(p["costs"], dtype=np.int64).reshape(4, 4)
                back.append(total.argmin(axis=0))
                cost = np.minimum(total.min(axis=0), FAR)
            last = int((cost + END_COST).argmin())
            full = int((cost + END_COST).min())
            for k in range(len(parts) - 1, -1, -1):
                first = int(back[k][last])
                rows.append((conv, parts[k]["seg"], first, last, k == len(parts) - 1, full))
                last = first
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()), strict=True)], ["conv_id", "seg", "first", "last", "closes", "cost"])


_REPAIRED = "conv_id long, seg int, pos long, sub int, turn long, role string, action string, step_cost long, cost long, rendered string"


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by piece."""
    held: list[tuple] = []
    key = None

    def finish() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        first, last, closes, cost = held[0][6:]
        steps = traced([r[4] for r in held], first, last)
        out: list[tuple] = []
        head = lambda r: f"{'' if first == START and not out else chr(10)}<|{ROLES[r]}|>\n"
        for (conv, seg, pos, turn, _, text, *_), (inserted, role, action, c) in zip(held, steps, strict=True):
            for k, r in enumerate(inserted):
                out.append((conv, seg, pos, k, None, ROLES[r], "insert", INSERT, cost, head(r)))
            body = text or ""
            out.append((conv, seg, pos, len(inserted), turn, ROLES[role], action, c - INSERT * len(inserted), cost, f"\n{body}" if action.endswith("merge") else f"{head(role)}{body}"))
        if closes:
            for k, r in enumerate(CLOSING[last]):
                out.append((held[-1][0], held[-1][1], held[-1][2], 10 + k, None, ROLES[r], "insert", INSERT, cost, head(r)))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in _REPAIRED.split(", ")])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                yield from finish()
                key, held = row[:2], []
            held.append(row)
    yield from finish()


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired turns of conversations (conv_id, turn, role, text), a row each and one for every inserted turn.

    Ordered by (seg, pos, sub) within conv_id; joining ``rendered`` in that order with
    nothing between gives the conversation's text. ``cost`` is the conversation's
    least cost, ``step_cost`` the row's part of it. Turns are taken in order of turn
    (null first), equal ones by a hash of role and text; rows with equal turns are turns
    of their own. Other columns are not looked at.
    Roles are trimmed and lower-cased; a null or unknown role may become any at a low
    cost; a null text is empty; a null conv_id is one conversation.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.xxhash64("role", "text").asc()]
    numbered = written(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, _TURNS), "turns")
    parts = numbered.where("costs IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "costs"))).alias("parts"))  # at most one a partition
    edges = parts.mapInArrow(_edges, "conv_id long, seg int, first int, last int, closes boolean, cost long").withColumnsRenamed({"conv_id": "c2", "seg": "s2"})
    rows = numbered.where("costs IS NULL").drop("costs").join(edges, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("seg") == F.col("s2"))).drop("c2", "s2")
    rows = rows.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "pos")
    return rows.mapInArrow(_traces, _REPAIRED)
