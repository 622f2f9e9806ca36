"""Chat formatting with minimum-cost role repair.

Turns of a conversation pass a legal-turn automaton: an optional system message, then user and assistant in turn. Dynamic
programming picks for each turn a role (its own, or another at a cost) and what to do: append it, merge it with the message
before, or put empty messages in front. Turns are laid out in range partitions by (conv_id, turn), so a conversation of
any length is cut into segments; a segment is summed up as a matrix of least costs between states, matrices are multiplied
along the conversation in (min, +), and each segment is then walked again between its states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import staged

ROLES = ["system", "user", "assistant"]
#: State 0 is the start; state i + 1 is that the last message has role i.
STATES = 4
START = 0
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, INSERT, RELABEL = 1, 2, 3
FAR = 1 << 40
KEY = "conv_id", "segment"


def _steps() -> dict[tuple[int, int], tuple[int, tuple[int, ...]]]:
    """(state, role's state): least cost to add a message of that role, and the empty messages put in front."""
    out = {}
    for s in range(STATES):
        ways, seen = [(s, ())], set()
        while ways:
            at, path = ways.pop(0)  # by number of empty messages, then by role
            for q in LEGAL[at]:
                if (s, q) not in out:
                    out[s, q] = INSERT * len(path), path
                if len(path) < STATES and (q, len(path)) not in seen:
                    seen.add((q, len(path)))
                    ways.append((q, (*path, q)))
    return out


STEPS = _steps()


def _turn(role: str | None) -> list[list[tuple[int, int, bool, tuple[int, ...]]]]:
    """For each state before a turn of this role, its choices (cost, state after, merged, empty messages), best first."""
    own = ROLES.index(role) + 1 if role in ROLES else -1
    out = []
    for s in range(STATES):
        choices = []
        for q in range(1, STATES):
            change = 0 if q == own else RELABEL
            if q == s:
                choices.append((change + MERGE, q, True, ()))
            if (s, q) in STEPS:
                cost, path = STEPS[s, q]
                choices.append((change + cost, q, False, path))
        best: dict[int, tuple] = {}
        for choice in sorted(choices, key=lambda c: (c[0], c[1], not c[2])):
            best.setdefault(choice[1], choice)
        out.append(sorted(best.values()))
    return out


TURNS = {role: _turn(role) for role in [*ROLES, None]}


def _normal(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def _matrix(role: str | None) -> np.ndarray:
    out = np.full((STATES, STATES), FAR, np.int64)
    for s, choices in enumerate(TURNS[role]):
        for cost, q, *_ in choices:
            out[s, q] = cost
    return out


MATRICES = {role: _matrix(role) for role in TURNS}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows one by one with a mark where a new (conv_id, segment) begins, batch by batch."""
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            key = row["conv_id"], row["segment"]
            yield key != last, row
            last = key


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least costs between states over each segment."""
    out, now, key = [], None, None

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in out], pa.int64()), pa.array([k[1] for k, _ in out], pa.int64()),
                                           pa.array([m.ravel().tolist() for _, m in out], pa.list_(pa.int64()))], [*KEY, "costs"])
        out.clear()
        return made

    for new, row in _runs(batches):
        if new:
            if now is not None:
                out.append((key, now))
            if len(out) >= 4096:
                yield batch()
            now, key = None, (row["conv_id"], row["segment"])
        step = MATRICES[_normal(row["role"])]
        now = step if now is None else np.minimum(FAR, (now[:, :, None] + step[None]).min(axis=1))
    if now is not None:
        out.append((key, now))
    yield batch()


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments by conversation, in order: cost of each state at the end of each one; the states are picked backwards.

    A conversation has as many segments as partitions it reaches into.
    """
    out, held, conv = [], [], object()

    def close():
        costs = np.where(np.arange(STATES) == START, 0, FAR)
        reached = [costs]
        for _, matrix in held:
            reached.append(np.minimum(FAR, (reached[-1][:, None] + matrix).min(axis=0)))
        state = int(np.argmin(reached[-1]))
        for i in range(len(held) - 1, -1, -1):
            segment, matrix = held[i]
            before = int(np.argmin(reached[i] + matrix[:, state]))
            out.append((conv, segment, before, state, i == len(held) - 1, int(reached[i][before])))
            state = before
        held.clear()

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(
            (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()))], ["conv_id", "segment", "enter", "leave", "is_last", "cost_before"])
        out.clear()
        return made

    for part in batches:
        for row in part.to_pylist():
            if held and row["conv_id"] != conv:
                close()
            conv = row["conv_id"]
            held.append((row["segment"], np.array(row["costs"], np.int64).reshape(STATES, STATES)))
        if len(out) >= 4096:
            yield batch()
    if held:
        close()
    yield batch()


def _walk(roles: list[str | None], enter: int, leave: int) -> list[tuple[int, int, bool, tuple[int, ...]]]:
    """Cheapest choices from state to state over a segment; equal costs take the lower state before."""
    costs = [[FAR] * STATES]
    costs[0][enter] = 0
    back = []
    for role in roles:
        now, came = [FAR] * STATES, [None] * STATES
        for s, choices in enumerate(TURNS[role]):
            if costs[-1][s] < FAR:
                for choice in choices:
                    total = costs[-1][s] + choice[0]
                    if total < now[choice[1]]:
                        now[choice[1]], came[choice[1]] = total, (s, choice)
        costs.append(now)
        back.append(came)
    out, state = [], leave
    for came in reversed(back):
        state, choice = came[state]
        out.append(choice)
    return out[::-1]


RESULT = ("conv_id long, turn long, place long, role string, new_role string, action string, n_inserted int, cost int, rendered string")
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]
RESULT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts with their segment's states: the piece of the rendered conversation that each turn adds.

    A segment's roles are read ahead, its texts are written batch by batch.
    """
    held: list[dict] = []

    def close() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        head = held[0]
        state, out = head["enter"], []
        for i, (row, (cost, q, merged, path)) in enumerate(zip(held, _walk([_normal(r["role"]) for r in held], head["enter"], head["leave"]))):
            role, text = ROLES[q - 1], row["text"] or ""
            if merged:
                piece = "\n" + text
            else:
                piece = ("" if state == START else "<|end|>\n") + "".join(f"<|{ROLES[p - 1]}|>\n<|end|>\n" for p in path) + f"<|{role}|>\n" + text
            if head["is_last"] and i == len(held) - 1:
                piece += "<|end|>\n"
            action = "+".join([*(["relabel"] if role != _normal(row["role"]) else []), *(["merge"] if merged else []), *(["insert"] if path else [])])
            out.append((row["conv_id"], row["turn"], row["place"], row["role"], role, action or "keep", len(path), cost, piece))
            state = q
        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(RESULT_TYPES)], RESULT_NAMES)

    for new, row in _runs(batches):
        if new:
            yield from close()
        held.append(row)
    yield from close()


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per turn of turns (conv_id, turn, role, text) with its repaired role and its piece of the rendered text.

    The pieces of a conversation in the order of `place`, one after the other, are the rendered sequence: they hold the
    role heads, the empty messages put in before the turn, and the ends. `action` names what was done, `cost` its price
    (merge 1, empty message 2, relabel 3); their sum over a conversation is the least possible, and among equal ones the lower
    states win (start, system, user, assistant). Roles are compared in lower case; a null or unknown role takes any
    role at the price of a relabel. Turns are in the order of `turn`, nulls first, equal ones by a hash of role and text
    (repeated rows stay); a null text is empty; null conv_ids are one conversation; an empty table gives none.
    """
    tie = F.xxhash64("role", "text")
    laid = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), tie.alias("__tie"))
    laid = (laid.repartitionByRange("conv_id", "turn", "__tie").sortWithinPartitions("conv_id", "turn", "__tie").drop("__tie")
            .withColumn("place", F.monotonically_increasing_id()))
    laid = staged(laid, "turns").withColumn("segment", F.shiftright("place", 33))
    sums = (laid.select("conv_id", "segment", "place", "role").repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")
            .mapInArrow(_sums, "conv_id long, segment long, costs array<long>"))
    borders = sums.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(
        _borders, "conv_id long, segment long, enter int, leave int, is_last boolean, cost_before long")
    named = borders.select(F.col("conv_id").alias("__conv"), F.col("segment").alias("__segment"), "enter", "leave", "is_last")
    both = laid.join(named, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("segment") == F.col("__segment")))
    return (both.select("conv_id", "segment", "place", "turn", "role", "text", "enter", "leave", "is_last")
            .repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place").mapInArrow(_render, RESULT))
