"""Chat formatting: minimum-cost role repair over a legal-turn automaton.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant.
Each input turn is merged into the turn before it, kept or relabelled, and empty turns may be inserted; a dynamic
program over the automaton's states finds the cheapest repair, and of equals the one with fewest turns. Of equals in both, it is the one
that, read from its end, comes from the lowest state at every step, unmerged before merged: costs up to a step decide
that, so neither blocks nor other conversations have a part in it.

Rows are put in one total order (conversation, turn, role, text) and cut into blocks of BLOCK rows, of which only the roles are
looked at. Conversations inside a block are repaired there. The first and the last one of a block may go on in others: their
segments are matrices of least costs between states, chained from the left per conversation to the
costs at each segment's start; each segment then tells where it would come from for every state it may end in, and
chaining these from the right gives the state it does end in. A conversation of any length is thus shared out, and what one task holds
of it are 4 x 4 numbers a segment. Texts meet the decisions row by row, so their size doesn't matter.

Null and unknown roles may take any role at the price of a relabel. A null text is empty. Equal rows follow each other.
A null turn comes first (Spark's order of nulls); rows with a null conv_id form one conversation. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, indexed, map_arrow

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
MERGE, RELABEL, INSERT = 1, 2, 3
BLOCK = 2048
UNIT = 1 << 24  # a price in units; below it the number of turns
FAR = 1 << 60

#: Steps of the automaton: state -> next turn's role.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest turns to insert so that a role may follow a state."""
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            todo: list[tuple[int, tuple[int, ...]]] = [(a, ())]
            while todo:
                at, way = todo.pop(0)
                if b in LEGAL[at]:
                    out[a, b] = way
                    break
                if len(way) < 3:
                    todo += [(x, (*way, x)) for x in LEGAL[at]]
    return out


PATHS = _paths()
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def moves(role: int) -> list[tuple[int, int, int, bool]]:
    """(from, to, weight, merged) of a turn whose role is 1..3, or 0 if unknown."""
    out = []
    for label in (SYSTEM, USER, ASSISTANT):
        relabel = 0 if label == role else RELABEL
        for a in range(4):
            if a == label:
                out.append((a, label, (MERGE + relabel) * UNIT, True))
            if (a, label) in PATHS:
                n = len(PATHS[a, label])
                out.append((a, label, (relabel + INSERT * n) * UNIT + n + 1, False))
    return out


MOVES = {r: moves(r) for r in range(4)}


def role_code(role: str | None) -> int:
    return NAMES.index(role) if role in NAMES[1:] else 0


def forward(roles: bytes, cost: list[int]) -> list[list[int]]:
    """Least weights of the states before each turn and after the last one, from those at the start."""
    out = [cost]
    for role in roles:
        after = [FAR] * 4
        for a, b, w, _ in MOVES[role]:
            if cost[a] + w < after[b]:
                after[b] = cost[a] + w
        cost = after
        out.append(cost)
    return out


def matrix(roles: bytes) -> list[int]:
    """Least weight between states over some turns, row by row."""
    return [w for a in range(4) for w in forward(roles, [0 if a == b else FAR for b in range(4)])[-1]]


def backward(roles: bytes, costs: list[list[int]], leave: int) -> list[tuple[int, int, bool]]:
    """(state before, label, merged) of every turn on the chosen way to ``leave``."""
    out, at = [], leave
    for k in range(len(roles) - 1, -1, -1):
        before = costs[k]
        at_, merged = min((a, m) for a, b, w, m in MOVES[roles[k]] if b == at and before[a] < FAR and before[a] + w == costs[k + 1][at])
        out.append((at_, at, merged))
        at = at_
    return out[::-1]


def final_state(cost: list[int]) -> int:
    return min(range(4), key=lambda s: (cost[s] + ending_weight(s), s))


@lru_cache(1 << 16)
def repair(roles: bytes) -> tuple[list[tuple[int, int, bool]], int]:
    """The chosen way through a whole conversation, and the state it ends in."""
    costs = forward(roles, [0, FAR, FAR, FAR])
    leave = final_state(costs[-1])
    return backward(roles, costs, leave), leave


def ending_weight(state: int) -> int:
    return (INSERT * UNIT + 1) * len(ENDING[state])


MOST = 256  # turns of a conversation whose repair is remembered
#: A row of the first pass is a conversation that lies in its block, or a segment of one that may not.
LOOKED = "conv_id long, first long, roles binary, weights array<long>"
STEP = "pos long, label int, merged boolean, inserts array<int>, out_turn long, closes boolean, ending array<int>"
OUT = "conv_id long, out_turn long, piece long, role string, action string, n_merged long, rendered string"


def _decisions(first: int, way: list[tuple[int, int, bool]], turn: int, goes_on: bool, last: bool) -> Iterator[tuple]:
    """``STEP`` rows of a segment: ``turn`` turns stand before it, ``goes_on`` if the next one begins by merging into its last."""
    for k, (a, label, merged) in enumerate(way):
        inserts = [] if merged else list(PATHS[a, label])
        turn += 0 if merged else len(inserts) + 1
        end = k == len(way) - 1
        closes = not (goes_on if end else way[k + 1][2])
        yield first + k, label, merged, inserts, turn - 1, closes, list(ENDING[label]) if end and last else []


def _turns(way: list[tuple[int, int, bool]]) -> int:
    return sum(0 if merged else len(PATHS[a, label]) + 1 for a, label, merged in way)


def _step_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in STEP.split(", ")])


def _mapped(rows_of):
    """A function over Arrow batches from one that turns a row into ``STEP`` rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for r in batch.to_pylist():
                held += rows_of(r)
                if len(held) >= 1 << 14:
                    yield _step_batch(held)
                    held = []
            yield _step_batch(held)

    return run


def _segments(frame: pd.DataFrame) -> pd.DataFrame:
    """A block's conversations; the outermost two with their matrices."""
    frame = frame.sort_values("pos", kind="stable")
    ids, pos = frame["conv_id"], frame["pos"].to_numpy()
    new = ((ids != ids.shift()) & ~(ids.isna() & ids.shift().isna())).to_numpy(bool, na_value=False).copy()
    new[0] = True
    at = np.append(np.flatnonzero(new), len(frame))
    codes = bytes(role_code(r) for r in frame["role"])
    out = []
    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        outer = k == 0 or k == len(at) - 2
        conv = ids.iloc[a]
        out.append((None if pd.isna(conv) else int(conv), pos[a], codes[a:b], matrix(codes[a:b]) if outer else None))
    return pd.DataFrame(out, columns=["conv_id", "first", "roles", "weights"]).astype({"conv_id": "Int64"})


def _from_left(frame: pd.DataFrame) -> pd.DataFrame:
    """The costs at the start of each segment of a conversation, and the state that the last one ends in."""
    frame = frame.sort_values("first")
    cost, entries = [0, FAR, FAR, FAR], []
    for w in frame["weights"]:
        low = min(cost)
        cost = [min(c - low, FAR) for c in cost]  # only differences matter
        entries.append(cost)
        m = np.asarray(w).reshape(4, 4)
        cost = np.minimum((np.array(cost)[:, None] + m).min(0), FAR).tolist()
    return pd.DataFrame({"f": frame["first"].to_numpy(), "entry": entries, "final": final_state(cost)})


def _from_right(frame: pd.DataFrame) -> pd.DataFrame:
    """The state that each segment ends in, the turns before it, and whether the next one merges into its last turn."""
    frame = frame.sort_values("first")
    at, goes_on, out = int(frame["final"].iloc[-1]), False, []
    for first, came, turns, merges in zip(frame["first"][::-1], frame["came"][::-1], frame["turns"][::-1], frame["merges"][::-1], strict=True):
        out.append([first, at, int(turns[at]), goes_on, not out])
        at, goes_on = int(came[at]), bool(merges[at])
    out.reverse()
    done = pd.DataFrame(out, columns=["f", "leave", "before", "goes_on", "last"])
    done["before"] = done["before"].cumsum() - done["before"]
    return done


def _told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each state that a segment may end in: the state it then begins in, its turns, and whether it begins with a merge."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            costs = forward(r["roles"], r["entry"])
            ways = [backward(r["roles"], costs, s) if costs[-1][s] < FAR else None for s in range(4)]
            rows.append((r["conv_id"], r["first"], r["final"], [w[0][0] if w else 0 for w in ways], [_turns(w) if w else 0 for w in ways], [bool(w and w[0][2]) for w in ways]))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "first", "final", "came", "turns", "merges"])


def decide(tables: Tables, rows: DataFrame) -> DataFrame:
    """``STEP`` of every row of ``rows`` (pos, conv_id, role): what is done with it."""
    blocks = rows.select("pos", "conv_id", "role", F.floor(F.col("pos") / BLOCK).alias("block"))
    looked = tables.put("looked", blocks.groupBy("block").applyInPandas(_segments, LOOKED))
    inner = map_arrow(looked.where("weights is null").select("first", "roles"), _mapped(lambda r: _whole(r["first"], r["roles"])), STEP)
    outer = looked.where("weights is not null")
    entries = tables.put("entries", outer.select("conv_id", "first", "weights").groupBy("conv_id").applyInPandas(_from_left, "f long, entry array<long>, final int"))
    known = tables.put("known", outer.select("conv_id", "first", "roles").join(entries, F.col("first") == F.col("f")).drop("f"))
    told = tables.put("told", map_arrow(known, _told, "conv_id long, first long, final int, came array<int>, turns array<long>, merges array<boolean>"))
    ends = tables.put("ends", told.groupBy("conv_id").applyInPandas(_from_right, "f long, leave int, before long, goes_on boolean, last boolean"))
    along = lambda r: _decisions(r["first"], backward(r["roles"], forward(r["roles"], r["entry"]), r["leave"]), r["before"], r["goes_on"], r["last"])
    border = map_arrow(known.join(ends, F.col("first") == F.col("f")), _mapped(along), STEP)
    return tables.put("steps", inner.union(border))


def _whole(first: int, roles: bytes) -> Iterator[tuple]:
    way, _ = (repair if len(roles) <= MOST else repair.__wrapped__)(roles)
    return _decisions(first, way, 0, False, True)


def format_chats(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One row per input turn and per inserted turn: conv_id, out_turn, piece, role, action, n_merged, rendered.

    Pieces of one out_turn are merged; a conversation's text is ``rendered`` put together by out_turn and piece.
    """
    tables = Tables(spark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows, _ = indexed(tables, "turns", rows, ["conv_id", "turn", "role", "text"])
    steps = decide(tables, rows)
    name = lambda state: F.element_at(F.array(*map(F.lit, NAMES[1:])), state)
    tag = lambda role: F.concat(F.lit("<|"), role, F.lit("|>\n"))
    end = F.lit("\n<|end|>\n")

    def inserted(states, turn):
        """Empty turns: the k-th of them has the number ``turn(k)``."""
        one = lambda s, k: F.struct(turn(k).alias("out_turn"), F.lit(0).cast("long").alias("piece"), name(s).alias("role"), F.lit("insert").alias("action"), F.lit(0).cast("long").alias("n_merged"), F.concat(tag(name(s)), end).alias("rendered"))
        return F.transform(states, one)

    label = name(F.col("label"))
    action = F.when(F.col("merged"), "merge").when(label.eqNullSafe(F.col("role")), "keep").otherwise("relabel")
    rendered = F.concat(F.when(F.col("merged"), F.lit("\n")).otherwise(tag(label)), F.coalesce("text", F.lit("")), F.when(F.col("closes"), end).otherwise(""))
    own = F.struct(F.col("out_turn"), F.col("pos").alias("piece"), label.alias("role"), action.alias("action"), F.lit(1).cast("long").alias("n_merged"), rendered.alias("rendered"))
    before = inserted(F.col("inserts"), lambda k: F.col("out_turn") - F.size("inserts") + k)
    after = inserted(F.col("ending"), lambda k: F.col("out_turn") + 1 + k)
    both = rows.join(steps, "pos").select("conv_id", F.explode(F.concat(before, F.array(own), after)).alias("x"))
    return both.select("conv_id", "x.*")


def op6_query(spark: SparkSession, turns: DataFrame) -> DataFrame:
    return format_chats(spark, turns)
