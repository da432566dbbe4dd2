"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in turn, user first and assistant last. Every
input turn is kept, merged into the turn before it (same role), or relabelled, and empty turns may be put in; each has a
cost, and dynamic programming over the automaton's states (the role of the last turn) finds the cheapest repair. Of equally
cheap repairs the one is taken whose first differing turn comes first in the order of ``choices``.

Conversations are dealt by range of (conv_id, turn), so a very long one spreads over many tasks. A task solves the
conversations that it has whole. Of one that goes on in other tasks it gives the matrix of least costs from each state to
each; matrices multiply in the (min, +) semiring, which gives the cost-to-go behind every part and with it each part's way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import Scratch, table

#: States: nothing yet, or the role of the last turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
FAR = 1 << 40
OUT = "conv_id long, turn long, turn_no long, role string, new_role string, action string, n_inserted int, rendered string, cost long"


@dataclass(frozen=True)
class Costs:
    relabel: int = 4
    merge: int = 2
    insert: int = 3


def _between(state: int, role: int) -> tuple[int, ...] | None:
    """The empty turns that lead from a state to a turn of a role; None where no way leads."""
    if role == SYSTEM:
        return () if state == NONE else None
    if role == USER:
        return (ASSISTANT,) if state == USER else ()
    return () if state == USER else (USER,)


def closing(state: int) -> tuple[int, ...]:
    return {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]


def choices(costs: Costs) -> list[list[list[tuple[int, int, bool, tuple[int, ...]]]]]:
    """By role of the turn (NONE: unknown) and state: (cost, new role, merged, turns put in), own role first, plain before merged before put in."""
    out = []
    for role in range(4):
        by_state = []
        for state in range(4):
            ways = []
            for new in sorted((SYSTEM, USER, ASSISTANT), key=lambda r: (r != role, r)):
                label = 0 if new == role else costs.relabel
                put = _between(state, new)
                if put == ():
                    ways.append((label, new, False, ()))
                if new == state:
                    ways.append((label + costs.merge, new, True, ()))
                if put:
                    ways.append((label + costs.insert * len(put), new, False, put))
            by_state.append(ways)
        out.append(by_state)
    return out


def end_costs(costs: Costs) -> list[int]:
    return [costs.insert * len(closing(s)) for s in range(4)]


def to_go(roles: list[int], end: list[int], table_: list) -> list[list[int]]:
    """Least cost from each state before each turn, and behind the last, to the end."""
    out = [end]
    for role in reversed(roles):
        nxt, ways = out[-1], table_[role]
        out.append([min(c + nxt[new] for c, new, _, _ in ways[s]) for s in range(4)])
    return out[::-1]


def walk(roles: list[int], state: int, end: list[int], table_: list) -> tuple[list[tuple], int]:
    """The way taken at each turn and the state behind the last."""
    costs, taken = to_go(roles, end, table_), []
    for k, role in enumerate(roles):
        way = next(w for w in table_[role][state] if w[0] + costs[k + 1][w[1]] == costs[k][state])
        taken.append(way)
        state = way[1]
    return taken, state


def _rendered(way: tuple, state: int, text: str, last: bool) -> str:
    """A turn's part of the output; the parts of a conversation, one behind the other, are the whole."""
    _, new, merged, put = way
    safe = text.replace("<|", "< |")
    if merged:
        part = "\n" + safe
    else:
        part = "" if state == NONE else "<|end|>\n"
        part += "".join(f"<|{ROLES[p]}|>\n<|end|>\n" for p in put) + f"<|{ROLES[new]}|>\n{safe}"
    if last:
        part += "<|end|>\n" + "".join(f"<|{ROLES[p]}|>\n<|end|>\n" for p in closing(new))
    return part


def _solved(conv: int | None, turns: list[tuple], start: int, state: int, end: list[int], last: bool, table_: list) -> list[tuple]:
    """turns: (turn, role, text) in order. Rows of OUT."""
    taken, _ = walk([_code(t[1]) for t in turns], state, end, table_)
    out = []
    for k, ((turn, role, text), way) in enumerate(zip(turns, taken, strict=True)):
        cost, new, merged, put = way
        ends = last and k == len(turns) - 1
        tail = closing(new) if ends else ()
        action = ("merge" if merged else "insert" if put else "keep") + ("+relabel" if ROLES[new] != role else "")
        out.append((conv, turn, start + k, role, ROLES[new], action, len(put) + len(tail), _rendered(way, state, text or "", ends), cost + (end[new] if ends else 0)))
        state = new
    return out


def _code(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else NONE


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64()]
_NAMES = [c.split()[0] for c in OUT.split(", ")]


def _batch(rows: list[tuple], extra: bool = False) -> pa.RecordBatch:
    names, types = (_NAMES + ["seg"], [*_TYPES, pa.int32()]) if extra else (_NAMES, _TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(names), types, strict=True)], names)


def _raw(seg: int, conv: int | None, turns: list[tuple]) -> list[tuple]:
    """Turns to be solved later: the text where its rendering goes, the place in this part as turn_no."""
    return [(conv, turn, k, role, None, None, 0, text, 0, seg) for k, (turn, role, text) in enumerate(turns)]


def _roles(t: pa.Table) -> list[int]:
    t = t.sort_by("turn_no")
    return [_code(r) for r in t.column("role").to_pylist()]


def repair(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(OUT) a row for each turn of (conv_id, turn, role, text), in the order of conv_id and turn_no.

    Turns are ordered by (turn, role, text), nulls first; turns alike in all of these are repeats and all stay. A null conv_id
    is a conversation of its own. A role that isn't system, user or assistant, or null, must be relabelled; a null text is
    empty. ``<|`` in a text becomes ``< |``. n_inserted counts the empty turns before a turn and, at the last turn, those that
    close the conversation. Other columns are not read.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "chat")
    ways, end = choices(costs), end_costs(costs)
    order = ["conv_id", "turn", "role", "text"]
    base = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Solve what lies between other conversations; the first and the last may go on elsewhere and stay as they are."""
        seg, held, conv, first = TaskContext.get().partitionId(), [], None, True
        for b in batches:
            out = []
            for c, *turn in zip(*(b.column(n).to_pylist() for n in order), strict=True):
                if held and c != conv:
                    out += _raw(seg, conv, held) if first else [(*r, -1) for r in _solved(conv, held, 0, NONE, end, True, ways)]
                    held, first = [], False
                conv = c
                held.append(tuple(turn))
            yield _batch(out, extra=True)
        yield _batch(_raw(seg, conv, held), extra=True)

    passed = scratch.save(dealt.mapInArrow(first_pass, OUT + ", seg int"), "passed")
    raw = passed.where("seg >= 0").withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))

    def matrix(t: pa.Table) -> pa.Table:
        roles = _roles(t)
        least = [[0 if k == s else FAR for k in range(4)] for s in range(4)]
        cost = [to_go(roles, [0 if k == s else FAR for k in range(4)], ways)[0] for s in range(4)] if roles else least
        return pa.table({"key": t.column("key")[:1], "seg": t.column("seg")[:1], "n": pa.array([len(roles)], pa.int64()), "m": pa.array([[cost[s][k] for k in range(4) for s in range(4)]], pa.list_(pa.int64()))})

    def behind(t: pa.Table) -> pa.Table:
        t = t.sort_by("seg")
        n, go, out = t.column("n").to_pylist(), end, []
        for m in reversed(t.column("m").to_pylist()):
            out.append(go)
            go = [min(m[4 * k + s] + go[s] for s in range(4)) for k in range(4)]
        start = [sum(n[:k]) for k in range(len(n))]
        return pa.table({"key": t.column("key"), "seg": t.column("seg"), "start": pa.array(start, pa.int64()), "go": pa.array(out[::-1], pa.list_(pa.int64())), "last": pa.array([k == len(n) - 1 for k in range(len(n))])})

    def leaves(t: pa.Table) -> pa.Table:
        go, roles = t.column("go")[0].as_py(), _roles(t)
        return pa.table({"key": t.column("key")[:1], "seg": t.column("seg")[:1], "leave": pa.array([[walk(roles, s, go, ways)[1] for s in range(4)]], pa.list_(pa.int32()))})

    def enters(t: pa.Table) -> pa.Table:
        t = t.sort_by("seg")
        state, out = NONE, []
        for leave in t.column("leave").to_pylist():
            out.append(state)
            state = leave[state]
        return pa.table({"key": t.column("key"), "seg": t.column("seg"), "enter": pa.array(out, pa.int32())})

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("turn_no")
        turns = list(zip(*(t.column(c).to_pylist() for c in ("turn", "role", "rendered")), strict=True))
        one = lambda c: t.column(c)[0].as_py()
        return pa.Table.from_batches([_batch(_solved(one("conv_id"), turns, one("start"), one("enter"), one("go"), one("last"), ways))])

    slim = raw.select("key", "seg", "turn_no", "role")
    plan = scratch.save(slim.groupBy("key", "seg").applyInArrow(matrix, "key string, seg int, n long, m array<long>").groupBy("key").applyInArrow(behind, "key string, seg int, start long, go array<long>, last boolean"), "plan")
    left = slim.join(plan.select("key", "seg", "go"), ["key", "seg"]).groupBy("key", "seg").applyInArrow(leaves, "key string, seg int, leave array<int>")
    entered = scratch.save(left.groupBy("key").applyInArrow(enters, "key string, seg int, enter int"), "entered")
    rest = raw.join(plan, ["key", "seg"]).join(entered, ["key", "seg"]).groupBy("key", "seg").applyInArrow(solve, OUT)
    return passed.where("seg < 0").drop("seg").unionByName(rest)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def _sql(costs: Costs = Costs()) -> str:
    """The same in DuckDB: costs-to-go by recursion from the last turn, then the first cheapest way from the first."""
    way = lambda w: f"{{'c': {w[0]}, 'n': {w[1]}, 'm': {str(w[2]).lower()}, 'p': {[ROLES[r] for r in w[3]]}::VARCHAR[]}}"
    rows = ", ".join(f"({role}, [{', '.join('[' + ', '.join(map(way, ways)) + ']' for ways in by_state)}])" for role, by_state in enumerate(choices(costs)))
    tails = ", ".join(f"{[ROLES[r] for r in closing(s)]}::VARCHAR[]" for s in range(4))
    pick = "list_filter(c.ways[{0} + 1], lambda w: w.c + b1.v[w.n + 1] = b0.v[{0} + 1])[1]"
    empties = "array_to_string(list_transform({0}, lambda r: '<|' || r || '|>' || chr(10) || '<|end|>' || chr(10)), '')"
    return f"""
WITH RECURSIVE ways_(code, ways) AS (VALUES {rows}),
c0 AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS safe, count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM conversations),
c AS (SELECT c0.*, ways FROM c0 JOIN ways_ ON code = CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 0 END),
back(conv_id, k, v) AS (SELECT DISTINCT conv_id, n + 1, {end_costs(costs)} FROM c
    UNION ALL SELECT c.conv_id, c.k, list_transform([1, 2, 3, 4], lambda s: list_min(list_transform(c.ways[s], lambda w: w.c + b.v[w.n + 1]))) FROM back b JOIN c ON c.conv_id = b.conv_id AND c.k = b.k - 1),
walk(conv_id, k, state, way) AS (SELECT c.conv_id, c.k, 0, {pick.format("0")} FROM c JOIN back b0 ON b0.conv_id = c.conv_id AND b0.k = 1 JOIN back b1 ON b1.conv_id = c.conv_id AND b1.k = 2 WHERE c.k = 1
    UNION ALL SELECT c.conv_id, c.k, x.way.n, {pick.format("x.way.n")} FROM walk x JOIN c ON c.conv_id = x.conv_id AND c.k = x.k + 1 JOIN back b0 ON b0.conv_id = c.conv_id AND b0.k = c.k JOIN back b1 ON b1.conv_id = c.conv_id AND b1.k = c.k + 1),
r AS (SELECT c.*, state, way, {list(ROLES)}[way.n + 1] AS new_role, CASE WHEN c.k = n THEN [{tails}][way.n + 1] ELSE [] END AS tail FROM walk JOIN c USING (conv_id, k))
SELECT conv_id, turn, k - 1 AS turn_no, role, new_role, CASE WHEN way.m THEN 'merge' WHEN len(way.p) > 0 THEN 'insert' ELSE 'keep' END || CASE WHEN role IS DISTINCT FROM new_role THEN '+relabel' ELSE '' END AS action,
    (len(way.p) + len(tail))::INTEGER AS n_inserted,
    CASE WHEN way.m THEN chr(10) || safe ELSE CASE WHEN state = 0 THEN '' ELSE '<|end|>' || chr(10) END || {empties.format("way.p")} || '<|' || new_role || '|>' || chr(10) || safe END
      || CASE WHEN k = n THEN '<|end|>' || chr(10) || {empties.format("tail")} ELSE '' END AS rendered,
    (way.c + CASE WHEN k = n THEN {end_costs(costs)}[way.n + 1] ELSE 0 END)::BIGINT AS cost
FROM r
"""


OP4_SQL = _sql()
