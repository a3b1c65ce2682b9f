"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, parts

#: Automaton states: nothing yet, or the role of the open turn. A conversation ends on an assistant turn.
ROLES = ("", "system", "user", "assistant", "tool")
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2, 4), 4: (3,)}
FINAL = 3
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "function": "tool"}
MERGE, RELABEL, INSERT = 1, 2, 3
#: Distinct turn numbers of a chunk, and chunks of a higher one.
CHUNK, FAN = 1024, 1024
#: Turns of a chunk, as many of one number make it, beyond which it is dealt into parts of CHUNK turns.
TIED = 8 * CHUNK
INF = np.int64(1 << 40)


def _insertions() -> np.ndarray:
    """Least number of empty turns that lead from one state to another."""
    d = np.full((5, 5), INF)
    np.fill_diagonal(d, 0)
    for s, to in LEGAL.items():
        d[s, list(to)] = 1
    for k in range(5):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d


INSERTED = _insertions()


def role_index(role: str | None) -> int:
    """0 for null or an unknown role: it becomes any role at the cost of a relabel."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else 0


def _step(role: int) -> tuple[np.ndarray, np.ndarray]:
    """Cost of a turn of ``role`` from state s to state t, and the state after the inserted turns (-1: the
    turn is merged into the open one). Of equal costs, the fewer insertions and then no merge."""
    cost, via = np.full((5, 5), INF), np.full((5, 5), -1)
    for s in range(5):
        for t in range(1, 5):
            change = 0 if role == t else RELABEL
            options = [(INSERT * int(INSERTED[s, p]) + change, int(INSERTED[s, p]), p) for p in range(5) if t in LEGAL[p] and INSERTED[s, p] < INF]
            if s == t:
                options.append((MERGE + change, 0, 9))
            if options:
                best = min(options)
                cost[s, t], via[s, t] = best[0], best[2] if best[2] < 9 else -1
    return cost, via


STEPS = [_step(r) for r in range(5)]
#: Cost of ending in each state: insertions up to an assistant turn; an empty conversation may end at once.
ENDING = np.array([0, *(INSERT * INSERTED[s, FINAL] for s in range(1, 5))])


def forward(start: np.ndarray, roles: list[int]) -> list[np.ndarray]:
    """Least cost of each state before each turn and after the last."""
    out = [start]
    for r in roles:
        out.append(np.minimum((out[-1][:, None] + STEPS[r][0]).min(0), INF))
    return out


def backward(costs: list[np.ndarray], roles: list[int], end: int) -> list[int]:
    """The states of the cheapest way to ``end``; of equal ways, the smallest earlier state."""
    states = [end]
    for cost, r in zip(costs[-2::-1], roles[::-1]):
        states.append(int((cost + STEPS[r][0][:, states[-1]]).argmin()))
    return states[::-1]


def product(roles: list[int]) -> np.ndarray:
    """Least cost from each state to each over ``roles``, as a min-plus matrix."""
    m = np.where(np.eye(5, dtype=bool), 0, INF)
    for r in roles:
        m = np.minimum((m[:, :, None] + STEPS[r][0][None]).min(1), INF)
    return m


def _route(s: int, p: int) -> list[int]:
    """The states on the shortest way of insertions from ``s`` to ``p``, without ``s``."""
    out = []
    while s != p:
        s = min(t for t in LEGAL[s] if INSERTED[t, p] == INSERTED[s, p] - 1)
        out.append(s)
    return out


def escaped(text: str) -> str:
    """``text`` without control tokens of its own: each ``<|`` gets a backslash between, and one more for each
    that stands there, so that ``unescaped`` gives the text back and no turn can forge another."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _open(role: int, text: str, state: int) -> str:
    return ("<|end|>\n" if state else "") + f"<|{ROLES[role]}|>\n" + text


def render(roles: list[int], texts: list[str], states: list[int], last: bool) -> list[tuple[str, str, int, str]]:
    """(new role, action, turns inserted, piece) of each turn; the pieces in order are the rendering."""
    out = []
    for r, text, s, t in zip(roles, texts, states, states[1:]):
        via = int(STEPS[r][1][s, t])
        action = ("" if r == t else "relabel") if via >= 0 else ("merge" if r == t else "relabel_merge")
        if via < 0:
            out.append((ROLES[t], action, 0, "\n" + text))
            continue
        piece, inserted = "", _route(s, via)
        for p in inserted:
            piece += _open(p, "", s)
            s = p
        out.append((ROLES[t], action or "keep", len(inserted), piece + _open(t, text, s)))
    if last and out:
        role, action, n, piece = out[-1]
        state, closing = states[-1], _route(states[-1], FINAL)
        for p in closing:
            piece += _open(p, "", state)
            state = p
        out[-1] = (role, action, n + len(closing), piece + "<|end|>\n")
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return ((k, list(g)) for k, g in groupby(rows, lambda r: r[:keys]))


def _streamed(df: DataFrame, keys: list[str], order: list[str], run, ddl: str) -> DataFrame:
    return df.repartition(parts(df.sparkSession), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])


def _emit(groups, make, ddl: str, size: int = 5000) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for key, group in groups:
        rows += make(key, group)
        if len(rows) >= size:
            yield _batch(rows, ddl)
            rows = []
    yield _batch(rows, ddl)


_RESOLVED = "conv_id long, chunk long, part long, start int, end int, last boolean"
_MATRIX = "conv_id long, chunk long, part long, m array<long>"


def _resolve(matrices: DataFrame) -> DataFrame:
    """For (conv_id, chunk, part, m), each part's states at its start and end on a cheapest way.

    Parts of one conversation are combined in order, FAN at a time: matrices are multiplied upwards
    until a conversation is one group, and start and end are handed down again.
    """
    matrices = materialize(matrices, "chat")
    span = matrices.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def down(items, start, end, last):
        """Start and end of each of ``items`` ((chunk, part), matrix), given those of the whole; end None: any that
        ends the conversation cheaply."""
        costs = [np.where(np.arange(5) == start, 0, INF)]
        for _, m in items:
            costs.append(np.minimum((costs[-1][:, None] + m).min(0), INF))
        states = [int((costs[-1] + ENDING).argmin()) if end is None else end]
        for cost, (_, m) in zip(costs[-2:0:-1], items[:0:-1]):
            states.append(int((cost + m[:, states[-1]]).argmin()))
        states.append(start)
        states.reverse()
        return [(*c, s, e, bool(last and i == len(items) - 1)) for i, ((c, _), s, e) in enumerate(zip(items, states, states[1:]))]

    matrix = lambda m: np.asarray(m, np.int64).reshape(5, 5)
    if span <= FAN:
        def top(batches):
            make = lambda key, rows: [(key[0], *x) for x in down([(r[1:3], matrix(r[3])) for r in rows], 0, None, True)]
            yield from _emit(_groups(batches, 1), make, _RESOLVED)

        return _streamed(matrices, ["conv_id"], ["chunk", "part"], top, _RESOLVED)

    upper = matrices.withColumn("up", F.floor(F.col("chunk") / FAN))

    def multiply(batches):
        def make(key, rows):
            m = np.where(np.eye(5, dtype=bool), 0, INF)
            for r in rows:
                m = np.minimum((m[:, :, None] + matrix(r[4])[None]).min(1), INF)
            return [(*key, 0, m.ravel().tolist())]

        yield from _emit(_groups(batches, 2), make, _MATRIX)

    above = _resolve(_streamed(upper.select("conv_id", "up", "chunk", "part", "m"), ["conv_id", "up"], ["chunk", "part"], multiply, _MATRIX))
    above = above.drop("part").withColumnRenamed("chunk", "up").withColumnRenamed("conv_id", "c")
    joined = upper.join(above, upper.conv_id.eqNullSafe(above.c) & (upper["up"] == above["up"])).select("conv_id", upper["up"], "chunk", "part", "m", "start", "end", "last")

    def hand_down(batches):
        make = lambda key, rows: [(key[0], *x) for x in down([(r[2:4], matrix(r[4])) for r in rows], rows[0][5], rows[0][6], rows[0][7])]
        yield from _emit(_groups(batches, 2), make, _RESOLVED)

    return _streamed(joined, ["conv_id", "up"], ["chunk", "part"], hand_down, _RESOLVED)


_ROWS = "conv_id long, chunk long, turn long, role string, text string, turn_order long, part long"


def _in_parts(rows: DataFrame) -> DataFrame:
    """Adds ``part``: 0 but in chunks of over TIED turns. Those are dealt by range of turn, role and text, sorted and
    cut into parts of at most CHUNK turns, whose numbers rise in that order; a range that equal turns fill is
    cut as well. Written, as the ranges of a second run need not be the same."""
    crowd = materialize(rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TIED).select(F.col("conv_id").alias("c"), F.col("chunk").alias("k")), "crowd")
    own = rows.conv_id.eqNullSafe(crowd.c) & (rows.chunk == crowd.k)
    single = rows.join(crowd, own, "left_anti").withColumn("part", F.lit(0).cast("long"))
    n, keys = parts(rows.sparkSession), ["conv_id", "chunk", "turn_order", "role"]
    tied = rows.join(crowd, own, "left_semi").withColumn("begins", F.substring("text", 1, 64)).repartitionByRange(n, *keys, "begins").drop("begins").sortWithinPartitions(*keys, "text")

    def number(batches):
        at, k, task = None, 0, TaskContext.get().partitionId()
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                k, at = (k + 1 if r[:2] == at else 0), r[:2]
                out.append((*r, task << 32 | k // CHUNK))
            yield _batch(out, _ROWS)

    return single.unionByName(materialize(tied.mapInArrow(number, _ROWS), "tied"))


_OUT = "conv_id long, chunk long, part long, pos long, turn long, role string, new_role string, action string, n_inserted long, piece string"


def repair(turns: DataFrame) -> DataFrame:
    """A row per turn of (conv_id, turn, role, text): its place (chunk, part, pos), repaired role, what was done
    (keep, merge, relabel, relabel_merge), empty turns inserted around it, and its piece of the rendering.

    The pieces of a conversation in order of chunk, part and pos are its rendering. Turns are ordered by turn
    (null last), role and text, so ties and repeated rows have a defined order; null text is empty; the
    null conv_id is one conversation. A conversation of any length is cut into chunks of CHUNK turn
    numbers, and one of many turns into parts: the costs of each are a matrix, the matrices are combined in
    order, and each then finds its own piece of a cheapest way, between the states that the combination has
    set. Empty tables give no rows; a text of any length is carried whole; other columns are not read.
    """
    late = F.lit(1 << 52)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.floor(F.col("turn") / CHUNK), late).cast("bigint").alias("chunk"), F.col("turn").cast("bigint").alias("turn"), "role", "text")

    def reduce(batches):
        make = lambda key, rows: [(*key, product([role_index(r[4]) for r in rows]).ravel().tolist())]
        yield from _emit(_groups(batches, 3), make, _MATRIX)

    keyed = _in_parts(rows.withColumn("turn_order", F.coalesce("turn", F.lit((1 << 63) - 1))))
    small = keyed.select("conv_id", "chunk", "part", "turn_order", "role")
    resolved = _resolve(_streamed(small, ["conv_id", "chunk", "part"], ["turn_order", "role"], reduce, _MATRIX))
    there = resolved.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.col("part").alias("p"), "start", "end", "last")
    both = keyed.join(there, keyed.conv_id.eqNullSafe(there.c) & (keyed.chunk == there.k) & (keyed.part == there.p)).select("conv_id", "chunk", "part", "turn_order", "role", "text", "turn", "start", "end", "last")

    def finish(batches):
        def make(key, rows):
            roles = [role_index(r[4]) for r in rows]
            costs = forward(np.where(np.arange(5) == rows[0][7], 0, INF), roles)
            states = backward(costs, roles, rows[0][8])
            pieces = render(roles, [escaped(r[5] or "") for r in rows], states, rows[0][9])
            return [(*key, i, r[6], r[4], *p) for i, (r, p) in enumerate(zip(rows, pieces))]

        yield from _emit(_groups(batches, 3), make, _OUT)

    return _streamed(both, ["conv_id", "chunk", "part"], ["turn_order", "role", "text"], finish, _OUT)


def renderings(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): each conversation's whole rendering. A conversation becomes one value here, so
    this is for conversations that fit one; ``repair`` gives the pieces of any."""
    pieces = F.sort_array(F.collect_list(F.struct("chunk", "part", "pos", "piece")))
    whole = F.concat_ws("", F.transform(pieces, lambda p: p["piece"]))
    return repair(turns).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), whole.alias("text"))


def op6(conversations: DataFrame) -> DataFrame:
    return repair(conversations)
