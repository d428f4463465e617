"""Least-cost repair of the roles in conversations, then rendering.

A legal conversation is an optional system turn, then user and assistant in
turn, ending with the assistant. Every turn is kept, relabelled, or merged
into the turn before (relabelled where its role differs), and empty turns are
inserted where the automaton needs them. A turn is thus a small matrix of
costs from state to state, and a conversation their product in (min, +),
which is associative: a long conversation is cut into segments, the segments'
matrices are multiplied, and each segment is then repaired by itself between
the states the product has chosen for its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import batches, narrow
from corpusbench.session import materialize

#: States: nothing yet, then the role of the last turn.
STATES = ("", "system", "user", "assistant")
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = "assistant"
KEEP, MERGE, INSERT, RELABEL, UNKNOWN = 0, 1, 2, 3, 1
NEVER = 10**15
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


@cache
def inserted(a: str, b: str) -> tuple[str, ...] | None:
    """Fewest empty turns between state a and a turn of role b."""
    paths = [(a,)]
    for _ in STATES:
        if found := next((p for p in paths if b in NEXT[p[-1]]), None):
            return found[1:]
        paths = [(*p, n) for p in paths for n in NEXT[p[-1]]]
    return None


@cache
def step(role: str) -> tuple[tuple[int, int, int, str], ...]:
    """Ways of a turn of this role: (from, to, cost, action), dearer ones and later states last."""
    ways = []
    for i, a in enumerate(STATES):
        for j, b in enumerate(STATES[1:], 1):
            change = KEEP if role == b else RELABEL if role in STATES[1:] else UNKNOWN
            name = "keep" if role == b else "relabel"
            if (gap := inserted(a, b)) is not None:
                ways.append((i, j, change + INSERT * len(gap), name))
            if i == j:
                ways.append((i, j, change + MERGE, "merge"))
    best: dict[tuple[int, int], tuple] = {}
    for w in ways:
        if w[:2] not in best or w[2] < best[w[:2]][2]:
            best[w[:2]] = w
    return tuple(best.values())


def known(role: str | None) -> str:
    role = (role or "").strip().lower()
    return role if role in STATES[1:] else "?"


def ending(state: int) -> tuple[str, ...]:
    """Empty turns needed to end in this state."""
    return () if STATES[state] == FINAL else (*(inserted(STATES[state], FINAL) or ()), FINAL)


def advance(costs: list[int], role: str) -> tuple[list[int], list[int]]:
    """Least costs after a turn, and from which state each comes."""
    out, back = [NEVER] * len(STATES), [0] * len(STATES)
    for i, j, cost, _ in step(role):
        if costs[i] + cost < out[j]:
            out[j], back[j] = costs[i] + cost, i
    return out, back


def matrix(roles: list[str]) -> list[int]:
    """Costs from each state to each over a run of turns, row by row."""
    rows = []
    for i in range(len(STATES)):
        costs = [NEVER] * len(STATES)
        costs[i] = 0
        for r in roles:
            costs, _ = advance(costs, r)
        rows += costs
    return rows


def ends(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """The states at both ends of each segment on the least path from nothing to a legal end."""
    n, costs, backs = len(STATES), [0] + [NEVER] * (len(STATES) - 1), []
    for m in matrices:
        ways = [min((costs[i] + m[i * n + j], i) for i in range(n)) for j in range(n)]
        costs, back = [w[0] for w in ways], [w[1] for w in ways]
        backs.append(back)
    state = min(range(1, n), key=lambda j: (costs[j] + INSERT * len(ending(j)), j))
    out = []
    for back in reversed(backs):
        out.append((back[state], state))
        state = back[state]
    return out[::-1]


def repair(roles: list[str], begin: int, end: int) -> list[tuple[int, int]]:
    """The states before and after each turn on the least path between two states."""
    costs = [NEVER] * len(STATES)
    costs[begin] = 0
    backs = []
    for r in roles:
        costs, back = advance(costs, r)
        backs.append(back)
    path = []
    for back in reversed(backs):
        path.append((back[end], end))
        end = back[end]
    return path[::-1]


def escaped(text: str | None) -> str:
    """A text that cannot be taken for the template's own marks."""
    return (text or "").replace("<|im_", "<| im_")


def render(rows: list[tuple], path: list[tuple[int, int]], first: bool, last: bool, before: int) -> Iterator[tuple]:
    """Output rows of a segment: place, source turn, role read, role, action, cost, rendered piece."""
    opened = not first

    def piece(role: str, text: str) -> str:
        nonlocal opened
        out = (f"{CLOSE}\n" if opened else "") + f"{OPEN}{role}\n{text}"
        opened = True
        return out

    for k, ((turn, role, text), (a, b)) in enumerate(zip(rows, path, strict=True)):
        way = next(w for w in step(known(role)) if w[:2] == (a, b))
        place, content = (before + k) * 4, escaped(text)
        if way[3] == "merge":
            yield place + 2, turn, role, STATES[b], "merge", way[2], "\n" + content
        else:
            gap = inserted(STATES[a], STATES[b])
            for x, empty in enumerate(gap):
                yield place + x, None, None, empty, "insert", INSERT, piece(empty, "")
            yield place + 2, turn, role, STATES[b], way[3], way[2] - INSERT * len(gap), piece(STATES[b], content)
    if last and rows:
        for x, empty in enumerate(ending(path[-1][1])):
            yield (before + len(rows)) * 4 + x, None, None, empty, "insert", INSERT, piece(empty, "")
        yield (before + len(rows)) * 4 + 3, None, None, STATES[path[-1][1]] if not ending(path[-1][1]) else FINAL, "close", 0, f"{CLOSE}\n"


OUT = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role_read", pa.string()), ("role", pa.string()),
                 ("action", pa.string()), ("cost", pa.int64()), ("rendered", pa.string())])
OUT_DDL = "conv_id long, place long, turn long, role_read string, role string, action string, cost long, rendered string"


def runs(parts: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the first ``key`` columns, over batch ends."""
    at, rows = None, []
    for part in parts:
        for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
            if row[:key] != at:
                if rows:
                    yield at, rows
                at, rows = row[:key], []
            rows.append(row)
    if rows:
        yield at, rows


def repair_conversations(turns: DataFrame, *, parts: int | None = None) -> DataFrame:
    """Legal, rendered conversations: one row per turn read, per turn inserted and per closing mark.

    Columns: conv_id, place (order in the conversation), turn, role_read,
    role (after repair), action (keep, relabel, merge, insert, close), cost,
    rendered; the pieces of a conversation in order of place are its text.
    Rows are ordered by turn, then role, then text, nulls first. Null conv_id:
    one conversation. Null or unknown role: relabelled at a low cost. Null
    text: empty. Repeated rows: turns of their own. Empty table: no rows. Of
    equal repairs, that with the earlier state is taken. Other columns are
    not read.

    The order is that of a range partition over all these columns, so a hot
    conversation lies in several parts; no task holds more than one part of it.
    """
    keys = ["conv_id", "turn", "role", "text"]
    base = narrow(turns, *keys)
    dealt = base.repartitionByRange(parts, *keys) if parts else base.repartitionByRange(*keys)
    ordered = dealt.sortWithinPartitions(*keys).withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "turns-in-order")

    def measure(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((conv, part, len(run), matrix([known(r[3]) for r in run])) for (conv, part), run in runs(batch, 2))
        yield from batches(rows, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("m", pa.list_(pa.int64()))]))

    by_segment = ordered.select("conv_id", "part", "seq", "role").repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seq")
    segments = by_segment.mapInArrow(measure, "conv_id long, part int, n long, m array<long>")

    def choose(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, run in runs(batch, 1):
                before = 0
                for k, ((conv, part, n, _), (a, b)) in enumerate(zip(run, ends([r[3] for r in run]), strict=True)):
                    yield conv, part, before, a, b, k == 0, k == len(run) - 1
                    before += n

        yield from batches(rows(), pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("a", pa.int32()),
                                              ("b", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())]))

    # a conversation has at most one segment per part, so a run here is no longer than the number of parts
    chosen = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        choose, "conv_id long, part int, before long, a int, b int, first boolean, last boolean")
    chosen = materialize(chosen, "turn-segments").withColumnsRenamed({"conv_id": "c", "part": "p"})
    joined = ordered.join(chosen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))

    def finish(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv, _), run in runs(batch, 2):
                before, a, b, first, last = run[0][6:]
                path = repair([known(r[4]) for r in run], a, b)
                for row in render([(r[3], r[4], r[5]) for r in run], path, first, last, before):
                    yield conv, *row

        yield from batches(rows(), OUT, 1024)

    whole = joined.select("conv_id", "part", "seq", "turn", "role", "text", "before", "a", "b", "first", "last")
    return whole.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(finish, OUT_DDL)


def conversation_costs(repaired: DataFrame) -> DataFrame:
    """Per conversation: turns read, total cost, and the number of each repair."""
    count = lambda a: F.count(F.when(F.col("action") == a, 1)).alias(f"n_{a}")
    return repaired.groupBy("conv_id").agg(F.sum("cost").alias("cost"), count("keep"), count("relabel"), count("merge"), count("insert"))
