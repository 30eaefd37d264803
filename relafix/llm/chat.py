"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

A conversation is legal if an automaton accepts its roles: an optional system
turn, then user and assistant in turn, the assistant last.  A turn may be kept,
relabelled, or merged into the turn before it, and empty turns may be put in.
Dynamic programming over the automaton's states finds the repair of least cost.

The step of one turn is a (state x state) matrix of costs, and steps compose by
(min, +) products, so a conversation may be cut anywhere.  Turns are sorted by
range; every partition reduces its stretch of a conversation to one matrix, the few
stretches of conversations that span partitions are chained, and each partition
then traces its own stretch back between the states it is given.  A conversation
that holds a third of all turns is as parallel as the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relafix.storage import cut

ROLES = ("system", "user", "assistant")
#: state -> roles that may follow; a state is 0 (nothing yet) or 1 + the last role's place in ROLES
_NEXT = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
_STATES, _END = 4, 3
_INF = 1 << 40
MERGE_COST, RELABEL_COST, INSERT_COST = 1, 2, 3
_RANK = {"keep": 0, "merge": 1, "relabel": 2}


@dataclass(frozen=True)
class Action:
    """What happens at one turn: empty turns put in first, then the turn itself."""

    cost: int
    inserts: tuple[int, ...]
    kind: str
    role: int

    @property
    def order(self) -> tuple:
        return (self.cost, len(self.inserts), _RANK[self.kind], self.inserts, self.role)

    @property
    def turns(self) -> int:
        return len(self.inserts) + (self.kind != "merge")


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest (then smallest) row of empty turns between two states."""
    best: dict[tuple[int, int], tuple[int, ...]] = {(s, s): () for s in range(_STATES)}
    frontier = dict(best)
    while frontier:
        longer = {}
        for (s, t), path in frontier.items():
            for role in _NEXT[t]:
                key = (s, role + 1)
                if key not in best and (key not in longer or path + (role,) < longer[key]):
                    longer[key] = path + (role,)
        best |= longer
        frontier = longer
    return best


_INSERT = _insertions()


def _actions(role: int) -> dict[tuple[int, int], Action]:
    """The best action between two states at a turn of ``role`` (3: none of ROLES)."""
    found: dict[tuple[int, int], Action] = {}
    for s in range(_STATES):
        options = []
        if s:
            options.append((s, Action(MERGE_COST + (0 if s - 1 == role else RELABEL_COST), (), "merge", s - 1)))
        for (start, mid), path in _INSERT.items():
            if start == s:
                for q in _NEXT[mid]:
                    options.append((q + 1, Action(INSERT_COST * len(path) + (0 if q == role else RELABEL_COST), path, "keep" if q == role else "relabel", q)))
        for t, action in options:
            if (s, t) not in found or action.order < found[s, t].order:
                found[s, t] = action
    return found


_STEP = [_actions(r) for r in range(len(ROLES) + 1)]


def role_number(role: str | None) -> int:
    """Place in ROLES, whatever the case and the blanks around; 3 for null and unknown roles."""
    name = role.strip().lower() if isinstance(role, str) else ""
    return ROLES.index(name) if name in ROLES else len(ROLES)


def solve(roles: list[int], entry: int) -> tuple[list[int], list[list[int]]]:
    """Least cost of each exit state from ``entry``, and for each turn the state before it."""
    cost, back = [_INF] * _STATES, []
    cost[entry] = 0
    for role in roles:
        now, came = [_INF] * _STATES, [-1] * _STATES
        for (s, t), action in _STEP[role].items():
            if cost[s] + action.cost < now[t]:
                now[t], came[t] = cost[s] + action.cost, s
        cost = now
        back.append(came)
    return cost, back


def trace(roles: list[int], back: list[list[int]], leave: int) -> list[Action]:
    state, out = leave, []
    for role, came in zip(reversed(roles), reversed(back), strict=True):
        out.append(_STEP[role][came[state], state])
        state = came[state]
    return out[::-1]


def _closing(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and empty turns that end a conversation after ``state``."""
    path = () if state == 0 else _INSERT[state, _END]
    return INSERT_COST * len(path), path


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one conversation at a time; a null id is a conversation of its own."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        ids = batch["conv_id"]
        same = (ids == ids.shift()) | (ids.isna() & ids.shift().isna())
        starts = [0, *[i for i, s in enumerate(same.to_numpy(bool)) if i and not s]]
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            part = batch.iloc[a:b]
            if held:
                x, y = held[0]["conv_id"].iloc[0], part["conv_id"].iloc[0]
                if not (x == y or (pd.isna(x) and pd.isna(y))):
                    yield pd.concat(held)
                    held = []
            held.append(part)
    if held:
        yield pd.concat(held)


_PAIRS = list(product(range(_STATES), repeat=2))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each partition its first and last stretch: costs, turns and pieces by entry and exit state."""
    first = last = None
    for part in _stretches(batches):
        first, last = (part if first is None else first), part
    for place, part in enumerate([first] if first is last else [first, last]):
        if part is None:
            continue
        roles = [role_number(r) for r in part["role"]]
        costs, turns, pieces = [_INF] * 16, [0] * 16, [0] * 16
        for s in range(_STATES):
            cost, back = solve(roles, s)
            for t in range(_STATES):
                if cost[t] < _INF:
                    way = trace(roles, back, t)
                    costs[4 * s + t], turns[4 * s + t] = cost[t], sum(a.turns for a in way)
                    pieces[4 * s + t] = len(way) + sum(len(a.inserts) for a in way)
        yield pd.DataFrame({"pid": [part["pid"].iloc[0]], "place": [place], "conv_id": [part["conv_id"].iloc[0]], "costs": [costs], "turns": [turns], "pieces": [pieces]})


def _chain(rows: list) -> dict[tuple[int, int], tuple[int, int, int, int, bool]]:
    """(entry, exit, first turn, first piece, is last) for the stretches of conversations that span partitions.

    ``rows`` are at most two per partition, so this is small whatever the data.
    """
    by_conv: dict = {}
    for r in sorted(rows, key=lambda r: (r["pid"], r["place"])):
        by_conv.setdefault(r["conv_id"], []).append(r)
    out = {}
    for parts in by_conv.values():
        cost, came = [0, _INF, _INF, _INF], []
        for r in parts:
            now, before = [_INF] * _STATES, [-1] * _STATES
            for s, t in _PAIRS:
                if cost[s] + r["costs"][4 * s + t] < now[t]:
                    now[t], before[t] = cost[s] + r["costs"][4 * s + t], s
            cost = now
            came.append(before)
        state = min(range(_STATES), key=lambda t: (cost[t] + _closing(t)[0], t))
        ways = []
        for before in reversed(came):
            ways.append((before[state], state))
            state = before[state]
        turn = piece = 0
        for i, (r, (s, t)) in enumerate(zip(parts, reversed(ways), strict=True)):
            out[r["pid"], r["place"]] = (s, t, turn, piece, i == len(parts) - 1)
            turn, piece = turn + r["turns"][4 * s + t], piece + r["pieces"][4 * s + t]
    return out


def _escape(text: str | None) -> str:
    return text.replace("<|", "<\\|") if isinstance(text, str) else ""


_OUT = "conv_id string, seq long, repaired_turn long, turn string, role string, original_role string, action string, cost int, rendered string"


def repair_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each piece of the repaired conversations, put together in order of ``seq``.

    ``conv_id, seq, repaired_turn, turn, role, original_role, action, cost,
    rendered``: ``action`` is keep, merge, relabel or insert (then ``turn`` and
    ``original_role`` are null); the costs of a conversation add up to the least
    possible; the ``rendered`` pieces of a conversation, joined in order, are its
    text in ``<|im_start|>role ... <|im_end|>`` form, with ``<|`` inside texts broken
    by a backslash.

    Turns are ordered by turn (null first), then role and a hash of the text, so
    ties and repeated rows have a place each.  Null conversation ids form one
    conversation, null and unknown roles have to be relabelled or merged, null
    texts are empty.  Ids and turns must be integers.  An empty table gives an
    empty result; other columns are not looked at.
    """
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("tie")]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()).drop("tie"))
    # numbers travel as text: a batch with a null would turn integers to floats
    rows = rows.withColumn("conv_id", F.col("conv_id").cast("string")).withColumn("turn", F.col("turn").cast("string"))
    schema = "pid int, place int, conv_id string, costs array<long>, turns array<long>, pieces array<long>"
    spans = _chain(rows.select("conv_id", "role", "pid").mapInPandas(_summaries, schema).collect())  # two rows per partition

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the last stretch is known as such only when nothing follows
        before = None
        place = 0
        for part in _stretches(batches):
            if before is not None:
                yield pieces(before, spans.get((int(before["pid"].iloc[0]), 0)) if place == 0 else None)
                place += 1
            before = part
        if before is not None:
            yield pieces(before, spans.get((int(before["pid"].iloc[0]), min(1, place))))

    def pieces(part: pd.DataFrame, span) -> pd.DataFrame:
        roles = [role_number(r) for r in part["role"]]
        cost, back = solve(roles, span[0] if span else 0)
        entry, leave, turn, seq, last = span or (0, min(range(_STATES), key=lambda t: (cost[t] + _closing(t)[0], t)), 0, 0, True)
        out = []
        turn -= 1

        def put(original, action: str, role: int, price: int, text: str) -> None:
            nonlocal turn, seq
            head = ""
            if action != "merge":
                turn += 1
                head = ("<|im_end|>\n" if turn else "") + f"<|im_start|>{ROLES[role]}\n"
            elif text:
                head = "\n"
            out.append((part["conv_id"].iloc[0], seq, turn, *original, action, price, ROLES[role], head + text))
            seq += 1

        for number, role, text, action in zip(part["turn"], part["role"], part["text"], trace(roles, back, leave), strict=True):
            for q in action.inserts:
                put((None, None), "insert", q, INSERT_COST, "")
            put((number, role), action.kind, action.role, action.cost - INSERT_COST * len(action.inserts), _escape(text))
        if last:
            for q in _closing(leave)[1]:
                put((None, None), "insert", q, INSERT_COST, "")
            out[-1] = (*out[-1][:-1], out[-1][-1] + "<|im_end|>\n")
        table = pd.DataFrame(out, columns=["conv_id", "seq", "repaired_turn", "turn", "original_role", "action", "cost", "role", "rendered"])
        return table[[f.split()[0] for f in _OUT.split(", ")]]

    out = rows.mapInPandas(emit, _OUT)
    return out.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))
