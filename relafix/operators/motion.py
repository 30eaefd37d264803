"""Code motion: where expressions are computed earliest and latest without needless work.

The published equations of busy and lazy code motion, one statement a node.  Each
predicate that must hold on all paths is derived by its complement, so every
relation is a plain closure over edges.  Edges from a branch into a join are to be
split beforehand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relafix.operators.fixpoint import Relations, fixpoint
from relafix.storage import counted_table, cut, stage_table

_CELL = ["method", "node", "expr"]
#: Rounds for all methods together; those that go on are closed apart.
_EARLY = 8
#: Ways of longer and longer hops are joined up to so many rows, or sixteen times the edges.
_WAYS = 1_000_000


@dataclass
class Motion:
    """Relations ``method, node, expr`` over the nodes that the entries reach."""

    up_safe: DataFrame
    down_safe: DataFrame
    earliest: DataFrame
    delayable: DataFrame
    latest: DataFrame
    isolated: DataFrame
    insert: DataFrame
    replace: DataFrame


def _over(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` one edge of ``edges(method, node, to)`` on; other columns are kept."""
    on = rows.join(edges, ["method", "node"])
    return on.select("method", F.col("to").alias("node"), *[c for c in rows.columns if c not in ("method", "node")])


def _closed(seeds: DataFrame, hop: Callable[[DataFrame], DataFrame], cells: DataFrame) -> DataFrame:
    """What ``hop`` reaches from ``seeds``, both within ``cells``; it moves ``node`` within a method and keeps other columns.

    Most methods end within a few rounds. A long one would add a round for each of its statements, and each round would read the
    cells of all methods again; so what goes on is taken out, its ways are doubled while they are few, and rounds go along these.
    """
    seen = {"rounds": 0}

    def early(delta: Relations) -> bool:
        seen.update(rounds=seen["rounds"] + 1, last=delta["r"])
        return seen["rounds"] > _EARLY

    found = fixpoint({"r": seeds}, lambda known, delta: {"r": hop(delta["r"])}, stop=early)["r"]
    if seen["rounds"] <= _EARLY:
        return found
    active = stage_table(seen["last"].select("method").distinct(), "active", plain=True)
    same = [c for c in cells.columns if c != "node"]

    def along(rows: DataFrame, ways: DataFrame) -> DataFrame:
        """``rows`` at the ends of ``ways`` from where they are; nulls compare as equal."""
        x, y = rows.alias("x"), ways.alias("y")
        on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in same] + [F.col("x.node") == F.col("y.start")]
        return x.join(y, on).select("y.node", *[f"x.{c}" for c in rows.columns if c != "node"])

    few = cells.join(active, "method", "left_semi")
    ways, n = counted_table(hop(few.withColumn("start", F.col("node"))).distinct(), "ways")
    limit, longer = max(_WAYS, 16 * n), 0
    while n <= limit:
        twice, longer = counted_table(ways.unionByName(along(ways, ways)).distinct(), "ways")
        if longer == n:
            break
        ways, n = twice, longer
    rest = fixpoint({"r": found.join(active, "method", "left_semi")}, lambda known, delta: {"r": along(delta["r"], ways)})["r"]
    return found.join(active, "method", "left_anti").unionByName(rest)


def code_motion(cfg: DataFrame, entry: DataFrame, computed: DataFrame, changed: DataFrame) -> Motion:
    """All predicates for the expressions of each method.

    ``computed`` and ``changed`` have ``method, node, expr``; a node computes before it
    changes an operand.  ``insert`` are nodes before which a temporary is filled,
    ``replace`` the computations that read it.
    """
    entry = entry.select("method", "node").distinct()
    ahead = cut(cfg.select("method", F.col("src").alias("node"), F.col("dst").alias("to")).distinct())
    reached = _closed(entry, lambda rows, edges=ahead: _over(edges, rows), ahead.select("method", "node").distinct())
    ahead = cut(ahead.join(reached, ["method", "node"], "left_semi"))
    back = ahead.select("method", F.col("to").alias("node"), F.col("node").alias("to"))
    exprs = computed.select("method", "expr").distinct()
    cells = cut(reached.join(exprs, "method").select(*_CELL))
    comp = cut(cells.join(computed, _CELL, "left_semi"))
    kill = cut(cells.join(changed, _CELL, "left_semi"))

    def after(rows: DataFrame, edges: DataFrame) -> DataFrame:
        """Cells one edge on."""
        return _over(edges, rows).distinct()

    def without(rows: DataFrame) -> DataFrame:
        return cells.join(rows, _CELL, "left_anti")

    def onward(seeds: DataFrame, edges: DataFrame, stops: DataFrame) -> DataFrame:
        """Cells reached from ``seeds``; those of ``stops`` are reached and lead no further."""
        return _closed(seeds, lambda rows: _over(edges, rows.join(stops, _CELL, "left_anti")), cells)

    def around(seeds: DataFrame, edges: DataFrame, blocked: DataFrame) -> DataFrame:
        """Cells reached from ``seeds``, none of them ``blocked``."""
        return _closed(seeds.select(*_CELL).join(blocked, _CELL, "left_anti"), lambda rows: _over(edges, rows).join(blocked, _CELL, "left_anti"), cells)

    first = cells.join(entry, ["method", "node"], "left_semi")
    last = cells.join(ahead, ["method", "node"], "left_anti")
    # a path that has not computed the expression since its last change
    open_up = cut(first.union(after(kill, ahead)).distinct())
    through = comp.join(kill, _CELL, "left_anti")
    up = cut(without(onward(open_up, ahead, through)))
    down = cut(without(around(last.union(kill), back, comp)))
    unsafe = cut(kill.union(without(up.union(down))).distinct())
    earliest = cut(down.join(first.union(after(unsafe, ahead)).distinct(), _CELL, "left_semi"))
    delayable = cut(without(around(first.union(after(comp, ahead)), ahead, earliest)))
    latest = cut(delayable.join(comp.union(after(without(delayable), back)).distinct(), _CELL, "left_semi"))
    needed = after(comp.join(latest, _CELL, "left_anti"), back)
    isolated = cut(without(onward(needed, back, latest)))
    alone = latest.join(isolated, _CELL, "left_semi")
    insert = latest.join(isolated, _CELL, "left_anti")
    return Motion(up, down, earliest, delayable, latest, isolated, insert, comp.join(alone, _CELL, "left_anti"))
