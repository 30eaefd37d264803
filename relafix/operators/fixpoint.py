"""The fixpoint operator: semi-naive evaluation of recursive relations.

Every analysis of this package is a set of step plans over this loop.  A round
joins only the rows that the round before it derived, drops what is known and
stops when nothing new appears.  Each round's new rows are written to the shared
folder, so lineage stays short and a lost executor costs no more than its own tasks.
The tasks that write them count them, and one job writes all relations of a round; as
the size of a written table is known, Spark broadcasts the news of a round by itself where
they are small and shuffles them where they are not.  They are written plainly, so that their size is that of their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relafix.storage import counted_table, counted_tables, empty_table, stage_table

Relations = dict[str, DataFrame]
Step = Callable[[Relations, Relations], Relations]


@dataclass
class RoundLog:
    """Rows derived per round and relation, for tuning and for tests."""

    rows: list[dict[str, int]] = field(default_factory=list)


class NoFixpoint(RuntimeError):
    """The round limit was reached while rows were still being derived."""


def _one_counted(tables: Relations) -> tuple[Relations, dict[str, int]]:
    """``counted_tables`` of a single table, without the columns that tell several apart."""
    ((name, df),) = tables.items()
    table, n = counted_table(df, name)
    return {name: table}, {name: n}


def _seeded(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once; without rows it is a relation that the first rounds need not read."""
    table, n = counted_table(df, name)
    return table if n else empty_table(df.sparkSession, df.schema)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fixpoint(
    seeds: Mapping[str, DataFrame],
    step: Step,
    max_rounds: int = 1000,
    partial: bool = False,
    log: RoundLog | None = None,
    compact_every: int = 8,
    stop: Callable[[Relations], bool] | None = None,
) -> Relations:
    """Least relations that contain ``seeds`` and are closed under ``step``.

    ``step(known, delta)`` returns new rows for any of the relations; it must use
    ``delta`` in every term (a rule with two recursive atoms needs one term per
    atom).  Relations are sets over all their columns.  Null keys match null keys.
    With ``partial`` the relations derived by ``max_rounds`` are returned, else
    reaching that limit raises ``NoFixpoint``.  ``stop`` sees each delta and may
    end the loop early, for "first result" queries.
    """
    known = {name: [_seeded(df.distinct(), name)] for name, df in seeds.items()}
    delta = {name: parts[0] for name, parts in known.items()}
    for number in range(max_rounds):
        if stop is not None and stop(delta):
            break
        derived = step({n: _union(p) for n, p in known.items()}, delta)
        olds = {name: _union(known[name]) for name in derived}
        news = {name: _fresh(rows.select(*olds[name].columns), olds[name]) for name, rows in derived.items()}
        fresh, counts = counted_tables(news) if len(news) > 1 else _one_counted(news)
        if log is not None:
            log.rows.append(counts)
        if not any(counts.values()):
            break
        for name, rows in fresh.items():
            if counts[name]:
                known[name].append(rows)
            if len(known[name]) > compact_every:
                known[name] = [stage_table(_union(known[name]), name, plain=True)]
        delta = {n: fresh[n] if n in fresh else empty_table(df.sparkSession, df.schema) for n, df in delta.items()}
    else:
        if not partial:
            raise NoFixpoint(f"rows still appear after {max_rounds} rounds")
    return {name: _union(parts) for name, parts in known.items()}


def _fresh(rows: DataFrame, old: DataFrame) -> DataFrame:
    """Distinct ``rows`` that are not in ``old``; nulls compare as equal."""
    rows, old = rows.distinct().alias("n"), old.alias("o")
    on = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in rows.columns])
    return rows.join(old, on, "left_anti")


def by_source(edges: DataFrame) -> DataFrame:
    """``src, dst`` written once, so that rounds do not derive them again and Spark knows their size."""
    return stage_table(edges.select("src", "dst"), "edges", plain=True)


def closure(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``node`` values reachable from ``seeds(node)`` over ``edges(src, dst)``, seeds included."""
    edges = by_source(edges)

    def step(known: Relations, delta: Relations) -> Relations:
        return {"reach": delta["reach"].join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))}

    return fixpoint({"reach": seeds.select("node")}, step, max_rounds)["reach"]
