"""Values that locals carry through a whole program along paths that return to their own caller.

Types of new objects, definitions, literals, sources of sensitive data or "not yet
set" are all payloads: they are born at a statement and go unchanged through copies,
arguments and results.  Summaries say which parameter may end up in which result of a
method, once for all callers; payloads then move over calls by them.  A payload born
in a method or below it returns to every caller, one that came in by a call returns
by the summary only, so no path leaves a method to a caller that it did not come from.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relafix.operators.fixpoint import Relations, fixpoint
from relafix.storage import cut


@dataclass
class Program:
    """A program as tables; nodes are unique over all methods.

    ``edges(src, dst)`` inside methods, from a call to where it goes on as well;
    ``starts(method, node)``, ``exits(method, node)``; ``defs(node, local)`` writes, a
    call's own result included; ``copies(node, local, source)``; ``arguments(node, callee,
    arg, param)``; ``results(node, callee, value, local)``, where ``value`` is the callee's
    local that it returns.
    """

    edges: DataFrame
    starts: DataFrame
    exits: DataFrame
    defs: DataFrame
    copies: DataFrame
    arguments: DataFrame
    results: DataFrame


def _staged(p: Program) -> Program:
    """The same tables, written once, so that rounds do not derive them again."""
    return Program(**{f.name: cut(getattr(p, f.name).distinct()) for f in fields(p)})


def _moved(rows: DataFrame, p: Program) -> DataFrame:
    """Rows with ``node, local`` after the statement: kept or copied."""
    kept = rows.join(p.defs.select("node", "local").distinct(), ["node", "local"], "left_anti")
    copied = rows.withColumnRenamed("local", "source").join(p.copies.select("node", "source", "local"), ["node", "source"]).select(*rows.columns)
    return kept.select(*rows.columns).union(copied)


def _on(rows: DataFrame, p: Program) -> DataFrame:
    """Rows after a statement, before the next ones."""
    names = rows.columns
    return rows.join(p.edges.select(F.col("src").alias("node"), "dst"), "node").select(*[F.col("dst").alias("node") if c == "node" else F.col(c) for c in names])


def _through(rows: DataFrame, summary: DataFrame, p: Program) -> DataFrame:
    """Rows at calls whose local comes back as the call's result."""
    names = rows.columns
    into = rows.join(p.arguments.withColumnRenamed("arg", "local"), ["node", "local"]).drop("local")
    out = into.join(summary.select("callee", "param", "value"), ["callee", "param"]).join(p.results, ["node", "callee", "value"])
    return out.select(*names)


def summaries(p: Program) -> DataFrame:
    """``callee, param, value``: the parameter's value may be returned as ``value``."""
    inside = p.starts.withColumnRenamed("method", "callee").join(p.arguments.select("callee", "param").distinct(), "callee")
    seeds = inside.select("callee", "param", "node", F.col("param").alias("local"))
    leave = p.exits.select(F.col("method").alias("callee"), "node").join(p.results.select("callee", F.col("value").alias("local")).distinct(), "callee")

    def step(known: Relations, delta: Relations) -> Relations:
        fresh = delta["e"]

        def back(rows: DataFrame, summary: DataFrame) -> DataFrame:
            own = rows.select(F.col("callee").alias("of"), F.col("param").alias("by"), "node", "local")
            return _through(own, summary, p).select(F.col("of").alias("callee"), F.col("by").alias("param"), "node", "local")

        after = _moved(fresh, p).union(back(fresh, known["s"])).union(back(known["e"], delta["s"]))
        done = fresh.join(leave, ["callee", "node", "local"]).select("callee", "param", F.col("local").alias("value"))
        return {"e": _on(after, p), "s": done}

    first = seeds.join(leave, ["callee", "node", "local"]).select("callee", "param", F.col("local").alias("value"))
    return fixpoint({"e": seeds, "s": first}, step)["s"]


def carried(p: Program, born: DataFrame, init: DataFrame | None = None) -> DataFrame:
    """``node, local, payload`` that may hold before each node.

    ``born(node, local, payload)`` begins as the statement's own effect, ``init`` before it.
    Repeated rows count once; a payload at a node without edges ends there.
    """
    p = _staged(p)
    summary = cut(summaries(p))
    columns = ["node", "local", "payload", "own"]
    seeds = _on(born.select("node", "local", "payload"), p)
    if init is not None:
        seeds = seeds.unionByName(init.select("node", "local", "payload"))
    starts = p.starts.select(F.col("method").alias("callee"), F.col("node").alias("start"))
    exits = p.exits.select(F.col("method").alias("callee"), F.col("node").alias("exit"))
    leave = p.results.join(exits, "callee").select(F.col("exit").alias("node"), F.col("value").alias("local"), F.col("node").alias("call"), F.col("local").alias("result")).distinct()

    def step(known: Relations, delta: Relations) -> Relations:
        rows = delta["v"].select(*columns)
        entered = rows.join(p.arguments.withColumnRenamed("arg", "local"), ["node", "local"]).join(starts, "callee")
        returned = rows.where("own").join(leave, ["node", "local"]).select(F.col("call").alias("node"), F.col("result").alias("local"), "payload", "own")
        after = _moved(rows, p).union(_through(rows, summary, p)).union(returned)
        return {"v": _on(after, p).union(entered.select(F.col("start").alias("node"), F.col("param").alias("local"), "payload", F.lit(False)))}

    found = fixpoint({"v": seeds.withColumn("own", F.lit(True)).select(*columns)}, step)["v"]
    return found.select("node", "local", "payload").distinct()


def possible_types(p: Program, made: DataFrame) -> DataFrame:
    """``node, local, type``: classes of the objects a local may hold; ``made(node, local, type)``."""
    return carried(p, made.withColumnRenamed("type", "payload")).withColumnRenamed("payload", "type")


def reaching_definitions(p: Program) -> DataFrame:
    """``node, local, def_node`` over calls: an argument's definitions are its parameter's, a result is defined by its call and by what the callee returns."""
    as_defs = Program(p.edges, p.starts, p.exits, p.defs, p.copies.limit(0), p.arguments, p.results)
    return carried(as_defs, p.defs.select("node", "local", F.col("node").alias("payload"))).withColumnRenamed("payload", "def_node")


def uninitialised(p: Program, locals_: DataFrame, uses: DataFrame) -> DataFrame:
    """``node, local``: uses that may see a local which nothing has set, arguments handed on included.

    ``locals_(method, local)``; what any call passes is a parameter and set at the start.
    """
    params = p.arguments.select(F.col("callee").alias("method"), F.col("param").alias("local")).distinct()
    unset = locals_.select("method", "local").distinct().join(params, ["method", "local"], "left_anti").join(p.starts, "method")
    init = unset.select("node", "local", F.lit("unset").alias("payload"))
    return uses.select("node", "local").distinct().join(carried(p, init.limit(0), init), ["node", "local"], "left_semi")


def literal_arguments(p: Program, literals: DataFrame, watched: DataFrame) -> DataFrame:
    """``node, local, value``: literals that reach a watched argument, through any number of calls.

    ``literals(node, local, value)`` assign one; ``watched(node, local)`` are the arguments.
    """
    return carried(p, literals.withColumnRenamed("value", "payload")).withColumnRenamed("payload", "value").join(watched.select("node", "local").distinct(), ["node", "local"])
