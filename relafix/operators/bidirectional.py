"""Bidirectional tabulation: a forward and a backward problem that leave a method together or not at all.

Both ways start at the same statements.  Where a way comes to the end of a method that it did not enter
by a call, it would go on in every caller, though a path that runs both ways through the
start need not exist there.  So each fact keeps its source, the start or the call by which its method
was last left, and a way waits at a call until the other way leaves to the same call from the same
source.  Beyond it both go on with that call as their source.  Methods entered by
a call are tabulated without a source and shared; a fact that returns takes its caller's source back.

Waiting is a join of two relations that only grow: the leaks of one way meet those of the other,
whichever came first, so no edge is ever paused by hand or derived again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relafix.operators.fixpoint import Relations, fixpoint
from relafix.operators.ifds import Problem
from relafix.storage import counted_table, counted_tables, empty_table

FORWARD, BACKWARD = "forward", "backward"
_EDGE = ("way", "entry_fact", "node", "fact", "source")
_LEAK = ("way", "source", "call", "site", "fact")


def _both(forward: Problem, backward: Problem) -> dict[str, DataFrame]:
    """The tables of both problems under one ``way`` column, in the form that rounds look them up in.

    A round reads each of them whole, so what one lookup can tell is one table, and what only methods
    entered by a call need holds those methods alone: ``onward(way, node, fact, dst, out)`` goes on in a method,
    ``leaving(way, node, fact, callee, call, site, out)`` leaves it at its ends, ``back`` are the returns of calls that enter.
    Rows of ``onward`` and returns may repeat: each stands alone in a join, so they cost no more than themselves.
    """

    def tagged(name: str, *columns: str) -> DataFrame:
        rows = [getattr(problem, name).select(F.lit(way).alias("way"), *columns) for problem, way in ((forward, FORWARD), (backward, BACKWARD))]
        return rows[0].unionByName(rows[1])

    small = {
        "starts": tagged("starts", "method", "node"),
        "exits": tagged("exits", "method", "node"),
        "call": tagged("call", "node", "callee", "fact", "out"),
        "seeds": tagged("seeds", "node", "fact"),
    }
    t = counted_tables({name: rows.distinct() for name, rows in small.items()})[0]
    normal, bypass = tagged("normal", "src", "dst", "fact", "out"), tagged("bypass", "node", "site", "fact", "out")
    onward = normal.withColumnRenamed("src", "node").unionByName(bypass.withColumnRenamed("site", "dst")).select("way", "node", "fact", "dst", "out")
    ret = tagged("ret", "node", "callee", "exit", "site", "fact", "out").withColumnRenamed("node", "call")
    ends = t["exits"].select("way", F.col("method").alias("callee"), F.col("node").alias("exit"))
    leaving = ret.join(ends, ["way", "callee", "exit"]).select("way", F.col("exit").alias("node"), "fact", "callee", "call", "site", "out")
    entered = t["call"].select("way", "callee", F.col("node").alias("call")).distinct()
    shared = t["exits"].join(entered.select("way", F.col("callee").alias("method")).distinct(), ["way", "method"], "left_semi").select("way", "node").distinct()
    for name, rows in {"onward": onward, "leaving": leaving, "back": ret.join(entered, ["way", "callee", "call"], "left_semi"), "ends": t["exits"].join(shared, ["way", "node"], "left_semi")}.items():
        table, n = counted_table(rows, name)
        t[name] = table if n else empty_table(table.sparkSession, table.schema)
    return t


def _turned(leaks: DataFrame) -> DataFrame:
    """The calls that the other way may now go on to: ``way, source, call``."""
    other = F.when(F.col("way") == FORWARD, BACKWARD).otherwise(FORWARD)
    return leaks.select(other.alias("way"), "source", "call")


def entangle(forward: Problem, backward: Problem, zero: str = "0", max_rounds: int = 1000) -> Relations:
    """Solves both problems together.

    The backward problem has its flows against the program's direction: its starts are the exits
    of methods, its sites lie before calls.  The seeds of both are taken as they are; ways meet
    where they began at the same node.  Returns

    * ``edge(way, entry_fact, node, fact, source)``: what may hold before (forward) or after
      (backward) a node; ``source`` is null in methods entered by a call, elsewhere ``entry_fact`` is ``zero``,
    * ``incoming(way, callee, entry_fact, call, caller_fact)`` and ``summary(way, method, entry_fact, exit, fact)``,
    * ``leak(way, source, call, site, fact)``: each time a way left, or waits to leave, to a caller.

    Repeated rows count once.  Without seeds all are empty; rows with a null fact, node or method take no part.
    A fact that a call brought into a method returns to that call's callers only; one that a seed in the
    same method brought there may return to all of them.
    """
    t = _both(forward, backward)
    call, onward, leaving, returns, ends = (t[n] for n in ("call", "onward", "leaving", "back", "ends"))
    starts = t["starts"].select("way", F.col("method").alias("callee"), F.col("node").alias("start"))

    def enter(edge: DataFrame) -> DataFrame:
        return edge.join(call, ["way", "node", "fact"])

    def arrivals(edge: DataFrame) -> DataFrame:
        return enter(edge).select("way", "callee", F.col("out").alias("entry_fact"), F.col("node").alias("call"), F.col("fact").alias("caller_fact"))

    def summaries(edge: DataFrame) -> DataFrame:
        return edge.where("source is null").join(ends, ["way", "node"]).select("way", "method", "entry_fact", F.col("node").alias("exit"), "fact")

    def leaks(edge: DataFrame) -> DataFrame:
        return edge.where("source is not null").join(leaving, ["way", "node", "fact"]).select("way", "source", "call", "site", F.col("out").alias("fact"))

    def resumed(fresh: DataFrame, known: DataFrame) -> DataFrame:
        # pairs that did not change went on before; where both ways meet at one that did, all its leaks go on
        pair = Window.partitionBy("source", "call")
        changed = known.join(fresh.select("source", "call").distinct(), ["source", "call"], "left_semi")
        met = changed.withColumn("__first", F.min("way").over(pair)).withColumn("__last", F.max("way").over(pair)).where("__first <> __last")
        return met.select("way", F.lit(zero).alias("entry_fact"), F.col("site").alias("node"), "fact", F.col("call").alias("source"))

    def back(incoming: DataFrame, summary: DataFrame, edge: DataFrame) -> DataFrame:
        met = incoming.join(summary.withColumnRenamed("method", "callee"), ["way", "callee", "entry_fact"])
        out = met.join(returns, ["way", "call", "callee", "exit", "fact"]).select("way", "call", "caller_fact", "site", F.col("out").alias("fact"))
        callers = edge.select("way", "entry_fact", F.col("node").alias("call"), F.col("fact").alias("caller_fact"), "source")
        return out.join(callers, ["way", "call", "caller_fact"]).select("way", "entry_fact", F.col("site").alias("node"), "fact", "source")

    def step(known: Relations, delta: Relations) -> Relations:
        fresh = delta["edge"]
        terms = [
            fresh.join(onward, ["way", "node", "fact"]).select("way", "entry_fact", F.col("dst").alias("node"), F.col("out").alias("fact"), "source"),
            enter(fresh).join(starts, ["way", "callee"]).select("way", F.col("out").alias("entry_fact"), F.col("start").alias("node"), F.col("out").alias("fact"), F.lit(None).cast(fresh.schema["source"].dataType).alias("source")),
            # three recursive atoms, one term for the news of each
            back(delta["incoming"], known["summary"], known["edge"]),
            back(known["incoming"], delta["summary"], known["edge"]),
            back(known["incoming"], known["summary"], fresh),
            resumed(delta["leak"], known["leak"]),
        ]
        return {"edge": reduce(DataFrame.union, [term.select(*_EDGE) for term in terms]), "incoming": arrivals(fresh), "summary": summaries(fresh), "leak": leaks(fresh)}

    edge = t["seeds"].select("way", F.lit(zero).alias("entry_fact"), "node", "fact", F.col("node").alias("source"))

    def none(df: DataFrame) -> DataFrame:
        return empty_table(df.sparkSession, df.schema)

    return fixpoint({"edge": edge, "incoming": none(arrivals(edge)), "summary": none(summaries(edge)), "leak": none(leaks(edge))}, step, max_rounds)


def departures(found: Relations) -> DataFrame:
    """``source, call, forward, backward``: which ways left from ``source`` to ``call``; beyond it only both go on."""
    return found["leak"].groupBy("source", "call").agg(F.bool_or(F.col("way") == FORWARD).alias(FORWARD), F.bool_or(F.col("way") == BACKWARD).alias(BACKWARD))


def waiting(found: Relations) -> DataFrame:
    """Leaks that the other way never followed, in the columns of ``leak``."""
    return found["leak"].join(_turned(found["leak"]), ["way", "source", "call"], "left_anti").select(*_LEAK)
