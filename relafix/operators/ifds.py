"""Interprocedural tabulation: path edges and summaries as mutually recursive relations.

A ``Problem`` holds the program and the flow functions as tables.  A flow function
is extensional, fact in to fact out at a node; the zero fact is a fact like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relafix.operators.fixpoint import Relations, fixpoint


@dataclass
class Problem:
    """Tables of an interprocedural problem.

    ``cfg(src, dst)`` edges inside methods out of nodes that are no calls;
    ``calls(node, callee)``, ``starts(method, node)``, ``exits(method, node)``,
    ``returns(call, site)``; flows ``normal(src, dst, fact, out)``,
    ``call(node, callee, fact, out)``, ``ret(node, callee, exit, site, fact, out)``,
    ``bypass(node, site, fact, out)``; ``seeds(node, fact)``.
    """

    calls: DataFrame
    starts: DataFrame
    exits: DataFrame
    returns: DataFrame
    normal: DataFrame
    call: DataFrame
    ret: DataFrame
    bypass: DataFrame
    seeds: DataFrame


def tabulate(p: Problem, unbalanced: bool = False, zero: str = "0", max_rounds: int = 1000) -> Relations:
    """``edge(entry_fact, node, fact)``, ``incoming(callee, entry_fact, call, caller_fact)``, ``summary(method, entry_fact, exit, fact)``.

    ``unbalanced`` also returns zero-fact summaries to callers that no call came from
    (a second stratum, since it asks for the absence of derived rows).
    """
    starts = p.starts.select(F.col("method").alias("callee"), F.col("node").alias("start"))

    def enter(edge: DataFrame) -> DataFrame:
        return edge.join(p.call, ["node", "fact"]).select("entry_fact", "node", "fact", "callee", "out")

    def step(known: Relations, delta: Relations) -> Relations:
        fresh = delta["edge"]
        normal = fresh.join(p.normal.withColumnRenamed("src", "node"), ["node", "fact"]).select("entry_fact", F.col("dst").alias("node"), F.col("out").alias("fact"))
        over = fresh.join(p.bypass, ["node", "fact"]).select("entry_fact", F.col("site").alias("node"), F.col("out").alias("fact"))
        entered = enter(fresh)
        into = entered.join(starts, "callee").select(F.col("out").alias("entry_fact"), F.col("start").alias("node"), F.col("out").alias("fact"))
        incoming = entered.select("callee", F.col("out").alias("entry_fact"), F.col("node").alias("call"), F.col("fact").alias("caller_fact"))
        done = fresh.join(p.exits, "node").select("method", "entry_fact", F.col("node").alias("exit"), "fact")

        def back(inc: DataFrame, summary: DataFrame, edge: DataFrame) -> DataFrame:
            met = inc.join(summary.withColumnRenamed("method", "callee"), ["callee", "entry_fact"])
            out = met.join(p.ret.withColumnRenamed("node", "call"), ["call", "callee", "exit", "fact"]).select("call", "caller_fact", "site", F.col("out").alias("fact"))
            callers = edge.select("entry_fact", F.col("node").alias("call"), F.col("fact").alias("caller_fact"))
            return out.join(callers, ["call", "caller_fact"]).select("entry_fact", F.col("site").alias("node"), "fact")

        # three recursive atoms, one term for the news of each
        returned = back(delta["incoming"], known["summary"], known["edge"]).union(back(known["incoming"], delta["summary"], known["edge"])).union(back(known["incoming"], known["summary"], fresh))
        return {"edge": normal.union(over).union(into).union(returned), "incoming": incoming, "summary": done}

    edge = p.seeds.select(F.col("fact").alias("entry_fact"), "node", "fact")
    inc = enter(edge).select("callee", F.col("out").alias("entry_fact"), F.col("node").alias("call"), F.col("fact").alias("caller_fact")).limit(0)
    done = edge.join(p.exits, "node").select("method", "entry_fact", F.col("node").alias("exit"), "fact").limit(0)
    found = fixpoint({"edge": edge, "incoming": inc, "summary": done}, step, max_rounds)
    while unbalanced:
        lone = found["summary"].where(F.col("entry_fact") == zero).join(found["incoming"].where(F.col("entry_fact") == zero).select(F.col("callee").alias("method")), "method", "left_anti")
        out = lone.withColumnRenamed("method", "callee").join(p.ret.withColumnRenamed("node", "call"), ["callee", "exit", "fact"]).select(F.lit(zero).alias("entry_fact"), F.col("site").alias("node"), F.col("out").alias("fact"))
        more = out.distinct().join(found["edge"], ["entry_fact", "node", "fact"], "left_anti")
        if more.isEmpty():
            break
        found = fixpoint({"edge": found["edge"].union(more), "incoming": found["incoming"], "summary": found["summary"]}, step, max_rounds)
    return found


def results_at(found: Relations) -> DataFrame:
    """``node, fact``: what may hold before each node."""
    return found["edge"].select("node", "fact").distinct()


def linear_values(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Value phase for linear functions: ``node, fact, value`` (null where paths differ).

    ``edges`` has ``node, fact, to_node, to_fact, mul, add``: the value at the target is
    ``mul * value + add``; ``mul`` 0 is a constant.  A cell that gets two values is at
    the lattice's bottom and stays there, so every cell is derived at most twice.
    """

    def step(known: Relations, delta: Relations) -> Relations:
        sent = delta["v"].join(edges, ["node", "fact"])
        value = F.when(F.col("mul") == 0, F.col("add")).otherwise(F.col("mul") * F.col("value") + F.col("add"))
        sent = sent.select(F.col("to_node").alias("node"), F.col("to_fact").alias("fact"), value.alias("value"))
        both = sent.withColumn("new", F.lit(True)).unionByName(known["v"].withColumn("new", F.lit(False)))
        joined = both.groupBy("node", "fact").agg(F.count_distinct("value").alias("n"), F.count_if(F.col("value").isNull()).alias("bottom"), F.max("value").alias("value"), F.bool_or("new").alias("new"))
        merged = F.when((F.col("n") == 1) & (F.col("bottom") == 0), F.col("value"))
        return {"v": joined.where("new").select("node", "fact", merged.alias("value"))}

    found = fixpoint({"v": seeds.select("node", "fact", "value")}, step, max_rounds)["v"]
    one = (F.count_distinct("value") == 1) & (F.count("value") == F.count("*"))
    return found.groupBy("node", "fact").agg(F.when(one, F.max("value")).alias("value"))
