"""Dataflow analyses as relations over control-flow edges.

``cfg`` has ``method, src, dst``; facts are values of a ``fact`` column.  May
analyses derive ``in(method, node, fact)``; must analyses derive the facts that
some path fails to establish and return the others, so all loops are monotone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relafix.operators.fixpoint import Relations, fixpoint
from relafix.storage import cut


def may_flow(cfg: DataFrame, gen: DataFrame, kill: DataFrame, init: DataFrame | None = None) -> DataFrame:
    """``method, node, fact`` before each node, for forward gen/kill problems.

    ``gen`` and ``kill`` have ``method, node, fact``; a node's own gens survive its
    kills.  ``init`` holds facts before entry nodes.
    """
    edges = cfg.select("method", F.col("src").alias("node"), "dst")
    seeds = gen.join(edges, ["method", "node"]).select("method", F.col("dst").alias("node"), "fact")
    if init is not None:
        seeds = seeds.unionByName(init.select("method", "node", "fact"))

    def step(known: Relations, delta: Relations) -> Relations:
        through = delta["in"].join(kill.select("method", "node", "fact"), ["method", "node", "fact"], "left_anti")
        return {"in": through.join(edges, ["method", "node"]).select("method", F.col("dst").alias("node"), "fact")}

    return fixpoint({"in": seeds}, step)["in"]


def backward(cfg: DataFrame) -> DataFrame:
    return cfg.select("method", F.col("dst").alias("src"), F.col("src").alias("dst"))


def must_flow(cfg: DataFrame, gen: DataFrame, kill: DataFrame, entry: DataFrame) -> DataFrame:
    """``method, node, fact`` that hold before the node on every path from an entry.

    ``entry`` has ``method, node``; nothing holds there.  A kill wins over nothing,
    a gen over a kill at the same node.
    """
    facts = gen.select("method", "fact").distinct()
    missing = entry.join(facts, "method").select("method", "node", "fact")
    lost = kill.join(gen, ["method", "node", "fact"], "left_anti")
    not_held = may_flow(cfg, lost, gen, missing)
    reach = cfg.select("method", F.col("dst").alias("node")).unionByName(entry.select("method", "node")).distinct()
    return reach.join(facts, "method").join(not_held, ["method", "node", "fact"], "left_anti").select("method", "node", "fact")


def reaching_definitions(cfg: DataFrame, defs: DataFrame) -> DataFrame:
    """``method, node, local, def_node``: definitions that may reach a node. ``defs`` has ``method, node, local``."""
    cells = defs.select("method", F.col("node").alias("def_node"), "local")
    gen = defs.select("method", "node", F.struct("local", F.col("node").alias("def_node")).alias("fact"))
    # a definition kills the others of its local, so facts are matched by local when they pass
    edges = cfg.select("method", F.col("src").alias("node"), "dst")
    seeds = gen.join(edges, ["method", "node"]).select("method", F.col("dst").alias("node"), F.col("fact.local").alias("local"), F.col("fact.def_node").alias("def_node"))
    kills = cells.select("method", F.col("def_node").alias("node"), "local").distinct()

    def step(known: Relations, delta: Relations) -> Relations:
        through = delta["in"].join(kills, ["method", "node", "local"], "left_anti")
        return {"in": through.join(edges, ["method", "node"]).select("method", F.col("dst").alias("node"), "local", "def_node")}

    return fixpoint({"in": seeds}, step)["in"]


def def_use(cfg: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """``method, node, local, def_node``: each use (``method, node, local``) with the definitions that reach it."""
    return uses.join(reaching_definitions(cfg, defs), ["method", "node", "local"])


def live_locals(cfg: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """``method, node, local`` live before a node."""
    turned = backward(cfg)
    gen = uses.select("method", "node", F.col("local").alias("fact"))
    kill = defs.select("method", "node", F.col("local").alias("fact"))
    after = may_flow(turned, gen, kill)
    own = gen.unionByName(after.join(kill, ["method", "node", "fact"], "left_anti"))
    return own.select("method", "node", F.col("fact").alias("local")).distinct()


def uninitialised(cfg: DataFrame, defs: DataFrame, uses: DataFrame, entry: DataFrame) -> DataFrame:
    """Uses of locals that some path leaves undefined: ``method, node, local``."""
    locals_ = uses.select("method", "local").union(defs.select("method", "local")).distinct()
    init = entry.join(locals_, "method").select("method", "node", F.col("local").alias("fact"))
    nothing = init.limit(0)
    open_ = may_flow(cfg, nothing, defs.select("method", "node", F.col("local").alias("fact")), init)
    return uses.join(open_.withColumnRenamed("fact", "local"), ["method", "node", "local"], "left_semi")


def lattice_flow(cfg: DataFrame, assigned: DataFrame, copies: DataFrame, defs: DataFrame, init: DataFrame | None = None) -> DataFrame:
    """``method, node, local, bits``: bit-set lattices such as parity, nullness or sign, joined by OR.

    ``assigned`` has ``method, node, local, bits`` for definitions by a known value,
    ``copies`` has ``method, node, local, source``.  Each bit is a fact of its own while
    the loop runs; ``bit_or`` puts them together.
    """
    edges = cfg.select("method", F.col("src").alias("node"), "dst")
    single = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.call_function("shiftleft", F.lit(1), i)), lambda b: F.col("bits").bitwiseAND(b) != 0))
    seeds = assigned.select("method", "node", "local", single.alias("bit")).join(edges, ["method", "node"]).select("method", F.col("dst").alias("node"), "local", "bit")
    if init is not None:
        seeds = seeds.unionByName(init.select("method", "node", "local", single.alias("bit")))
    written = defs.select("method", "node", "local").distinct()

    def step(known: Relations, delta: Relations) -> Relations:
        kept = delta["v"].join(written, ["method", "node", "local"], "left_anti")
        moved = delta["v"].withColumnRenamed("local", "source").join(copies, ["method", "node", "source"]).select("method", "node", "local", "bit")
        return {"v": kept.unionByName(moved).join(edges, ["method", "node"]).select("method", F.col("dst").alias("node"), "local", "bit")}

    found = fixpoint({"v": seeds}, step)["v"]
    return found.groupBy("method", "node", "local").agg(F.bit_or("bit").alias("bits"))


def constants(cfg: DataFrame, assigned: DataFrame, copies: DataFrame, defs: DataFrame) -> DataFrame:
    """``method, node, local, value``: locals that hold one constant on all paths; value null where paths differ.

    ``assigned`` has ``value`` (null for an unknown one).
    """
    edges = cfg.select("method", F.col("src").alias("node"), "dst")
    written = defs.select("method", "node", "local").distinct()
    seeds = assigned.join(edges, ["method", "node"]).select("method", F.col("dst").alias("node"), "local", "value")

    def step(known: Relations, delta: Relations) -> Relations:
        kept = delta["v"].join(written, ["method", "node", "local"], "left_anti")
        moved = delta["v"].withColumnRenamed("local", "source").join(copies, ["method", "node", "source"]).select("method", "node", "local", "value")
        return {"v": kept.unionByName(moved).join(edges, ["method", "node"]).select("method", F.col("dst").alias("node"), "local", "value")}

    found = fixpoint({"v": seeds}, step)["v"]
    one = (F.count_distinct("value") == 1) & (F.count("value") == F.count("*"))
    return found.groupBy("method", "node", "local").agg(F.when(one, F.max("value")).alias("value"))


def merge_keep_one_sided(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Merge of constant maps that keeps a key seen on one side only; where both differ the value is null."""
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = a.join(b, on, "full_outer")
    x, y = F.col(f"a.{value}"), F.col(f"b.{value}")
    seen_a, seen_b = F.col(f"a.{keys[0]}").isNotNull(), F.col(f"b.{keys[0]}").isNotNull()
    merged = F.when(~seen_b, x).when(~seen_a, y).when(x.isNull() | (x == y), x)
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], merged.alias(value))


def copy_propagation(uses: DataFrame, reaching: DataFrame, copies: DataFrame) -> DataFrame:
    """Uses with ``local`` replaced by the copy's source where one copy alone reaches the use.

    The source must have the same reaching definitions at the copy and at the use.
    """
    one = reaching.groupBy("method", "node", "local").agg(F.count("*").alias("n"), F.max("def_node").alias("def_node")).where("n = 1")
    state = reaching.groupBy("method", "node", "local").agg(F.sort_array(F.collect_set("def_node")).alias("defs"))
    at_use = state.select("method", "node", F.col("local").alias("source"), F.col("defs").alias("defs_use"))
    at_copy = state.select("method", F.col("node").alias("def_node"), F.col("local").alias("source"), F.col("defs").alias("defs_copy"))
    via = uses.join(one, ["method", "node", "local"]).join(copies.select("method", F.col("node").alias("def_node"), "local", "source"), ["method", "def_node", "local"])
    same = via.join(at_use, ["method", "node", "source"], "left").join(at_copy, ["method", "def_node", "source"], "left").where(F.col("defs_use").eqNullSafe(F.col("defs_copy")))
    return uses.join(same.select("method", "node", "local", "source"), ["method", "node", "local"], "left").select("method", "node", F.coalesce("source", "local").alias("local"))


def dead_assignments(cfg: DataFrame, defs: DataFrame, uses: DataFrame, effects: DataFrame) -> DataFrame:
    """``method, node``: side-effect-free definitions that no live use reaches.

    ``effects`` has ``method, node`` of statements that must stay.  Useful statements
    are the least set that has the effects and the definitions its uses need.
    """
    needed_by = cut(def_use(cfg, defs, uses))

    def step(known: Relations, delta: Relations) -> Relations:
        return {"live": delta["live"].join(needed_by, ["method", "node"]).select("method", F.col("def_node").alias("node"))}

    live = fixpoint({"live": effects.select("method", "node")}, step)["live"]
    return defs.select("method", "node").distinct().join(live, ["method", "node"], "left_anti")


def neighbours_in_order(units: DataFrame, method: str = "method", index: str = "idx") -> DataFrame:
    """``units`` with ``before`` and ``after``: the index of the unit next to it."""
    w = Window.partitionBy(method).orderBy(index)
    return units.withColumn("before", F.lag(index).over(w)).withColumn("after", F.lead(index).over(w))
