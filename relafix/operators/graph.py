"""Graph operators over edge tables ``(src, dst)``: closures, components, dominance, loops, blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relafix.operators.fixpoint import NoFixpoint, Relations, by_source, fixpoint
from relafix.storage import counted_table, stage_table


def inverse(edges: DataFrame) -> DataFrame:
    """Edges turned round; other columns stay."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def heads(edges: DataFrame) -> DataFrame:
    """Nodes without predecessors."""
    return nodes(edges).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def tails(edges: DataFrame) -> DataFrame:
    """Nodes without successors."""
    return nodes(edges).join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def reach_from(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``origin, node``: what each seed (``origin``) reaches over one edge or more."""
    edges = by_source(edges)

    def step(known: Relations, delta: Relations) -> Relations:
        return {"r": delta["r"].join(edges, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"))}

    first = seeds.select("origin").join(edges, F.col("origin") == F.col("src")).select("origin", F.col("dst").alias("node"))
    return fixpoint({"r": first}, step, max_rounds)["r"]


def transitive_closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``src, dst`` pairs joined by a path; paths double in length each round."""

    def step(known: Relations, delta: Relations) -> Relations:
        def chained(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.alias("a").join(b.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")

        # one term for each recursive atom
        return {"t": chained(delta["t"], known["t"]).union(chained(known["t"], delta["t"]))}

    return fixpoint({"t": edges.select("src", "dst")}, step, max_rounds)["t"]


def depths(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``node, depth``: shortest number of edges from any seed; a topological order for layered graphs."""
    edges = by_source(edges)

    def step(known: Relations, delta: Relations) -> Relations:
        further = delta["d"].join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        return {"d": further.join(known["d"].select("node"), "node", "left_anti")}

    return fixpoint({"d": seeds.select("node", F.lit(0).alias("depth"))}, step, max_rounds)["d"]


def longest_depths(edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """``node, depth``: longest path from a head, for acyclic graphs; ascending depth is a topological order.

    Heads go round by round, and what loses its last predecessor in a round has that depth,
    so every node is derived once and every edge is looked at once.  Where nodes are left
    without a head there is a cycle, which raises ``NoFixpoint``.
    """
    edges = by_source(edges.select("src", "dst").distinct())
    front, n = counted_table(heads(edges), "heads")
    waiting = stage_table(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("missing")), "waiting")
    found = []
    for depth in range(max_rounds):
        if not n:
            break
        found.append(front.select("node", F.lit(depth).alias("depth")))
        gone = front.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.count("*").alias("gone"))
        left = waiting.join(gone, F.col("node") == F.col("dst"), "left").select("node", (F.col("missing") - F.coalesce("gone", F.lit(0))).alias("missing"))
        left = stage_table(left, "waiting")
        front, n = counted_table(left.where("missing = 0").select("node"), "heads")
        waiting = left.where("missing > 0")
    if not waiting.isEmpty():
        raise NoFixpoint("a cycle has no longest path")
    if not found:
        return nodes(edges).select("node", F.lit(0).alias("depth"))
    return reduce(DataFrame.unionByName, found)


def components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``node, component``: weakly connected components, named by their smallest node."""
    both = by_source(edges.select("src", "dst").union(inverse(edges).select("src", "dst")).distinct())

    def step(known: Relations, delta: Relations) -> Relations:
        low = known["c"].groupBy("node").agg(F.min("component").alias("best"))
        sent = delta["c"].join(both, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("component").alias("component"))
        better = sent.join(low, F.col("dst") == F.col("node")).where("component < best")
        return {"c": better.select(F.col("dst").alias("node"), "component")}

    found = fixpoint({"c": nodes(edges).select("node", F.col("node").alias("component"))}, step, max_rounds)["c"]
    return found.groupBy("node").agg(F.min("component").alias("component"))


def _lowest(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, label``: the smallest label among those that reach each node; a round sends on what got smaller."""
    best = news = labels
    while True:
        sent = news.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("label").alias("low"))
        news, n = counted_table(sent.join(best, F.col("dst") == F.col("node")).where("low < label").select("node", F.col("low").alias("label")), "news")
        if not n:
            return best
        best = stage_table(best.join(news.withColumnRenamed("label", "low"), "node", "left").select("node", F.coalesce("low", "label").alias("label")), "best")


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component``: strongly connected components, named by their smallest node.

    Nodes that nothing leads to, or that lead to nothing, are components of their own and go.
    The others take the smallest node that reaches them as colour; what reaches that node within its colour is
    its component.  Then the rest is coloured again.  Work grows with the edges, never with the pairs that reach each other.
    """
    everything = nodes(edges)
    live, n = counted_table(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    done = []
    while n:
        trimmed = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        trimmed, left = counted_table(trimmed.select("src", "dst"), "edges")
        if left < n:
            live, n = trimmed, left
            continue
        colours = _lowest(live, nodes(live).select("node", F.col("node").alias("label")))
        a, b = colours.select(F.col("node").alias("src"), F.col("label").alias("colour")), colours.select(F.col("node").alias("dst"), F.col("label").alias("other"))
        inner = stage_table(live.join(a, "src").join(b, "dst").where("colour = other").select(F.col("dst").alias("node"), F.col("src").alias("to"), "colour"), "inner")

        def back(known: Relations, delta: Relations) -> Relations:
            return {"c": delta["c"].join(inner, ["node", "colour"]).select(F.col("to").alias("node"), "colour")}

        members = fixpoint({"c": colours.where("node = label").select("node", F.col("label").alias("colour"))}, back)["c"]
        members = stage_table(members, "members")
        done.append(members.select("node", F.col("colour").alias("component")))
        live, n = counted_table(live.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")
    if not done:
        return everything.select("node", F.col("node").alias("component"))
    return everything.join(reduce(DataFrame.unionByName, done), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def collapse(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between components of ``members(node, component)``; inner edges go."""
    a, b = members.select(F.col("node").alias("src"), F.col("component").alias("a")), members.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def dominators(edges: DataFrame, entry, keys: tuple[str, ...] = ()) -> DataFrame:
    """``dom, node``: every path from the entry to ``node`` passes ``dom``.

    ``entry`` is one node's value, or with ``keys``, which tell graphs apart, a
    table ``keys, node``.  The greatest fixpoint of the usual equations, found as a
    least one: the pairs for which some path avoids ``dom`` are derived, and the
    rest of the reachable pairs dominate.  Nothing is ever taken back.
    """
    on = list(keys)
    if not on:
        spark = edges.sparkSession
        entry = spark.range(1).select(F.lit(entry).alias("node"))
    out = stage_table(edges.withColumnRenamed("src", "node").select(*on, "node", "dst").distinct(), "out", plain=True)

    def flow(known: Relations, delta: Relations) -> Relations:
        return {"reach": delta["reach"].join(out, [*on, "node"]).select(*on, F.col("dst").alias("node"))}

    reach = fixpoint({"reach": entry.select(*on, "node")}, flow)["reach"]

    def avoid(known: Relations, delta: Relations) -> Relations:
        return {"avoid": delta["avoid"].join(out, [*on, "node"]).where("dst <> dom").select(*on, "dom", F.col("dst").alias("node"))}

    doms = reach.select(*on, F.col("node").alias("dom"))
    starts = doms.join(entry.select(*on, "node"), on) if on else doms.withColumn("node", F.lit(entry.first()["node"]))
    avoided = fixpoint({"avoid": starts.where("dom <> node").select(*on, "dom", "node")}, avoid)["avoid"]
    # a dominator reaches what it dominates, so reachability bounds the pairs

    def below(known: Relations, delta: Relations) -> Relations:
        return {"pair": delta["pair"].join(out, [*on, "node"]).select(*on, "dom", F.col("dst").alias("node"))}

    pairs = fixpoint({"pair": doms.withColumn("node", F.col("dom"))}, below)["pair"]
    return pairs.join(avoided, [*on, "dom", "node"], "left_anti")


def immediate_dominators(dom: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``node, idom``: the strict dominator that itself has most dominators; entries have none."""
    count = dom.groupBy(*keys, F.col("node").alias("dom")).agg(F.count("*").alias("height"))
    strict = dom.where("dom <> node").join(count, [*keys, "dom"])
    return strict.groupBy(*keys, "node").agg(F.max_by("dom", "height").alias("idom"))


def dominance_frontier(edges: DataFrame, dom: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``node, frontier``: ``node`` dominates a predecessor of ``frontier`` but not strictly the frontier itself."""
    strict = dom.where("dom <> node").select(*keys, F.col("dom").alias("at"), F.col("node").alias("dst"))
    over = dom.withColumnRenamed("node", "src").join(edges, [*keys, "src"]).select(*keys, F.col("dom").alias("at"), "dst")
    return over.join(strict, [*keys, "at", "dst"], "left_anti").select(*keys, F.col("at").alias("node"), F.col("dst").alias("frontier")).distinct()


def natural_loops(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """``head, node``: bodies of natural loops; edges into a dominator go back to a loop's head."""
    back = edges.join(dom.select(F.col("dom").alias("dst"), F.col("node").alias("src")), ["src", "dst"]).select(F.col("dst").alias("head"), F.col("src").alias("node"))

    def step(known: Relations, delta: Relations) -> Relations:
        up = delta["body"].where("node <> head").join(edges, F.col("node") == F.col("dst")).select("head", F.col("src").alias("node"))
        return {"body": up}

    own = back.select("head", F.col("head").alias("node"))
    return fixpoint({"body": back.union(own)}, step)["body"]


def loop_nest(bodies: DataFrame) -> DataFrame:
    """``head, parent, depth``: the smallest other loop around each loop of ``bodies(head, node)``; outermost have depth 1 and no parent.

    Of equally small ones the smallest head.  Loops of a reducible graph are nested or disjoint.
    """
    heads = bodies.select("head").distinct()
    size = bodies.groupBy("head").agg(F.count("*").alias("n"))
    around = bodies.where("head <> node").join(heads.select(F.col("head").alias("node")), "node").select(F.col("node").alias("inner"), "head").join(size, "head")
    own = size.select(F.col("head").alias("inner"), F.col("n").alias("own"))
    outer = around.join(own, "inner").where("n > own").groupBy("inner").agg(F.min_by("head", F.struct("n", "head")).alias("parent"), (F.count("*") + 1).alias("depth"))
    return heads.join(outer, F.col("head") == F.col("inner"), "left").select("head", "parent", F.coalesce("depth", F.lit(1)).cast("int").alias("depth"))


def control_dependence(edges: DataFrame, leave) -> DataFrame:
    """``node, on``: ``node`` runs or not by the branch taken at ``on`` (frontier of post-dominance)."""
    turned = inverse(edges)
    post = dominators(turned, leave)
    return dominance_frontier(turned, post).select("node", F.col("frontier").alias("on"))


def contract_chains(edges: DataFrame) -> DataFrame:
    """``node, block``: straight-line runs of nodes share the block of their first node."""
    outs = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    ins = edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    straight = edges.join(outs, "src").join(ins, "dst").where("n_out = 1 AND n_in = 1 AND src <> dst").select("src", "dst")
    start = nodes(edges).join(straight.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.col("node").alias("block"))

    def step(known: Relations, delta: Relations) -> Relations:
        return {"b": delta["b"].join(straight, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "block")}

    return fixpoint({"b": start}, step)["b"]


def basic_blocks(units: DataFrame, leader: Column, method: str = "method", index: str = "idx") -> DataFrame:
    """``units`` with ``block``: a running number of leaders within each method."""
    upto = Window.partitionBy(method).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn("block", F.sum(leader.cast("int")).over(upto))


def critical_edges(edges: DataFrame) -> DataFrame:
    """Edges from a node with several successors to a node with several predecessors."""
    outs = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    ins = edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    return edges.join(outs, "src").join(ins, "dst").where("n_out > 1 AND n_in > 1").select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """``node, n_in, n_out``."""
    both = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return both.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
