"""Program transformations as plans over fact tables: what to drop, rename, fold or merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relafix.functions import scalar
from relafix.operators import flow, graph
from relafix.operators.fixpoint import Relations, fixpoint


def unused_locals(locals_: DataFrame, operands: DataFrame) -> DataFrame:
    """Locals that no operand names."""
    named = operands.select("method", F.col("text").alias("name"))
    return locals_.join(named, ["method", "name"], "left_anti")


def standard_names(locals_: DataFrame, operands: DataFrame, prefix: str = "v") -> DataFrame:
    """``method, name, new_name``: locals numbered by their first definition, then by name."""
    first = operands.where("role = 'def'").groupBy("method", F.col("text").alias("name")).agg(F.min("idx").alias("first"))
    order = Window.partitionBy("method").orderBy(F.col("first").asc_nulls_last(), "name")
    return locals_.join(first, ["method", "name"], "left").select("method", "name", F.concat(F.lit(prefix), (F.row_number().over(order) - 1).cast("string")).alias("new_name"))


def split_locals(cfg: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """``method, local, def_node, web``: definitions that share a use are one web, each web a local of its own."""
    reached = flow.def_use(cfg, defs, uses)
    point = F.concat_ws("|", "method", "local", F.col("def_node").cast("string"))
    same = reached.select("method", "local", "node", point.alias("d"))
    hub = same.groupBy("method", "local", "node").agg(F.min("d").alias("hub"))
    edges = same.join(hub, ["method", "local", "node"]).where("d <> hub").select(F.col("d").alias("src"), F.col("hub").alias("dst")).distinct()
    webs = graph.components(edges)
    rows = defs.select("method", "local", F.col("node").alias("def_node")).withColumn("d", F.concat_ws("|", "method", "local", F.col("node").cast("string")))
    return rows.join(webs, F.col("d") == F.col("node"), "left").select("method", "local", "def_node", F.coalesce("component", "d").alias("web"))


def single_use_definitions(cfg: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """``method, local, def_node, node``: definitions with one use, which has no other definition; these fold into the use."""
    reached = flow.def_use(cfg, defs, uses)
    by_def, by_use = Window.partitionBy("method", "local", "def_node"), Window.partitionBy("method", "local", "node")
    return reached.withColumn("a", F.count("*").over(by_def)).withColumn("b", F.count("*").over(by_use)).where("a = 1 AND b = 1").select("method", "local", "def_node", "node")


def reachable_units(cfg: DataFrame, units: DataFrame, traps: DataFrame | None = None) -> DataFrame:
    """``method, idx`` reachable from the first unit, through handlers of traps whose range is entered too."""
    edges = cfg.select("method", "src", "dst")
    if traps is not None:
        covered = units.select("method", "idx").join(traps, "method").where("idx >= begin AND idx < end").select("method", F.col("idx").alias("src"), F.col("handler").alias("dst"))
        edges = edges.union(covered).distinct()

    def step(known: Relations, delta: Relations) -> Relations:
        return {"r": delta["r"].join(edges.withColumnRenamed("src", "idx"), ["method", "idx"]).select("method", F.col("dst").alias("idx"))}

    return fixpoint({"r": units.groupBy("method").agg(F.min("idx").alias("idx"))}, step)["r"]


def unreachable_units(cfg: DataFrame, units: DataFrame, traps: DataFrame | None = None) -> DataFrame:
    return units.join(reachable_units(cfg, units, traps), ["method", "idx"], "left_anti")


def exceptional_edges(units: DataFrame, traps: DataFrame, may_throw: Column) -> DataFrame:
    """``method, src, dst, kind``: from units in a trap's range that may throw to its handler."""
    return units.where(may_throw).join(traps, "method").where("idx >= begin AND idx < end").select("method", F.col("idx").alias("src"), F.col("handler").alias("dst"), F.lit("exceptional").alias("kind")).distinct()


def tightened_traps(units: DataFrame, traps: DataFrame, may_throw: Column) -> DataFrame:
    """Trap ranges from the first to the last covered unit that may throw; traps without any go."""
    inside = units.where(may_throw).select("method", "idx").join(traps, "method").where("idx >= begin AND idx < end")
    return inside.groupBy("method", "begin", "end", "handler", "type").agg(F.min("idx").alias("new_begin"), (F.max("idx") + 1).alias("new_end")).select("method", F.col("new_begin").alias("begin"), F.col("new_end").alias("end"), "handler", "type")


def folded_constants(cfg: DataFrame, assigned: DataFrame, copies: DataFrame, binary: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``method, node, local, value``: definitions whose value is a constant, folding over rounds.

    ``assigned(method, node, local, value)``, ``copies(method, node, local, source)``,
    ``binary(method, node, local, op, left, right)`` with locals as operands.  Each
    round takes the operands that the round before made constant; a definition's value
    is final once found, since all its operands' definitions were.
    """
    known = assigned.where("value is not null").select("method", "node", "local", F.col("value").cast("int").alias("value"))
    defs = assigned.select("method", "node", "local").union(copies.select("method", "node", "local")).union(binary.select("method", "node", "local")).distinct()
    reach = flow.reaching_definitions(cfg, defs)
    every = reach.groupBy("method", "node", "local").agg(F.count("*").alias("n_defs"))

    def step(found: Relations, delta: Relations) -> Relations:
        values = reach.join(found["c"].withColumnRenamed("node", "def_node"), ["method", "def_node", "local"]).groupBy("method", "node", "local").agg(F.count("*").alias("n"), F.min("value").alias("value"), F.max("value").alias("other"))
        at = values.join(every, ["method", "node", "local"]).where("n = n_defs AND value = other").select("method", "node", "local", "value")
        moved = copies.join(at.withColumnRenamed("local", "source"), ["method", "node", "source"]).select("method", "node", "local", "value")
        left, right = at.select("method", "node", F.col("local").alias("left"), F.col("value").alias("a")), at.select("method", "node", F.col("local").alias("right"), F.col("value").alias("b"))
        both = binary.join(left, ["method", "node", "left"]).join(right, ["method", "node", "right"]).select("method", "node", "local", scalar.fold(F.col("op"), F.col("a"), F.col("b")).alias("value"))
        return {"c": moved.unionByName(both.where("value is not null"))}

    return fixpoint({"c": known}, step, max_rounds)["c"]


def decided_branches(conditions: DataFrame) -> DataFrame:
    """``method, node, taken``: branches (``op, a, b`` constants) that always go one way."""
    return conditions.select("method", "node", (scalar.fold(F.col("op"), F.col("a"), F.col("b")) == 1).alias("taken")).where("taken is not null")


def constant_parameters(calls: DataFrame, arguments: DataFrame, n_sites: DataFrame | None = None) -> DataFrame:
    """``callee, pos, value``: parameters that get one and the same constant from every call site."""
    per = calls.join(arguments, ["src", "idx"]).groupBy("tgt", "pos").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.count_distinct("value").alias("kinds"), F.max("value").alias("value"))
    return per.where("n = known AND kinds = 1").select(F.col("tgt").alias("callee"), "pos", "value")


def line_attributes(units: DataFrame) -> DataFrame:
    """``method, lines``: line numbers of a method's units, one entry where they change."""
    w = Window.partitionBy("method").orderBy("idx")
    turns = units.where("line is not null").withColumn("before", F.lag("line").over(w)).where("before is null or before <> line")
    return turns.groupBy("method").agg(F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("lines"))


def unreachable_methods(methods: DataFrame, reachable: DataFrame) -> DataFrame:
    return methods.join(reachable.withColumnRenamed("method", "sig"), "sig", "left_anti")


def unused_fields(fields: DataFrame, operands: DataFrame) -> DataFrame:
    """Fields that no operand reads or writes."""
    named = operands.select(F.regexp_extract("text", r"(<[^()>]+>)$", 1).alias("sig")).where("sig <> ''")
    return fields.join(named, "sig", "left_anti")


def repeated_expressions(cfg: DataFrame, computed: DataFrame, defs: DataFrame, parts: DataFrame, entry: DataFrame) -> DataFrame:
    """``method, node, expr``: computations of an expression that every path has computed already.

    ``computed(method, node, expr)``; ``parts(method, expr, local)`` are an expression's
    operands, whose definitions end its availability.
    """
    gen = computed.select("method", "node", F.col("expr").alias("fact"))
    kill = defs.join(parts, ["method", "local"]).select("method", "node", F.col("expr").alias("fact")).distinct()
    live = gen.join(kill, ["method", "node", "fact"], "left_anti")
    available = flow.must_flow(cfg, live, kill, entry)
    return computed.join(available.withColumnRenamed("fact", "expr"), ["method", "node", "expr"], "left_semi")


def loop_invariants(bodies: DataFrame, computed: DataFrame, operands: DataFrame, defs: DataFrame) -> DataFrame:
    """``method, head, node, expr``: computations in a loop none of whose operands the loop defines.

    ``bodies(method, head, node)``; ``operands(method, expr, local)``; expressions without
    operands are invariant everywhere.
    """
    inside = bodies.join(computed, ["method", "node"]).select("method", "head", "node", "expr")
    written = bodies.join(defs, ["method", "node"]).select("method", "head", "local").distinct()
    varies = written.join(operands, ["method", "local"]).select("method", "head", "expr").distinct()
    return inside.join(varies, ["method", "head", "expr"], "left_anti").select("method", "head", "node", "expr")


def bypassed(cfg: DataFrame, skipped: DataFrame) -> DataFrame:
    """``method, src, dst``: edges with the nodes of ``skipped(method, node)`` taken out: no-ops, and jumps that only lead to jumps.

    An edge into a run of such nodes goes to where the run leads; one that leads nowhere else, such
    as a jump to itself, is left out with its edge.
    """
    edges = cfg.select("method", "src", "dst").distinct()
    gone = skipped.select("method", F.col("node").alias("dst")).distinct()
    on = edges.join(gone.withColumnRenamed("dst", "src"), ["method", "src"], "left_semi").select("method", F.col("src").alias("dst"), F.col("dst").alias("to"))
    kept = edges.join(gone.withColumnRenamed("dst", "src"), ["method", "src"], "left_anti")

    def step(known: Relations, delta: Relations) -> Relations:
        return {"e": delta["e"].join(on, ["method", "dst"]).select("method", "src", F.col("to").alias("dst"))}

    return fixpoint({"e": kept}, step)["e"].join(gone, ["method", "dst"], "left_anti").select("method", "src", "dst")
