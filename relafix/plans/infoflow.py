"""Whole-program taint of textual code: facts of the reader to the tables of the analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relafix.operators import graph, infoflow, pointsto
from relafix.operators.fixpoint import Relations, fixpoint
from relafix.storage import stage_table


def node_of(method: str = "method", idx: str = "idx") -> Column:
    return F.concat(F.col(method), F.lit("#"), F.col(idx).cast("string"))


def _places(operands: DataFrame) -> DataFrame:
    """Operands as ``base`` and ``field``: locals by method, static fields by signature, elements as the field ``[]``."""
    name = F.regexp_extract("text", r"^([\w$#]+)", 1)
    base = F.when(F.col("kind") == "static_field", F.col("text")).otherwise(F.concat(F.col("method"), F.lit("#"), name))
    field = F.when(F.col("kind") == "field", F.regexp_extract("text", r"(<.*>)$", 1)).when(F.col("kind") == "array", F.lit("[]"))
    return operands.where("kind in ('local', 'field', 'static_field', 'array')").select("method", "idx", "role", "pos", base.alias("base"), field.alias("field"))


def call_edges(facts: dict[str, DataFrame]) -> DataFrame:
    """``method, idx, callee`` by class hierarchy, for callees that the facts have code of."""
    methods = facts["method"].select("sig", "class", "subsig", (~F.col("has_body")).alias("abstract"))
    parts = F.regexp_extract("target_sig", r"^<([^:]+): (.*)>$", 1), F.regexp_extract("target_sig", r"^<([^:]+): (.*)>$", 2)
    invokes = facts["invoke"].select("method", "idx", "kind", parts[0].alias("class"), parts[1].alias("subsig"))
    found = pointsto.class_hierarchy_calls(invokes, pointsto.subtypes(facts["class"]), pointsto.dispatch_table(facts["class"], methods))
    return found.select(F.col("src").alias("method"), "idx", F.col("tgt").alias("callee")).distinct()


def program(facts: dict[str, DataFrame], edges: DataFrame, models: DataFrame | None = None) -> infoflow.Program:
    """The tables of ``infoflow.analyse`` for ``facts`` and call edges ``method, idx, callee``.

    ``models(target_sig, src, dst)`` tells how calls without code pass taint between
    positions (-1 the receiver, -2 the result).  A call or throw that no trap covers
    leaves its method by a node of its own, which is the exceptional exit.
    """
    unit, cfg, operand = facts["unit"], facts["cfg"], facts["operand"]
    places = _places(operand)
    at = unit.select("method", "idx", F.col("kind").alias("unit"))
    calls = edges.select(node_of().alias("node"), "callee").distinct()
    calling = edges.select("method", "idx").distinct()
    away = F.concat("method", F.lit("#!"))

    defs, uses = places.where("role = 'def'"), places.where("role = 'use'")
    copied = defs.join(at.where("unit = 'assign'"), ["method", "idx"]).select("method", "idx", F.col("base").alias("to_base"), F.col("field").alias("to_field"))
    copies = copied.join(uses.select("method", "idx", F.col("base").alias("from_base"), F.col("field").alias("from_field")), ["method", "idx"])
    text = F.lit(None).cast("string")
    thrown = uses.join(at.where("unit = 'throw'"), ["method", "idx"]).select("method", "idx", F.lit(infoflow.THROWN).alias("to_base"), text.alias("to_field"), F.col("base").alias("from_base"), F.col("field").alias("from_field"))
    caught = operand.where("role = 'use' and text like '@caughtexception%'").select("method", "idx")
    catches = caught.join(defs, ["method", "idx"]).select("method", "idx", F.col("base").alias("to_base"), text.alias("to_field"), F.lit(infoflow.THROWN).alias("from_base"), text.alias("from_field"))
    assigns = copies.unionByName(thrown).unionByName(catches).select(node_of().alias("node"), "to_base", "to_field", "from_base", "from_field")

    invoke = facts["invoke"]
    given = operand.where("role = 'arg' and kind = 'local'").select("method", "idx", "pos", F.concat("method", F.lit("#"), "text").alias("base"))
    receiver = invoke.where("base is not null").select("method", "idx", F.lit(-1).alias("pos"), F.concat("method", F.lit("#"), "base").alias("base"))
    result = invoke.select("method", "idx").join(defs.where("field is null"), ["method", "idx"]).select("method", "idx", F.lit(-2).alias("pos"), "base")
    args = given.unionByName(receiver).unionByName(result)
    if models is not None:
        lone = invoke.join(calling, ["method", "idx"], "left_anti").select("method", "idx", "target_sig").join(models, "target_sig")
        modelled = lone.join(args.select("method", "idx", F.col("pos").alias("src"), F.col("base").alias("from_base")), ["method", "idx", "src"]).join(args.select("method", "idx", F.col("pos").alias("dst"), F.col("base").alias("to_base")), ["method", "idx", "dst"])
        # a model adds to what its receiver or argument has, so it goes by a field that stands for the whole
        assigns = assigns.unionByName(modelled.select(node_of().alias("node"), "to_base", text.alias("to_field"), "from_base", text.alias("from_field")))
        assigns = assigns.unionByName(modelled.where("dst >= -1").select(node_of().alias("node"), "to_base", text.alias("to_field"), F.col("to_base").alias("from_base"), text.alias("from_field")))

    renewed = defs.where("field is null").join(at.where("unit = 'assign'"), ["method", "idx"]).select(node_of().alias("node"), "base")
    kills = renewed.unionByName(caught.select(node_of().alias("node"), F.lit(infoflow.THROWN).alias("base")))

    position = F.when(F.col("text").startswith("@this"), F.lit(-1)).otherwise(F.regexp_extract("text", r"^@parameter(\d+)", 1).try_cast("int"))
    entered = operand.where("role = 'use' and kind = 'param' and text not like '@caughtexception%'").select("method", "idx", position.alias("pos")).where("pos is not null")
    params = entered.join(defs.select("method", "idx", "base"), ["method", "idx"]).select("method", "pos", "base")
    params = params.union(uses.join(at.where("unit = 'return'"), ["method", "idx"]).where("field is null").select("method", F.lit(-2), "base"))

    covered = at.join(facts["trap"], "method").where("idx >= begin and idx < end").select("method", "idx", F.concat("method", F.lit("#"), F.col("handler").cast("string")).alias("to"))
    escaping = covered.union(at.select("method", "idx", away.alias("to")))
    throws = at.where("unit = 'throw'").select("method", "idx")
    flow = cfg.join(calling.withColumnRenamed("idx", "src"), ["method", "src"], "left_anti").select(node_of("method", "src").alias("src"), node_of("method", "dst").alias("dst"))
    flow = flow.union(escaping.join(throws, ["method", "idx"], "left_semi").select(node_of().alias("src"), F.col("to").alias("dst")))
    normal = cfg.join(calling.withColumnRenamed("idx", "src"), ["method", "src"], "left_semi").select(node_of("method", "src").alias("call"), node_of("method", "dst").alias("site"), F.lit("normal").alias("kind"))
    returns = normal.union(escaping.join(calling, ["method", "idx"], "left_semi").select(node_of().alias("call"), F.col("to").alias("site"), F.lit("thrown").alias("kind")))

    exits = at.where("unit = 'return'").select("method", node_of().alias("node"), F.lit("normal").alias("kind")).union(at.select("method", away.alias("node"), F.lit("thrown")).distinct())
    return infoflow.Program(
        nodes=at.select(node_of().alias("node"), "method").union(at.select(away.alias("node"), "method").distinct()),
        cfg=flow,
        assigns=assigns,
        kills=kills,
        calls=calls,
        returns=returns,
        exits=exits,
        starts=at.groupBy("method").agg(F.min("idx").alias("idx")).select("method", node_of().alias("node")),
        args=args.select(node_of().alias("node"), "pos", "base"),
        params=params,
        statics=operand.where("kind = 'static_field'").select(F.col("text").alias("base")).distinct(),
    )


def control_dependence(facts: dict[str, DataFrame]) -> DataFrame:
    """``method, branch, node``: statements that run or not by what a branch decides, over branches under branches too.

    These are the dominance frontiers of the graph turned round, from one exit for each method.
    """
    flow = facts["cfg"].select("method", "src", "dst")
    out = facts["unit"].where("kind in ('return', 'throw')").select("method", F.col("idx").alias("src"), F.lit(-1).alias("dst"))
    back = stage_table(flow.union(out).select("method", F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), "back")
    dom = graph.dominators(back, out.select("method", F.col("dst").alias("node")).distinct(), ("method",))
    direct = stage_table(graph.dominance_frontier(back, dom, ("method",)).select("method", F.col("frontier").alias("branch"), "node"), "direct")

    def step(known: Relations, delta: Relations) -> Relations:
        under = direct.select("method", F.col("branch").alias("node"), F.col("node").alias("inner"))
        return {"c": delta["c"].join(under, ["method", "node"]).select("method", "branch", F.col("inner").alias("node"))}

    return fixpoint({"c": direct}, step)["c"]


def implicit_flows(facts: dict[str, DataFrame]) -> infoflow.Implicit:
    """The tables of flows through conditions."""
    conds = facts["operand"].where("role = 'cond' and kind = 'local'").select(node_of().alias("node"), F.concat("method", F.lit("#"), "text").alias("base"))
    dependent = control_dependence(facts).select(node_of("method", "branch").alias("branch"), node_of("method", "node").alias("node"))
    assigned = _places(facts["operand"]).where("role = 'def'").join(facts["unit"].where("kind = 'assign'").select("method", "idx"), ["method", "idx"])
    return infoflow.Implicit(conds, dependent, assigned.select(node_of().alias("node"), F.col("base").alias("to_base"), F.col("field").alias("to_field")))


def leaks(facts: dict[str, DataFrame], sources: DataFrame, sinks: DataFrame, models: DataFrame | None = None, limit: int = 5, aliases: bool = True, implicit: bool = False) -> DataFrame:
    """``origin, sink``: calls of ``sources(sig)`` whose result reaches an argument of a call of ``sinks(sig)``.

    With ``implicit`` also those that decide what an argument is, or whether the call is made.
    """
    p = program(facts, call_edges(facts), models)
    invoke = facts["invoke"]
    start = invoke.join(sources.withColumnRenamed("sig", "target_sig"), "target_sig", "left_semi").select(node_of().alias("node")).join(p.args.where("pos = -2").select("node", "base"), "node")
    ends = invoke.join(sinks.withColumnRenamed("sig", "target_sig"), "target_sig", "left_semi").select(node_of().alias("node"))
    end = ends.join(p.args.where("pos >= -1").select("node", "base"), "node")
    through = implicit_flows(facts) if implicit else None
    found = infoflow.analyse(p, start, limit, aliases, implicit=through)
    told = infoflow.leaks(found, p.nodes, end).select("origin", "sink")
    if through is not None:
        under = through.dependent.select("branch", F.col("node").alias("under")).join(ends.withColumnRenamed("node", "under"), "under")
        decided = through.conds.withColumnRenamed("node", "branch").join(under, "branch").select("branch", "base", "under")
        by_branch = infoflow.leaks(found, p.nodes, decided.select(F.col("branch").alias("node"), "base"))
        told = told.union(by_branch.join(decided.select(F.col("branch").alias("sink"), "base", "under"), ["sink", "base"]).select("origin", F.col("under").alias("sink")))
    return told.distinct()
