"""Field-sensitive tabulation: facts are access paths whose unread part stays symbolic.

A method is entered with a name alone; what lies below it is an unknown tail.  An edge says that
whatever tail comes in, it arrives with the edge's path before it.  Only a read of a field that
no path names asks who called whether a tail begins with that field.  The callers that know answer, those whose own
tail it would be ask theirs, and an edge of the narrower context starts where the question was put.  So methods are
entered once however deep the structures are that they are given, and paths need no limit.

Paths are text: each field is followed by a dot.  ``$`` at the end says that nothing follows, ``*`` that anything may;
without either the tail is unknown.  Where a loop or a recursion stores an object into itself over
and over, ``widen`` fields are kept and what is below them becomes ``*``, and no question is longer than that either;
this is the only over-approximation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relafix.operators import alike
from relafix.operators.fixpoint import Relations, fixpoint
from relafix.storage import stage_table

_CONTEXT = ["method", "entry", "prefix"]
_EDGE = [*_CONTEXT, "node", "base", "path", "excluded"]


@dataclass
class Program:
    """Tables of a program.

    ``nodes(node, method)``; ``cfg(src, dst)`` inside methods, not out of calls; ``assigns(node, to_base, to_field, from_base, from_field)``, fields null
    for whole variables; ``kills(node, base)`` variables that get a new value; ``overwrites(node, base, field)`` fields that surely do.
    ``calls(node, callee)``, ``returns(call, site)``, ``starts(method, node)``, ``exits(method, node)``; ``args(node, pos, base)``
    and ``params(method, pos, base)``, position -2 the result.  What a call must not carry past itself is in ``kills``.
    """

    nodes: DataFrame
    cfg: DataFrame
    assigns: DataFrame
    kills: DataFrame
    overwrites: DataFrame
    calls: DataFrame
    returns: DataFrame
    starts: DataFrame
    exits: DataFrame
    args: DataFrame
    params: DataFrame

    def staged(self) -> Program:
        """Written once, without repeated rows, so that rounds do not derive the tables again and Spark knows their sizes."""
        columns = {
            "nodes": ["node", "method"],
            "cfg": ["src", "dst"],
            "assigns": ["node", "to_base", "to_field", "from_base", "from_field"],
            "kills": ["node", "base"],
            "overwrites": ["node", "base", "field"],
            "calls": ["node", "callee"],
            "returns": ["call", "site"],
            "starts": ["method", "node"],
            "exits": ["method", "node"],
            "args": ["node", "pos", "base"],
            "params": ["method", "pos", "base"],
        }
        return Program(**{name: stage_table(getattr(self, name).select(*cols).distinct(), name) for name, cols in columns.items()})


def is_open(path: Column) -> Column:
    """Whether an unknown tail follows."""
    return ~path.endswith("$") & ~path.endswith("*")


def first_field(path: Column) -> Column:
    """The first field; null where a path names none."""
    name = F.substring_index(path, ".", 1)
    return F.when(F.instr(path, ".") > 0, name)


def _excludes(excluded: Column, field: Column) -> Column:
    return F.array_contains(excluded, F.coalesce(field, F.lit("")))


def remainder(path: Column, prefix: Column) -> Column:
    """What follows ``prefix`` in ``path``; null where the path does not begin with it."""
    anything = path.endswith("*") & prefix.startswith(F.expr("left(path, length(path) - 1)"))
    return F.when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1)).when(anything, F.lit("*"))


def widened(path: Column, most: int) -> Column:
    """``path`` with at most ``most`` fields, ``*`` for those below."""
    kept = F.concat(F.substring_index(path, ".", most), F.lit(".*"))
    return F.when(n_fields(path) > most, kept).otherwise(path)


def n_fields(path: Column) -> Column:
    """How many fields a path names."""
    return F.length(path) - F.length(F.replace(path, F.lit("."), F.lit("")))


def _none() -> Column:
    return F.array().cast("array<string>")


def analyse(program: Program, seeds: DataFrame, widen: int = 32, max_rounds: int = 1000) -> Relations:
    """All that ``seeds(method, node, base, path)`` reach, as ``edge`` and the relations behind it.

    A seed's path is text such as ``f.g.`` and names the value exactly.  ``edge`` has ``method, entry, prefix`` (the
    context: the name a method was entered with and what of the tail was asked for; ``0`` and ``$`` for seeds),
    ``node``, ``base``, ``path`` and ``excluded`` (fields the tail does not begin with), all before the node.  ``incoming``
    holds what calls pass in, ``paused`` the edges that wait for an answer, ``asked`` and ``supported`` questions and those
    with a yes, ``link`` which question of a caller decides one of its callee.  Nodes without a
    method in ``calls`` step to their successors; empty tables give what the seeds reach without them.
    """
    p = program.staged()
    entered = p.params.withColumnsRenamed({"method": "callee", "base": "param"})
    ways_in = p.calls.join(p.args, "node").join(entered, ["callee", "pos"]).where("pos <> -2").select("node", "callee", "base", F.col("param").alias("into"))
    ways_in = stage_table(ways_in.distinct(), "ways_in")
    back = p.calls.join(p.args, "node").join(entered, ["callee", "pos"]).join(p.returns, F.col("node") == F.col("call"))
    back = stage_table(back.select("call", "callee", F.col("param").alias("out"), "site", F.col("base").alias("to"), (F.col("pos") == -2).alias("result")).distinct(), "back")
    over_all = stage_table(p.overwrites.groupBy("node", "base").agg(F.collect_set("field").alias("over")), "over")
    outward = stage_table(back.join(p.nodes.withColumnsRenamed({"node": "call", "method": "c_method"}), "call"), "outward")
    steps = stage_table(p.cfg.union(p.returns).select(F.col("src").alias("node"), "dst").distinct(), "steps")
    starts, exits = p.starts.select(F.col("method").alias("callee"), F.col("node").alias("start")), p.exits.select("node").distinct()

    def moved(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges behind the statements of ``edges``, and those that wait for what their tail begins with."""
        path, excluded = F.col("path"), F.col("excluded")
        kept = edges.join(p.kills, ["node", "base"], "left_anti").join(over_all, ["node", "base"], "left")
        over = F.coalesce("over", _none())
        narrowed = F.when(path == "", F.array_sort(F.array_union(excluded, over))).otherwise(excluded)
        kept = kept.where(~F.array_contains(over, F.coalesce(first_field(path), F.lit("")))).select(*_CONTEXT, "node", "base", "path", narrowed.alias("excluded"))
        made = edges.join(p.assigns.withColumnRenamed("from_base", "base"), ["node", "base"])
        read, to = F.col("from_field"), F.coalesce(F.concat("to_field", F.lit(".")), F.lit(""))
        below = F.when(read.isNull(), path).when(path.startswith(F.concat(read, F.lit("."))), F.substr(path, F.length(read) + 2)).when(path == "*", path)
        told = made.where(below.isNotNull()).select(*_CONTEXT, "node", F.col("to_base").alias("base"), widened(F.concat(to, below), widen).alias("path"), "excluded")
        unknown = made.where((path == "") & read.isNotNull() & ~_excludes(excluded, read))
        deep = n_fields(F.col("prefix")) >= widen
        waits = unknown.where(~deep).select("method", "entry", F.concat("prefix", "from_field", F.lit(".")).alias("prefix"), "node", F.col("to_base").alias("base"), to.alias("path"), _none().alias("excluded"))
        told = told.unionByName(unknown.where(deep).select(*_CONTEXT, "node", F.col("to_base").alias("base"), F.concat(to, F.lit("*")).alias("path"), _none().alias("excluded")))

        def on(rows: DataFrame) -> DataFrame:
            return rows.join(steps, "node").drop("node").withColumnRenamed("dst", "node").select(*_EDGE)

        return on(kept.unionByName(told)), on(waits)

    def questions(incoming: DataFrame, asked: DataFrame) -> DataFrame:
        """Each question with each call that may answer it: ``rest`` is what of the call's path is left, ``need`` what its caller must be asked for."""
        met = incoming.join(asked, ["method", "entry"])
        path, prefix = F.col("path"), F.col("prefix")
        need = F.when(is_open(path) & prefix.startswith(path) & (F.length(prefix) > F.length(path)), F.substr(prefix, F.length(path) + 1))
        met = met.withColumn("rest", remainder(path, prefix)).withColumn("need", need).where("rest is not null or need is not null")
        return met.where(F.col("need").isNull() | ~_excludes(F.col("excluded"), first_field(F.col("need"))))

    def returned(incoming: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges at return sites, and those that wait for the caller's own tail."""
        ends = ends.select("method", "entry", "prefix", F.col("base").alias("out"), F.col("path").alias("left"), F.col("excluded").alias("barred"))
        met = questions(incoming, ends).withColumnRenamed("method", "callee").join(back, ["call", "callee", "out"])
        closed = ~is_open(F.col("left"))
        fits = closed | ~_excludes(F.col("barred"), first_field(F.col("rest")))
        path = F.when(closed, F.col("left")).otherwise(F.concat("left", "rest"))
        barred = F.when(closed, _none()).when(F.col("rest") == "", F.array_sort(F.array_union("barred", "excluded"))).otherwise(F.col("excluded"))
        caller = [F.col("c_method").alias("method"), F.col("c_entry").alias("entry")]
        told = met.where(F.col("rest").isNotNull() & fits).where(F.col("result") | (path != "$")).select(*caller, F.col("c_prefix").alias("prefix"), F.col("site").alias("node"), F.col("to").alias("base"), widened(path, widen).alias("path"), barred.alias("excluded"))
        deep = n_fields(F.concat("c_prefix", "need")) > widen
        guessed = met.where(deep).select(*caller, F.col("c_prefix").alias("prefix"), F.col("site").alias("node"), F.col("to").alias("base"), F.when(closed, F.col("left")).otherwise(F.concat("left", F.lit("*"))).alias("path"), _none().alias("excluded"))
        told = told.unionByName(guessed)
        waits = met.where(~deep).select(*caller, F.concat("c_prefix", "need").alias("prefix"), F.col("site").alias("node"), F.col("to").alias("base"), F.col("left").alias("path"), F.col("barred").alias("excluded"))
        return told, waits

    def called(edges: DataFrame) -> DataFrame:
        into = edges.join(ways_in, ["node", "base"])
        return into.select(F.col("callee").alias("method"), F.col("into").alias("entry"), F.col("node").alias("call"), F.col("method").alias("c_method"), F.col("entry").alias("c_entry"), F.col("prefix").alias("c_prefix"), "path", "excluded")

    def step(known: Relations, delta: Relations) -> Relations:
        new = delta["edge"]
        on, waits = moved(new)
        into = called(new)
        begun = into.withColumnRenamed("method", "callee").join(starts, "callee").select(F.col("callee").alias("method"), "entry", F.lit("").alias("prefix"), F.col("start").alias("node"), F.col("entry").alias("base"), F.lit("").alias("path"), _none().alias("excluded"))
        met = questions(delta["incoming"], known["asked"]).unionByName(questions(known["incoming"], delta["asked"]))
        above = met.where("need is not null").select(*_CONTEXT, "c_method", "c_entry", F.concat("c_prefix", "need").alias("c_prefix"), (n_fields(F.col("need")) == 1).alias("next"))
        link, deep = above.where(n_fields(F.col("c_prefix")) <= widen), above.where(n_fields(F.col("c_prefix")) > widen)
        news, olds = new.join(exits, "node", "left_semi"), known["edge"].join(exits, "node", "left_semi")
        told, held = returned(delta["incoming"], olds)
        told_too, held_too = returned(known["incoming"], news)

        # an own end of a method that holds a seed goes to all who call it
        lone = news.where("entry = '0'").select(F.col("method").alias("callee"), F.col("base").alias("out"), "path", "excluded").join(outward, ["callee", "out"]).where(F.col("result") | (F.col("path") != "$"))
        lone = lone.select(F.col("c_method").alias("method"), F.lit("0").alias("entry"), F.lit("$").alias("prefix"), F.col("site").alias("node"), F.col("to").alias("base"), "path", "excluded")
        upper = ["c_method", "c_entry", "c_prefix"]

        def yes(links: DataFrame, supported: DataFrame) -> DataFrame:
            return links.join(supported.toDF(*upper), upper, "left_semi").select(*_CONTEXT)

        def further(links: DataFrame, supported: DataFrame) -> DataFrame:
            """Longer questions wait until the one without their last field has a yes, so they are no longer than what callers hold."""
            shorter = links.where("not next").withColumn("shorter", F.regexp_replace("c_prefix", r"[^.]+\.$", ""))
            return shorter.join(supported.toDF("c_method", "c_entry", "shorter"), ["c_method", "c_entry", "shorter"], "left_semi").select(*upper)

        resumed = delta["paused"].join(known["supported"], _CONTEXT, "left_semi").unionByName(known["paused"].join(delta["supported"], _CONTEXT, "left_semi"))
        paused = waits.unionByName(held).unionByName(held_too)
        return {
            "edge": on.unionByName(begun).unionByName(told).unionByName(told_too).unionByName(lone).unionByName(resumed.select(*_EDGE)),
            "incoming": into,
            "paused": paused,
            "asked": delta["paused"].select(*_CONTEXT).union(delta["link"].where("next").select(*upper)).union(further(delta["link"], known["supported"])).union(further(known["link"], delta["supported"])),
            "link": link,
            "supported": met.where("rest is not null").select(*_CONTEXT).union(deep.select(*_CONTEXT)).union(yes(delta["link"], known["supported"])).union(yes(known["link"], delta["supported"])),
        }

    edge = seeds.select("method", F.lit("0").alias("entry"), F.lit("$").alias("prefix"), "node", "base", F.concat(F.coalesce("path", F.lit("")), F.lit("$")).alias("path"), _none().alias("excluded"))
    context = edge.limit(0).select(*_CONTEXT)
    none = {
        "incoming": called(edge).limit(0),
        "paused": edge.limit(0),
        "asked": context,
        "link": context.select("*", F.col("method").alias("c_method"), F.col("entry").alias("c_entry"), F.col("prefix").alias("c_prefix"), F.lit(True).alias("next")),
        "supported": context,
    }
    return fixpoint({"edge": edge} | none, step, max_rounds)


def reached(found: Relations, sinks: DataFrame) -> DataFrame:
    """``node, base, prefix, path``: edges whose value itself arrives at ``sinks(node, base)``.

    An open path may end where it is only if some call passes exactly what was asked for, so it counts where
    a call's path is its context's prefix and then nothing, or an open path that callers end there.
    """
    edge = found["edge"].join(sinks.select("node", "base").distinct(), ["node", "base"], "left_semi")
    whole = edge.where(F.col("path").isin("$", "*"))
    bare = edge.where("path = ''")
    ends = ending(found)
    return whole.unionByName(bare.join(ends, _CONTEXT, "left_semi")).select("node", "base", "prefix", "path").distinct()


def ending(found: Relations, max_rounds: int = 1000) -> DataFrame:
    """``method, entry, prefix``: contexts some caller enters with exactly that path and nothing below."""
    incoming = found["incoming"]
    contexts = stage_table(found["supported"].union(incoming.select("method", "entry", F.lit(""))).distinct(), "contexts")
    met = contexts.join(incoming, ["method", "entry"])
    seeds = met.where(remainder(F.col("path"), F.col("prefix")).isin("$", "*")).select(*_CONTEXT)
    same = met.where("path = prefix").select(*_CONTEXT, "c_method", "c_entry", "c_prefix")
    up = stage_table(same.union(found["link"].drop("next").select(*same.columns)).distinct(), "up")

    def step(known: Relations, delta: Relations) -> Relations:
        return {"e": up.join(delta["e"].toDF("c_method", "c_entry", "c_prefix"), ["c_method", "c_entry", "c_prefix"], "left_semi").select(*_CONTEXT)}

    return fixpoint({"e": seeds}, step, max_rounds)["e"]


def program_reached(p: Program, seeds: DataFrame, sinks: DataFrame, widen: int = 32, max_rounds: int = 1000) -> DataFrame:
    """``reached`` of ``analyse``, of methods that are alike and not called one analysed for all of them."""
    tables = {
        "cfg": alike.Rows(p.cfg, "src", ["dst"]),
        "assigns": alike.Rows(p.assigns, "node", ["to_base", "from_base"]),
        "kills": alike.Rows(p.kills, "node", ["base"]),
        "overwrites": alike.Rows(p.overwrites, "node", ["base"]),
        "calls": alike.Rows(p.calls, "node"),
        "returns": alike.Rows(p.returns, "call", ["site"]),
        "starts": alike.Rows(p.starts, "method", ["node"]),
        "exits": alike.Rows(p.exits, "method", ["node"]),
        "args": alike.Rows(p.args, "node", ["base"]),
        "params": alike.Rows(p.params, "method", ["base"]),
        "seeds": alike.Rows(seeds, "method", ["node", "base"]),
        "sinks": alike.Rows(sinks, "node", ["base"]),
    }
    less, copies = alike.kept(tables, p.nodes, p.calls.select("callee"), p.nodes.select(F.col("node").alias("base")).limit(0))
    seeds, sinks = less.pop("seeds"), stage_table(less.pop("sinks"), "sinks")
    found = reached(analyse(Program(nodes=copies.nodes, **less), seeds, widen, max_rounds), sinks)
    return copies.spread(stage_table(found, "found"), {"node": ["base"]})
