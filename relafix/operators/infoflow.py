"""Whole-program taint: access paths over calls and returns, with an alias search.

Two relations grow together.  ``fwd`` holds taints before a node.  ``bwd`` holds other
names that the target of a heap write may have had before it; it runs against the flow
from the write and sends every name it finds forward as an inactive taint, which no sink
sees until it passes the write it waits for, or a call that led there.

Both are tabulated: a fact in a method belongs to a context, the fact with which the
method was entered, so callers do not mix, and what a method does with an entry fact is
derived once for all callers.  A source opens a context of its own, which goes back to
whoever may have called its method.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relafix.operators import alike
from relafix.operators.fixpoint import Relations, fixpoint
from relafix.operators.taint import appended
from relafix.storage import stage_table

#: The base of an exception's path between the throw and the catch.
THROWN = "!"

_FACT = ["base", "fields", "cut", "act"]
_ROW = ["ctx", "ctx_act", "node", *_FACT]


@dataclass
class Program:
    """Tables of a whole program; nodes, methods and bases are strings, and locals' names tell their method.

    ``nodes(node, method)``; ``cfg(src, dst)`` edges out of nodes that are no calls, those of
    thrown exceptions included; ``assigns(node, to_base, to_field, from_base, from_field)``
    copies (a null field: the base itself; the field ``[]``, an element, is never overwritten), ``kills(node, base)`` bases that get something new
    (allocations, constants); ``calls(node, callee)``, ``returns(call, site, kind)`` and
    ``exits(method, node, kind)`` with the kind ``normal`` or ``thrown``; ``starts(method, node)``;
    ``args(node, pos, base)`` and ``params(method, pos, base)`` with position -1 for the receiver and
    -2 for the result; ``statics(base)``.  A throw copies to the base ``THROWN``, a catch copies from it and
    kills it.  Calls without a callee are nodes like others, whose assigns model them.
    """

    nodes: DataFrame
    cfg: DataFrame
    assigns: DataFrame
    kills: DataFrame
    calls: DataFrame
    returns: DataFrame
    exits: DataFrame
    starts: DataFrame
    args: DataFrame
    params: DataFrame
    statics: DataFrame

    def staged(self) -> Program:
        """Every table written once, so that rounds do not derive them again."""
        return Program(**{n: stage_table(getattr(self, n).distinct(), n) for n in self.__dataclass_fields__})


def _none() -> Column:
    return F.array().cast("array<string>")


def _rest(n: int = 1) -> Column:
    return F.slice("fields", F.lit(n + 1), F.greatest(F.size("fields") - n, F.lit(0)))


def _ctx(way: str) -> Column:
    """The name of a context: its way (forward or backward) and the fact at its border."""
    return F.concat_ws("\x01", F.lit(way), "base", F.concat_ws("\x02", "fields"), F.col("cut").cast("string"), F.coalesce("act", F.lit("")))


def _through(rows: DataFrame, head: Column, rest: Column, limit: int, base: str = "to_base") -> DataFrame:
    """``rows`` whose path becomes ``base`` with ``head`` before ``rest``."""
    path, was_cut = appended(head, rest, limit)
    return rows.withColumn("path", path).withColumn("cut", F.col("cut") | was_cut).withColumn("base", F.col(base)).drop("fields").withColumnRenamed("path", "fields")


def _field(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.array(name)).otherwise(_none())


@dataclass
class Implicit:
    """Tables of flows through conditions: ``conds(node, base)`` what a branch asks, ``dependent(branch, node)``
    what runs or not by a branch, ``writes(node, to_base, to_field)`` everything that nodes assign.
    """

    conds: DataFrame
    dependent: DataFrame
    writes: DataFrame


def analyse(p: Program, sources: DataFrame, limit: int = 5, aliases: bool = True, max_rounds: int = 1000, implicit: Implicit | None = None) -> Relations:
    """``fwd``, ``bwd`` (``ctx, ctx_act, node, base, fields, cut, act``), ``inc(callee, ctx, call, up_ctx, up_act)``, ``ends`` and ``above(act, call)``.

    ``sources(node, base)`` taint after their node; if that is a call, at its return sites.
    ``act`` is null for an active taint, else the write it waits for.  Paths are cut after ``limit`` fields.
    ``above`` tells which calls led to a write whose other names went up to callers.  With ``implicit``
    whatever is assigned under a branch on something tainted is tainted too, in the branch's own method.
    Null nodes and bases derive nothing; repeated rows count once.
    """
    p = p.staged()
    on_call = p.calls.select("node").distinct()
    succ = stage_table(p.cfg.select(F.col("src").alias("node"), "dst").union(p.returns.select("call", "site")).distinct(), "succ")
    pred = stage_table(p.cfg.select(F.col("dst").alias("node"), F.col("src").alias("from_node")).distinct(), "pred")
    overwritten = stage_table(p.assigns.where("to_field is null").select("node", F.col("to_base").alias("base")).union(p.kills.select("node", "base")).distinct(), "overwritten")
    stores = stage_table(p.assigns.where("to_field <> '[]'").select("node", F.col("to_base").alias("base"), F.col("to_field").alias("field")).distinct(), "stores")
    statics = p.statics
    passed = p.args.where("pos >= -1")
    # a parameter that its method assigns is no longer the caller's argument at the exit
    kept_params = stage_table(p.params.where("pos >= -1").join(p.assigns.where("to_field is null").select(F.col("to_base").alias("base")), "base", "left_anti"), "kept_params")
    back_of = stage_table(p.params.where("pos = -2").select("method", "base", "pos").union(kept_params.select("method", "base", "pos")).distinct(), "back_of")
    links = stage_table(p.calls.withColumnRenamed("node", "call").join(p.args.withColumnRenamed("node", "call"), "call").join(p.params.select(F.col("method").alias("callee"), "pos", F.col("base").alias("inner")), ["callee", "pos"]).select("call", "callee", "pos", F.col("base").alias("outer"), "inner"), "links")

    if implicit is not None:
        implicit = Implicit(*(stage_table(getattr(implicit, n).distinct(), n) for n in ("conds", "dependent", "writes")))

    def implied(rows: DataFrame) -> DataFrame:
        """What is assigned under branches on active taints."""
        asked = rows.where("act is null").join(implicit.conds, ["node", "base"]).select("ctx", "ctx_act", F.col("node").alias("branch")).distinct()
        under = asked.join(implicit.dependent, "branch").join(implicit.writes, "node")
        return under.select("ctx", "ctx_act", "node", F.col("to_base").alias("base"), _field("to_field").alias("fields"), F.lit(False).alias("cut"), F.lit(None).cast("string").alias("act"), "to_field")

    def source_facts() -> DataFrame:
        return sources.join(succ, "node").select(F.concat(F.lit("@"), "node").alias("ctx"), F.lit(None).cast("string").alias("ctx_act"), F.col("dst").alias("node"), "base", _none().alias("fields"), F.lit(False).alias("cut"), F.lit(None).cast("string").alias("act"))

    def survived(rows: DataFrame) -> DataFrame:
        """Facts that a node does not overwrite."""
        left = rows.join(overwritten, ["node", "base"], "left_anti").withColumn("field", F.get("fields", F.lit(0)))
        return left.join(stores, ["node", "base", "field"], "left_anti").drop("field")

    def moved(rows: DataFrame) -> DataFrame:
        """What the copies of a node make of facts before it, with the field written."""
        got = rows.withColumnRenamed("base", "from_base").join(p.assigns, ["node", "from_base"])
        first, whole = F.get("fields", F.lit(0)), F.size("fields") == 0
        got = got.where(F.col("from_field").isNull() | (first == F.col("from_field")) | (whole & F.col("cut")))
        rest = F.when(F.col("from_field").isNotNull() & ~whole, _rest()).otherwise(F.col("fields"))
        return _through(got, _field("to_field"), rest, limit)

    def activated(rows: DataFrame, above: DataFrame) -> DataFrame:
        """Facts after their node: at the write itself they are active, at a call that led there they may be."""
        own = rows.withColumn("act", F.when(F.col("act") != F.col("node"), F.col("act")))
        led = rows.where("act is not null").join(above.withColumnRenamed("call", "node"), ["act", "node"], "left_semi").withColumn("act", F.lit(None).cast("string"))
        return own.select(*_ROW).union(led.select(*_ROW))

    def on(rows: DataFrame) -> DataFrame:
        return rows.join(succ, "node").select("ctx", "ctx_act", F.col("dst").alias("node"), *_FACT)

    def bypassed(rows: DataFrame) -> DataFrame:
        """Facts at calls that the callees cannot change: neither the result's, nor below an argument, nor static."""
        mine = rows.join(on_call, "node", "left_semi")
        left = mine.join(p.args.where("pos = -2").select("node", "base"), ["node", "base"], "left_anti").join(statics, "base", "left_anti")
        below = left.where(F.size("fields") > 0).join(passed.select("node", "base"), ["node", "base"], "left_anti")
        return left.where((F.size("fields") == 0)).select(*_ROW).union(below.select(*_ROW))

    def entering(rows: DataFrame, positions: str, way: str) -> DataFrame:
        """Facts of arguments (or results) as the callees name them, with the new context."""
        at = rows.withColumnRenamed("node", "call").withColumnRenamed("base", "outer").join(links.where(positions), ["call", "outer"])
        at = at.select("call", "callee", F.col("ctx").alias("up_ctx"), F.col("ctx_act").alias("up_act"), F.col("inner").alias("base"), "fields", "cut", "act")
        shared = rows.withColumnRenamed("node", "call").join(statics, "base").join(p.calls.withColumnRenamed("node", "call"), "call")
        at = at.union(shared.select("call", "callee", F.col("ctx").alias("up_ctx"), F.col("ctx_act").alias("up_act"), "base", "fields", "cut", "act"))
        return at.withColumn("ctx", _ctx(way)).withColumn("ctx_act", F.col("act"))

    def callers(inner: DataFrame, inc: DataFrame) -> DataFrame:
        """``inner(callee, ctx, ..)`` with every call it came from; a source's context came from any call."""
        known = inner.join(inc, ["callee", "ctx"])
        return known.select(*inner.columns, "call", "up_ctx", "up_act")

    def any_callers(inner: DataFrame) -> DataFrame:
        free = inner.where(F.col("ctx").startswith("@")).join(p.calls.select(F.col("node").alias("call"), "callee"), "callee")
        return free.select(*inner.columns, "call", F.col("ctx").alias("up_ctx"), F.lit(None).cast("string").alias("up_act"))

    def returned(ended: DataFrame) -> DataFrame:
        """Facts at the exits, as callers name them, at the return sites of their kind."""
        local = ended.withColumnRenamed("base", "inner").join(links, ["call", "callee", "inner"]).where("pos = -2 or size(fields) > 0").withColumnRenamed("outer", "base")
        shared = ended.join(statics, "base", "left_semi").unionByName(ended.where(F.col("base") == THROWN))
        both = local.select(*ended.columns).unionByName(shared)
        act = F.when(F.col("act") == F.col("ctx_act"), F.when(F.col("act") != F.col("call"), F.col("act")))
        return both.join(p.returns, ["call", "kind"]).select(F.col("up_ctx").alias("ctx"), F.col("up_act").alias("ctx_act"), F.col("site").alias("node"), "base", "fields", "cut", act.alias("act"))

    def rising(at_start: DataFrame) -> DataFrame:
        """Other names at a method's start, as callers name them."""
        local = at_start.withColumnRenamed("base", "inner").join(links.where("pos >= -1"), ["call", "callee", "inner"]).withColumnRenamed("outer", "base")
        return local.select(*at_start.columns).unionByName(at_start.join(statics, "base", "left_semi"))

    def step(known: Relations, delta: Relations) -> Relations:
        new, above = delta["fwd"], known["above"]
        plain = new.join(on_call, "node", "left_anti")
        copied = moved(plain)
        entered = entering(new, "pos >= -1", "f")
        late = known["fwd"].where("act is not null").join(delta["above"].withColumnRenamed("call", "node"), ["act", "node"], "left_semi")
        forward = [
            on(activated(survived(plain), above)),
            on(activated(copied, above)),
            on(activated(bypassed(new), above)),
            on(activated(bypassed(late), delta["above"])),
            entered.join(p.starts.withColumnRenamed("method", "callee"), "callee").select(*_ROW),
            returned(callers(delta["ends"], known["inc"])),
            returned(callers(known["ends"], delta["inc"])),
            returned(any_callers(delta["ends"])),
        ]
        if implicit is not None:
            under = implied(new)
            forward.append(on(under))
            copied = copied.select(*under.columns).union(under)
        incoming = [entered]
        at_exit = new.join(p.exits, "node").select(F.col("method").alias("callee"), "ctx", "ctx_act", "kind", *_FACT)
        own = at_exit.join(back_of.withColumnRenamed("method", "callee"), ["callee", "base"], "left_semi")
        ends = own.unionByName(at_exit.join(statics, "base", "left_semi")).unionByName(at_exit.where(F.col("base") == THROWN))
        out = {"ends": ends.where("kind = 'thrown' or base <> '!'")}
        if aliases:
            written = copied.where("to_field is not null")
            spawned = written.withColumn("act", F.coalesce("act", "node")).select(*_ROW)
            back = delta["bwd"]
            before = back.join(pred, "node").withColumn("after", F.col("node")).withColumn("node", F.col("from_node")).drop("from_node")
            deep = (F.size("fields") > 1) | F.col("cut")
            # what stood on the left is from here on known by what stood on the right
            left = before.withColumnRenamed("base", "to_base").join(p.assigns, ["node", "to_base"])
            left = left.where(F.col("to_field").isNull() | ((F.get("fields", F.lit(0)) == F.col("to_field")) & deep))
            left = _through(left, _field("from_field"), F.when(F.col("to_field").isNull(), F.col("fields")).otherwise(_rest()), limit, "from_base")
            # what stood on the right has the left as another name after the node
            right = before.withColumnRenamed("base", "from_base").join(p.assigns, ["node", "from_base"])
            right = right.where(F.col("from_field").isNull() | ((F.get("fields", F.lit(0)) == F.col("from_field")) & deep))
            right = _through(right, _field("to_field"), F.when(F.col("from_field").isNull(), F.col("fields")).otherwise(_rest()), limit)
            replaced = stores.withColumnRenamed("field", "first")
            stay = before.join(overwritten, ["node", "base"], "left_anti").withColumn("first", F.when(deep, F.get("fields", F.lit(0)))).join(replaced, ["node", "base", "first"], "left_anti")
            # over calls: names of arguments go into the callees' exits, and past them
            over = back.join(p.returns.where("kind = 'normal'").select(F.col("site").alias("node"), "call"), "node").withColumn("node", F.col("call")).drop("call")
            past = over.join(p.args.where("pos = -2").select("node", "base"), ["node", "base"], "left_anti")
            inside = entering(over, "pos >= -2", "b")
            at_exits = inside.join(p.exits.where("kind = 'normal'").select(F.col("method").alias("callee"), "node"), "callee")
            incoming.append(inside)
            # up to the callers
            here = ["callee", "ctx", "ctx_act", *_FACT]
            started = lambda rows: rows.join(p.starts.withColumnRenamed("method", "callee"), "node").select(*here)
            up = rising(callers(started(back), known["inc"])).unionByName(rising(callers(started(known["bwd"]), delta["inc"]))).unionByName(rising(any_callers(started(back))))
            risen = up.select(F.col("up_ctx").alias("ctx"), F.col("up_act").alias("ctx_act"), F.col("call").alias("node"), *_FACT)
            out["above"] = up.where(~F.col("act").eqNullSafe(F.col("ctx_act"))).select("act", "call")
            found = left.select(*_ROW).union(stay.select(*_ROW)).union(past.select(*_ROW))
            out["bwd"] = spawned.union(found).union(at_exits.select(*_ROW)).union(risen.select(*_ROW)).where("size(fields) > 0 or cut")
            forward += [left.select(*_ROW), right.withColumn("node", F.col("after")).select(*_ROW), risen.select(*_ROW)]
        inc = incoming[0].select("callee", "ctx", "call", "up_ctx", "up_act")
        for more in incoming[1:]:
            inc = inc.union(more.select("callee", "ctx", "call", "up_ctx", "up_act"))
        every = forward[0]
        for more in forward[1:]:
            every = every.union(more)
        return out | {"fwd": every, "inc": inc}

    seeds = source_facts()
    none = seeds.limit(0)
    text = lambda *names: none.select(*[F.col("node").alias(n) for n in names])
    return fixpoint(
        {
            "fwd": seeds,
            "bwd": none,
            "inc": text("callee", "ctx", "call", "up_ctx", "up_act"),
            "ends": none.select(F.col("node").alias("callee"), "ctx", "ctx_act", F.col("node").alias("kind"), *_FACT),
            "above": text("act", "call"),
        },
        step,
        max_rounds,
    )


def origins(found: Relations, nodes: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``callee, ctx, origin``: the sources whose contexts led to each entered context."""
    inc = stage_table(found["inc"].join(nodes.select(F.col("node").alias("call"), F.col("method").alias("caller")), "call").select("callee", "ctx", "caller", "up_ctx").distinct(), "entered")
    first = inc.where(F.col("up_ctx").startswith("@")).select("callee", "ctx", F.substring("up_ctx", 2, 1 << 30).alias("origin"))

    def step(known: Relations, delta: Relations) -> Relations:
        up = delta["o"].select(F.col("callee").alias("caller"), F.col("ctx").alias("up_ctx"), "origin")
        return {"o": inc.join(up, ["caller", "up_ctx"]).select("callee", "ctx", "origin")}

    return fixpoint({"o": first}, step, max_rounds)["o"]


def leaks(found: Relations, nodes: DataFrame, sinks: DataFrame) -> DataFrame:
    """``origin, sink, base, fields``: active taints of an argument where a sink (``sinks(node, base)``) is reached."""
    hit = found["fwd"].where("act is null").join(sinks, ["node", "base"]).select("ctx", "node", "base", "fields").distinct()
    own = hit.where(F.col("ctx").startswith("@")).select(F.substring("ctx", 2, 1 << 30).alias("origin"), F.col("node").alias("sink"), "base", "fields")
    inner = hit.join(nodes.select("node", F.col("method").alias("callee")), "node").join(origins(found, nodes), ["callee", "ctx"])
    return own.union(inner.select("origin", F.col("node").alias("sink"), "base", "fields")).distinct()


def program_leaks(p: Program, sources: DataFrame, sinks: DataFrame, limit: int = 5, max_rounds: int = 1000) -> DataFrame:
    """``leaks`` of ``analyse``, of methods that are alike and not called one analysed for all of them."""
    tables = {
        "cfg": alike.Rows(p.cfg, "src", ["dst"]),
        "assigns": alike.Rows(p.assigns, "node", ["to_base", "from_base"]),
        "kills": alike.Rows(p.kills, "node", ["base"]),
        "calls": alike.Rows(p.calls, "node"),
        "returns": alike.Rows(p.returns, "call", ["site"]),
        "exits": alike.Rows(p.exits, "method", ["node"]),
        "starts": alike.Rows(p.starts, "method", ["node"]),
        "args": alike.Rows(p.args, "node", ["base"]),
        "params": alike.Rows(p.params, "method", ["base"]),
        "sources": alike.Rows(sources, "node", ["base"]),
        "sinks": alike.Rows(sinks, "node", ["base"]),
    }
    fixed = p.statics.select("base").union(p.statics.sparkSession.range(1).select(F.lit(THROWN)))
    less, copies = alike.kept(tables, p.nodes, p.calls.select("callee"), fixed)
    sources, sinks = less.pop("sources"), stage_table(less.pop("sinks"), "sinks")
    found = leaks(analyse(Program(nodes=copies.nodes, statics=p.statics, **less), sources, limit, max_rounds=max_rounds), copies.nodes, sinks)
    return copies.spread(stage_table(found, "found"), {"origin": [], "sink": ["base"]})
