"""Class hierarchy, dispatch, call graphs and subset-based points-to sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relafix.operators.fixpoint import Relations, by_source, fixpoint
from relafix.storage import bounded_broadcast, cut, stage_table

#: Objects of a class that are gathered together, those of a run, and runs of values that are listed by one row.
_SHARE, _RUN, _RUNS = 1 << 14, 256, 8


def subtypes(classes: DataFrame) -> DataFrame:
    """``sub, super``: reflexive and transitive, over superclasses and interfaces of ``classes(name, super, interfaces)``."""
    up = classes.where("super is not null").select(F.col("name").alias("src"), F.col("super").alias("dst"))
    up = up.union(classes.select(F.col("name").alias("src"), F.explode("interfaces").alias("dst")))
    up = by_source(up.distinct())
    own = classes.select(F.col("name").alias("sub"), F.col("name").alias("super"))

    def step(known: Relations, delta: Relations) -> Relations:
        return {"s": delta["s"].join(up, F.col("super") == F.col("src")).select("sub", F.col("dst").alias("super"))}

    return fixpoint({"s": own}, step)["s"]


def least_upper_bounds(pairs: DataFrame, subtype: DataFrame) -> DataFrame:
    """``a, b, bound``: common supertypes of each pair that no other common supertype is below; several with interfaces."""
    left, right = subtype.select(F.col("sub").alias("a"), F.col("super").alias("bound")), subtype.select(F.col("sub").alias("b"), F.col("super").alias("bound"))
    common = cut(pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "bound"]).select("a", "b", "bound"))
    strict = subtype.where("sub <> super").select(F.col("sub").alias("below"), F.col("super").alias("bound"))
    beaten = common.withColumnRenamed("bound", "below").join(strict, "below").select("a", "b", "bound")
    return common.join(beaten, ["a", "b", "bound"], "left_anti")


def dispatch_table(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """``class, subsig, target``: the first declaration found walking up superclasses.

    ``methods`` has ``sig, class, subsig, abstract``.
    """
    declared = methods.select("class", "subsig", "sig", "abstract")

    def step(known: Relations, delta: Relations) -> Relations:
        down = delta["d"].join(classes.select(F.col("super").alias("class"), F.col("name").alias("sub")), "class").select(F.col("sub").alias("class"), "subsig", "target")
        return {"d": down.join(declared, ["class", "subsig"], "left_anti")}

    seeds = declared.where("not abstract").select("class", "subsig", F.col("sig").alias("target"))
    return fixpoint({"d": seeds}, step)["d"]


def class_hierarchy_calls(invokes: DataFrame, subtype: DataFrame, dispatch: DataFrame) -> DataFrame:
    """``src, idx, tgt, kind``: call edges by declared type.

    ``invokes`` has ``method, idx, kind, class, subsig``; static and special calls go to
    the declared class's own (or inherited) method, others to every subtype's.
    """
    # targets by declared type first, so that what many subtypes share is listed once for all sites
    by = ["direct", "class", "subsig"]
    sites = invokes.where("kind in ('static', 'special', 'virtual', 'interface')").select("method", "idx", "kind", F.col("kind").isin("static", "special").alias("direct"), "class", "subsig")
    sites = stage_table(sites.dropna(subset=["class", "subsig"]).distinct(), "sites")
    asked = sites.select(*by).distinct()
    below = asked.where("not direct").join(subtype.withColumnRenamed("super", "class"), "class").withColumnRenamed("class", "declared").withColumnRenamed("sub", "class")
    targets = asked.where("direct").join(dispatch, ["class", "subsig"]).select(*by, "target").union(below.join(dispatch, ["class", "subsig"]).select("direct", "declared", "subsig", "target"))
    targets = stage_table(targets.distinct(), "targets")
    edges = sites.groupBy(*by).agg(F.count("*").alias("n")).join(targets.groupBy(*by).agg(F.count("*").alias("m")), by).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    site = ["method", "idx", "kind"]
    sites = sites.withColumn("n", F.count("*").over(Window.partitionBy(*site)))
    found = _spread(sites, edges).join(targets, by).select("n", F.col("method").alias("src"), "idx", F.col("target").alias("tgt"), "kind")
    # only a site that is written with several declared types can meet one target twice
    return found.where("n = 1").drop("n").unionByName(found.where("n > 1").drop("n").distinct())


def _tasks(derived: int | None) -> int:
    return min((derived or 0) // 500_000, 20_000)


def _spread(rows: DataFrame, derived: int | None, *order: Column) -> DataFrame:
    """``rows`` dealt out so that a task derives some half a million of the ``derived`` rows, neighbours by ``order`` together."""
    tasks = _tasks(derived)
    if tasks <= 1:
        return rows
    return rows.repartitionByRange(tasks, *order) if order else rows.repartition(tasks)


def reachable_methods(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """``method`` reachable from ``entries(method)``."""

    def step(known: Relations, delta: Relations) -> Relations:
        return {"r": delta["r"].join(calls, F.col("method") == F.col("src")).select(F.col("tgt").alias("method"))}

    return fixpoint({"r": entries.select("method")}, step)["r"]


def points_to(alloc: DataFrame, simple: DataFrame, store: DataFrame, load: DataFrame, type_ok: DataFrame | None = None, heap: bool = True) -> Relations:
    """``pts(var, obj)``, ``edge(src, dst)`` and ``heap(obj, field, val)``: inclusion-based, field-sensitive.

    ``alloc(obj, var)``, ``simple(src, dst)``, ``store(src, base, field)``,
    ``load(base, field, dst)``; ``type_ok(var, obj)`` keeps only objects that a variable
    of that declared type can hold (variables not in it take all).

    A store and a load of one field whose bases share an object make an edge from what is stored
    to what is loaded, so rounds pass on sets along edges and never hold the heap, which is
    the product of two sets a store; it is a plan over the finished sets, left out without ``heap``.
    Objects that are made for the same variables (and fit the same types) are in the same sets, so one of them
    stands for all; sets and cells are listed for every object at the end.
    """
    alike = _alike(alloc, type_ok)
    stands = alike.select(F.col("rep").alias("obj")).distinct()
    alloc = _same(alloc, stands, "obj", "obj", "left_semi")
    simple, store, load = (stage_table(t.distinct(), n) for t, n in ((simple.select("src", "dst"), "simple"), (store.select("src", "base", "field"), "store"), (load.select("base", "field", "dst"), "load")))
    ok = None if type_ok is None else stage_table(type_ok.select("var", "obj").join(stands, "obj", "left_semi").distinct(), "type_ok")
    typed = None if type_ok is None else stage_table(type_ok.select("var").distinct(), "typed")
    fields = store.select("field").distinct().join(load.select("field").distinct(), "field")
    into = stage_table(store.join(fields, "field").select(F.col("base").alias("var")).distinct(), "into")
    out_of = stage_table(load.join(fields, "field").select(F.col("base").alias("var")).distinct(), "out_of")

    def masked(rows: DataFrame) -> DataFrame:
        if ok is None:
            return rows
        return rows.join(ok, ["var", "obj"], "left_semi").unionByName(rows.join(typed, "var", "left_anti"))

    def step(known: Relations, delta: Relations) -> Relations:
        pts, new = known["pts"], delta["pts"]

        def copied(sets: DataFrame, edges: DataFrame) -> DataFrame:
            return sets.join(edges, F.col("var") == F.col("src")).select(F.col("dst").alias("var"), "obj")

        def met(written: DataFrame, read: DataFrame) -> DataFrame:
            a = written.join(into, "var", "left_semi").select(F.col("var").alias("base"), "obj")
            b = read.join(out_of, "var", "left_semi").select(F.col("var").alias("other"), "obj")
            return a.join(b, "obj").select("base", "other")

        bases = met(new, pts).union(met(pts, new)).distinct()
        flows = store.join(bases, "base").select("src", F.col("other").alias("base"), "field").distinct().join(load, ["base", "field"]).select("src", "dst")
        return {"pts": masked(copied(new, known["edge"]).union(copied(pts, delta["edge"])).distinct()), "edge": flows}

    found = fixpoint({"pts": masked(alloc.select("var", "obj")), "edge": simple}, step)
    sets = found["pts"].withColumnRenamed("obj", "stand")
    found = found | {"pts": _same(sets, alike, "stand", "rep").select("var", "obj")}
    if not heap:
        return found
    base = sets.select(F.col("var").alias("base"), F.col("stand").alias("to"))
    value = sets.select(F.col("var").alias("src"), F.col("stand").alias("of"))
    # per object and field the variables first, so that equal cells of many stores meet before their values are listed
    cells = store.join(base, "base").select("to", "field", "src").distinct()
    cells = cells.join(value, "src").select("to", "field", "of").distinct()
    return found | {"heap": _for_all_alike(cells, alike)}


def _for_all_alike(cells: DataFrame, alike: DataFrame) -> DataFrame:
    """``obj, field, val``: ``cells(to, field, of)`` of classes, listed for every object of both.

    No two of these products share a cell, so nothing is compared after them.  Objects of a class are kept in runs of
    ``_RUN``, and only the numbers of runs are dealt out, a row for each half a million cells of large classes; the names come by a
    join in the task that lists them.  A value comes with a whole run before the next one does, so a file repeats few names in one
    order and packs to a small part of what the same cells take in the order of a shuffle.
    """
    sizes = alike.groupBy("rep").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("obj"), F.ceil(F.col("n") / _SHARE)).alias("share")
    shares = _same(alike, sizes.withColumnRenamed("rep", "of"), "rep", "of").groupBy("rep", share).agg(F.sort_array(F.collect_list(F.struct("obj"))).alias("objs"))
    shares = shares.withColumn("run", F.explode(F.expr(f"sequence(0L, (size(objs) - 1) div {_RUN})")))
    objs = F.transform(F.slice("objs", (F.col("run") * _RUN + 1).cast("int"), _RUN), lambda o: o["obj"])  # null is an object, too
    runs = stage_table(shares.select("rep", "share", "run", objs.alias("objs")), "runs")
    sizes = runs.groupBy("rep", "share").agg(F.sum(F.size("objs")).alias("n"))
    for side, s in (("to", "t"), ("of", "o")):
        cells = _same(cells, sizes.toDF("rep", f"{s}_share", f"{s}_n"), side, "rep").drop("rep")
    cells = stage_table(cells, "cells")
    n = cells.agg(F.sum(F.col("t_n") * F.col("o_n"))).first()[0]
    dealt = cells.withColumn("t_run", F.explode(F.expr(f"sequence(0L, (t_n - 1) div {_RUN})"))).withColumn("o_runs", F.explode(F.expr(f"sequence(0L, (o_n - 1) div {_RUN * _RUNS})")))
    # as few objects and values as can be in a task; hashes, as the driver gets a sample of what is ordered by
    dealt = _spread(dealt.drop("t_n", "o_n"), n, F.xxhash64("to", "t_share", "t_run"), F.xxhash64("of", "o_share", "o_runs"), F.xxhash64("field"))
    listed = bounded_broadcast(runs, 1_000_000, 64 << 20)
    objs, vals = listed.toDF("t_rep", "t_of", "t_at", "objs"), listed.select(F.col("rep").alias("o_rep"), F.col("share").alias("o_of"), F.expr(f"run div {_RUNS}").alias("o_at"), F.col("objs").alias("vals"))
    listed = dealt.join(objs, F.expr("to <=> t_rep and t_share = t_of and t_run = t_at")).join(vals, F.expr("of <=> o_rep and o_share = o_of and o_runs = o_at"))
    listed = listed.select("objs", "field", F.explode("vals").alias("val"))
    # Spark holds all that one compiled loop makes of a row; parted here, that is a run for a value and not a row's product
    listed = listed.coalesce(_tasks(n)) if _tasks(n) > 1 else listed
    return listed.select(F.explode("objs").alias("obj"), "field", "val")


def _same(rows: DataFrame, other: DataFrame, a: str, b: str, how: str = "inner") -> DataFrame:
    """A join of ``rows.a`` with ``other.b``; nulls compare as equal."""
    x, y = rows.alias("x"), other.alias("y")
    return x.join(y, F.col(f"x.{a}").eqNullSafe(F.col(f"y.{b}")), how)


def _alike(alloc: DataFrame, type_ok: DataFrame | None) -> DataFrame:
    """``rep, obj``: objects that the same variables get first and the same typed variables can hold, under the smallest of them."""
    made = alloc.groupBy("obj").agg(F.sort_array(F.collect_set(F.struct("var"))).alias("made"))
    if type_ok is None:
        made = made.withColumn("fits", F.array().cast("array<string>"))
    else:
        made = made.join(type_ok.groupBy("obj").agg(F.sort_array(F.collect_set("var")).alias("fits")), "obj", "left").withColumn("fits", F.coalesce("fits", F.array()))
    made = stage_table(made, "made")
    return stage_table(made.join(made.groupBy("made", "fits").agg(F.min("obj").alias("rep")), ["made", "fits"]).select("rep", "obj"), "alike")


def points_to_with_calls(alloc: DataFrame, simple: DataFrame, store: DataFrame, load: DataFrame, invokes: DataFrame, dispatch: DataFrame, types: DataFrame, actuals: DataFrame, formals: DataFrame, entries: DataFrame) -> Relations:
    """Points-to sets and the call graph together: ``pts``, ``heap``, ``reach``, ``call``, ``simple``.

    Facts carry the method they stand in: ``alloc(method, obj, var)``, ``simple``, ``store``
    and ``load`` with ``method``; ``invokes(method, idx, base, subsig)``, ``types(obj, class)``,
    ``actuals(method, idx, pos, var)`` and ``formals(method, pos, var)`` (position -1 the
    receiver, -2 the result, whose flow is turned round).
    """

    def step(known: Relations, delta: Relations) -> Relations:
        def live(table: DataFrame) -> DataFrame:
            return delta["reach"].join(table, "method").drop("method")

        pts, new = known["pts"], delta["pts"]

        def called(reach: DataFrame, sets: DataFrame) -> DataFrame:
            at = invokes.join(reach, "method").join(sets.withColumnRenamed("var", "base"), "base")
            return at.join(types, "obj").join(dispatch, ["class", "subsig"]).select("method", "idx", F.col("target").alias("callee"))

        def copied(sets: DataFrame, edges: DataFrame) -> DataFrame:
            return sets.join(edges, F.col("var") == F.col("src")).select(F.col("dst").alias("var"), "obj")

        calls = called(delta["reach"], pts).union(called(known["reach"], new)).distinct()
        bound = delta["call"].join(actuals.withColumnRenamed("var", "a"), ["method", "idx"]).join(formals.select(F.col("method").alias("callee"), "pos", F.col("var").alias("f")), ["callee", "pos"])
        back = F.col("pos") == -2
        bound = bound.select(F.when(back, F.col("f")).otherwise(F.col("a")).alias("src"), F.when(back, F.col("a")).otherwise(F.col("f")).alias("dst"))
        live_store, live_load = known["reach"].join(store, "method").drop("method"), known["reach"].join(load, "method").drop("method")

        def stored(base: DataFrame, value: DataFrame, rows: DataFrame) -> DataFrame:
            b = base.select(F.col("var").alias("base"), F.col("obj").alias("into"))
            return rows.join(b, "base").join(value.select(F.col("var").alias("src"), F.col("obj").alias("val")), "src").select(F.col("into").alias("obj"), "field", "val")

        def loaded(base: DataFrame, cells: DataFrame, rows: DataFrame) -> DataFrame:
            return rows.join(base.withColumnRenamed("var", "base"), "base").join(cells, ["obj", "field"]).select(F.col("dst").alias("var"), F.col("val").alias("obj"))

        return {
            "pts": live(alloc).select("var", "obj").union(copied(new, known["simple"])).union(copied(pts, delta["simple"])).union(loaded(new, known["heap"], live_load)).union(loaded(pts, delta["heap"], live_load)).union(loaded(pts, known["heap"], live(load))),
            "heap": stored(new, pts, live_store).union(stored(pts, new, live_store)).union(stored(pts, pts, live(store))),
            "call": calls,
            "reach": delta["call"].select(F.col("callee").alias("method")),
            "simple": live(simple).select("src", "dst").union(bound),
        }

    entry = cut(entries.select("method"))
    none = alloc.limit(0)
    seeds = {
        "pts": none.select("var", "obj"),
        "heap": none.select("obj", F.col("var").alias("field"), F.col("obj").alias("val")),
        "call": invokes.limit(0).select("method", "idx", F.col("method").alias("callee")),
        "reach": entry,
        "simple": simple.limit(0).select("src", "dst"),
    }
    return fixpoint(seeds, step)


def may_alias(pts: DataFrame) -> DataFrame:
    """``a, b`` (a < b): variables with a common object."""
    x, y = pts.select(F.col("var").alias("a"), "obj"), pts.select(F.col("var").alias("b"), "obj")
    return x.join(y, "obj").where("a < b").select("a", "b").distinct()


def set_size_histogram(pts: DataFrame) -> DataFrame:
    """``size, n_vars``: how many variables point to how many objects."""
    return pts.groupBy("var").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_vars"))


def monomorphic_sites(calls: DataFrame) -> DataFrame:
    """``src, idx, tgt`` of call sites with exactly one target."""
    return calls.groupBy("src", "idx").agg(F.count_distinct("tgt").alias("n"), F.max("tgt").alias("tgt")).where("n = 1").drop("n")


def side_effects(access: DataFrame, calls: DataFrame) -> DataFrame:
    """``method, mode, obj, field``: transitive read and write sets; ``access`` has the same columns, per method."""

    def step(known: Relations, delta: Relations) -> Relations:
        return {"rw": delta["rw"].withColumnRenamed("method", "tgt").join(calls.select("src", "tgt").distinct(), "tgt").select(F.col("src").alias("method"), "mode", "obj", "field")}

    return fixpoint({"rw": access.select("method", "mode", "obj", "field")}, step)["rw"]


def interference(sets: DataFrame) -> DataFrame:
    """``a, b`` (a < b): methods of which one writes what the other reads or writes."""
    w = sets.where("mode = 'write'").select(F.col("method").alias("x"), "obj", "field")
    any_ = sets.select(F.col("method").alias("y"), "obj", "field")
    met = w.join(any_, ["obj", "field"]).where("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
