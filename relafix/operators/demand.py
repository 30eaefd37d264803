"""Demand-driven, context-sensitive points-to: only what asked variables need, along matched calls and returns.

The search runs backward from the asked variables.  Going back from a call's result into the callee puts
the call on a stack; going back from a parameter leaves to the call on top, or to all calls where
the stack is empty, so values of different callers do not mix.  A field is opened only when
a wanted variable loads it: then the bases of its stores are asked for as well, and a store meets the
load where both bases hold one object.  Stored values are looked up for any
caller.  Stacks keep their ``depth`` newest calls; what is older is taken as any caller, which can only add objects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relafix.operators.fixpoint import Relations, fixpoint
from relafix.storage import counted_tables, empty_table

_TABLES = {
    "asked": ("var",),
    "alloc": ("var", "obj"),
    "assign": ("dst", "src"),
    "store": ("base", "field", "src"),
    "load": ("dst", "base", "field"),
    "param": ("call", "formal", "actual"),
    "result": ("call", "dst", "returned"),
}


def _any() -> Column:
    """The stack of a variable that any caller may have entered."""
    return F.array().cast("array<string>")


def left_by(want: DataFrame, param: DataFrame) -> DataFrame:
    """``var, stack, actual``: wanted parameters with what the call on top of the stack hands on, or all calls if it is empty.

    A parameter is wanted with as many stacks as its method has calls, so the call is part of the key.
    """
    free = want.where(F.size("stack") == 0).join(param.withColumnRenamed("formal", "var"), "var")
    matched = want.withColumn("call", F.get("stack", F.lit(0))).join(param.withColumnRenamed("formal", "var"), ["call", "var"])
    return free.select("var", "stack", "actual").union(matched.select("var", "stack", "actual"))


def demanded(asked: DataFrame, alloc: DataFrame, assign: DataFrame, store: DataFrame, load: DataFrame, param: DataFrame, result: DataFrame, depth: int = 3, max_rounds: int = 1000) -> Relations:
    """What a search for the ``asked(var)`` visits and finds.

    ``alloc(var, obj)``, ``assign(dst, src)``, ``store(base, field, src)``, ``load(dst, base, field)`` within methods,
    ``param(call, formal, actual)`` and ``result(call, dst, returned)`` at calls with strings as names of calls.
    Gives ``want(var, stack)``, ``flow(var, stack, src, from_stack)``, ``pts(var, stack, obj)``,
    ``read(var, stack, obj, field)`` and ``write(obj, field, src)``.  With ``depth`` 0 the sets are those of an
    analysis that ignores callers.  Repeated rows count once, rows with nulls take no part, and without
    asked variables all relations are empty.
    """
    given = {"asked": asked, "alloc": alloc, "assign": assign, "store": store, "load": load, "param": param, "result": result}
    t = counted_tables({name: given[name].select(*columns).dropna().distinct() for name, columns in _TABLES.items()})[0]
    loads = t["load"].withColumnRenamed("dst", "var")
    stack = F.col("stack")

    def follow(want: DataFrame) -> DataFrame:
        """The ways back out of wanted variables that need no heap."""
        inside = want.join(t["assign"], F.col("var") == F.col("dst")).select("var", "stack", "src", stack.alias("from_stack"))
        into = want.join(t["result"], F.col("var") == F.col("dst")).select("var", "stack", F.col("returned").alias("src"), F.slice(F.concat(F.array("call"), stack), 1, depth).alias("from_stack"))
        # an empty stack stays empty: slices beyond the end have no elements
        out = left_by(want, t["param"]).select("var", "stack", F.col("actual").alias("src"), F.slice("stack", 2, max(depth, 1)).alias("from_stack"))
        return inside.union(into).union(out)

    def opened(want: DataFrame) -> DataFrame:
        """Bases to ask for: those of wanted loads, and of all stores into the fields that they read."""
        loading = want.join(loads, "var")
        fields = loading.select("field").distinct()
        return loading.select(F.col("base").alias("var"), "stack").union(t["store"].join(fields, "field", "left_semi").select(F.col("base").alias("var"), _any().alias("stack")))

    def reading(want: DataFrame, pts: DataFrame) -> DataFrame:
        held = pts.withColumnRenamed("var", "base")
        return want.join(loads, "var").join(held, ["base", "stack"]).select("var", "stack", "obj", "field")

    def writing(pts: DataFrame) -> DataFrame:
        return pts.where(F.size("stack") == 0).join(t["store"], F.col("var") == F.col("base")).select("obj", "field", "src")

    def meeting(read: DataFrame, write: DataFrame) -> DataFrame:
        return read.join(write, ["obj", "field"]).select("var", "stack", "src", _any().alias("from_stack"))

    def carried(flow: DataFrame, pts: DataFrame) -> DataFrame:
        held = pts.select(F.col("var").alias("src"), F.col("stack").alias("from_stack"), "obj")
        return flow.join(held, ["src", "from_stack"]).select("var", "stack", "obj")

    def made(want: DataFrame) -> DataFrame:
        return want.join(t["alloc"], "var").select("var", "stack", "obj")

    def union(*parts: DataFrame) -> DataFrame:
        return reduce(DataFrame.union, parts)

    def step(known: Relations, delta: Relations) -> Relations:
        want, pts = delta["want"], delta["pts"]
        return {
            "want": union(opened(want), delta["flow"].select(F.col("src").alias("var"), F.col("from_stack").alias("stack"))),
            "flow": union(follow(want), meeting(delta["read"], known["write"]), meeting(known["read"], delta["write"])),
            "pts": union(made(want), carried(delta["flow"], known["pts"]), carried(known["flow"], pts)),
            "read": union(reading(want, known["pts"]), reading(known["want"], pts)),
            "write": writing(pts),
        }

    want = t["asked"].select("var", _any().alias("stack"))
    firsts = {"flow": follow(want), "pts": made(want), "read": reading(want, made(want)), "write": writing(made(want))}
    return fixpoint({"want": want} | {name: empty_table(df.sparkSession, df.schema) for name, df in firsts.items()}, step, max_rounds)


def points_to_of(asked: DataFrame, *program: DataFrame, depth: int = 3, max_rounds: int = 1000) -> DataFrame:
    """``var, obj`` of the asked variables for any caller; ``program`` as in ``demanded``, in that order."""
    found = demanded(asked, *program, depth=depth, max_rounds=max_rounds)
    return found["pts"].where(F.size("stack") == 0).join(asked.select("var").distinct(), "var", "left_semi").select("var", "obj")
