"""What statements and methods may raise, and what escapes their handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relafix.operators.fixpoint import Relations, fixpoint
from relafix.storage import cut

# What a kind of statement raises by the language's definition.
IMPLICIT = {
    "array": ["java.lang.NullPointerException", "java.lang.ArrayIndexOutOfBoundsException"],
    "array_store": ["java.lang.ArrayStoreException"],
    "cast": ["java.lang.ClassCastException"],
    "division": ["java.lang.ArithmeticException"],
    "field": ["java.lang.NullPointerException"],
    "invoke": ["java.lang.NullPointerException"],
    "monitor": ["java.lang.NullPointerException", "java.lang.IllegalMonitorStateException"],
    "new_array": ["java.lang.NegativeArraySizeException"],
    "throw": ["java.lang.NullPointerException"],
}


def implicit(units: DataFrame, kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """``method, idx, type`` that statements raise by their ``kind``; kinds without an entry raise nothing."""
    pairs = [F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("type")) for kind, names in (IMPLICIT if kinds is None else kinds).items() for name in names]
    listed = F.filter(F.array(*pairs), lambda p: p["kind"] == F.col("kind"))
    return units.select("method", "idx", F.explode(listed).alias("p")).select("method", "idx", F.col("p.type").alias("type"))


def may_raise(raised: DataFrame, calls: DataFrame, traps: DataFrame, subtype: DataFrame) -> DataFrame:
    """``method, idx, type``: what leaves each statement, a callee's escaping types included.

    ``raised(method, idx, type)``; ``calls(method, idx, callee)``; ``traps(method, begin, end,
    type)`` with ``end`` exclusive; ``subtype(sub, super)`` is closed and reflexive.  A trap
    catches its type and all subtypes, so a type in the result that a trap covers has gone
    to a handler; ``escaping`` keeps the others.
    """
    calls = cut(calls.select("method", "idx", "callee").distinct())
    shut = _caught(traps, subtype, raised)

    def step(known: Relations, delta: Relations) -> Relations:
        out = _escaping(delta["r"], shut).select(F.col("method").alias("callee"), "type").distinct()
        return {"r": out.join(calls, "callee").select("method", "idx", "type")}

    return fixpoint({"r": raised.select("method", "idx", "type")}, step)["r"]


def escaping(raises: DataFrame, traps: DataFrame, subtype: DataFrame) -> DataFrame:
    """``method, type``: what leaves a method, of the result of ``may_raise``."""
    return _escaping(raises, _caught(traps, subtype, raises)).select("method", "type").distinct()


def handled(raises: DataFrame, traps: DataFrame, subtype: DataFrame) -> DataFrame:
    """``method, idx, handler, type``: edges to handlers for what may be raised and is caught there (``traps`` with ``handler``)."""
    wide = traps.withColumnRenamed("type", "super").join(subtype, "super").withColumnRenamed("sub", "type")
    return raises.join(wide, ["method", "type"]).where("idx >= begin AND idx < end").select("method", "idx", "handler", "type").distinct()


def _caught(traps: DataFrame, subtype: DataFrame, raised: DataFrame) -> DataFrame:
    """What each trap catches of the types that are raised at all; a type may have far more subtypes than that."""
    subtype = subtype.join(raised.select(F.col("type").alias("sub")).distinct(), "sub", "left_semi")
    wide = traps.withColumnRenamed("type", "super").join(subtype, "super")
    return cut(wide.select("method", F.col("sub").alias("type"), "begin", "end").distinct())


def _escaping(rows: DataFrame, shut: DataFrame) -> DataFrame:
    r, s = rows.alias("r"), shut.alias("s")
    inside = (F.col("r.method") == F.col("s.method")) & (F.col("r.type") == F.col("s.type")) & (F.col("r.idx") >= F.col("s.begin")) & (F.col("r.idx") < F.col("s.end"))
    return r.join(s, inside, "left_anti")
