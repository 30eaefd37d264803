"""Nullness of locals, with what tests and dereferences tell along single edges.

A status is two bits, one for each value a local may hold; ``NULL | NON_NULL`` is
unknown.  Each bit is a fact of its own while the loop runs, so an edge that rules
a value out only lets that bit not pass, and the loop stays monotone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relafix.operators.fixpoint import Relations, fixpoint
from relafix.storage import cut

NULL, NON_NULL = 1, 2


def branched_flow(cfg: DataFrame, assigned: DataFrame, copies: DataFrame, defs: DataFrame, refined: DataFrame, bits: tuple[int, ...] = (NULL, NON_NULL), init: DataFrame | None = None) -> DataFrame:
    """``method, node, local, bits`` before each node, where edges may rule out bits.

    ``refined(method, src, dst, local, mask)``: of the local's bits only those in ``mask``
    pass that edge, what the edge's own node assigned included; several rows for an edge
    hold together.  The other tables are as for ``flow.lattice_flow``.  A local without a
    row cannot be there with any value.
    """
    edges = cut(cfg.select("method", F.col("src").alias("node"), "dst").distinct())
    single = F.explode(F.filter(F.array(*[F.lit(b) for b in bits]), lambda b: F.col("bits").bitwiseAND(b) != 0)).alias("bit")
    mask = refined.groupBy("method", F.col("src").alias("node"), "dst", "local").agg(F.bit_and("mask").alias("mask"))
    shut = cut(mask.select("method", "node", "dst", "local", F.explode(F.filter(F.array(*[F.lit(b) for b in bits]), lambda b: F.col("mask").bitwiseAND(b) == 0)).alias("bit")))
    written = defs.select("method", "node", "local").distinct()

    def over(rows: DataFrame) -> DataFrame:
        passing = rows.join(edges, ["method", "node"]).join(shut, ["method", "node", "dst", "local", "bit"], "left_anti")
        return passing.select("method", F.col("dst").alias("node"), "local", "bit")

    seeds = over(assigned.select("method", "node", "local", single))
    if init is not None:
        seeds = seeds.unionByName(init.select("method", "node", "local", single))

    def step(known: Relations, delta: Relations) -> Relations:
        kept = delta["v"].join(written, ["method", "node", "local"], "left_anti")
        moved = delta["v"].withColumnRenamed("local", "source").join(copies, ["method", "node", "source"])
        return {"v": over(kept.unionByName(moved.select("method", "node", "local", "bit")))}

    found = fixpoint({"v": seeds}, step)["v"]
    return found.groupBy("method", "node", "local").agg(F.bit_or("bit").alias("bits"))


def nullness(cfg: DataFrame, assigned: DataFrame, copies: DataFrame, defs: DataFrame, tests: DataFrame, dereferences: DataFrame, init: DataFrame | None = None) -> DataFrame:
    """``method, node, local, bits`` before each node.

    ``tests(method, node, local, null_dst, other_dst)`` are comparisons with null and where
    each outcome goes on; ``dereferences(method, node, local)`` fail on null, so the local is
    not null after them unless the node also defines it.  A test with both outcomes at one
    successor tells nothing.
    """
    told = tests.where("null_dst <> other_dst")
    known = told.select("method", F.col("node").alias("src"), F.col("null_dst").alias("dst"), "local", F.lit(NULL).alias("mask"))
    known = known.unionByName(told.select("method", F.col("node").alias("src"), F.col("other_dst").alias("dst"), "local", F.lit(NON_NULL).alias("mask")))
    used = dereferences.join(defs, ["method", "node", "local"], "left_anti").join(cfg.select("method", F.col("src").alias("node"), "dst"), ["method", "node"])
    known = known.unionByName(used.select("method", F.col("node").alias("src"), "dst", "local", F.lit(NON_NULL).alias("mask")))
    return branched_flow(cfg, assigned, copies, defs, known, init=init)


def colour(bits: Column) -> Column:
    """A status in words: ``null``, ``non-null`` or ``unknown``; null where no value arrives."""
    return F.when(bits == NULL, "null").when(bits == NON_NULL, "non-null").when(bits == NULL | NON_NULL, "unknown")


def decided_tests(status: DataFrame, tests: DataFrame) -> DataFrame:
    """``method, node, local, is_null``: comparisons with null that always go one way; these can be dropped."""
    at = tests.join(status, ["method", "node", "local"]).where(F.col("bits") != NULL | NON_NULL)
    return at.select("method", "node", "local", (F.col("bits") == NULL).alias("is_null"))


def checked_dereferences(status: DataFrame, dereferences: DataFrame) -> DataFrame:
    """``method, node, local, verdict``: ``safe``, ``check`` where null may arrive, ``crash`` where nothing else does, ``unreached``."""
    at = dereferences.select("method", "node", "local").distinct().join(status, ["method", "node", "local"], "left")
    verdict = F.when(F.col("bits") == NON_NULL, "safe").when(F.col("bits") == NULL, "crash").when(F.col("bits").isNotNull(), "check").otherwise("unreached")
    return at.select("method", "node", "local", verdict.alias("verdict"))
