"""Taint: access paths that flow from sources to sinks, with the paths they took.

A fact is an access path: a base and a list of fields, cut off after ``limit``
fields (a cut-off path stands for all its extensions).  Program edges come as
tables, one row per assignment pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relafix.operators.fixpoint import Relations, fixpoint
from relafix.storage import stage_table


def appended(fields: Column, more: Column, limit: int) -> tuple[Column, Column]:
    """Fields with others appended, cut to ``limit``; and whether something was cut."""
    every = F.concat(fields, more)
    return F.slice(every, 1, limit), F.size(every) > limit


def is_prefix(short: Column, long: Column) -> Column:
    """The fields of ``short`` begin ``long``."""
    return F.slice(long, F.lit(1), F.size(short)) == short


def without_first(fields: Column) -> Column:
    """The path seen from its first field; the empty path stays."""
    return F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0)))


def without_last(fields: Column) -> Column:
    """The path of the object that holds the last field; the empty path stays."""
    return F.slice(fields, F.lit(1), F.greatest(F.size(fields) - 1, F.lit(0)))


def rebased(fields: Column, base_fields: Column, old_base_fields: Column, limit: int) -> Column:
    """``fields`` with ``base_fields`` instead of its prefix ``old_base_fields``, cut to ``limit``; null if that is no prefix."""
    rest = F.slice(fields, F.size(old_base_fields) + 1, F.greatest(F.size(fields) - F.size(old_base_fields), F.lit(0)))
    return F.when(is_prefix(old_base_fields, fields), appended(base_fields, rest, limit)[0])


def n_sinks(found: DataFrame) -> DataFrame:
    """``origin, n_sinks``: how many sinks each source leaks into."""
    return found.groupBy("origin").agg(F.count_distinct("sink").alias("n_sinks"))


def propagate(cfg: DataFrame, assigns: DataFrame, sources: DataFrame, limit: int = 5, max_rounds: int = 1000) -> DataFrame:
    """``node, base, fields, cut, pred_node, origin``: taints before each node, with the node they came over.

    ``cfg(src, dst)``; ``assigns(node, to_base, to_field, from_base, from_field)`` copies
    (a null field: the base itself); array elements are the base, so array stores do not
    kill.  A copy to a plain local kills what the local had; a store kills only paths
    through the same base and field.  ``sources(node, base)`` start at the node's successors.
    """
    none = F.array().cast("array<string>")
    edges = cfg.select(F.col("src").alias("node"), "dst")
    columns = ["node", "base", "fields", "cut", "pred_node", "origin"]
    seeds = sources.join(edges, "node").select(F.col("dst").alias("node"), "base", none.alias("fields"), F.lit(False).alias("cut"), F.col("node").alias("pred_node"), F.col("node").alias("origin"))
    written = assigns.select("node", F.col("to_base").alias("base"), "to_field").distinct()

    def step(known: Relations, delta: Relations) -> Relations:
        fact = delta["t"].drop("pred_node")
        kill = F.col("w.to_field").isNull() & F.col("overwrites") | (F.col("w.to_field") == F.get("fields", F.lit(0)))
        hit = fact.alias("f").join(written.withColumn("overwrites", F.lit(True)).alias("w"), ["node", "base"], "left").where(~F.coalesce(kill, F.lit(False)))
        kept = hit.select("node", "base", "fields", "cut", "origin")
        moved = fact.withColumnRenamed("base", "from_base").join(assigns, ["node", "from_base"])
        first = F.get("fields", F.lit(0))
        whole = F.size("fields") == 0
        moved = moved.where(F.col("from_field").isNull() | (first == F.col("from_field")) | (whole & F.col("cut")))
        rest = F.when(F.col("from_field").isNotNull() & ~whole, F.slice("fields", F.lit(2), F.greatest(F.size("fields") - 1, F.lit(0)))).otherwise(F.col("fields"))
        head = F.when(F.col("to_field").isNotNull(), F.array("to_field")).otherwise(none)
        path, was_cut = appended(head, rest, limit)
        moved = moved.select("node", F.col("to_base").alias("base"), path.alias("fields"), (F.col("cut") | was_cut).alias("cut"), "origin")
        both = kept.unionByName(moved).join(edges, "node")
        return {"t": both.select(F.col("dst").alias("node"), "base", "fields", "cut", F.col("node").alias("pred_node"), "origin")}

    return fixpoint({"t": seeds.select(*columns)}, step, max_rounds)["t"].select(*columns)


def leaks(taints: DataFrame, sinks: DataFrame) -> DataFrame:
    """``sink, base, fields, origin``: taints whose base is an argument (``sinks(node, base)``) where they arrive."""
    return taints.join(sinks, ["node", "base"]).select(F.col("node").alias("sink"), "base", "fields", "origin").distinct()


def drop_entailed(found: DataFrame) -> DataFrame:
    """Leaks without those that a shorter path at the same sink, base and origin stands for.

    A path's own prefixes are looked up by length and hash, so paths are never compared pair by pair and no prefix is
    written out; where hashes meet, the paths themselves decide.
    """
    same = ["sink", "base", "origin"]
    found = stage_table(found, "found")
    marks = stage_table(found.select(*same, F.size("fields").alias("n"), F.xxhash64("fields").alias("mark")).distinct(), "marks", plain=True)
    sizes = F.sequence(F.lit(0), F.size("fields") - 1)
    prefixes = F.when(F.size("fields") > 0, F.transform(sizes, lambda n: F.xxhash64(F.slice("fields", F.lit(1), n))))
    own = found.select(*same, F.size("fields").alias("n"), F.xxhash64("fields").alias("mark"), "fields").distinct()
    tried = found.select(*same, F.size("fields").alias("n"), F.xxhash64("fields").alias("mark"), F.posexplode(prefixes).alias("by_n", "by_mark"))
    met = stage_table(tried.join(marks.toDF(*same, "by_n", "by_mark"), [*same, "by_n", "by_mark"], "left_semi").distinct(), "met", plain=True)
    pairs = met.join(own, [*same, "n", "mark"]).join(own.toDF(*same, "by_n", "by_mark", "by"), [*same, "by_n", "by_mark"])
    entailed = pairs.where(F.slice("fields", F.lit(1), F.col("by_n")) == F.col("by")).select(*same, "fields").distinct()
    return found.join(entailed, [*same, "fields"], "left_anti").select(*found.columns)


def paths(taints: DataFrame, found: DataFrame) -> DataFrame:
    """``sink, origin, path``: one node sequence for each leak, one of the shortest, however long."""
    links = taints.select("origin", "node", "pred_node").distinct()
    seeds = found.select("sink", "origin", F.col("sink").alias("node"), F.array("sink").alias("path")).distinct()

    def step(known: Relations, delta: Relations) -> Relations:
        back = delta["p"].where(F.col("node") != F.col("origin")).join(links, ["origin", "node"])
        fresh = back.where(~F.array_contains("path", F.col("pred_node")))
        longer = fresh.select("sink", "origin", F.col("pred_node").alias("node"), F.concat(F.array("pred_node"), "path").alias("path"))
        # one way to each node is enough: alternatives are kept as links, not walked again
        one = longer.groupBy("sink", "origin", "node").agg(F.min("path").alias("path"))
        return {"p": one.join(known["p"].select("sink", "origin", "node"), ["sink", "origin", "node"], "left_anti")}

    # each round but the last comes to a new node of some leak, so the links bound the rounds
    return fixpoint({"p": seeds}, step, links.count() + 2)["p"].where("node = origin").select("sink", "origin", "path")


def shortcut(calls: DataFrame, rules: DataFrame, subtype: DataFrame) -> DataFrame:
    """``node, action``: library calls that a rule models; rules hold for subtypes of their class.

    ``calls(node, class, subsig)``, ``rules(class, subsig, action)``; of several actions the
    order is exclude, kill, create.
    """
    expanded = rules.where("action <> 'include'").join(subtype.withColumnRenamed("super", "class"), "class").select(F.col("sub").alias("class"), "subsig", "action")
    rank = F.array_position(F.array(F.lit("exclude"), F.lit("kill"), F.lit("create")), F.col("action"))
    return calls.join(expanded, ["class", "subsig"]).groupBy("node").agg(F.min_by("action", rank).alias("action"))
