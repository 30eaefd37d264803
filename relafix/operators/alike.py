"""Methods that differ by their names alone, analysed once for all of them.

Two methods that no call leads to are alike if their rows become the same once each method's own name is taken off the
front of the nodes and locals in it.  Putting one in the place of the other maps the program
into itself, so whatever is derived about one holds about the other under its own names, and shared callees
learn nothing new from the second.  One of each kind is kept; findings are listed for every one at the end.
Methods that something calls are always kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relafix.storage import stage_table


@dataclass(frozen=True)
class Rows:
    """A table of a program: the column that tells whose row it is (``method`` or a node) and the other columns with nodes and bases."""

    table: DataFrame
    owner: str
    names: Sequence[str] = ()


@dataclass
class Copies:
    """``nodes(node, method)`` of the methods left, and ``members(rep, method)``: whom each of them stands for, itself included."""

    nodes: DataFrame
    members: DataFrame

    def spread(self, rows: DataFrame, places: Mapping[str, Sequence[str]]) -> DataFrame:
        """``rows`` for every method that theirs stand for; ``places`` are the node columns, each with the bases of its method."""
        stands = self.nodes.join(self.members.select(F.col("rep").alias("method")).distinct(), "method", "left_semi")
        out = rows
        for place in places:
            out = out.join(stands.select(F.col("node").alias(place), F.col("method").alias(f"__{place}")), place, "left")
        out = out.withColumn("__rep", F.coalesce(*[F.col(f"__{place}") for place in places]))
        out = out.join(self.members.toDF("__rep", "__member"), "__rep", "left")

        def renamed(name: str, place: str) -> Column:
            own = F.col(f"__{place}").isNotNull() & F.col(name).startswith(F.col("__rep"))
            return F.when(own, F.concat("__member", F.substr(F.col(name), F.length("__rep") + 1))).otherwise(F.col(name))

        new = {name: renamed(name, place).alias(name) for place, bases in places.items() for name in (place, *bases)}
        return out.select(*[new.get(name, F.col(name)) for name in rows.columns])


def _prints(tables: Mapping[str, Rows], nodes: DataFrame) -> DataFrame:
    """``method`` with sums over hashes of its rows; no row order or repetition in a plan matters, and no method is gathered anywhere."""

    def listed(names: Sequence[str]) -> Column:
        return F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in names]) if names else F.array().cast("array<string>")

    def flat(tag: str, rows: Rows) -> DataFrame:
        names = [*([] if rows.owner == "method" else [rows.owner]), *rows.names]
        rest = [c for c in rows.table.columns if c not in names and c != rows.owner]
        return rows.table.select(F.col(rows.owner).alias("owner"), F.lit(tag).alias("tag"), listed(names).alias("names"), listed(rest).alias("rest"))

    mine = [flat(tag, rows).withColumnRenamed("owner", "method") for tag, rows in tables.items() if rows.owner == "method"]
    placed = [flat(tag, rows).withColumnRenamed("owner", "node") for tag, rows in tables.items() if rows.owner != "method"]
    if placed:
        mine.append(reduce(DataFrame.unionByName, placed).join(nodes, "node").select("method", "tag", "names", "rest"))
    rows = reduce(DataFrame.unionByName, mine)
    short = F.transform("names", lambda n: F.when(n.startswith(F.col("method")), F.concat(F.lit("\x01"), F.substr(n, F.length("method") + 1))).otherwise(n))
    rows = rows.select("method", F.struct("tag", short.alias("names"), "rest").alias("row"))
    rows = rows.select("method", F.xxhash64("row").alias("a"), F.xxhash64(F.lit(7), "row").alias("b"))
    low, high = (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)), (lambda c: F.shiftrightunsigned(c, 32))
    return rows.groupBy("method").agg(F.count("*").alias("n"), *[F.sum(part(c)).alias(f"{c}{i}") for c in "ab" for i, part in enumerate((low, high))])


def kept(tables: Mapping[str, Rows], nodes: DataFrame, callees: DataFrame, fixed: DataFrame) -> tuple[dict[str, DataFrame], Copies]:
    """``tables`` without the rows of methods that another one stands for, and how to list findings for those.

    ``nodes(node, method)`` has every node, each in one method; ``callees(callee)`` are methods that calls lead to,
    ``fixed(base)`` names that belong to no method; a method whose name such a name begins with is kept as it is.
    Locals' names are used in their own method only.  Methods are held against each other by 4 sums of 32-bit halves of two 64-bit hashes.
    """
    nodes = nodes.select("node", "method").dropna().distinct()
    prints = _prints({**tables, "__nodes": Rows(nodes, "method", ["node"])}, nodes)
    begun = fixed.where("base is not null").select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("base"), F.lit(1))), lambda n: F.left(F.col("base"), n))).alias("method")).distinct()
    free = prints.where("method <> ''").join(callees.select(F.col("callee").alias("method")).distinct(), "method", "left_anti").join(begun, "method", "left_anti")
    free = stage_table(free, "free")
    by = [c for c in free.columns if c != "method"]
    members = stage_table(free.join(free.groupBy(*by).agg(F.min("method").alias("rep")), by).select("rep", "method"), "members")
    gone = members.where("method <> rep").select("method")
    left = stage_table(nodes.join(gone, "method", "left_anti"), "left", plain=True)
    methods = stage_table(left.select("method").union(callees.select("callee")).distinct(), "methods", plain=True)
    out = {}
    for name, rows in tables.items():
        mine = methods if rows.owner == "method" else left.select(F.col("node").alias(rows.owner))
        out[name] = rows.table.join(mine, rows.owner, "left_semi").select(*rows.table.columns)
    return out, Copies(left, members)
