"""Field-sensitive tabulation over a program made from the driver's tables.

Every customer is a method that hides a value two fields deep, under fields that depend on its segment, and
has a method of its nation read it back.  Nations read by one of three paths, the last of them over two methods, so
all customers of a nation meet in one callee that must ask each of them for its fields.  The value
shows only where the reading path is the writing path; one segment overwrites the field before it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relafix.operators import fieldsens
from relafix.plans.catalogue import register
from relafix.storage import stage_table
from relafix.tables import table

_BODIES = {
    "AUTOMOBILE": ["a.f = x", "b.g = a", "r read b", "put r"],
    "BUILDING": ["a.h = x", "b.g = a", "r read b", "put r"],
    "FURNITURE": ["a.f = x", "b.g = a", "b.g :=", "r read b", "put r"],
    "HOUSEHOLD": ["a.f = x", "b.g = a", "s same b", "r read s", "put r"],
    "MACHINERY": ["a.g = x", "b.f = a", "r read b", "put r"],
}
#: What methods of a nation do, by the key's remainder; ``next`` is the nation's second method.
_READERS = [["q = p.g", "q = q.f", "return q"], ["q = p.g", "q = q.h", "return q"], ["q = p.f", "q next q", "return q"]]
_SECOND = ["q = p.g", "return q"]


def _statements(spark: SparkSession) -> DataFrame:
    """``body, i, kind, x, x_field, z, z_field`` of all bodies above."""
    rows = []
    bodies = _BODIES | {str(i): b for i, b in enumerate(_READERS)} | {"next": _SECOND, "same": ["return p"]}
    for name, body in bodies.items():
        for i, line in enumerate(body):
            words = line.split()
            if words[0] in ("put", "return"):
                words = [words[1], words[0], ""]
            (x, _, x_field), (z, _, z_field) = words[0].partition("."), (words + [""])[2].partition(".")
            rows.append((name, i, words[1], x, x_field or None, z or None, z_field or None))
    return F.broadcast(spark.createDataFrame(rows, "body string, i int, kind string, x string, x_field string, z string, z_field string"))  # as many as are written above


def _program(spark: SparkSession, sf_dir: str) -> tuple[fieldsens.Program, DataFrame, DataFrame]:
    customer, nation = table(spark, sf_dir, "customer").where("c_custkey is not null"), table(spark, sf_dir, "nation").where("n_nationkey is not null")
    segment = F.when(F.col("c_mktsegment").isin(*_BODIES), F.col("c_mktsegment")).otherwise("FURNITURE")
    key = F.col("n_nationkey")
    methods = customer.select(F.concat(F.lit("c"), "c_custkey").alias("method"), segment.alias("body"), F.concat(F.lit("read"), "c_nationkey").alias("read"), F.lit(None).cast("string").alias("next"), (F.coalesce("c_acctbal", F.lit(0.0)) >= 0).alias("rich"))
    readers = nation.select(F.concat(F.lit("read"), key), F.pmod(key, F.lit(3)).cast("string"), F.lit(None).cast("string"), F.concat(F.lit("next"), key), F.lit(False))
    seconds = nation.select(F.concat(F.lit("next"), key), F.lit("next"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False))
    same = spark.range(1).select(F.lit("same"), F.lit("same"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False))
    lines = methods.union(readers).union(seconds).union(same).join(_statements(spark), "body")

    def at(i) -> F.Column:
        return F.concat_ws(":", "method", i)

    def named(name) -> F.Column:
        return F.concat_ws(".", "method", name)

    lines = lines.withColumn("node", at(F.col("i"))).withColumn("x", named("x")).withColumn("z", F.when(F.col("z").isNotNull(), named("z")))
    lines = lines.withColumn("callee", F.when(F.col("kind") == "read", F.col("read")).when(F.col("kind") == "next", F.col("next")).when(F.col("kind") == "same", F.lit("same")))
    lines = stage_table(lines.select("method", "i", "kind", "node", "x", "x_field", "z", "z_field", "callee", "rich"), "lines")
    calls, ends = lines.where("callee is not null"), lines.where("kind = 'return'")
    enters = lines.where("i = 0")
    after = at(F.col("i") + 1)
    program = fieldsens.Program(
        nodes=lines.select("node", "method"),
        cfg=lines.where("callee is null and kind not in ('return', 'put')").select(F.col("node").alias("src"), after.alias("dst")),
        assigns=lines.where("kind = '='").select("node", F.col("x").alias("to_base"), F.col("x_field").alias("to_field"), F.col("z").alias("from_base"), F.col("z_field").alias("from_field")),
        kills=lines.where("callee is not null or kind = '=' and x_field is null").select("node", F.col("x").alias("base")),
        overwrites=lines.where("kind = ':='").select("node", F.col("x").alias("base"), F.col("x_field").alias("field")),
        calls=calls.select("node", "callee"),
        returns=calls.select(F.col("node").alias("call"), after.alias("site")),
        starts=enters.select("method", "node"),
        exits=ends.select("method", "node"),
        args=calls.select("node", F.lit(0).alias("pos"), F.col("z").alias("base")).union(calls.select("node", F.lit(-2), "x")),
        params=enters.where("not startswith(method, 'c')").select("method", F.lit(0).alias("pos"), named(F.lit("p")).alias("base")).union(ends.select("method", F.lit(-2), "x")),
    )
    seeds = enters.where("rich").select("method", "node", named(F.lit("x")).alias("base"), F.lit("").alias("path"))
    return program, seeds, lines.where("kind = 'put'").select("node", F.col("x").alias("base"))


_SQL = """SELECT c_custkey AS custkey, c_nationkey AS nationkey FROM customer WHERE coalesce(c_acctbal, 0) >= 0 AND c_custkey IS NOT NULL
  AND c_nationkey IN (SELECT n_nationkey FROM nation) AND CASE c_nationkey % 3 WHEN 0 THEN c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD')
  WHEN 1 THEN c_mktsegment = 'BUILDING' ELSE c_mktsegment = 'MACHINERY' END"""


@register("field_reads", _SQL)
def field_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose hidden value comes back from their nation's reader."""
    program, seeds, sinks = _program(spark, sf_dir)
    shown = fieldsens.program_reached(program, seeds, sinks)
    methods = shown.select(F.substring_index("node", ":", 1).alias("method")).distinct()
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("method"), F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"))
    return customer.join(methods, "method", "left_semi").select("custkey", "nationkey")
