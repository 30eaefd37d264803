"""Whole-program taint over a program made from the driver's tables.

Every customer is a method: it makes an object, takes another name for it (how depends on
its segment), gets a value, has a method of its nation write that value into the
object, and shows what the other name's field holds.  In nations with odd keys the writing method calls
itself before it writes.  The value is a source unless the customer is in debt, so all customers of
a nation meet in one callee and must not mix there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relafix.operators import infoflow
from relafix.plans.catalogue import register
from relafix.tables import table

#: Statements by segment; ``w`` calls the nation's writer, ``s`` the method that returns its argument.
_BODIES = {
    "AUTOMOBILE": ["new a", "b = a", "get x", "w a x", "y = b.f", "put y"],
    "BUILDING": ["new a", "new b", "get x", "w a x", "y = b.f", "put y"],
    "FURNITURE": ["new a", "b = a", "get x", "y = b.f", "put y", "w a x"],
    "HOUSEHOLD": ["new a", "get x", "w a x", "b = a", "y = b.f", "put y"],
    "MACHINERY": ["new a", "s b a", "get x", "w a x", "y = b.f", "put y"],
}
_ENDS = len(_BODIES["BUILDING"])


def _statements(spark: SparkSession) -> DataFrame:
    rows = []
    for segment, body in _BODIES.items():
        for i, line in enumerate(body):
            if " = " in line:
                to, value = line.split(" = ")
                rows.append((segment, i, "copy", to, *(value.split(".") + [None])[:2]))
            else:
                kind, *names = line.split(" ")
                rows.append((segment, i, kind, *(names + [None, None])[:2], None))
        rows.append((segment, _ENDS, "return", None, None, None))
    return F.broadcast(spark.createDataFrame(rows, "segment string, i int, kind string, x string, z string, field string"))  # as many as are written above


def _program(spark: SparkSession, sf_dir: str) -> tuple[infoflow.Program, DataFrame, DataFrame]:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    segment = F.when(F.col("c_mktsegment").isin(*_BODIES), F.col("c_mktsegment")).otherwise("BUILDING")
    own = customer.where("c_custkey is not null").select(F.concat(F.lit("c"), "c_custkey").alias("method"), F.concat(F.lit("w"), "c_nationkey").alias("writer"), (F.coalesce("c_acctbal", F.lit(0.0)) < 0).alias("debt"), segment.alias("segment"))

    def at(i):
        return F.concat_ws(":", "method", i if not isinstance(i, int) else F.lit(str(i)))

    def named(name: str):
        return F.concat_ws(".", "method", F.col(name))

    text = F.lit(None).cast("string")
    lines = own.join(_statements(spark), "segment").withColumn("node", at(F.col("i").cast("string")))
    writers = nation.where("n_nationkey is not null").select(F.concat(F.lit("w"), "n_nationkey").alias("method"), (F.col("n_nationkey") % 2 != 0).alias("again"))
    steps = writers.crossJoin(F.broadcast(spark.range(4).select(F.col("id").cast("string").alias("i")))).withColumn("node", at(F.col("i")))
    same = spark.range(1).select(F.lit("same").alias("method"), F.lit("same:0").alias("node"))

    def inside(i: int, to: str, to_field, value: str) -> DataFrame:
        return writers.select(at(i).alias("node"), F.concat("method", F.lit(f".{to}")).alias("to_base"), to_field.alias("to_field"), F.concat("method", F.lit(f".{value}")).alias("from_base"), text.alias("from_field"))

    assigns = lines.where("kind = 'copy'").select("node", named("x").alias("to_base"), text.alias("to_field"), named("z").alias("from_base"), F.col("field").alias("from_field"))
    assigns = assigns.union(inside(1, "q", text, "p")).union(inside(2, "q", F.lit("f"), "v"))
    kills = lines.where("kind in ('new', 'get')").select("node", named("x").alias("base")).union(lines.where("kind = 'copy'").select("node", named("x")))
    writing, asking, again = lines.where("kind = 'w'"), lines.where("kind = 's'"), writers.where("again").select(at(0).alias("node"), F.col("method").alias("callee"), "method")
    calls = writing.select("node", F.col("writer").alias("callee")).union(asking.select("node", F.lit("same"))).union(again.select("node", "callee"))
    args = writing.select("node", F.lit(0).alias("pos"), named("x").alias("base")).union(writing.select("node", F.lit(1), named("z")))
    args = args.union(asking.select("node", F.lit(-2), named("x"))).union(asking.select("node", F.lit(0), named("z")))
    args = args.union(again.select("node", F.lit(0), F.concat("method", F.lit(".p")))).union(again.select("node", F.lit(1), F.concat("method", F.lit(".v"))))
    params = writers.select("method", F.lit(0).alias("pos"), F.concat("method", F.lit(".p")).alias("base")).union(writers.select("method", F.lit(1), F.concat("method", F.lit(".v"))))
    params = params.union(same.select("method", F.lit(0), F.lit("same.p"))).union(same.select("method", F.lit(-2), F.lit("same.p")))
    following = lines.where(f"i < {_ENDS}").select("node", at((F.col("i") + 1).cast("string")).alias("dst"), F.col("kind").isin("w", "s").alias("calls"))
    following = following.union(steps.where("i < '3'").select("node", at((F.col("i").cast("int") + 1).cast("string")), (F.col("i") == "0") & F.col("again")))
    exits = lines.where("kind = 'return'").select("method", "node").union(steps.where("i = '3'").select("method", "node")).union(same)
    # where the writer calls itself, a way past the call ends the recursion
    skip = writers.where("again").select(at(0).alias("call"), at(1).alias("site"))
    program = infoflow.Program(
        nodes=lines.select("node", "method").union(steps.select("node", "method")).union(same.select("node", "method")),
        cfg=following.where("not calls").select(F.col("node").alias("src"), "dst"),
        assigns=assigns,
        kills=kills,
        calls=calls,
        returns=following.where("calls").select(F.col("node").alias("call"), F.col("dst").alias("site"), F.lit("normal").alias("kind")).union(skip.select("call", "site", F.lit("normal"))),
        exits=exits.select("method", "node", F.lit("normal").alias("kind")),
        starts=lines.where("i = 0").select("method", "node").union(steps.where("i = '0'").select("method", "node")).union(writers.where("again").select("method", at(1))).union(same),
        args=args,
        params=params,
        statics=same.select(F.lit("none").alias("base")),
    )
    return program, lines.where("kind = 'get' and not debt").select("node", named("x").alias("base")), lines.where("kind = 'put'").select("node", named("x").alias("base"))


def _sql() -> str:
    ends = [(s, body.index("get x"), body.index("put y")) for s, body in _BODIES.items() if s not in ("BUILDING", "FURNITURE")]
    values = ", ".join(f"('{s}', {a}, {b})" for s, a, b in ends)
    return f"""WITH ends(segment, a, b) AS (VALUES {values})
    SELECT DISTINCT 'c' || c_custkey || ':' || a AS origin, 'c' || c_custkey || ':' || b AS sink FROM customer JOIN ends ON segment = c_mktsegment
    WHERE coalesce(c_acctbal, 0) >= 0 AND c_custkey IS NOT NULL AND c_nationkey IN (SELECT n_nationkey FROM nation)"""


@register("whole_program_leaks", _sql())
def whole_program_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose value shows under the other name of the object it was written into."""
    program, sources, sinks = _program(spark, sf_dir)
    return infoflow.program_leaks(program, sources, sinks).select("origin", "sink").distinct()
