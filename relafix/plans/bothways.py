"""Bidirectional tabulation over a program made from the driver's tables.

Every customer is a method and every order a call of it by the customer whose key is a tenth of its
own; customer 0 calls itself.  A customer in debt holds a start.  Forward, the start's value goes through
a method of the customer's nation, which the nations of region 2 do not return from, and then to the
customer's end; backward it goes to the customer's beginning.  Calls let values out by the order: forward
those that are not open, backward those that are not of low priority.  Building customers
keep what was let out to them forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relafix.operators import bidirectional
from relafix.operators.ifds import Problem
from relafix.plans.catalogue import register
from relafix.tables import table


def _at(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key))


def _problems(spark: SparkSession, sf_dir: str) -> tuple[Problem, Problem]:
    customers = table(spark, sf_dir, "customer").where("c_custkey is not null").select(F.col("c_custkey").alias("m"), F.col("c_nationkey").alias("n"), "c_acctbal", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").where("o_custkey is not null and o_orderkey is not null")
    orders = orders.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("m"), F.expr("o_custkey div 10").alias("caller"), "o_orderstatus", "o_orderpriority")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    debt = customers.where("c_acctbal < 0")
    v, a, helper = F.lit("v"), F.lit("a"), _at("helper", "n")
    begin, end, held, sent, seed = _at("begin", "m"), _at("end", "m"), _at("held", "m"), _at("sent", "m"), _at("seed", "m")

    def flow(rows: DataFrame, src: Column, dst: Column, fact: Column = v) -> DataFrame:
        return rows.select(src.alias("src"), dst.alias("dst"), fact.alias("fact"), fact.alias("out"))

    def bounds(rows: DataFrame, method: Column, node: Column) -> DataFrame:
        return rows.select(method.alias("method"), node.alias("node"))

    def left(rows: DataFrame, last: Column, site: str) -> DataFrame:
        return rows.select(_at("call", "o").alias("node"), _at("customer", "m").alias("callee"), last.alias("exit"), _at(site, "o").alias("site"), v.alias("fact"), v.alias("out"))

    called = orders.select(F.col("caller").alias("m"), "o").join(customers.select("m", "c_mktsegment"), "m")
    first, last = bounds(customers, _at("customer", "m"), begin), bounds(customers, _at("customer", "m"), end)
    seeds = debt.select(seed.alias("node"), v.alias("fact"))
    calls = debt.select(held.alias("node"), helper.alias("callee"), v.alias("fact"), a.alias("out"))
    no_calls, no_bypass = calls.limit(0), calls.limit(0).select("node", F.col("callee").alias("site"), "fact", "out")
    returned = debt.select(held.alias("node"), helper.alias("callee"), _at("washed", "n").alias("exit"), sent.alias("site"), a.alias("fact"), v.alias("out"))
    forward = Problem(
        calls=calls,
        starts=first.unionByName(bounds(nations, helper, _at("taken", "n"))),
        exits=last.unionByName(bounds(nations, helper, _at("washed", "n"))),
        returns=returned.select("node", "site"),
        normal=flow(debt, seed, held).unionByName(flow(debt, sent, end)).unionByName(flow(nations.where("r <> 2"), _at("taken", "n"), _at("washed", "n"), a)).unionByName(flow(called.where("c_mktsegment <> 'BUILDING'"), _at("after", "o"), end)),
        call=calls,
        ret=returned.unionByName(left(orders.where("o_orderstatus <> 'O'"), end, "after")),
        bypass=no_bypass,
        seeds=seeds,
    )
    backward = Problem(
        calls=no_calls,
        starts=last,
        exits=first,
        returns=returned.select("node", "site").limit(0),
        normal=flow(debt, seed, begin).unionByName(flow(called, _at("before", "o"), begin)),
        call=no_calls,
        ret=left(orders.where("o_orderpriority <> '5-LOW'"), begin, "before"),
        bypass=no_bypass,
        seeds=seeds,
    )
    return forward, backward


@register(
    "both_ways",
    """WITH RECURSIVE customers AS (SELECT c_custkey AS m, max(c_mktsegment <> 'BUILDING') AS passes FROM customer WHERE c_custkey IS NOT NULL GROUP BY 1),
    sites AS (SELECT o_orderkey AS o, o_custkey AS m, o_custkey // 10 AS caller, coalesce(o_orderstatus <> 'O', false) AS f, coalesce(o_orderpriority <> '5-LOW', false) AS b
      FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL),
    reached(source, m, f) AS (
      SELECT 'seed:' || c_custkey, c_custkey, coalesce(n_regionkey <> 2, false) FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IS NOT NULL AND c_acctbal < 0
      UNION SELECT 'call:' || s.o, c.m, coalesce(c.passes, false) FROM reached r JOIN sites s ON s.m = r.m JOIN customers c ON c.m = s.caller WHERE r.f AND s.f AND s.b)
    SELECT r.source, 'call:' || s.o AS call, r.f AND s.f AS forward, s.b AS backward FROM reached r JOIN sites s ON s.m = r.m WHERE (r.f AND s.f) OR s.b""",
)
def both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which starts and calls each way leaves to each call; beyond a call both ways left to, both go on."""
    return bidirectional.departures(bidirectional.entangle(*_problems(spark, sf_dir)))
