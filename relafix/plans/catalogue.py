"""Registered queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relafix.operators.fixpoint import closure
from relafix.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query under ``name`` and, where SQL can express it, its oracle."""

    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


#: The trade graph: regions to nations to customers to orders, nations to suppliers.
TRADE_SQL = """
edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
)"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def link(name: str, a: str, src: str, b: str, dst: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(src)).alias("src"), F.concat(F.lit(b), F.col(dst)).alias("dst"))

    parts = [
        link("nation", "r", "n_regionkey", "n", "n_nationkey"),
        link("customer", "n", "c_nationkey", "c", "c_custkey"),
        link("orders", "c", "o_custkey", "o", "o_orderkey"),
        link("supplier", "n", "s_nationkey", "s", "s_suppkey"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("reachability", f"WITH RECURSIVE {TRADE_SQL}, reach AS (SELECT 'r2' AS node UNION SELECT dst FROM edges JOIN reach ON src = node) SELECT node FROM reach")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that region 2 reaches."""
    seeds = spark.createDataFrame([("r2",)], "node string")
    return closure(trade_edges(spark, sf_dir), seeds)


def _load() -> None:
    """Importing the modules registers their queries."""
    from relafix.plans import analyses, bothways, core, demanded, fieldreads, leaks, relational  # noqa: F401


_load()
