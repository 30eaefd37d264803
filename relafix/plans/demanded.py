"""Demand-driven points-to over a program made from the driver's tables.

Each customer hands an object of its segment and a cell of its own through one method of its
nation, which returns what it gets, writes the first into the cell and reads the cell by the name that came back.
Customers in debt also write into a box of their nation.  Callers that mixed would see every segment of the nation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relafix.operators import demand
from relafix.plans.catalogue import register
from relafix.tables import table


@register(
    "demanded_points_to",
    """WITH known AS (SELECT c_custkey AS m, c_nationkey AS n, c_mktsegment AS seg, c_acctbal AS money FROM customer WHERE c_custkey IS NOT NULL AND c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL)
    SELECT 'cell_read:' || m AS var, 'segment:' || seg AS obj FROM known UNION SELECT 'box_read:' || n, 'segment:' || seg FROM known WHERE money < 0""",
)
def demanded_points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer reads from its cell and each nation from its box."""
    known = table(spark, sf_dir, "customer").where("c_custkey is not null and c_nationkey is not null and c_mktsegment is not null")
    known = known.select(F.col("c_custkey").alias("m"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"), "c_acctbal")
    debt = known.where("c_acctbal < 0")

    def at(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.col(key))

    def rows(names: str, *parts: tuple) -> DataFrame:
        made = [source.select(*[c.alias(n) for c, n in zip(cells, names.split(), strict=True)]) for source, *cells in parts]
        out = made[0]
        for more in made[1:]:
            out = out.unionByName(more)
        return out

    taken, back = at("taken", "n"), at("returned", "n")
    value, got, cell, name = at("value", "m"), at("got", "m"), at("cell", "m"), at("name", "m")
    f, g = F.lit("f"), F.lit("g")
    asked = rows("var", (known, at("cell_read", "m")), (known, at("box_read", "n")))
    program = (
        rows("var obj", (known, value, at("segment", "s")), (known, cell, at("a cell", "m")), (known, at("box", "n"), at("a box", "n"))),
        rows("dst src", (known, back, taken)),
        rows("base field src", (known, cell, f, got), (debt, at("box", "n"), g, got)),
        rows("dst base field", (known, at("cell_read", "m"), name, f), (known, at("box_read", "n"), at("box", "n"), g)),
        rows("call formal actual", (known, at("give", "m"), taken, value), (known, at("rename", "m"), taken, cell)),
        rows("call dst returned", (known, at("give", "m"), got, back), (known, at("rename", "m"), name, back)),
    )
    return demand.points_to_of(asked, *program)
