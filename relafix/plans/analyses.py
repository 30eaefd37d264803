"""Nullness, exceptions, code motion, loop nests, bounds of types and entry points on relations made from the driver's tables.

As in ``core``, conversations serve as methods and their turns as statements;
suppliers, nations and regions are a class hierarchy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relafix.operators import carried, exceptions, graph, motion, nullness, pointsto, taint
from relafix.plans import core, entrypoints, passes
from relafix.plans.catalogue import register
from relafix.tables import table

_NULLS = f"""{core._TURNS},
gen AS (SELECT method, node, 1 AS bit FROM entry UNION SELECT t.method, t.node, 2 FROM turns t LEFT JOIN entry e USING (method, node) WHERE t.answers AND NOT t.asks AND e.method IS NULL),
edge AS (SELECT method, node AS src, node + 1 AS dst, CASE WHEN asks THEN 2 ELSE 3 END AS mask FROM turns UNION SELECT method, node, node + 2, 1 FROM turns WHERE asks),
r AS (SELECT g.method, e.dst AS node, g.bit FROM gen g JOIN edge e ON e.method = g.method AND e.src = g.node WHERE e.mask & g.bit <> 0
  UNION SELECT r.method, e.dst, r.bit FROM r JOIN edge e ON e.method = r.method AND e.src = r.node WHERE e.mask & r.bit <> 0 AND NOT EXISTS (SELECT 1 FROM gen g WHERE g.method = r.method AND g.node = r.node)),
status AS (SELECT method, node, bit_or(bit) AS bits FROM r GROUP BY ALL)"""


def _nullness(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first turn sets ``x`` to null, assistants to something else; users ask whether it is null and then skip a turn."""
    turns, x = core._turns(spark, sf_dir), F.lit("x").alias("local")
    first = core._entry(turns).select("method", "node", x, F.lit(nullness.NULL).alias("bits"))
    set_ = turns.where("answers AND NOT asks").join(first, ["method", "node"], "left_anti").select("method", "node", x, F.lit(nullness.NON_NULL).alias("bits"))
    assigned = first.union(set_)
    tests = turns.where("asks").select("method", "node", x, (F.col("node") + 2).alias("null_dst"), (F.col("node") + 1).alias("other_dst"))
    copies, uses = assigned.select("method", "node", "local", F.col("local").alias("source")).limit(0), turns.where("NOT asks").select("method", "node", x)
    return nullness.nullness(core._cfg(turns), assigned, copies, assigned, tests, uses.limit(0)), tests, uses


@register("nullness", f"WITH RECURSIVE {_NULLS} SELECT method, node, CASE bits WHEN 1 THEN 'null' WHEN 2 THEN 'non-null' ELSE 'unknown' END AS colour FROM status")
def null_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``x`` may be before each turn."""
    return _nullness(spark, sf_dir)[0].select("method", "node", nullness.colour(F.col("bits")).alias("colour"))


@register("decided_null_tests", f"WITH RECURSIVE {_NULLS} SELECT method, node, bits = 1 AS is_null FROM status JOIN turns USING (method, node) WHERE asks AND bits <> 3")
def decided_null_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who know the answer before they ask."""
    status, tests, _ = _nullness(spark, sf_dir)
    return nullness.decided_tests(status, tests).select("method", "node", "is_null")


@register("checked_dereferences", f"WITH RECURSIVE {_NULLS} SELECT t.method, t.node, CASE s.bits WHEN 2 THEN 'safe' WHEN 1 THEN 'crash' WHEN 3 THEN 'check' ELSE 'unreached' END AS verdict FROM turns t LEFT JOIN status s USING (method, node) WHERE NOT t.asks")
def checked_dereferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of others use ``x``: which of them need a check."""
    status, _, uses = _nullness(spark, sf_dir)
    return nullness.checked_dereferences(status, uses).select("method", "node", "verdict")


_RAISED = f"""{core._CLASSES}, traps AS (SELECT s_suppkey AS method, 'R' || s_suppkey % 5 AS type FROM supplier WHERE s_suppkey % 3 = 0),
shut AS (SELECT t.method, u.sub AS type FROM traps t JOIN up u ON u.super = t.type),
esc AS (SELECT s_suppkey AS method, 'N' || s_nationkey AS type FROM supplier WHERE s_acctbal < 0
  UNION SELECT s.s_suppkey, e.type FROM esc e JOIN supplier s ON s.s_suppkey // 2 = e.method WHERE NOT EXISTS (SELECT 1 FROM shut h WHERE h.method = s.s_suppkey AND h.type = e.type))"""


@register("escaping_exceptions", f"WITH RECURSIVE {_RAISED} SELECT method, type FROM esc")
def escaping_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in debt raise their nation, each calls the supplier of half its number, every third handles one region around that call."""
    supplier = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    raised = supplier.where("s_acctbal < 0").select(key.alias("method"), F.lit(0).alias("idx"), F.concat(F.lit("N"), "s_nationkey").alias("type"))
    calls = supplier.select(key.alias("method"), F.lit(1).alias("idx"), F.expr("s_suppkey div 2").alias("callee"))
    traps = supplier.where("s_suppkey % 3 = 0").select(key.alias("method"), F.lit(1).alias("begin"), F.lit(2).alias("end"), F.concat(F.lit("R"), (key % 5).cast("string")).alias("type"))
    subtype = pointsto.subtypes(core._hierarchy(spark, sf_dir)[0])
    return exceptions.escaping(exceptions.may_raise(raised, calls, traps, subtype), traps, subtype).select("method", "type")


_MOVED = f"""{core._TURNS}, nodes AS (SELECT method, node FROM entry UNION SELECT r.method, c.dst FROM nodes r JOIN cfg c ON c.method = r.method AND c.src = r.node),
e AS (SELECT c.* FROM cfg c JOIN nodes n ON n.method = c.method AND n.node = c.src),
comp AS (SELECT method, node FROM turns JOIN nodes USING (method, node) WHERE answers), kill AS (SELECT method, node FROM turns JOIN nodes USING (method, node) WHERE asks AND node % 3 = 0),
cells AS (SELECT * FROM nodes WHERE method IN (SELECT method FROM turns WHERE answers)),
notup AS (SELECT * FROM entry UNION SELECT e.method, e.dst FROM e JOIN kill k ON k.method = e.method AND k.node = e.src
  UNION SELECT e.method, e.dst FROM notup u JOIN e ON e.method = u.method AND e.src = u.node WHERE (u.method, u.node) NOT IN (SELECT (method, node) FROM comp)),
up AS (SELECT * FROM cells EXCEPT SELECT * FROM notup),
leave AS (SELECT method, node FROM cells EXCEPT SELECT method, src FROM e),
notdown AS (SELECT * FROM (SELECT * FROM leave UNION SELECT * FROM kill) WHERE (method, node) NOT IN (SELECT (method, node) FROM comp)
  UNION SELECT e.method, e.src FROM notdown d JOIN e ON e.method = d.method AND e.dst = d.node WHERE (e.method, e.src) NOT IN (SELECT (method, node) FROM comp)),
down AS (SELECT * FROM cells EXCEPT SELECT * FROM notdown),
safe AS (SELECT * FROM up UNION SELECT * FROM down),
early AS (SELECT * FROM down INTERSECT (SELECT * FROM entry UNION SELECT method, dst FROM e WHERE (method, src) IN (SELECT (method, node) FROM kill) OR (method, src) NOT IN (SELECT (method, node) FROM safe))),
notdel AS (SELECT * FROM (SELECT * FROM entry UNION SELECT method, dst FROM e WHERE (method, src) IN (SELECT (method, node) FROM comp)) WHERE (method, node) NOT IN (SELECT (method, node) FROM early)
  UNION SELECT e.method, e.dst FROM notdel d JOIN e ON e.method = d.method AND e.src = d.node WHERE (e.method, e.dst) NOT IN (SELECT (method, node) FROM early)),
del AS (SELECT * FROM cells EXCEPT SELECT * FROM notdel),
late AS (SELECT * FROM del WHERE (method, node) IN (SELECT (method, node) FROM comp) OR (method, node) IN (SELECT (method, src) FROM e WHERE (method, dst) NOT IN (SELECT (method, node) FROM del))),
notiso AS (SELECT method, src AS node FROM e WHERE (method, dst) IN (SELECT (method, node) FROM comp) AND (method, dst) NOT IN (SELECT (method, node) FROM late)
  UNION SELECT e.method, e.src FROM notiso i JOIN e ON e.method = i.method AND e.dst = i.node WHERE (i.method, i.node) NOT IN (SELECT (method, node) FROM late)),
iso AS (SELECT * FROM cells EXCEPT SELECT * FROM notiso)"""


@register(
    "lazy_code_motion",
    f"""WITH RECURSIVE {_MOVED} SELECT method, node, what FROM (
    SELECT *, 'earliest' AS what FROM early UNION ALL SELECT *, 'latest' FROM late UNION ALL (SELECT *, 'insert' FROM (SELECT * FROM late EXCEPT SELECT * FROM iso))
    UNION ALL (SELECT *, 'replace' FROM (SELECT * FROM comp EXCEPT (SELECT * FROM late INTERSECT SELECT * FROM iso))))""",
)
def lazy_code_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants compute an expression that every third turn, if a user's, changes."""
    turns = core._turns(spark, sf_dir)
    expr = F.lit("e").alias("expr")
    found = motion.code_motion(core._cfg(turns), core._entry(turns), turns.where("answers").select("method", "node", expr), turns.where("asks AND node % 3 = 0").select("method", "node", expr))
    named = [getattr(found, what).select("method", "node", F.lit(what).alias("what")) for what in ("earliest", "latest", "insert", "replace")]
    return named[0].union(named[1]).union(named[2]).union(named[3])


_LOOPS = f"""{core._RING}, reach AS (SELECT 0 AS node UNION SELECT dst FROM reach JOIN ring ON src = node),
avoid AS (SELECT node AS dom, 0 AS node FROM reach WHERE node <> 0 UNION SELECT dom, dst FROM avoid JOIN ring ON src = node WHERE dst <> dom),
dom AS (SELECT a.node AS dom, b.node FROM reach a CROSS JOIN reach b WHERE NOT EXISTS (SELECT 1 FROM avoid x WHERE x.dom = a.node AND x.node = b.node)),
back AS (SELECT dst AS head, src AS node FROM ring JOIN dom ON dom = dst AND node = src),
body AS (SELECT head, node FROM back UNION SELECT head, head FROM back UNION SELECT head, src FROM body JOIN ring ON dst = node WHERE node <> head),
size AS (SELECT head, count(*) AS n FROM body GROUP BY head)"""


@register(
    "loop_nest",
    f"""WITH RECURSIVE {_LOOPS}, outer_ AS (SELECT i.head AS inner_, o.head, o.n FROM size i JOIN body b ON b.node = i.head JOIN size o ON o.head = b.head WHERE o.head <> i.head AND o.n > i.n)
    SELECT s.head, coalesce((SELECT head FROM outer_ WHERE inner_ = s.head ORDER BY n, head LIMIT 1), -1) AS parent, (1 + (SELECT count(*) FROM outer_ WHERE inner_ = s.head))::INTEGER AS depth FROM size s""",
)
def loop_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the nations' loops lies in which; -1 for outermost ones."""
    ring = core._ring(spark, sf_dir)
    return graph.loop_nest(graph.natural_loops(ring, graph.dominators(ring, 0))).fillna(-1, "parent")


@register(
    "loop_invariants",
    f"""WITH RECURSIVE {_LOOPS}, inside AS (SELECT b.head, b.node, n_regionkey AS expr FROM body b JOIN nation ON n_nationkey = b.node),
    varies AS (SELECT DISTINCT b.head, n_nationkey % 5 AS expr FROM body b JOIN nation ON n_nationkey = b.node WHERE n_nationkey % 4 = 0)
    SELECT head, node, expr FROM inside ANTI JOIN varies USING (head, expr)""",
)
def loop_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations compute what reads the local of their region; every fourth sets the local of its number modulo 5."""
    ring, nation, m = core._ring(spark, sf_dir), table(spark, sf_dir, "nation"), F.lit("m").alias("method")
    bodies = graph.natural_loops(ring, graph.dominators(ring, 0)).select(m, "head", "node")
    computed = nation.select(m, F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("expr"))
    defs = nation.where("n_nationkey % 4 = 0").select(m, F.col("n_nationkey").alias("node"), (F.col("n_nationkey") % 5).alias("local"))
    operands = nation.select(m, F.col("n_regionkey").alias("expr"), F.col("n_regionkey").alias("local")).distinct()
    return passes.loop_invariants(bodies, computed, operands, defs).select("head", "node", "expr")


@register(
    "least_upper_bounds",
    f"""WITH RECURSIVE {core._CLASSES}, pairs AS (SELECT 'S' || s_suppkey AS a, 'S' || (s_suppkey + 1) AS b FROM supplier),
    common AS (SELECT p.a, p.b, x.super AS bound, x.n AS height FROM pairs p JOIN up x ON x.sub = p.a JOIN up y ON y.sub = p.b AND y.super = x.super)
    SELECT a, b, arg_min(bound, height) AS bound FROM common GROUP BY ALL""",
)
def least_upper_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest thing that two suppliers next to each other have in common."""
    subtype = pointsto.subtypes(core._hierarchy(spark, sf_dir)[0])
    key = F.col("s_suppkey")
    pairs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), key).alias("a"), F.concat(F.lit("S"), key + 1).alias("b"))
    return pointsto.least_upper_bounds(pairs, subtype).select("a", "b", "bound")


@register(
    "bypassed_edges",
    f"""WITH RECURSIVE {core._TURNS}, gone AS (SELECT method, node FROM turns WHERE NOT asks AND NOT answers),
    r AS (SELECT c.method, c.src, c.dst FROM cfg c ANTI JOIN gone g ON g.method = c.method AND g.node = c.src
      UNION SELECT r.method, r.src, c.dst FROM r JOIN gone g ON g.method = r.method AND g.node = r.dst JOIN cfg c ON c.method = r.method AND c.src = r.dst)
    SELECT method, src, dst FROM r ANTI JOIN gone g ON g.method = r.method AND g.node = r.dst""",
)
def bypassed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without the turns of neither user nor assistant."""
    turns = core._turns(spark, sf_dir)
    return passes.bypassed(core._cfg(turns), turns.where("NOT asks AND NOT answers").select("method", "node"))


@register("distinct_sinks", "SELECT l_suppkey AS origin, count(DISTINCT l_partkey) AS n_sinks FROM lineitem GROUP BY ALL")
def distinct_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that each supplier's goods end in."""
    lines = table(spark, sf_dir, "lineitem")
    return taint.n_sinks(lines.select(F.col("l_suppkey").alias("origin"), F.col("l_partkey").alias("sink")))


_PLATFORM = f"""{core._CLASSES}, listed(base, stage) AS (VALUES ('R0', 0), ('R2', 0), ('N7', 0)),
starts AS (SELECT DISTINCT u.sub AS component, l.base, l.stage, f.target FROM up u JOIN listed l ON l.base = u.super JOIN found f ON f.class = u.sub WHERE u.sub LIKE 'S%')"""


@register("lifecycle_calls", f"WITH RECURSIVE {_PLATFORM} SELECT component, base, stage, target FROM starts")
def lifecycle_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions and a nation are component classes whose ``m`` the platform calls on every supplier below."""
    classes, methods = core._hierarchy(spark, sf_dir)
    components = classes.where("name LIKE 'S%'").select("name")
    listed = entrypoints.lifecycle_table(spark, {"R0": ["m"], "R2": ["m"], "N7": ["m"]})
    return entrypoints.lifecycle_calls(components, pointsto.subtypes(classes), pointsto.dispatch_table(classes, methods), listed)


@register(
    "callback_targets",
    f"""WITH RECURSIVE {_PLATFORM}, made AS (SELECT 'S' || s_suppkey || '.m' AS src, 'S' || (s_suppkey + 3) AS class FROM supplier UNION SELECT 'N' || n_nationkey || '.m', 'S' || (n_nationkey * 3 + 1) FROM nation),
    go AS (SELECT m.src, f.target AS tgt FROM made m JOIN found f ON f.class = m.class JOIN up u ON u.sub = m.class AND u.super IN ('R1', 'R3')),
    r AS (SELECT component, target AS method FROM starts UNION SELECT r.component, g.tgt FROM r JOIN go g ON g.src = r.method)
    SELECT DISTINCT component, tgt AS target FROM r JOIN go ON src = method""",
)
def callback_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of suppliers and nations create further suppliers; those of two regions are called back on ``m``."""
    classes, methods = core._hierarchy(spark, sf_dir)
    subtype, dispatch = pointsto.subtypes(classes), pointsto.dispatch_table(classes, methods)
    entries = lifecycle_calls(spark, sf_dir).select("component", F.col("target").alias("method")).distinct()
    made = [table(spark, sf_dir, t).select(F.concat(F.lit(p), k, F.lit(".m")).alias("method"), F.concat(F.lit("S"), F.expr(c)).alias("class")) for t, p, k, c in (("supplier", "S", "s_suppkey", "s_suppkey + 3"), ("nation", "N", "n_nationkey", "n_nationkey * 3 + 1"))]
    interfaces = spark.createDataFrame([("R1", "m"), ("R3", "m")], "interface string, subsig string")
    calls = spark.createDataFrame([], "src string, tgt string")
    return entrypoints.callbacks(entries, calls, made[0].union(made[1]), subtype, dispatch, interfaces)[1]


def _asking(spark: SparkSession, sf_dir: str) -> tuple[carried.Program, DataFrame, DataFrame]:
    """Turns as a program: a user's sets ``y`` by a call on ``x``, an assistant's makes a new ``x``, others copy ``y`` to ``x``.

    The callee returns its argument or a new object.  The second table is what is made, the third the turns.
    """
    turns = core._turns(spark, sf_dir)
    here = core._node().alias("node")
    asks, makes, others = turns.where("asks"), turns.where("answers AND NOT asks"), turns.where("NOT asks AND NOT answers")

    def row(schema: str, *lines: str) -> DataFrame:
        return spark.createDataFrame([tuple(x.split()) for x in lines], schema)

    def fixed(*pairs: tuple[str, str]) -> list:
        return [F.lit(v).alias(n) for n, v in pairs]

    sets = asks.select(here, *fixed(("local", "y"))).union(turns.where("NOT asks").select(here, *fixed(("local", "x")))).union(row("node string, local string", "ask:1 q", "ask:2 q"))
    program = carried.Program(
        edges=turns.select(core._node().alias("src"), core._node(1).alias("dst")).union(row("src string, dst string", "ask:0 ask:1", "ask:0 ask:2", "ask:1 ask:3", "ask:2 ask:3")),
        starts=row("method string, node string", "ask ask:0"),
        exits=row("method string, node string", "ask ask:3"),
        defs=sets,
        copies=others.select(here, *fixed(("local", "x"), ("source", "y"))).union(row("node string, local string, source string", "ask:1 q p")),
        arguments=asks.select(here, *fixed(("callee", "ask"), ("arg", "x"), ("param", "p"))),
        results=asks.select(here, *fixed(("callee", "ask"), ("value", "q"), ("local", "y"))),
    )
    made = makes.select(here, *fixed(("local", "x")), F.concat(F.lit("A"), (F.col("node") % 3).cast("string")).alias("type"))
    return program, made.union(row("node string, local string, type string", "ask:2 q Ask")), turns


@register(
    "possible_types",
    f"""WITH RECURSIVE {core._TURNS}, r AS (SELECT method, node + 1 AS node, 'x' AS local, 'A' || node % 3 AS type FROM turns WHERE answers AND NOT asks UNION SELECT method, node + 1, 'y', 'Ask' FROM turns WHERE asks
      UNION SELECT r.method, t.node + 1, v.local, r.type FROM r JOIN turns t ON t.method = r.method AND t.node = r.node CROSS JOIN (VALUES ('x'), ('y')) v(local)
      WHERE CASE WHEN t.asks THEN r.local = 'x' WHEN t.answers THEN r.local = 'y' AND v.local = 'y' ELSE r.local = 'y' END)
    SELECT method || ':' || node AS node, local, type FROM r""",
)
def possible_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the locals of a conversation may hold, over the calls of its users."""
    program, made, _ = _asking(spark, sf_dir)
    return carried.possible_types(program, made).where("node NOT LIKE 'ask:%'").select("node", "local", "type")


@register(
    "unset_over_calls",
    f"""WITH RECURSIVE {core._TURNS}, r AS (SELECT e.method, e.node, v.local FROM entry e CROSS JOIN (VALUES ('x'), ('y')) v(local)
      UNION SELECT r.method, t.node + 1, v.local FROM r JOIN turns t ON t.method = r.method AND t.node = r.node CROSS JOIN (VALUES ('x'), ('y')) v(local)
      WHERE CASE WHEN t.asks THEN r.local = 'x' WHEN t.answers THEN r.local = 'y' AND v.local = 'y' ELSE r.local = 'y' END)
    SELECT r.method || ':' || r.node AS node, r.local FROM r JOIN turns t ON t.method = r.method AND t.node = r.node WHERE (t.asks AND r.local = 'x') OR (NOT t.asks AND NOT t.answers AND r.local = 'y')""",
)
def unset_over_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that may read what nothing has set, a callee handing it back included."""
    program, _, turns = _asking(spark, sf_dir)
    first = core._entry(turns).select("method", core._node().alias("node"))
    # every conversation is a method of its own, with both locals
    program.starts = program.starts.union(first.select(F.col("method").cast("string"), "node"))
    names = F.explode(F.array(F.lit("x"), F.lit("y"))).alias("local")
    uses = turns.where("asks").select(core._node().alias("node"), F.lit("x").alias("local")).union(turns.where("NOT asks AND NOT answers").select(core._node(), F.lit("y")))
    return carried.uninitialised(program, first.select(F.col("method").cast("string").alias("method"), names), uses)
