"""The core analyses on relations made from the driver's tables: dominance, loops, hierarchies, points-to, tabulation, taint.

Conversations serve as methods and turns as statements: a turn goes on to the next
one, a user's turn may also skip one.  Suppliers, nations, regions, parts and
customers serve as classes, objects, variables and call sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relafix.operators import flow, graph, ifds, pointsto, taint
from relafix.plans import passes
from relafix.plans.catalogue import register
from relafix.tables import table

_TURNS = """turns AS (SELECT conv_id AS method, turn::INTEGER AS node, coalesce(bool_or(role = 'user'), false) AS asks, coalesce(bool_or(role = 'assistant'), false) AS answers
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
cfg AS (SELECT method, node AS src, node + 1 AS dst FROM turns UNION SELECT method, node, node + 2 FROM turns WHERE asks),
entry AS (SELECT method, min(node) AS node FROM turns GROUP BY method)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    said = [F.coalesce(F.bool_or(F.col("role") == r), F.lit(False)).alias(n) for r, n in (("user", "asks"), ("assistant", "answers"))]
    return rows.groupBy(F.col("conv_id").alias("method"), F.col("turn").cast("int").alias("node")).agg(*said)


def _cfg(turns: DataFrame) -> DataFrame:
    on = turns.select("method", F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    return on.union(turns.where("asks").select("method", "node", F.col("node") + 2))


def _entry(turns: DataFrame) -> DataFrame:
    return turns.groupBy("method").agg(F.min("node").alias("node"))


_DOM = """reach AS (SELECT method, node FROM entry UNION SELECT r.method, c.dst FROM reach r JOIN cfg c ON c.method = r.method AND c.src = r.node),
avoid AS (SELECT r.method, r.node AS dom, e.node FROM reach r JOIN entry e ON e.method = r.method AND e.node <> r.node
  UNION SELECT a.method, a.dom, c.dst FROM avoid a JOIN cfg c ON c.method = a.method AND c.src = a.node WHERE c.dst <> a.dom),
dom AS (SELECT a.method, a.node AS dom, b.node FROM reach a JOIN reach b ON a.method = b.method WHERE NOT EXISTS (SELECT 1 FROM avoid x WHERE x.method = a.method AND x.dom = a.node AND x.node = b.node))"""


def _dominators(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = _turns(spark, sf_dir)
    cfg = _cfg(turns)
    return cfg, graph.dominators(cfg, _entry(turns), ("method",))


@register("dominators", f"WITH RECURSIVE {_TURNS}, {_DOM} SELECT method, dom, node FROM dom")
def dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that every way to a turn passes."""
    return _dominators(spark, sf_dir)[1].select("method", "dom", "node")


@register(
    "immediate_dominators",
    f"""WITH RECURSIVE {_TURNS}, {_DOM}, height AS (SELECT method, node AS dom, count(*) AS n FROM dom GROUP BY ALL)
    SELECT d.method, d.node, arg_max(d.dom, h.n) AS idom FROM dom d JOIN height h ON h.method = d.method AND h.dom = d.dom WHERE d.dom <> d.node GROUP BY ALL""",
)
def immediate_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominator tree of each conversation."""
    return graph.immediate_dominators(_dominators(spark, sf_dir)[1], ("method",)).select("method", "node", "idom")


@register(
    "dominance_frontier",
    f"""WITH RECURSIVE {_TURNS}, {_DOM} SELECT DISTINCT d.method, d.dom AS node, c.dst AS frontier FROM dom d JOIN cfg c ON c.method = d.method AND c.src = d.node
    WHERE NOT EXISTS (SELECT 1 FROM dom s WHERE s.method = d.method AND s.dom = d.dom AND s.node = c.dst AND s.dom <> s.node)""",
)
def dominance_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a turn's dominance ends."""
    cfg, dom = _dominators(spark, sf_dir)
    return graph.dominance_frontier(cfg, dom, ("method",)).select("method", "node", "frontier")


_RING = "ring AS (SELECT n_nationkey AS src, n_nationkey + 1 AS dst FROM nation UNION SELECT n_nationkey, n_regionkey * 4 FROM nation)"


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") + 1).alias("dst")).union(nation.select("n_nationkey", F.col("n_regionkey") * 4)).distinct()


@register(
    "natural_loops",
    f"""WITH RECURSIVE {_RING}, reach AS (SELECT 0 AS node UNION SELECT dst FROM reach JOIN ring ON src = node),
    avoid AS (SELECT node AS dom, 0 AS node FROM reach WHERE node <> 0 UNION SELECT dom, dst FROM avoid JOIN ring ON src = node WHERE dst <> dom),
    dom AS (SELECT a.node AS dom, b.node FROM reach a CROSS JOIN reach b WHERE NOT EXISTS (SELECT 1 FROM avoid x WHERE x.dom = a.node AND x.node = b.node)),
    back AS (SELECT dst AS head, src AS node FROM ring JOIN dom ON dom = dst AND node = src),
    body AS (SELECT head, node FROM back UNION SELECT head, head FROM back UNION SELECT head, src FROM body JOIN ring ON dst = node WHERE node <> head)
    SELECT head, node FROM body""",
)
def natural_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops of nations: each goes on to the next one and back to its region's first."""
    ring = _ring(spark, sf_dir)
    return graph.natural_loops(ring, graph.dominators(ring, 0)).select("head", "node")


@register(
    "strong_components",
    f"""WITH RECURSIVE {_RING}, t AS (SELECT src, dst FROM ring UNION SELECT t.src, r.dst FROM t JOIN ring r ON r.src = t.dst),
    nodes AS (SELECT src AS node FROM ring UNION SELECT dst FROM ring)
    SELECT node, least(node, coalesce((SELECT min(a.dst) FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src WHERE a.src = node), node)) AS component FROM nodes""",
)
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that reach each other along the ring."""
    return graph.strong_components(_ring(spark, sf_dir))


_CLASSES = """classes AS (SELECT 'S' || s_suppkey AS name, 'N' || s_nationkey AS super FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || r_regionkey, NULL FROM region),
up AS (SELECT name AS sub, name AS super, 0 AS n FROM classes UNION ALL SELECT u.sub, c.super, u.n + 1 FROM up u JOIN classes c ON c.name = u.super WHERE c.super IS NOT NULL),
declared AS (SELECT 'R' || r_regionkey AS class FROM region UNION ALL SELECT 'N' || n_nationkey FROM nation WHERE n_nationkey > n_regionkey * 5 UNION ALL SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal < 0),
found AS (SELECT u.sub AS class, arg_min(d.class, u.n) || '.m' AS target FROM up u JOIN declared d ON d.class = u.super GROUP BY u.sub)"""


def _hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers under nations under regions; ``m`` is declared by all regions, some nations and suppliers in debt."""
    supplier, nation, region = (table(spark, sf_dir, n) for n in ("supplier", "nation", "region"))

    def name(letter: str, column: str):
        return F.concat(F.lit(letter), F.col(column))

    classes = supplier.select(name("S", "s_suppkey").alias("name"), name("N", "s_nationkey").alias("super"))
    classes = classes.union(nation.select(name("N", "n_nationkey"), name("R", "n_regionkey"))).union(region.select(name("R", "r_regionkey"), F.lit(None).cast("string")))
    declared = region.select(name("R", "r_regionkey").alias("class")).union(nation.where("n_nationkey > n_regionkey * 5").select(name("N", "n_nationkey"))).union(supplier.where("s_acctbal < 0").select(name("S", "s_suppkey")))
    methods = declared.select(F.concat("class", F.lit(".m")).alias("sig"), "class", F.lit("m").alias("subsig"), F.lit(False).alias("abstract"))
    return classes.withColumn("interfaces", F.array().cast("array<string>")), methods


@register("subtypes", f"WITH RECURSIVE {_CLASSES} SELECT sub, super FROM up")
def subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, nations and regions with all they descend from."""
    return pointsto.subtypes(_hierarchy(spark, sf_dir)[0])


@register("dispatch_table", f"WITH RECURSIVE {_CLASSES} SELECT class, target FROM found")
def dispatch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declaration of ``m`` that each class has."""
    return pointsto.dispatch_table(*_hierarchy(spark, sf_dir)).select("class", "target")


@register(
    "class_hierarchy_calls",
    f"""WITH RECURSIVE {_CLASSES} SELECT DISTINCT 'c' || c_custkey AS src, 0 AS idx, f.target AS tgt, 'virtual' AS kind FROM customer JOIN up u ON u.super = 'N' || c_nationkey JOIN found f ON f.class = u.sub""",
)
def class_hierarchy_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers call ``m`` on something of their nation."""
    classes, methods = _hierarchy(spark, sf_dir)
    customer = table(spark, sf_dir, "customer")
    invokes = customer.select(F.concat(F.lit("c"), "c_custkey").alias("method"), F.lit(0).alias("idx"), F.lit("virtual").alias("kind"), F.concat(F.lit("N"), "c_nationkey").alias("class"), F.lit("m").alias("subsig"))
    return pointsto.class_hierarchy_calls(invokes, pointsto.subtypes(classes), pointsto.dispatch_table(classes, methods))


_HEAP = """low AS (SELECT 'a' || s_nationkey AS var, 's' || s_suppkey AS obj FROM supplier),
high AS (SELECT DISTINCT 'b' || n_regionkey AS var, obj FROM nation JOIN low ON var = 'a' || n_nationkey),
cells AS (SELECT DISTINCT h.obj, p_brand AS field, l.obj AS val FROM part JOIN high h ON h.var = 'b' || (p_size % 5) JOIN low l ON l.var = 'a' || (p_partkey % 25)),
loaded AS (SELECT DISTINCT 'c' || p_type AS var, x.val AS obj FROM part JOIN high h ON h.var = 'b' || (p_size % 5) JOIN cells x ON x.obj = h.obj AND x.field = p_brand)"""


def _points_to(spark: SparkSession, sf_dir: str, heap: bool):
    """``a`` variables hold suppliers, ``b`` copies; parts store one into a field of another, load it back and copy it."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", F.concat(F.lit("b"), F.col("p_size") % 5).alias("base"), F.concat(F.lit("a"), F.col("p_partkey") % 25).alias("src")).distinct()
    alloc = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("obj"), F.concat(F.lit("a"), "s_nationkey").alias("var"))
    simple = table(spark, sf_dir, "nation").select(F.concat(F.lit("a"), "n_nationkey").alias("src"), F.concat(F.lit("b"), "n_regionkey").alias("dst"))
    simple = simple.union(part.select(F.concat(F.lit("c"), "p_type"), F.concat(F.lit("d"), "p_brand")).distinct())
    store = part.select("src", "base", F.col("p_brand").alias("field")).distinct()
    load = part.select("base", F.col("p_brand").alias("field"), F.concat(F.lit("c"), "p_type").alias("dst")).distinct()
    return pointsto.points_to(alloc, simple, store, load, heap=heap)


@register("points_to", f"WITH {_HEAP} SELECT var, obj FROM low UNION SELECT var, obj FROM high UNION SELECT var, obj FROM loaded UNION SELECT 'd' || p_brand, obj FROM part JOIN loaded ON var = 'c' || p_type")
def points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each variable may hold."""
    return _points_to(spark, sf_dir, heap=False)["pts"].select("var", "obj")


@register("heap_cells", f"WITH {_HEAP} SELECT obj, field, val FROM cells")
def heap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each field of each object may hold."""
    return _points_to(spark, sf_dir, heap=True)["heap"].select("obj", "field", "val")


@register(
    "call_graph_on_the_fly",
    """WITH held AS (SELECT s_nationkey AS n, 's' || s_suppkey AS obj, 'C' || (s_suppkey % 7) || '.go' AS callee FROM supplier), given AS (SELECT DISTINCT c_nationkey AS n, 'o' || c_mktsegment AS obj FROM customer),
    calls AS (SELECT DISTINCT n, callee FROM held), ret AS (SELECT DISTINCT callee, obj FROM calls JOIN given USING (n))
    SELECT 'call' AS kind, n::VARCHAR AS a, callee AS b FROM calls UNION SELECT 'pts', 'x' || n, obj FROM held UNION SELECT 'pts', 'y' || n, obj FROM given UNION SELECT 'pts', calls.callee || '.this', obj FROM calls JOIN held USING (n)
    UNION SELECT 'pts', callee || '.p', obj FROM ret UNION SELECT 'pts', callee || '.ret', obj FROM ret UNION SELECT 'pts', 'r' || n, obj FROM calls JOIN ret USING (callee)""",
)
def call_graph_on_the_fly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's site calls ``go`` on its suppliers with its customers' segments; targets return what they get."""
    supplier, customer, nation = (table(spark, sf_dir, n) for n in ("supplier", "customer", "nation"))
    main = F.lit("main").alias("method")
    obj, kind = F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("C"), F.col("s_suppkey") % 7)
    alloc = supplier.select(main, obj.alias("obj"), F.concat(F.lit("x"), "s_nationkey").alias("var")).union(customer.select(main, F.concat(F.lit("o"), "c_mktsegment"), F.concat(F.lit("y"), "c_nationkey")).distinct())
    classes = supplier.select(kind.alias("class")).distinct()
    target = F.concat("class", F.lit(".go"))
    idx = F.col("n_nationkey").alias("idx")
    actuals = nation.select(main, idx, F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.concat(F.lit(v), "n_nationkey").alias("var")) for p, v in ((-1, "x"), (0, "y"), (-2, "r"))])).alias("e")).select("method", "idx", "e.*")
    formals = classes.select(target.alias("method"), F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.concat("class", F.lit(f".go.{v}")).alias("var")) for p, v in ((-1, "this"), (0, "p"), (-2, "ret"))])).alias("e")).select("method", "e.*")
    found = pointsto.points_to_with_calls(
        alloc=alloc,
        simple=classes.select(target.alias("method"), F.concat("class", F.lit(".go.p")).alias("src"), F.concat("class", F.lit(".go.ret")).alias("dst")),
        store=spark.createDataFrame([], "method string, src string, base string, field string"),
        load=spark.createDataFrame([], "method string, base string, field string, dst string"),
        invokes=nation.select(main, idx, F.concat(F.lit("x"), "n_nationkey").alias("base"), F.lit("go").alias("subsig")),
        dispatch=classes.select("class", F.lit("go").alias("subsig"), target.alias("target")),
        types=supplier.select(obj.alias("obj"), kind.alias("class")),
        actuals=actuals,
        formals=formals,
        entries=spark.range(1).select(main),
    )
    calls = found["call"].select(F.lit("call").alias("kind"), F.col("idx").cast("string").alias("a"), F.col("callee").alias("b"))
    return calls.union(found["pts"].select(F.lit("pts"), "var", "obj")).distinct()


_LINKED = f"""{_RING}, held AS (SELECT s_nationkey AS n, 's' || s_suppkey AS obj FROM supplier),
peopled AS (SELECT src, dst FROM ring WHERE src IN (SELECT n FROM held) AND dst IN (SELECT n FROM held)),
walk AS (SELECT DISTINCT n, n AS m FROM held JOIN nation ON n = n_nationkey UNION SELECT n, dst FROM walk JOIN peopled ON src = m)"""


@register(
    "points_to_loops",
    f"""WITH RECURSIVE {_LINKED} SELECT 'v' || n AS var, obj FROM held UNION SELECT 'x' || walk.n, obj FROM walk JOIN held ON held.n = m UNION SELECT 'y' || w.n, obj FROM walk w JOIN peopled p ON p.src = w.m JOIN held ON held.n = p.dst
    UNION SELECT 't' || n_nationkey, 'T' || n_nationkey FROM nation UNION SELECT 'r' || m, 'T' || n FROM walk""",
)
def points_to_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation are linked to those of the nations after it; a loop follows the links and marks all it comes to.

    What is loaded is loaded from again and stored into, so sets, edges and meeting bases feed each other.
    """
    supplier, nation, ring = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), _ring(spark, sf_dir)

    def var(letter: str, column: str = "n_nationkey"):
        return F.concat(F.lit(letter), F.col(column))

    alloc = supplier.select(var("s", "s_suppkey").alias("obj"), var("v", "s_nationkey").alias("var")).union(nation.select(var("T"), var("t")))
    simple = nation.select(var("v").alias("src"), var("x").alias("dst")).union(nation.select(var("y"), var("x")))
    store = ring.select(var("v", "dst").alias("src"), var("v", "src").alias("base"), F.lit("next").alias("field")).union(nation.select(var("t"), var("x"), F.lit("tag")))
    load = nation.select(var("x").alias("base"), F.lit("next").alias("field"), var("y").alias("dst")).union(nation.select(var("v"), F.lit("tag"), var("r")))
    return pointsto.points_to(alloc, simple, store, load, heap=False)["pts"].select("var", "obj")


@register(
    "call_graph_levels",
    f"""WITH RECURSIVE {_RING}, nations AS (SELECT src, dst FROM ring WHERE dst IN (SELECT n_nationkey FROM nation)), reach AS (SELECT 0 AS n UNION SELECT dst FROM reach JOIN nations ON src = n)
    SELECT 'call' AS kind, 'm' || src AS a, 'm' || dst AS b FROM nations JOIN reach ON src = n UNION SELECT 'pts', 'p' || n, 'P' FROM reach UNION SELECT 'pts', 'o' || src || '_' || dst, 'O' || dst FROM nations JOIN reach ON src = n""",
)
def call_graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's method calls those of the nations after it, level by level and in circles, and hands on what it was given."""
    nation = table(spark, sf_dir, "nation")
    ring = _ring(spark, sf_dir).join(nation.select(F.col("n_nationkey").alias("dst")), "dst").select("src", "dst")

    def of(letter: str, *columns: str):
        return F.concat(F.lit(letter), F.concat_ws("_", *columns))

    idx = F.col("dst").cast("int").alias("idx")
    start = spark.range(1)
    alloc = ring.select(of("m", "src").alias("method"), of("O", "dst").alias("obj"), of("o", "src", "dst").alias("var")).union(start.select(F.lit("m0"), F.lit("P"), F.lit("p0")))
    actuals = ring.select(of("m", "src").alias("method"), idx, F.lit(0).alias("pos"), of("p", "src").alias("var"))
    found = pointsto.points_to_with_calls(
        alloc=alloc,
        simple=spark.createDataFrame([], "method string, src string, dst string"),
        store=spark.createDataFrame([], "method string, src string, base string, field string"),
        load=spark.createDataFrame([], "method string, base string, field string, dst string"),
        invokes=ring.select(of("m", "src").alias("method"), idx, of("o", "src", "dst").alias("base"), F.lit("go").alias("subsig")),
        dispatch=nation.select(of("K", "n_nationkey").alias("class"), F.lit("go").alias("subsig"), of("m", "n_nationkey").alias("target")),
        types=nation.select(of("O", "n_nationkey").alias("obj"), of("K", "n_nationkey").alias("class")),
        actuals=actuals,
        formals=nation.select(of("m", "n_nationkey").alias("method"), F.lit(0).alias("pos"), of("p", "n_nationkey").alias("var")),
        entries=start.select(F.lit("m0").alias("method")),
    )
    calls = found["call"].select(F.lit("call").alias("kind"), F.col("method").alias("a"), F.col("callee").alias("b"))
    return calls.union(found["pts"].select(F.lit("pts"), "var", "obj")).distinct()


@register(
    "side_effects",
    """WITH own AS (SELECT DISTINCT 'n' || c_nationkey AS method, CASE WHEN c_acctbal < 0 THEN 'write' ELSE 'read' END AS mode, c_mktsegment AS obj FROM customer)
    SELECT method, mode, obj FROM own UNION SELECT 'r' || n_regionkey, mode, obj FROM nation JOIN own ON method = 'n' || n_nationkey""",
)
def side_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that nations read and write, and regions through the nations they call."""
    access = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("method"), F.when(F.col("c_acctbal") < 0, "write").otherwise("read").alias("mode"), F.col("c_mktsegment").alias("obj"), F.lit("f").alias("field")).distinct()
    calls = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("tgt"))
    return pointsto.side_effects(access, calls).select("method", "mode", "obj")


def _node(step: int = 0):
    return F.concat_ws(":", "method", (F.col("node") + step).cast("string"))


@register(
    "tabulation",
    f"""WITH RECURSIVE {_TURNS}, r AS (SELECT method, node, 'x' AS fact FROM entry
    UNION SELECT r.method, t.node + 1, f.fact FROM r JOIN turns t ON t.method = r.method AND t.node = r.node CROSS JOIN (VALUES ('x'), ('y')) f(fact)
    WHERE (t.asks AND r.fact = 'x') OR (NOT t.asks AND r.fact = f.fact))
    SELECT method || ':' || node AS node, fact FROM r""",
)
def tabulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn calls a method that turns ``x`` into ``y``; ``x`` goes by the call, an older ``y`` does not."""
    turns = _turns(spark, sf_dir)
    here, after = _node().alias("node"), _node(1)
    calls, plain = turns.where("asks"), turns.where("not asks")
    both = F.explode(F.array(F.lit("x"), F.lit("y")))
    facts = [F.lit("x").alias("fact")]

    def row(text: str, schema: str) -> DataFrame:
        return spark.createDataFrame([tuple(text.split())], schema)

    problem = ifds.Problem(
        calls=calls.select(here, F.lit("ask").alias("callee")),
        starts=row("ask ask:s", "method string, node string"),
        exits=row("ask ask:e", "method string, node string"),
        returns=calls.select(_node().alias("call"), after.alias("site")),
        normal=plain.select(_node().alias("src"), after.alias("dst"), both.alias("fact")).withColumn("out", F.col("fact")).unionByName(row("ask:s ask:e p q", "src string, dst string, fact string, out string")),
        call=calls.select(here, F.lit("ask").alias("callee"), *facts, F.lit("p").alias("out")),
        ret=calls.select(here, F.lit("ask").alias("callee"), F.lit("ask:e").alias("exit"), after.alias("site"), F.lit("q").alias("fact"), F.lit("y").alias("out")),
        bypass=calls.select(here, after.alias("site"), *facts, F.lit("x").alias("out")),
        seeds=_entry(turns).select(here, *facts),
    )
    return ifds.results_at(ifds.tabulate(problem)).where("node not like 'ask:%'")


@register(
    "linear_values",
    f"""WITH RECURSIVE {_TURNS}, r AS (SELECT method, node, 0::BIGINT AS value FROM entry
    UNION ALL SELECT r.method, t.node + 1, CASE WHEN t.asks THEN 2 * r.value + 1 ELSE r.value + 3 END FROM r JOIN turns t ON t.method = r.method AND t.node = r.node)
    SELECT method || ':' || node AS node, value FROM r""",
)
def linear_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number that a user's turn doubles and adds 1 to, and others add 3 to."""
    turns = _turns(spark, sf_dir)
    fact = F.lit("v")
    edges = turns.select(_node().alias("node"), fact.alias("fact"), _node(1).alias("to_node"), fact.alias("to_fact"), F.when(F.col("asks"), 2).otherwise(1).cast("long").alias("mul"), F.when(F.col("asks"), 1).otherwise(3).cast("long").alias("add"))
    seeds = _entry(turns).select(_node().alias("node"), fact.alias("fact"), F.lit(0).cast("long").alias("value"))
    return ifds.linear_values(edges, seeds).select("node", "value")


_SAID = "said AS (SELECT DISTINCT conv_id AS method, turn::INTEGER AS node, role AS local, length(text) % 3 AS value FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL)"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null and role is not null")
    return rows.select(F.col("conv_id").alias("method"), F.col("turn").cast("int").alias("node"), F.col("role").alias("local"), (F.length("text") % 3).cast("long").alias("value")).distinct()


_FLOWN = f"""{_TURNS}, {_SAID}, r AS (SELECT s.method, c.dst AS node, s.local, s.value FROM said s JOIN cfg c ON c.method = s.method AND c.src = s.node
  UNION SELECT r.method, c.dst, r.local, r.value FROM r JOIN cfg c ON c.method = r.method AND c.src = r.node
  WHERE NOT EXISTS (SELECT 1 FROM said k WHERE k.method = r.method AND k.node = r.node AND k.local = r.local))"""


@register("constants", f"WITH RECURSIVE {_FLOWN} SELECT method, node, local, CASE WHEN count(DISTINCT value) = 1 AND count(value) = count(*) THEN max(value) END AS value FROM r GROUP BY ALL")
def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles whose last text has one length, modulo 3, whichever way was taken."""
    said = _said(spark, sf_dir)
    copies = said.limit(0).select("method", "node", "local", F.col("local").alias("source"))
    return flow.constants(_cfg(_turns(spark, sf_dir)), said, copies, said)


@register("lattice_flow", f"WITH RECURSIVE {_FLOWN} SELECT method, node, local, bit_or(CASE value WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 END)::INTEGER AS bits FROM r WHERE value IS NOT NULL GROUP BY ALL")
def lattice_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a set of bits, joined where ways meet."""
    said = _said(spark, sf_dir)
    known = said.where("value is not null").select("method", "node", "local", F.when(F.col("value") == 0, 1).when(F.col("value") == 1, 2).otherwise(4).alias("bits"))
    copies = said.limit(0).select("method", "node", "local", F.col("local").alias("source"))
    return flow.lattice_flow(_cfg(_turns(spark, sf_dir)), known, copies, said).select("method", "node", "local", F.col("bits").cast("int").alias("bits"))


@register(
    "must_flow",
    f"""WITH RECURSIVE {_TURNS}, {_SAID}, facts AS (SELECT DISTINCT method, local AS fact FROM said),
    r AS (SELECT e.method, e.node, f.fact FROM entry e JOIN facts f ON f.method = e.method
      UNION SELECT r.method, c.dst, r.fact FROM r JOIN cfg c ON c.method = r.method AND c.src = r.node WHERE NOT EXISTS (SELECT 1 FROM said k WHERE k.method = r.method AND k.node = r.node AND k.local = r.fact)),
    nodes AS (SELECT method, dst AS node FROM cfg UNION SELECT method, node FROM entry)
    SELECT n.method, n.node, f.fact FROM nodes n JOIN facts f ON f.method = n.method WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.method = n.method AND r.node = n.node AND r.fact = f.fact)""",
)
def must_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that have spoken on every way to a turn."""
    turns = _turns(spark, sf_dir)
    gen = _said(spark, sf_dir).select("method", "node", F.col("local").alias("fact")).distinct()
    return flow.must_flow(_cfg(turns), gen, gen.limit(0), _entry(turns))


@register(
    "uninitialised",
    f"""WITH RECURSIVE {_TURNS}, {_SAID}, names AS (SELECT DISTINCT method, local FROM said),
    r AS (SELECT e.method, e.node, n.local FROM entry e JOIN names n ON n.method = e.method
      UNION SELECT r.method, c.dst, r.local FROM r JOIN cfg c ON c.method = r.method AND c.src = r.node WHERE NOT EXISTS (SELECT 1 FROM said k WHERE k.method = r.method AND k.node = r.node AND k.local = r.local))
    SELECT DISTINCT method, node, local FROM r JOIN said USING (method, node, local)""",
)
def uninitialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns at which a role may speak for the first time."""
    turns = _turns(spark, sf_dir)
    spoken = _said(spark, sf_dir).select("method", "node", "local").distinct()
    return flow.uninitialised(_cfg(turns), spoken, spoken, _entry(turns)).select("method", "node", "local")


@register(
    "taint_leaks",
    f"""WITH RECURSIVE {_TURNS}, r AS (SELECT e.method, e.node + 1 AS node, 's' AS fact FROM entry e JOIN turns USING (method, node)
    UNION SELECT r.method, t.node + 1, f.fact FROM r JOIN turns t ON t.method = r.method AND t.node = r.node CROSS JOIN (VALUES ('s'), ('o.f'), ('t')) f(fact)
    WHERE CASE WHEN t.asks THEN (r.fact = 's' AND f.fact IN ('s', 'o.f')) OR (r.fact = 't' AND f.fact = 't')
      WHEN t.answers THEN (r.fact = 's' AND f.fact = 's') OR (r.fact = 'o.f' AND f.fact IN ('o.f', 't'))
      ELSE r.fact = f.fact AND r.fact <> 's' END)
    SELECT r.method || ':' || r.node AS sink, split_part(fact, '.', 1) AS base, CASE WHEN fact = 'o.f' THEN 'f' ELSE '' END AS field, e.method || ':' || e.node AS origin
    FROM r JOIN entry e USING (method) JOIN turns t ON t.method = r.method AND t.node = r.node""",
)
def taint_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first turn taints ``s``; users store it into ``o.f``, assistants load ``t``, others clean ``s``; every turn sinks all three."""
    turns = _turns(spark, sf_dir)
    node = _node().alias("node")
    none = F.lit(None).cast("string")

    def assign(rows: DataFrame, *parts) -> DataFrame:
        return rows.select(node, *[(none if p is None else F.lit(p)).alias(n) for p, n in zip(parts, ("to_base", "to_field", "from_base", "from_field"), strict=True)])

    assigns = assign(turns.where("asks"), "o", "f", "s", None).union(assign(turns.where("not asks and answers"), "t", None, "o", "f")).union(assign(turns.where("not asks and not answers"), "s", None, "clean", None))
    cfg = turns.select(_node().alias("src"), _node(1).alias("dst"))
    found = taint.propagate(cfg, assigns, _entry(turns).select(node, F.lit("s").alias("base")))
    sinks = turns.select(node, F.explode(F.array(*[F.lit(b) for b in "sot"])).alias("base"))
    return taint.leaks(found, sinks).select("sink", "base", F.array_join("fields", ".").alias("field"), "origin").distinct()


@register("unreachable_units", f"WITH RECURSIVE {_TURNS}, r AS (SELECT method, node FROM entry UNION SELECT r.method, c.dst FROM r JOIN cfg c ON c.method = r.method AND c.src = r.node) SELECT method, node AS idx FROM turns WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.method = turns.method AND r.node = turns.node)")
def unreachable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns behind a gap that no turn before them skips."""
    turns = _turns(spark, sf_dir)
    return passes.unreachable_units(_cfg(turns), turns.select("method", F.col("node").alias("idx"))).select("method", "idx")
