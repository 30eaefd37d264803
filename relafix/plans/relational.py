"""Graph and dataflow operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relafix.functions import scalar
from relafix.operators import flow, graph, pointsto, taint
from relafix.operators.fixpoint import closure
from relafix.plans import passes
from relafix.plans.catalogue import TRADE_SQL, register, trade_edges
from relafix.plans.vulnerabilities import accepted
from relafix.storage import partitions_for, stage_table
from relafix.tables import table

_PART_SQL = "parts AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem)"


@register(
    "closure_by_origin",
    f"""WITH RECURSIVE {TRADE_SQL}, r AS (SELECT 'n' || n_nationkey AS origin, dst AS node FROM nation JOIN edges ON src = 'n' || n_nationkey
    UNION SELECT origin, dst FROM r JOIN edges ON src = node) SELECT origin, count(*) AS n_reached FROM r GROUP BY origin""",
)
def closure_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each nation reaches."""
    seeds = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("origin"))
    return graph.reach_from(trade_edges(spark, sf_dir), seeds).groupBy("origin").agg(F.count("*").alias("n_reached"))


@register(
    "cyclic_reachability",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
    reach AS (SELECT 's1' AS node UNION SELECT dst FROM e JOIN reach ON src = node) SELECT node FROM reach""",
)
def cyclic_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers tied to supplier 1, on a cyclic graph."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    return closure(rows.union(graph.inverse(rows)), spark.createDataFrame([("s1",)], "node string"))


@register(
    "topological_depth",
    f"WITH RECURSIVE {TRADE_SQL}, d AS (SELECT DISTINCT src AS node, 0 AS depth FROM edges WHERE src LIKE 'r%' UNION SELECT dst, depth + 1 FROM d JOIN edges ON src = node) SELECT node, min(depth)::INTEGER AS depth FROM d GROUP BY node",
)
def topological_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of the trade graph."""
    edges = trade_edges(spark, sf_dir)
    seeds = edges.where("src like 'r%'").select(F.col("src").alias("node")).distinct()
    return graph.depths(edges, seeds)


@register(
    "connected_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, l_suppkey + 1000000 AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    two_way AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e),
    r AS (SELECT DISTINCT src AS node, src AS label, 0 AS n FROM two_way
    UNION ALL SELECT t.src, least(min(x.label), min(y.label)), x.n + 1 FROM r x JOIN two_way t ON t.src = x.node JOIN r y ON y.node = t.dst WHERE x.n < 30 GROUP BY t.src, x.n)
    SELECT node, label AS component FROM r WHERE n = 30""",
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers tied by orders."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    edges = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst")).distinct()
    with partitions_for(spark, lines.count()):
        return stage_table(graph.components(edges), "components")


_EVENT_CFG = """seq AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


def _event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.row_number().over(w).alias("n"))


@register(
    "last_definition",
    f"""WITH {_EVENT_CFG}, d AS (SELECT *, max(CASE WHEN event_type = 'view' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def FROM seq)
    SELECT user_id, n::INTEGER AS n, def::INTEGER AS def_n FROM d WHERE event_type = 'purchase' AND def IS NOT NULL""",
)
def last_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view that reaches each purchase: straight-line code has one reaching definition, a window finds it."""
    w = Window.partitionBy("user_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = _event_sequence(spark, sf_dir).withColumn("def_n", F.max(F.when(F.col("event_type") == "view", F.col("n"))).over(w))
    return rows.where("event_type = 'purchase' and def_n is not null").select("user_id", "n", "def_n")


@register(
    "taint_with_kill",
    f"""WITH {_EVENT_CFG}, d AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN n END) OVER w AS gen, max(CASE WHEN event_type = 'error' THEN n END) OVER w AS kill FROM seq
    WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT user_id, event_id FROM d WHERE event_type = 'purchase' AND gen > coalesce(kill, 0)""",
)
def taint_with_kill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases reached by a signup that no error has killed."""
    w = Window.partitionBy("user_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = _event_sequence(spark, sf_dir)
    gen, kill = (F.max(F.when(F.col("event_type") == t, F.col("n"))).over(w) for t in ("signup", "error"))
    return rows.withColumn("gen", gen).withColumn("kill", kill).where("event_type = 'purchase' and gen > coalesce(kill, 0)").select("user_id", "event_id")


_TURN_CFG = "cfg AS (SELECT DISTINCT conv_id AS method, turn::INTEGER AS src, (turn + 1)::INTEGER AS dst FROM conversations WHERE conv_id IS NOT NULL)"


def _turn_cfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null")
    return rows.select(F.col("conv_id").alias("method"), F.col("turn").cast("int").alias("src"), (F.col("turn") + 1).cast("int").alias("dst")).distinct()


def _turn_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn defines the local of its role and uses the other's."""
    return table(spark, sf_dir, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("method"), F.col("turn").cast("int").alias("node"), F.col("role").alias("local")).distinct()


@register(
    "reaching_definitions",
    f"""WITH RECURSIVE {_TURN_CFG}, defs AS (SELECT DISTINCT conv_id AS method, turn::INTEGER AS node, role AS local FROM conversations WHERE conv_id IS NOT NULL),
    r AS (SELECT d.method, c.dst AS node, d.local, d.node AS def_node FROM defs d JOIN cfg c ON c.method = d.method AND c.src = d.node
    UNION SELECT r.method, c.dst, r.local, r.def_node FROM r JOIN cfg c ON c.method = r.method AND c.src = r.node
    WHERE NOT EXISTS (SELECT 1 FROM defs k WHERE k.method = r.method AND k.node = r.node AND k.local = r.local))
    SELECT method, node, local, def_node FROM r""",
)
def reaching_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as statements: the last turn of each role that reaches a turn."""
    return flow.reaching_definitions(_turn_cfg(spark, sf_dir), _turn_defs(spark, sf_dir))


@register(
    "live_locals",
    f"""WITH RECURSIVE {_TURN_CFG}, defs AS (SELECT DISTINCT conv_id AS method, turn::INTEGER AS node, role AS local FROM conversations WHERE conv_id IS NOT NULL),
    uses AS (SELECT DISTINCT method, node, CASE local WHEN 'user' THEN 'assistant' ELSE 'user' END AS local FROM defs),
    live AS (SELECT method, node, local FROM uses UNION SELECT l.method, c.src, l.local FROM live l JOIN cfg c ON c.method = l.method AND c.dst = l.node
    WHERE NOT EXISTS (SELECT 1 FROM defs k WHERE k.method = l.method AND k.node = c.src AND k.local = l.local)) SELECT method, node, local FROM live""",
)
def live_locals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles whose text a later turn still answers."""
    defs = _turn_defs(spark, sf_dir)
    uses = defs.withColumn("local", F.when(F.col("local") == "user", "assistant").otherwise("user"))
    return flow.live_locals(_turn_cfg(spark, sf_dir), defs, uses)


@register(
    "must_merge",
    """WITH n AS (SELECT u.user_id % 10 AS segment, count(DISTINCT u.user_id) AS users FROM events u GROUP BY 1)
    SELECT (e.user_id % 10)::INTEGER AS segment, e.event_type FROM events e JOIN n ON n.segment = e.user_id % 10 GROUP BY e.user_id % 10, e.event_type, n.users HAVING count(DISTINCT e.user_id) = n.users""",
)
def must_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that all users of a segment have: what holds behind branches, one for each user."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("int").alias("method"), F.col("user_id").alias("node"), F.col("event_type").alias("fact")).distinct()
    users = rows.select("method", "node").distinct()
    enter, leave = F.lit(-1).cast("long"), F.lit(-2).cast("long")
    cfg = users.select("method", enter.alias("src"), F.col("node").alias("dst")).union(users.select("method", "node", leave))
    entry = users.select("method", enter.alias("node")).distinct()
    return flow.must_flow(cfg, rows, rows.limit(0), entry).where("node = -2").select(F.col("method").alias("segment"), F.col("fact").alias("event_type"))


@register("lattice_or", "SELECT l_orderkey, bit_or(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 4 END)::INTEGER AS flags FROM lineitem GROUP BY l_orderkey")
def lattice_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice join of flags per order."""
    flag = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(4)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bit_or(flag).alias("flags"))


@register("dead_members", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def dead_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts never sold in large quantities: members that nothing reaches."""
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("method"))
    return passes.unreachable_methods(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sig")), sold).select(F.col("sig").alias("p_partkey"))


@register(
    "dispatch",
    """WITH rules(level, k, target) AS (SELECT 1, 'P' || p_partkey, 'own' FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT 2, p_brand, 'brand' FROM part GROUP BY p_brand HAVING count(*) % 2 = 0 UNION ALL SELECT 3, p_type, 'type' FROM part GROUP BY p_type)
    SELECT p_partkey, coalesce(a.target, b.target, c.target) AS target FROM part LEFT JOIN rules a ON a.level = 1 AND a.k = 'P' || p_partkey LEFT JOIN rules b ON b.level = 2 AND b.k = p_brand LEFT JOIN rules c ON c.level = 3 AND c.k = p_type""",
)
def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First declaration up a hierarchy of three classes: a part's own, its brand's, its type's."""
    part = table(spark, sf_dir, "part")
    even = part.groupBy("p_brand").agg((F.count("*") % 2 == 0).alias("even"))
    levels = part.join(even, "p_brand").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("target"), w.alias("declares")) for n, t, w in ((1, "own", F.col("p_partkey") % 7 == 0), (2, "brand", F.col("even")), (3, "type", F.lit(True)))])).alias("l"))
    name = F.concat_ws("/", F.col("l.n"), "p_partkey")
    classes = levels.select(name.alias("name"), F.when(F.col("l.n") < 3, F.concat_ws("/", F.col("l.n") + 1, "p_partkey")).alias("super"))
    methods = levels.where("l.declares").select(F.col("l.target").alias("sig"), name.alias("class"), F.lit("m").alias("subsig"), F.lit(False).alias("abstract"))
    found = pointsto.dispatch_table(classes, methods).where("class like '1/%'")
    return found.select(F.substring_index("class", "/", -1).cast("long").alias("p_partkey"), "target")


@register(
    "provenance_path",
    f"""WITH RECURSIVE {TRADE_SQL}, p AS (SELECT 'r1' AS node, 0 AS depth, ['r1'] AS path UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM p JOIN edges ON src = node WHERE depth < 3)
    SELECT node, min(array_to_string(path, '>')) AS path FROM p WHERE node LIKE 'c%' GROUP BY node""",
)
def provenance_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How region 1 comes to each of its customers."""
    taints = trade_edges(spark, sf_dir).select(F.col("dst").alias("node"), F.col("src").alias("pred_node"), F.lit("r1").alias("origin"))
    sinks = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("sink"), F.lit("r1").alias("origin"))
    return taint.paths(taints, sinks).select(F.col("sink").alias("node"), F.concat_ws(">", "path").alias("path"))


@register("entailment", "WITH u AS (SELECT DISTINCT regexp_extract(url, '^[^?#]*') AS path FROM pages WHERE url IS NOT NULL) SELECT path FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE a.path <> b.path AND starts_with(a.path, b.path))")
def entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that no shorter path stands for, characters as fields."""
    paths = table(spark, sf_dir, "pages").where("url is not null").select(F.regexp_extract("url", "^[^?#]*", 0).alias("path")).distinct()
    found = paths.select(F.lit(0).alias("sink"), F.lit("url").alias("base"), F.lit(0).alias("origin"), F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "")).alias("fields"))
    return taint.drop_entailed(found).select(F.concat_ws("", "fields").alias("path"))


@register("rule_scan", r"SELECT doc_id, bool_or(regexp_matches(text, '\+[0-9] \(')) AS has_phone, bool_or(contains(text, '@')) AS has_at FROM documents GROUP BY doc_id")
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any rule of a set accepts the value."""
    rules = {"has_phone": r"\+[0-9] \(", "has_at": "@"}
    return table(spark, sf_dir, "documents").groupBy("doc_id").agg(*[F.bool_or(F.when(F.col("text").isNotNull(), accepted(F.lit("regex"), F.lit(r), F.col("text")))).alias(n) for n, r in rules.items()])


@register("constant_argument", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events WHERE json_extract_string(props, '$.k')::INTEGER > 90")
def constant_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose argument k meets a rule."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k > 90")


@register(
    "unit_order",
    "SELECT conv_id, turn, lag(turn) OVER w AS before, lead(turn) OVER w AS after, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS block FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def unit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in a chain and the block each unit is in; user turns lead blocks."""
    rows = flow.neighbours_in_order(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")
    return graph.basic_blocks(rows, F.col("role") == "user", "conv_id", "turn").select("conv_id", "turn", "before", "after", "block")


@register(
    "score_report",
    "SELECT l_suppkey, round(sum(l_extendedprice * l_discount), 2) AS score, count(*) AS n_findings, max(l_shipdate) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey",
)
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of scores and number of findings."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return rows.groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("score"), F.count("*").alias("n_findings"), F.max("l_shipdate").alias("last"))


@register(
    "set_size_histogram",
    "SELECT size, count(*) AS n_vars FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS size FROM lineitem GROUP BY l_partkey) GROUP BY size",
)
def set_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts have how many suppliers."""
    return pointsto.set_size_histogram(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("var"), F.col("l_suppkey").alias("obj")).distinct())


@register("monomorphic_sites", "SELECT l_orderkey AS src, l_returnflag AS idx, min(l_suppkey) AS tgt FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) = 1")
def monomorphic_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites with one target."""
    return pointsto.monomorphic_sites(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_returnflag").alias("idx"), F.col("l_suppkey").alias("tgt"))).select("src", "idx", "tgt")


@register(
    "degrees",
    f"WITH {TRADE_SQL} SELECT node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node",
)
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In- and out-degree."""
    return graph.degrees(trade_edges(spark, sf_dir))


@register(
    "integer_arithmetic",
    """WITH x AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7919 + l_linenumber)::BIGINT AS a, (l_suppkey % 13 - 6)::BIGINT AS b FROM lineitem),
    w AS (SELECT *, CASE WHEN (a * 1000003) & 4294967295 >= 2147483648 THEN ((a * 1000003) & 4294967295) - 4294967296 ELSE (a * 1000003) & 4294967295 END AS product FROM x)
    SELECT l_orderkey, l_linenumber, product::INTEGER AS product, CASE WHEN b = 0 THEN NULL ELSE a // b END::INTEGER AS quotient, CASE WHEN b = 0 THEN NULL ELSE a % b END::INTEGER AS remainder, sign(a - b * 100000)::INTEGER AS compared FROM w""",
)
def integer_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapping products, truncating quotients, remainders and comparisons of the analysed language."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 7919 + F.col("l_linenumber")).alias("a"), (F.col("l_suppkey") % 13 - 6).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", scalar.multiply(F.col("a"), F.lit(1000003)).alias("product"), scalar.divide(F.col("a"), F.col("b")).alias("quotient"), scalar.remainder(F.col("a"), F.col("b")).alias("remainder"), scalar.compare(F.col("a"), F.col("b") * 100000).alias("compared"))


@register("union_of_sets", "SELECT l_partkey AS node FROM lineitem WHERE l_discount > 0.09 UNION SELECT p_partkey FROM part WHERE p_size > 45")
def union_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_sets(spark, sf_dir)
    return a.union(b).distinct()


@register("intersection_of_sets", "SELECT l_partkey AS node FROM lineitem WHERE l_discount > 0.09 INTERSECT SELECT p_partkey FROM part WHERE p_size > 45")
def intersection_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_sets(spark, sf_dir)
    return a.intersect(b)


@register("difference_of_sets", "SELECT l_partkey AS node FROM lineitem WHERE l_discount > 0.09 EXCEPT SELECT p_partkey FROM part WHERE p_size > 45")
def difference_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_sets(spark, sf_dir)
    return a.subtract(b)


def _two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("node")), table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("node"))
