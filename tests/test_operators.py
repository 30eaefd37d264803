"""Core operators against naive evaluation on small graphs and programs."""

import random

import pytest
from pyspark.sql import functions as F

from relafix import storage
from relafix.functions import dnf, scalar
from relafix.operators import flow, graph, ifds, pointsto, taint
from relafix.operators.fixpoint import NoFixpoint, RoundLog, closure, fixpoint


def edges_of(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src int, dst int")


def reach(pairs, start):
    seen, todo = {start}, [start]
    while todo:
        a = todo.pop()
        for x, y in pairs:
            if x == a and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def cyclic():
    rng = random.Random(4)
    return {(rng.randrange(14), rng.randrange(14)) for _ in range(24)} | {(0, 1), (0, 2)}


def test_closure_and_components(spark, cyclic):
    e = edges_of(spark, cyclic)
    nodes = {n for p in cyclic for n in p}
    assert rows(closure(e, spark.createDataFrame([(0,)], "node int"))) == [(n,) for n in sorted(reach(cyclic, 0))]
    closed = {(a, b) for a in nodes for m in (y for x, y in cyclic if x == a) for b in reach(cyclic, m)}
    assert rows(graph.transitive_closure(e)) == sorted(closed)
    want = sorted((n, min([m for m in nodes if (n, m) in closed and (m, n) in closed] + [n])) for n in nodes)
    assert rows(graph.strong_components(e), "node", "component") == want
    both = cyclic | {(b, a) for a, b in cyclic}
    assert rows(graph.components(e), "node", "component") == sorted((n, min(reach(both, n))) for n in nodes)


def test_fixpoint_limits(spark):
    e = edges_of(spark, {(i, i + 1) for i in range(6)})
    step = lambda known, delta: {"r": delta["r"].join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))}
    seed = {"r": spark.createDataFrame([(0,)], "node int")}
    with pytest.raises(NoFixpoint):
        fixpoint(seed, step, max_rounds=3)
    assert fixpoint(seed, step, max_rounds=3, partial=True)["r"].count() == 4
    log = RoundLog()
    assert fixpoint(seed, step, log=log, compact_every=2)["r"].count() == 7
    assert [r["r"] for r in log.rows] == [1] * 6 + [0]


def test_dominance(spark):
    cfg = {(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5)}
    nodes = range(6)
    want = sorted((d, n) for n in nodes for d in nodes if n not in (reach({p for p in cfg if d not in p}, 0) if d else set()) or d == n)
    dom = graph.dominators(edges_of(spark, cfg), 0)
    assert rows(dom, "dom", "node") == want
    assert dict(rows(graph.immediate_dominators(dom), "node", "idom")) == {1: 0, 2: 1, 3: 1, 4: 1, 5: 4}
    assert rows(graph.dominance_frontier(edges_of(spark, cfg), dom), "node", "frontier") == [(1, 1), (2, 4), (3, 4), (4, 1)]
    assert rows(graph.natural_loops(edges_of(spark, cfg), dom), "head", "node") == [(1, 1), (1, 2), (1, 3), (1, 4)]
    assert rows(graph.control_dependence(edges_of(spark, cfg), 5), "node", "on") == [(1, 4), (2, 1), (3, 1), (4, 4)]


def test_graph_shapes(spark):
    e = edges_of(spark, {(1, 2), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6)})
    assert rows(graph.contract_chains(e), "node", "block") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)]
    assert rows(graph.longest_depths(e), "node", "depth") == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 3), (6, 4)]
    assert rows(graph.heads(e)) == [(1,)] and rows(graph.tails(e)) == [(6,)]


def program(spark):
    """0: x=1  1: if  2: x=2  3: y=x  4: use y  (1 also goes to 3)"""
    cfg = spark.createDataFrame([("m", 0, 1), ("m", 1, 2), ("m", 1, 3), ("m", 2, 3), ("m", 3, 4)], "method string, src int, dst int")
    defs = spark.createDataFrame([("m", 0, "x"), ("m", 2, "x"), ("m", 3, "y")], "method string, node int, local string")
    uses = spark.createDataFrame([("m", 3, "x"), ("m", 4, "y")], "method string, node int, local string")
    return cfg, defs, uses


def test_dataflow(spark):
    cfg, defs, uses = program(spark)
    assert rows(flow.def_use(cfg, defs, uses), "node", "local", "def_node") == [(3, "x", 0), (3, "x", 2), (4, "y", 3)]
    assert rows(flow.live_locals(cfg, defs, uses), "node", "local") == [(1, "x"), (3, "x"), (4, "y")]
    entry = spark.createDataFrame([("m", 0)], "method string, node int")
    assert rows(flow.uninitialised(cfg, defs.where("node > 0"), uses, entry), "node", "local") == [(3, "x")]
    gen = spark.createDataFrame([("m", 0, "a"), ("m", 2, "b")], "method string, node int, fact string")
    kill = spark.createDataFrame([("m", 2, "a")], "method string, node int, fact string")
    assert rows(flow.must_flow(cfg, gen, kill.limit(0), entry), "node", "fact") == [(1, "a"), (2, "a"), (3, "a"), (4, "a")]
    assert rows(flow.must_flow(cfg, gen, kill, entry), "node", "fact") == [(1, "a"), (2, "a")]
    effects = spark.createDataFrame([("m", 4)], "method string, node int")
    assert rows(flow.dead_assignments(cfg, defs.union(spark.createDataFrame([("m", 1, "z")], defs.schema)), uses, effects)) == [("m", 1)]


def test_values(spark):
    cfg, defs, _ = program(spark)
    copies = spark.createDataFrame([("m", 3, "y", "x")], "method string, node int, local string, source string")
    bits = spark.createDataFrame([("m", 0, "x", 2), ("m", 2, "x", 1)], "method string, node int, local string, bits int")
    found = {(n, v): b for n, v, b in rows(flow.lattice_flow(cfg, bits, copies, defs), "node", "local", "bits")}
    assert found[3, "x"] == 3 and found[4, "y"] == 3 and found[1, "x"] == 2
    values = bits.withColumnRenamed("bits", "value")
    found = {(r.node, r.local): r.value for r in flow.constants(cfg, values, copies, defs).collect()}
    assert found[1, "x"] == 2 and found[3, "x"] is None and found[4, "y"] is None
    a, b = (spark.createDataFrame(r, "k string, value int") for r in ([("p", 1), ("q", 2), ("r", None)], [("p", 1), ("q", 3), ("s", 4), ("r", 5)]))
    assert {r.k: r.value for r in flow.merge_keep_one_sided(a, b, ["k"]).collect()} == {"p": 1, "q": None, "r": None, "s": 4}


def test_tabulation(spark):
    """a to b makes x; the call at c enters foo with y, which becomes z and returns as u."""
    def t(rows_, schema):
        return spark.createDataFrame(rows_, schema)

    p = ifds.Problem(
        calls=t([("c", "foo")], "node string, callee string"),
        starts=t([("foo", "d")], "method string, node string"),
        exits=t([("foo", "e")], "method string, node string"),
        returns=t([("c", "f")], "call string, site string"),
        normal=t([("a", "b", "0", "x"), ("b", "c", "x", "x"), ("d", "e", "y", "y"), ("d", "e", "y", "z")], "src string, dst string, fact string, out string"),
        call=t([("c", "foo", "x", "y")], "node string, callee string, fact string, out string"),
        ret=t([("c", "foo", "e", "f", "z", "u")], "node string, callee string, exit string, site string, fact string, out string"),
        bypass=t([("c", "f", "x", "x")], "node string, site string, fact string, out string"),
        seeds=t([("a", "0")], "node string, fact string"),
    )
    found = ifds.tabulate(p)
    assert [f for n, f in rows(ifds.results_at(found), "node", "fact") if n == "f"] == ["u", "x"]
    assert rows(found["summary"], "method", "entry_fact", "fact") == [("foo", "y", "y"), ("foo", "y", "z")]
    edges = t([("a", "x", "b", "x", 0, 5), ("b", "x", "c", "x", 2, 1), ("b", "x", "d", "x", 1, 0), ("c", "x", "d", "x", 1, 0)], "node string, fact string, to_node string, to_fact string, mul int, add int")
    values = {(r.node): r.value for r in ifds.linear_values(edges, t([("a", "x", 0)], "node string, fact string, value int")).collect()}
    assert values == {"a": 0, "b": 5, "c": 11, "d": None}


def test_hierarchy_and_points_to(spark):
    classes = spark.createDataFrame([("O", None, []), ("I", "O", []), ("A", "O", ["I"]), ("B", "A", [])], "name string, super string, interfaces array<string>")
    assert ("B", "I") in rows(pointsto.subtypes(classes), "sub", "super")
    methods = spark.createDataFrame([("O.m", "O", "m", False), ("A.m", "A", "m", False), ("B.n", "B", "n", True)], "sig string, class string, subsig string, abstract boolean")
    dispatch = pointsto.dispatch_table(classes, methods)
    assert rows(dispatch, "class", "target") == [("A", "A.m"), ("B", "A.m"), ("I", "O.m"), ("O", "O.m")]
    invokes = spark.createDataFrame([("main", 0, "virtual", "A", "m"), ("main", 1, "special", "O", "m")], "method string, idx int, kind string, class string, subsig string")
    assert rows(pointsto.class_hierarchy_calls(invokes, pointsto.subtypes(classes), dispatch), "idx", "tgt") == [(0, "A.m"), (1, "O.m")]
    ab = "a string, b string"
    # p = new 1; q = new 2; r = p; p.f = q; s = r.f
    found = pointsto.points_to(
        spark.createDataFrame([("1", "p"), ("2", "q")], ab).toDF("obj", "var"),
        spark.createDataFrame([("p", "r")], ab).toDF("src", "dst"),
        spark.createDataFrame([("q", "p", "f")], "src string, base string, field string"),
        spark.createDataFrame([("r", "f", "s")], "base string, field string, dst string"),
    )
    assert rows(found["pts"], "var", "obj") == [("p", "1"), ("q", "2"), ("r", "1"), ("s", "2")]
    assert rows(pointsto.may_alias(found["pts"])) == [("p", "r"), ("q", "s")]


def counting(monkeypatch, module):
    """Rows of every table that ``module`` stages, by name."""
    sizes = {}

    def spy(df, name="stage", *more):
        table = storage.stage_table(df, name, *more)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(module, "stage_table", spy)
    return sizes


def test_cells_are_found_once_for_objects_that_are_alike(spark, monkeypatch):
    """All objects of ``p`` are stored into all of ``q``: the product is listed, never compared."""
    sizes = counting(monkeypatch, pointsto)
    ab = "obj string, var string"
    alloc = spark.createDataFrame([(f"p{i}", "p") for i in range(20)] + [(f"q{i}", "q") for i in range(30)] + [("q1", "p"), ("n", None), (None, "q")], ab)
    none = spark.createDataFrame([], "base string, field string, dst string")
    store = spark.createDataFrame([("p", "q", "f"), ("p", "q", "f"), ("p", "q", "g")], "src string, base string, field string")
    ok = spark.createDataFrame([(f"p{i}", "p") for i in range(10)] + [("q1", "p")], ab)
    for typed, held in ((None, 21), (ok, 11)):
        found = pointsto.points_to(alloc, spark.createDataFrame([], "src string, dst string"), store, none, typed)
        # q1 is in both sets and in a class of its own, and so is the null object with types
        cells = rows(found["heap"].where("obj is not null"), "obj", "field", "val")
        assert len(cells) == len(set(cells)) == 30 * 2 * held
        assert found["heap"].count() == 31 * 2 * held and sizes["cells"] <= 2 * 3 * 3
        assert found["pts"].where("var = 'q'").count() == 31 and found["pts"].where("var = 'p'").count() == held
        assert "Aggregate" not in found["heap"]._jdf.queryExecution().optimizedPlan().toString()


def test_cells_of_large_classes_are_dealt_as_runs(spark, monkeypatch, tmp_path):
    """All objects of five classes are stored into all: a row is dealt for a pair of runs, not for a value, and the cells pack well."""
    dealt = []

    def spy(rows_, *more):
        dealt.append(rows_.count())
        return spread(rows_, *more)

    spread = pointsto._spread
    monkeypatch.setattr(pointsto, "_spread", spy)
    held = {f"v{k}": [f"{k}-{i}" for i in range(251 + k)] for k in range(5)}
    alloc = spark.createDataFrame([(o, v) for v, objs in held.items() for o in objs], "obj string, var string")
    store = spark.createDataFrame([(a, b, f) for a in held for b in held for f in "fg"], "src string, base string, field string")
    none = spark.createDataFrame([], "base string, field string, dst string")
    heap = pointsto.points_to(alloc, spark.createDataFrame([], "src string, dst string"), store, none)["heap"]
    heap.write.parquet(str(tmp_path / "cells"))
    n = sum(map(len, held.values()))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    assert cells.count() == cells.distinct().count() == 2 * n * n
    assert dealt == [2 * 5 * 5]
    assert sum(p.stat().st_size for p in (tmp_path / "cells").glob("*.parquet")) < 0.3 * 2 * n * n


def test_cells_of_classes_in_several_runs(spark, monkeypatch):
    """Classes that fill several shares, runs and rows of runs, the null object among them, and one of a single object."""
    for name, size in (("_SHARE", 64), ("_RUN", 8), ("_RUNS", 2)):
        monkeypatch.setattr(pointsto, name, size)
    p, q = [*(f"p{i}" for i in range(150)), None], [f"q{i}" for i in range(17)]
    alloc = spark.createDataFrame([(o, "p") for o in p] + [(o, "q") for o in q] + [("one", "r")], "obj string, var string")
    store = spark.createDataFrame([("p", "q", "f"), ("q", "p", "f"), ("r", "p", None), ("p", "r", "g")], "src string, base string, field string")
    none = spark.createDataFrame([], "base string, field string, dst string")
    want = [(a, "f", b) for a in q for b in p] + [(a, "f", b) for a in p for b in q] + [(a, None, "one") for a in p] + [("one", "g", b) for b in p]
    for limit in (1_000_000, 0):  # with runs sent to all tasks, and joined by a shuffle
        monkeypatch.setattr(pointsto, "bounded_broadcast", lambda df, *more, limit=limit: storage.bounded_broadcast(df, limit))
        heap = pointsto.points_to(alloc, spark.createDataFrame([], "src string, dst string"), store, none)["heap"].select("obj", "field", "val")
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert ("BroadcastHashJoin" in heap._jdf.queryExecution().executedPlan().toString()) == bool(limit)
            found = [tuple(r) for r in heap.collect()]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert sorted(found, key=str) == sorted(want, key=str)


def test_targets_are_found_once_for_all_sites(spark, monkeypatch):
    """Sites of one type share its targets, however many subtypes inherit them; a site of two types names a target once."""
    sizes = counting(monkeypatch, pointsto)
    classes = spark.createDataFrame([("R", None, [])] + [(f"C{i}", "R", []) for i in range(50)], "name string, super string, interfaces array<string>")
    methods = spark.createDataFrame([("R.m", "R", "m", False), ("C1.m", "C1", "m", False)], "sig string, class string, subsig string, abstract boolean")
    sites = [(f"s{i}", 0, "virtual", "R", "m") for i in range(20)] + [("two", 0, "virtual", c, "m") for c in ("R", "C1", "C2")] + [("none", 0, "virtual", None, "m")]
    invokes = spark.createDataFrame(sites + sites, "method string, idx int, kind string, class string, subsig string")
    found = pointsto.class_hierarchy_calls(invokes, pointsto.subtypes(classes), pointsto.dispatch_table(classes, methods))
    assert rows(found, "src", "tgt") == sorted((s, t) for s in [*(f"s{i}" for i in range(20)), "two"] for t in ("R.m", "C1.m"))
    assert sizes["targets"] == 4  # of R two, of C1 and C2 one each


def test_call_graph_on_the_fly(spark):
    def t(rows_, schema):
        return spark.createDataFrame(rows_, schema)

    found = pointsto.points_to_with_calls(
        alloc=t([("main", "o1", "x"), ("dead", "o9", "z")], "method string, obj string, var string"),
        simple=t([("A.m", "this", "ret")], "method string, src string, dst string"),
        store=t([], "method string, src string, base string, field string"),
        load=t([], "method string, base string, field string, dst string"),
        invokes=t([("main", 1, "x", "m"), ("dead", 1, "z", "m")], "method string, idx int, base string, subsig string"),
        dispatch=t([("A", "m", "A.m")], "class string, subsig string, target string"),
        types=t([("o1", "A"), ("o9", "A")], "obj string, class string"),
        actuals=t([("main", 1, -1, "x"), ("main", 1, -2, "y")], "method string, idx int, pos int, var string"),
        formals=t([("A.m", -1, "this"), ("A.m", -2, "ret")], "method string, pos int, var string"),
        entries=t([("main",)], "method string"),
    )
    assert rows(found["pts"], "var", "obj") == [("ret", "o1"), ("this", "o1"), ("x", "o1"), ("y", "o1")]
    assert rows(found["reach"]) == [("A.m",), ("main",)]


def test_taint(spark):
    """0: s = source  1: o.f = s  2: s = clean  3: t = o.f  4: sink(t)  5: sink(s)"""
    cfg = edges_of(spark, {(i, i + 1) for i in range(6)})
    assigns = spark.createDataFrame([(1, "o", "f", "s", None), (2, "s", None, "clean", None), (3, "t", None, "o", "f")], "node int, to_base string, to_field string, from_base string, from_field string")
    found = taint.propagate(cfg, assigns, spark.createDataFrame([(0, "s")], "node int, base string"))
    sinks = spark.createDataFrame([(4, "t"), (5, "s")], "node int, base string")
    leaks = taint.leaks(found, sinks)
    assert rows(leaks, "sink", "base", "origin") == [(4, "t", 0)]
    assert [r.path for r in taint.paths(found, leaks).collect()] == [[0, 1, 2, 3, 4]]
    more = spark.createDataFrame([(4, "t", [], 0), (4, "t", ["g"], 0)], "sink int, base string, fields array<string>, origin int")
    assert rows(taint.drop_entailed(more), "fields") == [([],)]


def test_long_taint_paths(spark):
    taints = spark.createDataFrame([(i, i - 1, 0) for i in range(1, 67)], "node int, pred_node int, origin int")
    found = spark.createDataFrame([(66, 0)], "sink int, origin int")
    assert [r.path for r in taint.paths(taints, found).collect()] == [list(range(67))]


def test_scalar_functions(spark):
    nums = [(2**31 - 1, 1), (-(2**31), -1), (7, -2), (-7, 2), (5, 0), (123456789, 987654321)]
    got = spark.createDataFrame(nums, "a int, b int").select(*[f(F.col("a"), F.col("b")).alias(n) for n, f in (("add", scalar.add), ("mul", scalar.multiply), ("div", scalar.divide), ("rem", scalar.remainder))]).collect()
    wrap = lambda x: (x + 2**31) % 2**32 - 2**31
    for (a, b), r in zip(nums, got, strict=True):
        assert r["add"] == wrap(a + b) and r["mul"] == wrap(a * b)
        assert r["div"] == (None if b == 0 else wrap(int(a / b))) and r["rem"] == (None if b == 0 else a - b * int(a / b))
    sig = "<a.B: int m(java.lang.String,int[])>"
    parsed = spark.createDataFrame([(sig,), ("x",)], "s string").select(scalar.parse_signature(F.col("s")).alias("p")).collect()
    assert parsed[0].p.asDict() == {"class": "a.B", "ret": "int", "name": "m", "params": ["java.lang.String", "int[]"]} and parsed[1].p is None
    kinds = spark.createDataFrame([("getStringExtra",), ("getIntArrayExtra",), ("getFoo",)], "m string").select(scalar.extra_type(F.col("m"))).collect()
    assert [r[0] for r in kinds] == ["String", "Int[]", None]


def test_conditions(spark):
    x, y = dnf.literal(F.lit("x"), F.lit(True)), dnf.literal(F.lit("y"), F.lit(True))
    not_x = dnf.negation(x)
    one = spark.range(1)
    both = one.select(dnf.conjunction(x, not_x).alias("f"), dnf.disjunction(x, dnf.conjunction(x, y)).alias("absorbed"), dnf.negation(dnf.disjunction(x, y)).alias("none")).first()
    assert both.f == [] and len(both.absorbed) == 1 and [(l["var"], l["positive"]) for l in both.none[0]] == [("x", False), ("y", False)]
    values = F.create_map(F.lit("x"), F.lit(False))
    r = one.select(dnf.evaluate(dnf.disjunction(x, y), values).alias("open"), dnf.evaluate(x, values).alias("no"), dnf.evaluate(not_x, values).alias("yes")).first()
    assert (r.open, r.no, r.yes) == (None, False, True)


def test_strong_components_by_hand(spark):
    """Random graphs, a long cycle beside a long chain, and graphs without cycles or edges."""
    rng = random.Random(4)
    graphs = [{(rng.randrange(30), rng.randrange(30)) for _ in range(38)}, {(i, (i + 1) % 9) for i in range(9)} | {(i, i + 1) for i in range(20, 28)} | {(3, 20), (28, 28)}, {(1, 2), (2, 3)}, set()]
    for pairs in graphs:
        far = {n: reach(pairs, n) for e in pairs for n in e}
        want = sorted((n, min(m for m in r if n in far[m])) for n, r in far.items())
        got = graph.strong_components(edges_of(spark, pairs))
        assert rows(got, "node", "component") == want


def test_longest_depths_of_cycles(spark):
    with pytest.raises(NoFixpoint):
        graph.longest_depths(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "src int, dst int"))
    assert graph.longest_depths(spark.createDataFrame([], "src int, dst int")).count() == 0
    many = [(i, j) for i in range(12) for j in range(i + 1, 12)]  # every order of a full order: one depth each
    assert rows(graph.longest_depths(spark.createDataFrame(many, "src int, dst int")), "node", "depth") == [(i, i) for i in range(12)]


def test_written_rounds_are_as_large_as_their_rows(spark):
    """Spark takes the file's size for that of the rows when it plans a broadcast; packed keys would pass for next to nothing."""
    same = spark.range(100_000).select(F.lit(7).cast("long").alias("a"), F.lit("method").alias("b"))
    one, n = storage.counted_table(same)
    several, _ = storage.counted_tables({"x": same, "y": same})
    for table in (one, several["x"], storage.stage_table(same, plain=True)):
        assert n == table.count() and int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= 100_000 * 14


def test_long_paths_are_looked_up_without_writing_out_their_prefixes(spark):
    rows_in = [(0, "x", 0, list("ab" * 1500) + [str(i)]) for i in range(30)] + [(0, "x", 0, list("ab" * 1500) + ["7", "8"]), (1, "x", 0, list("ab")), (0, "y", 0, None)]
    found = spark.createDataFrame(rows_in, "sink int, base string, origin int, fields array<string>")
    left = taint.drop_entailed(found)
    assert sorted(len(r.fields or []) for r in left.collect()) == [0, 2] + [3001] * 30


def test_shuffles_get_partitions_by_rows_and_the_session_keeps_its_number(spark):
    from relafix.storage import partitions_for

    before = spark.conf.get("spark.sql.shuffle.partitions")
    with partitions_for(spark, 90, 10):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
    with partitions_for(spark, 90, 90):
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
