"""Nullness, exceptions, code motion, loops, bounds and entry points against naive evaluation on small programs."""

import random

import pytest
from pyspark.sql import functions as F

from relafix.operators import carried, exceptions, graph, motion, nullness, pointsto, taint
from relafix.plans import entrypoints, passes


def table(spark, schema, rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def random_cfg(rng, n):
    return {(i, i + 1) for i in range(n - 1)} | {(rng.randrange(n), rng.randrange(1, n)) for _ in range(n // 3)}


def test_nullness_follows_the_outcome_of_tests(spark):
    # 0: x = null; 1: if y is null goto 3; 2: x = new; 3: use y; 4: y = x; 5: if y is null goto 7; 6: use y; 7: end
    cfg = table(spark, "method string, src int, dst int", [("f", a, b) for a, b in [(0, 1), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6), (5, 7), (6, 7)]])
    cell = "method string, node int, local string"
    assigned = table(spark, cell + ", bits int", [("f", 0, "x", nullness.NULL), ("f", 2, "x", nullness.NON_NULL)])
    copies = table(spark, cell + ", source string", [("f", 4, "y", "x")])
    defs = table(spark, cell, [("f", 0, "x"), ("f", 2, "x"), ("f", 4, "y")])
    tests = table(spark, cell + ", null_dst int, other_dst int", [("f", 1, "y", 3, 2), ("f", 5, "y", 7, 6)])
    uses = table(spark, cell, [("f", 3, "y"), ("f", 6, "y")])
    init = table(spark, cell + ", bits int", [("f", 0, "y", 3)])
    status = nullness.nullness(cfg, assigned, copies, defs, tests, uses, init)
    got = {(n, v): b for _, n, v, b in rows(status)}
    assert [got[n, "x"] for n in range(1, 8)] == [1, 1, 3, 3, 3, 3, 3]
    # what was used without failing is not null; what comes from x is unknown again, until tested
    assert [got[n, "y"] for n in range(8)] == [3, 3, 2, 3, 2, 3, 2, 3]
    assert rows(nullness.checked_dereferences(status, uses), "node", "verdict") == [(3, "check"), (6, "safe")]
    assert rows(nullness.decided_tests(status, tests)) == []
    only_null = nullness.nullness(cfg, assigned.where("node = 0"), copies, defs.where("node <> 2"), tests, uses, init)
    assert rows(nullness.decided_tests(only_null, tests), "node", "is_null") == [(5, True)]
    assert rows(nullness.checked_dereferences(only_null, uses), "node", "verdict") == [(3, "check"), (6, "unreached")]
    assert rows(only_null.select(nullness.colour(F.col("bits")).alias("c")).distinct()) == [("non-null",), ("null",), ("unknown",)]


def test_a_test_with_one_successor_tells_nothing_and_empty_tables(spark):
    cfg = table(spark, "method string, src int, dst int", [("f", 0, 1), ("f", 1, 2), ("f", 1, 2)])
    cell = "method string, node int, local string"
    assigned = table(spark, cell + ", bits int", [("f", 0, "x", 3)])
    tests = table(spark, cell + ", null_dst int, other_dst int", [("f", 1, "x", 2, 2)])
    none = table(spark, cell, [])
    copies = table(spark, cell + ", source string", [])
    assert rows(nullness.nullness(cfg, assigned, copies, assigned, tests, none), "node", "bits") == [(1, 3), (2, 3)]
    assert rows(nullness.nullness(cfg.limit(0), assigned, copies, assigned, tests, none)) == []


def naive_motion(nodes, edges, entry, comp, kill):
    """Greatest solutions of the equations, by iteration from all true."""
    pred = {n: [a for a, b in edges if b == n] for n in nodes}
    succ = {n: [b for a, b in edges if a == n] for n in nodes}

    def greatest(rule):
        hold = dict.fromkeys(nodes, True)
        while True:
            new = {n: rule(n, hold) for n in nodes}
            if new == hold:
                return {n for n in nodes if hold[n]}
            hold = new

    up = greatest(lambda n, h: n != entry and all(m not in kill and (m in comp or h[m]) for m in pred[n]))
    down = greatest(lambda n, h: n in comp or (n not in kill and bool(succ[n]) and all(h[m] for m in succ[n])))
    early = {n for n in down if n == entry or any(m in kill or m not in up | down for m in pred[n])}
    delay = greatest(lambda n, h: n in early or (n != entry and all(h[m] and m not in comp for m in pred[n])))
    late = {n for n in delay if n in comp or any(m not in delay for m in succ[n])}
    alone = greatest(lambda n, h: all(m in late or (m not in comp and h[m]) for m in succ[n]))
    return {"up_safe": up, "down_safe": down, "earliest": early, "delayable": delay, "latest": late, "isolated": alone, "insert": late - alone, "replace": comp - (late & alone)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_code_motion_is_the_greatest_solution(spark, seed):
    rng = random.Random(seed)
    edges = random_cfg(rng, 12)
    nodes = range(12)
    exprs = {e: ({n for n in nodes if rng.random() < 0.3}, {n for n in nodes if rng.random() < 0.2}) for e in "ab"}
    exprs["a"][0].add(5)
    exprs["b"][0].add(7)
    cell = "method string, node int, expr string"
    comp = table(spark, cell, [("f", n, e) for e, (c, _) in exprs.items() for n in c])
    kill = table(spark, cell, [("f", n, e) for e, (_, k) in exprs.items() for n in k])
    cfg = table(spark, "method string, src int, dst int", [("f", a, b) for a, b in edges] + [("f", 50, 51)])
    found = motion.code_motion(cfg, table(spark, "method string, node int", [("f", 0)]), comp, kill)
    want = {e: naive_motion(nodes, edges, 0, c, k) for e, (c, k) in exprs.items()}
    for what in want["a"]:
        assert rows(getattr(found, what), "node", "expr") == sorted((n, e) for e in exprs for n in want[e][what]), what


@pytest.mark.parametrize("ways, most", [(1, 24), (200_000, 12)])
def test_rounds_of_code_motion_do_not_grow_with_long_methods(spark, monkeypatch, ways, most):
    """Ways are joined up to a bound, or until there are no more; nodes 30 and 31 of ``f`` are blocked for ``b``."""
    monkeypatch.setattr(motion, "_WAYS", ways)
    rounds, plain = [], motion.fixpoint
    monkeypatch.setattr(motion, "fixpoint", lambda seeds, step, stop=None: plain(seeds, lambda k, d: rounds.append(1) or step(k, d), stop=stop))
    cell = "method string, node int, expr string"
    edges = motion.stage_table(table(spark, "method string, node int, to int", [("f", i, i + k) for i in range(60) for k in (1, 2)] + [("g", 0, 1), ("g", 1, 2)]))
    blocked = motion.stage_table(table(spark, cell, [("f", 30, "b"), ("f", 31, "b")]))
    cells = table(spark, cell, [("f", i, e) for i in range(62) for e in ("a", "b", None)] + [("g", i, "a") for i in range(3)])
    seeds = table(spark, cell, [("f", 0, "a"), ("f", 2, "b"), ("f", 5, None), ("g", 1, "a")])
    found = motion._closed(seeds, lambda r: motion._over(edges, r).join(blocked, ["method", "node", "expr"], "left_anti"), cells)
    want = [("f", i, "a") for i in range(62)] + [("f", i, "b") for i in range(2, 30)] + [("f", i, None) for i in range(5, 62)] + [("g", 1, "a"), ("g", 2, "a")]
    assert sorted(str(tuple(r)) for r in found.select("method", "node", "expr").collect()) == sorted(map(str, want)) and len(rounds) <= most


def test_exceptions_pass_callers_until_a_handler(spark):
    subtype = table(spark, "sub string, super string", [(a, a) for a in "TERX"] + [("E", "T"), ("R", "E"), ("R", "T"), ("X", "T")])
    raised = table(spark, "method string, idx int, type string", [("c", 0, "R"), ("c", 1, "X")])
    calls = table(spark, "method string, idx int, callee string", [("b", 3, "c"), ("a", 5, "b"), ("d", 0, "a"), ("a", 6, "a")])
    traps = table(spark, "method string, begin int, end int, handler int, type string", [("b", 0, 3, 9, "T"), ("a", 5, 6, 8, "E"), ("d", 0, 1, 4, "T")])
    raises = exceptions.may_raise(raised, calls, traps, subtype)
    # b's trap ends before the call; a's handles R, not X
    assert rows(raises) == [("a", 5, "R"), ("a", 5, "X"), ("a", 6, "X"), ("b", 3, "R"), ("b", 3, "X"), ("c", 0, "R"), ("c", 1, "X"), ("d", 0, "X")]
    assert rows(exceptions.escaping(raises, traps, subtype)) == [("a", "X"), ("b", "R"), ("b", "X"), ("c", "R"), ("c", "X")]
    assert rows(exceptions.handled(raises, traps, subtype)) == [("a", 5, 8, "R"), ("d", 0, 4, "X")]


def test_traps_are_held_against_raised_types_only(spark, monkeypatch):
    """A trap of a wide type lists what is raised under it, not all of its subtypes."""
    cuts = []

    def spy(df):
        cuts.append((df.columns, df.count()))
        return df

    monkeypatch.setattr(exceptions, "cut", spy)
    raised = spark.createDataFrame([("a", 0, "T1"), ("a", 0, "T2"), ("a", 0, "X")], "method string, idx int, type string")
    calls = spark.createDataFrame([("b", 1, "a")], "method string, idx int, callee string")
    traps = spark.createDataFrame([("b", 1, 2, "T"), ("b", 5, 6, "X")], "method string, begin int, end int, type string")
    subtype = spark.createDataFrame([(f"T{i}", "T") for i in range(100)] + [("T", "T"), ("X", "X")], "sub string, super string")
    raises = exceptions.may_raise(raised, calls, traps, subtype)
    assert rows(exceptions.escaping(raises, traps, subtype)) == [("a", "T1"), ("a", "T2"), ("a", "X"), ("b", "X")]
    assert [n for columns, n in cuts if "begin" in columns] == [3, 3]
    units = table(spark, "method string, idx int, kind string", [("f", 0, "array"), ("f", 1, "assign"), ("f", 2, "division"), ("f", 3, None)])
    assert rows(exceptions.implicit(units), "idx", "type") == [(0, "java.lang.ArrayIndexOutOfBoundsException"), (0, "java.lang.NullPointerException"), (2, "java.lang.ArithmeticException")]


def test_loops_invariants_and_taken_out_nodes(spark):
    bodies = table(spark, "head int, node int", [(1, n) for n in range(1, 9)] + [(3, n) for n in (3, 4, 5)] + [(4, 4)] + [(7, 7), (7, 8)])
    assert rows(graph.loop_nest(bodies)) == [(1, None, 1), (3, 1, 2), (4, 3, 3), (7, 1, 2)]
    of = bodies.select(F.lit("f").alias("method"), "head", "node")
    computed = table(spark, "method string, node int, expr string", [("f", 4, "a+b"), ("f", 8, "c"), ("f", 5, "1"), ("f", 9, "c")])
    operands = table(spark, "method string, expr string, local string", [("f", "a+b", "a"), ("f", "a+b", "b"), ("f", "c", "c")])
    defs = table(spark, "method string, node int, local string", [("f", 2, "a"), ("f", 7, "c")])
    assert rows(passes.loop_invariants(of, computed, operands, defs), "head", "node", "expr") == [(1, 5, "1"), (3, 4, "a+b"), (3, 5, "1"), (4, 4, "a+b")]
    cfg = table(spark, "method string, src int, dst int", [("f", 0, 1), ("f", 1, 2), ("f", 2, 3), ("f", 0, 4), ("f", 4, 4), ("g", 1, 2)])
    gone = table(spark, "method string, node int", [("f", 1), ("f", 2), ("f", 4)])
    assert rows(passes.bypassed(cfg, gone)) == [("f", 0, 3), ("g", 1, 2)]


def test_least_upper_bounds_with_interfaces(spark):
    classes = table(spark, "name string, super string, interfaces array<string>", [("O", None, []), ("I", "O", []), ("J", "O", []), ("A", "O", ["I", "J"]), ("B", "O", ["I", "J"]), ("C", "A", [])])
    pairs = table(spark, "a string, b string", [("A", "B"), ("C", "A"), ("C", "B"), ("A", "missing"), ("A", None)])
    got = rows(pointsto.least_upper_bounds(pairs, pointsto.subtypes(classes)))
    assert got == [("A", "B", "I"), ("A", "B", "J"), ("C", "A", "A"), ("C", "B", "I"), ("C", "B", "J")]


def test_access_paths_without_ends_and_with_another_base(spark):
    paths = table(spark, "fields array<string>", [(["f", "g", "h"],), ([],)])
    assert rows(paths.select(taint.without_first(F.col("fields")), taint.without_last(F.col("fields")))) == [([], []), (["g", "h"], ["f", "g"])]
    lit = lambda *names: F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    moved = paths.where("size(fields) > 0").select(taint.rebased(F.col("fields"), lit("x", "y"), lit("f"), 3), taint.rebased(F.col("fields"), lit(), lit("f", "g", "h"), 3), taint.rebased(F.col("fields"), lit("x"), lit("g"), 3))
    assert rows(moved) == [(["x", "y", "g"], [], None)]
    found = table(spark, "sink string, origin string", [("s", "o"), ("s", "o"), ("t", "o"), ("s", "p")])
    assert rows(taint.n_sinks(found)) == [("o", 2), ("p", 1)]


def test_lifecycle_and_callbacks(spark):
    base = "android.app.Activity"
    subtype = table(spark, "sub string, super string", [("Main", "Main"), ("Main", base), ("L1", "L1"), ("L1", "Listener"), ("L2", "L2"), ("L2", "Listener"), ("Other", "Other")])
    dispatch = table(spark, "class string, subsig string, target string", [("Main", "void onCreate(android.os.Bundle)", "Main.create"), ("Main", "void onPause()", "Base.pause"), ("Main", "void helper()", "Main.helper"), ("L1", "void on()", "L1.on"), ("L2", "void on()", "L2.on")])
    components = table(spark, "name string", [("Main",), ("Other",), (None,)])
    calls = entrypoints.lifecycle_calls(components, subtype, dispatch, entrypoints.lifecycle_table(spark))
    assert rows(calls, "component", "target") == [("Main", "Base.pause"), ("Main", "Main.create")]
    assert rows(entrypoints.lifecycle_order(calls)) == [("Main", "Base.pause", "Main.create"), ("Main", "Main.create", "Base.pause")]
    made = table(spark, "method string, class string", [("Main.helper", "L1"), ("L1.on", "L2"), ("Far.away", "L2")])
    edges = table(spark, "src string, tgt string", [("Main.create", "Main.helper")])
    interfaces = table(spark, "interface string, subsig string", [("Listener", "void on()")])
    reached, back = entrypoints.callbacks(calls.select("component", F.col("target").alias("method")), edges, made, subtype, dispatch, interfaces)
    assert rows(back) == [("Main", "L1.on"), ("Main", "L2.on")]
    assert {m for _, m in rows(reached)} == {"Main.create", "Base.pause", "Main.helper", "L1.on", "L2.on"}


def naive_carried(edges, starts, exits, defs, copies, args, results, born):
    """Facts at nodes, one at a time along all paths, with the stack of calls they came in by."""
    seen, todo = set(), [(dst, v, x, ()) for n, v, x in born for a, dst in edges if a == n]
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        node, local, x, stack = state
        out = ([local] if (node, local) not in defs else []) + [a for n, a, source in copies if n == node and source == local]
        todo += [(dst, v, x, stack) for v in out for a, dst in edges if a == node]
        for n, callee, arg, param in args:
            if n == node and arg == local:
                todo.append((starts[callee], param, x, (*stack, node)))
        for method, leave in exits:
            if leave == node:
                for call, callee, value, result in results:
                    if callee == method and value == local and (not stack or stack[-1] == call):
                        todo += [(dst, result, x, stack[:-1]) for a, dst in edges if a == call]
    return sorted({s[:3] for s in seen})


@pytest.mark.parametrize("seed", [1, 2])
def test_carried_payloads_keep_to_their_callers(spark, seed):
    rng = random.Random(seed)
    edges, starts, exits, defs, copies, args, results, born = set(), {}, [], set(), set(), set(), set(), set()
    names = "fgh"
    for m, method in enumerate(names):
        n = 7
        node = lambda i, method=method: f"{method}{i}"
        starts[method] = node(0)
        exits.append((method, node(n - 1)))
        edges |= {(node(i), node(i + 1)) for i in range(n - 1)} | {(node(rng.randrange(n)), node(rng.randrange(1, n)))}
        for i in range(1, n - 1):
            local, other, what = rng.choice("abp"), rng.choice("abp"), rng.random()
            if what < 0.35 and m < 2:
                callee = rng.choice(names[m + 1 :])
                args.add((node(i), callee, other, "p"))
                results.add((node(i), callee, rng.choice("ab"), local))
            elif what < 0.7:
                copies.add((node(i), local, other))
            else:
                born.add((node(i), local, node(i)))
            defs.add((node(i), local))
    # a result is the callee's fixed local
    results = {(n, c, "a", v) for n, c, _, v in results}
    p = carried.Program(
        table(spark, "src string, dst string", edges), table(spark, "method string, node string", starts.items()), table(spark, "method string, node string", exits),
        table(spark, "node string, local string", defs), table(spark, "node string, local string, source string", copies),
        table(spark, "node string, callee string, arg string, param string", args), table(spark, "node string, callee string, value string, local string", results),
    )
    got = rows(carried.possible_types(p, table(spark, "node string, local string, type string", born)))
    assert args and got == naive_carried(edges, starts, exits, defs, copies, args, results, born)


def test_literals_and_definitions_over_a_recursive_call(spark):
    # f: 0 a = "k"; 1 b = f(a) [p]; 2 use b; 3 return p     main: m0 c = "z"; m1 d = f(c); m2 use d
    p = carried.Program(
        table(spark, "src string, dst string", [("f0", "f1"), ("f1", "f2"), ("f2", "f3"), ("m0", "m1"), ("m1", "m2"), ("o0", "o1"), ("o1", "o2")]),
        table(spark, "method string, node string", [("f", "f0"), ("main", "m0"), ("o", "o0")]),
        table(spark, "method string, node string", [("f", "f3"), ("main", "m2"), ("o", "o2")]),
        table(spark, "node string, local string", [("f0", "a"), ("f1", "b"), ("m0", "c"), ("m1", "d"), ("o1", "e")]),
        table(spark, "node string, local string, source string", []),
        table(spark, "node string, callee string, arg string, param string", [("f1", "f", "a", "p"), ("m1", "f", "c", "p"), ("o1", "f", "e", "p")]),
        table(spark, "node string, callee string, value string, local string", [("f1", "f", "p", "b"), ("m1", "f", "p", "d"), ("o1", "f", "p", "e")]),
    )
    literals = table(spark, "node string, local string, value string", [("f0", "a", "k"), ("m0", "c", "z")])
    watched = table(spark, "node string, local string", [("f2", "b"), ("m2", "d"), ("o2", "e"), ("f3", "p")])
    # main's literal comes back to main, not to f's own call or to o
    assert rows(carried.literal_arguments(p, literals, watched)) == [("f2", "b", "k"), ("f3", "p", "k"), ("f3", "p", "z"), ("m2", "d", "z")]
    assert [r for r in rows(carried.reaching_definitions(p)) if r[0] in ("m2", "f3") and r[1] in "dp"] == [("f3", "p", "f0"), ("f3", "p", "m0"), ("m2", "d", "m0"), ("m2", "d", "m1")]
    uses = table(spark, "node string, local string", [("o1", "e"), ("o2", "e"), ("m2", "d")])
    assert rows(carried.uninitialised(p, table(spark, "method string, local string", [("o", "e"), ("main", "c"), ("main", "d"), ("f", "p")]), uses)) == [("o1", "e"), ("o2", "e")]
