"""Demand-driven points-to against plain search, against the whole-program sets, and on programs where callers matter."""

from __future__ import annotations

import random

import pytest

from relafix.operators import demand, pointsto

SCHEMAS = {"alloc": "var, obj", "assign": "dst, src", "store": "base, field, src", "load": "dst, base, field", "param": "call, formal, actual", "result": "call, dst, returned"}


def frames(spark, tables):
    return [spark.createDataFrame([tuple(r) for r in tables[n]] * 2, ", ".join(f"{c} string" for c in s.split(", "))) for n, s in SCHEMAS.items()]


def parsed(**lines):
    return {n: [line.split() for line in lines.get(n, "").split(", ") if line] for n in SCHEMAS}


def plain(asked, p, depth):
    """The same rules, one after the other over Python sets until nothing changes."""
    want, flow, pts, before = {(v, ()) for v in asked}, set(), set(), None
    while before != (len(want), len(flow), len(pts)):
        before = (len(want), len(flow), len(pts))
        flow |= {(v, s, src, s) for v, s in want for d, src in p["assign"] if d == v}
        flow |= {(v, s, r, ((c, *s))[:depth]) for v, s in want for c, d, r in p["result"] if d == v}
        flow |= {(v, s, a, s[1:]) for v, s in want for c, f, a in p["param"] if f == v and (not s or s[0] == c)}
        for v, s in list(want):
            for d, base, field in p["load"]:
                if d == v:
                    want.add((base, s))
                    for sb, sf, sv in p["store"]:
                        if sf == field:
                            want.add((sb, ()))
                            if {o for x, y, o in pts if (x, y) == (base, s)} & {o for x, y, o in pts if (x, y) == (sb, ())}:
                                flow.add((v, s, sv, ()))
        want |= {(src, fs) for _, _, src, fs in flow}
        pts |= {(v, s, o) for v, s in want for x, o in p["alloc"] if x == v}
        pts |= {(v, s, o) for v, s, src, fs in flow for x, y, o in pts if (x, y) == (src, fs)}
    return want, flow, pts


def drawn(seed):
    rng = random.Random(seed)
    name = [f"{seed}.{v}" for v in "abcdefghij"]
    pick = lambda n, *kinds: [[rng.choice(k) for k in kinds] for _ in range(n)]
    objs, calls, fields = [f"{seed}.o{i}" for i in range(4)], [f"{seed}.c{i}" for i in range(4)], ["f", "g"]
    return {"alloc": pick(3, name, objs), "assign": pick(3, name, name), "store": pick(3, name, fields, name), "load": pick(3, name, name, fields), "param": pick(4, calls, name, name), "result": pick(3, calls, name, name)}, name[:3]


@pytest.mark.parametrize("depth", [0, 2])
def test_random_programs(spark, depth):
    """Forty programs in one run: every relation is that of a plain search; without stacks the sets are the whole-program ones."""
    both = [drawn(seed) for seed in range(40)]
    p = {n: [tuple(r) for tables, _ in both for r in tables[n]] for n in SCHEMAS}
    asked = [v for _, names in both for v in names]
    program = frames(spark, p)
    found = demand.demanded(spark.createDataFrame([(v,) for v in asked], "var string"), *program, depth=depth)
    want, flow, pts = set(), set(), set()
    for tables, names in both:  # names differ but for fields, whose stores are asked for in all programs
        others = {"store": p["store"]}
        for known, more in zip((want, flow, pts), plain(names, tables | others | {n: tables[n] for n in ("alloc",)}, depth), strict=True):
            known |= more
    got = {(r.var, tuple(r.stack), r.obj) for r in found["pts"].collect()}
    mine = {(v, s, o) for v, s, o in got if (v, s) in want}
    asked_pts = {(v, o) for v, s, o in pts if not s and v in asked}
    assert {(v, o) for v, s, o in got if not s and v in asked} == asked_pts and len(asked_pts) > 30
    assert mine >= pts
    assert {(r.var, tuple(r.stack), r.src, tuple(r.from_stack)) for r in found["flow"].collect()} >= flow
    if depth == 0:
        alloc, assign, store, load, param, result = program
        moves = assign.union(param.select("formal", "actual")).union(result.select("dst", "returned"))
        whole = pointsto.points_to(alloc.distinct(), moves.distinct(), store.distinct(), load.distinct())["pts"]
        assert {(r.var, r.obj) for r in whole.select("var", "obj").collect() if r.var in asked} == asked_pts


def test_callers_do_not_mix(spark):
    """One identity method, called twice, once through another; a whole-program analysis gives both objects to both."""
    p = parsed(
        alloc="a A, b B, boxa BA, boxb BB",
        assign="r p",
        store="boxa f a, boxb f b, boxa g b",
        load="fromx x f, fromy y f",
        param="c1 p a, c2 q b, c3 p q, d1 p boxa, d2 p boxb",
        result="c1 u r, c2 w s, c3 s r, d1 x r, d2 y r",
    )

    def sets(depth, *names):
        asked = spark.createDataFrame([(n,) for n in names], "var string")
        found = demand.points_to_of(asked, *frames(spark, p), depth=depth)
        return {n: "".join(sorted(f"{r.obj} " for r in found.collect() if r.var == n)).split() for n in names}

    assert sets(3, "u", "w", "x", "fromx", "fromy", "r") == {"u": ["A"], "w": ["B"], "x": ["BA"], "fromx": ["A"], "fromy": ["B"], "r": ["A", "B", "BA", "BB"]}
    loose = sets(0, "u", "fromx")
    assert loose["u"] == ["A", "B", "BA", "BB"] and loose["fromx"] == ["A", "B"]


def test_only_what_is_asked(spark):
    """A part of the program that the asked variable does not need is not visited; fields are opened when they are read."""
    p = parsed(alloc="a A, z Z, y Y", assign="b a, far z", store="y f z", param="c p far", load="l a f")
    found = demand.demanded(spark.createDataFrame([("b",)], "var string"), *frames(spark, p))
    assert {r.var for r in found["want"].collect()} == {"a", "b"}
    none = demand.demanded(spark.createDataFrame([], "var string"), *frames(spark, p))
    assert all(df.isEmpty() for df in none.values())


def test_recursion_ends(spark):
    """A method that hands its parameter to itself: stacks are cut, the set is still whole."""
    p = parsed(alloc="a A, b B", param="c1 p a, c2 p q, c3 p b", assign="q p, r p", result="c1 u r, c2 r s, c3 w r")
    asked = spark.createDataFrame([("u",), ("w",)], "var string")
    found = {(r.var, r.obj) for r in demand.points_to_of(asked, *frames(spark, p), depth=2).collect()}
    assert found >= {("u", "A"), ("w", "B")}


def test_ways_out_of_a_method_are_joined_by_call(spark):
    """As many stacks as calls meet at a parameter: only the call on top may be looked up there, not all of them."""
    n = 30
    p = parsed(alloc=", ".join(f"v{i} o{i}" for i in range(n)), assign="r p", param=", ".join(f"c{i} p v{i}" for i in range(n)), result=", ".join(f"c{i} got{i} r" for i in range(n)))
    asked = spark.createDataFrame([(f"got{i}",) for i in range(n)], "var string")
    found = demand.points_to_of(asked, *frames(spark, p)).collect()
    assert sorted(map(tuple, found)) == sorted((f"got{i}", f"o{i}") for i in range(n))
    wants = spark.createDataFrame([("p", [f"c{i}"]) for i in range(n)] + [("p", [])], "var string, stack array<string>")
    out = demand.left_by(wants, spark.createDataFrame([(f"c{i}", "p", f"v{i}") for i in range(n)], "call string, formal string, actual string"))
    assert out.count() == 2 * n
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 2 and any("call#" in line for line in joins)
