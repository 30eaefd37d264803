"""Small programs of the bidirectional tabulation, all analysed in one run."""

from __future__ import annotations

import pytest

from relafix.operators import bidirectional as bi
from relafix.operators.ifds import Problem

#: A line is a way (``>`` forward, ``<`` backward, ``=`` both) and a row of a table; the last part of a flow is ``fact fact``.
PROGRAMS = {
    # both ways reach the ends of bar and leave to the one call of it
    "both_leave": """= seed b 0 | > flow b e 0 x | < flow b s 0 y | > exit bar e | < exit bar s | > ret c bar e f x u | < ret c bar s a y v | > flow f g u w | < flow a z v k""",
    # the backward fact dies on its way: forward waits
    "one_dies": """= seed b 0 | > flow b e 0 x | > exit bar e | < exit bar s | > ret c bar e f x u | < ret c bar s a y v | > flow f g u w""",
    # the ways would leave to different calls
    "other_calls": """= seed b 0 | > flow b e 0 x | < flow b s 0 y | > exit bar e | < exit bar s | > ret c1 bar e f x u | < ret c2 bar s a y v | > flow f g u w""",
    # of two callers only one is left to by both
    "one_of_two": """= seed b 0 | > flow b e 0 x | < flow b s 0 y | > exit bar e | < exit bar s | > ret c1 bar e f1 x u | > ret c2 bar e f2 x u | < ret c2 bar s a2 y v""",
    # two seeds in two methods called from one place each; each source has one way only
    "two_sources": """= seed b1 0 | = seed b2 0 | > flow b1 e1 0 x | < flow b2 s2 0 y | > exit m1 e1 | < exit m2 s2 | > ret c m1 e1 f x u | < ret c m2 s2 a y v""",
    # two seeds of one method: forward from one, backward from the other
    "one_method_two_seeds": """= seed b1 0 | = seed b2 0 | > flow b1 e 0 x | < flow b2 s 0 y | > exit m e | < exit m s | > ret c m e f x u | < ret c m s a y v""",
    # two levels: beyond the first call the call is the source, however the method was left
    "two_levels": """= seed b 0 | > flow b e 0 x | < flow b s 0 y | > exit in e | < exit in s | > ret c in e f x u | < ret c in s a y v
        | > flow f e2 u u | < flow a s2 v v | > exit out e2 | < exit out s2 | > ret d out e2 g u p | < ret d out s2 h v q | > flow g last p p""",
    # forward calls a method between, entered with x; what returns has its source again and leaves
    "balanced_between": """= seed b 0 | > flow b k 0 x | > call k h x a | > start h hs | > exit h he | > flow hs he a a | > ret k h he r a x2 | > flow r e x2 x2
        | < flow b s 0 y | > exit bar e | < exit bar s | > ret c bar e f x2 u | < ret c bar s o y v""",
    # a fact entered by a call never leaves to a call that did not bring it
    "no_mixing": """= seed b 0 | > flow b k 0 x | > call k h x a | > start h hs | > exit h he | > flow hs he a a | > ret k h he r a x2 | > ret other h he w a bad | < ret other h hs w2 y bad | < seed hs y""",
    # a recursive method leaves to itself and to its caller
    "recursive": """= seed b 0 | > flow b e 0 x | < flow b s 0 y | > exit m e | < exit m s | > ret c m e f x x | < ret c m s a y y | > flow f e x x | < flow a s y y
        | > ret d m e g x out | < ret d m s i y in""",
    # facts go by a call
    "by_a_call": """= seed b 0 | > flow b k 0 x | > pass k e x x | < flow b s 0 y | > exit m e | < exit m s | > ret c m e f x u | < ret c m s a y v""",
}

#: Facts after calls, and the leaks that wait, as ``way node fact`` and ``way call fact``.
EXPECTED = {
    "both_leave": ("> f u, > g w, < a v, < z k", ""),
    "one_dies": ("", "> c u"),
    "other_calls": ("", "> c1 u, < c2 v"),
    "one_of_two": ("> f2 u, < a2 v", "> c1 u"),
    "two_sources": ("", "> c u, < c v"),
    "one_method_two_seeds": ("", "> c u, < c v"),
    "two_levels": ("> f u, > e2 u, > g p, > last p, < a v, < s2 v, < h q", ""),
    "balanced_between": ("> f u, < o v", ""),
    "no_mixing": ("", ""),
    "recursive": ("> f x, > e x, < a y, < s y, > g out, < i in", ""),
    "by_a_call": ("> f u, < a v", ""),
}

SCHEMAS = {
    "start": "method, node",
    "exit": "method, node",
    "flow": "src, dst, fact, out",
    "call": "node, callee, fact, out",
    "ret": "node, callee, exit, site, fact, out",
    "pass": "node, site, fact, out",
    "seed": "node, fact",
}
FACTS = {"start": 0, "exit": 0, "flow": 2, "call": 2, "ret": 2, "pass": 2, "seed": 1}


def tables(spark, programs, way):
    rows = {name: [] for name in SCHEMAS}
    for program, text in programs.items():
        for line in text.split("|"):
            sign, kind, *parts = line.split()
            if sign in (way, "="):
                places = len(parts) - FACTS[kind]
                rows[kind].append(tuple(f"{program}.{p}" if i < places else p for i, p in enumerate(parts)))
    made = {name: spark.createDataFrame(rows[name] * 2, ", ".join(f"{c.strip()} string" for c in schema.split(","))) for name, schema in SCHEMAS.items()}
    return Problem(calls=made["call"], starts=made["start"], exits=made["exit"], returns=made["ret"], normal=made["flow"], call=made["call"], ret=made["ret"], bypass=made["pass"], seeds=made["seed"])


@pytest.fixture(scope="module")
def found(spark):
    done = bi.entangle(tables(spark, PROGRAMS, ">"), tables(spark, PROGRAMS, "<"))
    sign = {"forward": ">", "backward": "<"}
    edges = [(sign[r.way], *r.node.split("."), r.fact, r.source) for r in done["edge"].collect()]
    waits = [(sign[r.way], *r.call.split("."), r.fact) for r in bi.waiting(done).collect()]
    return done, edges, waits


@pytest.mark.parametrize("name", PROGRAMS)
def test_program(found, name):
    _, edges, waits = found
    calls = {c for c in PROGRAMS[name].split("|") if " ret " in f" {c} "}
    calls = {f"{name}.{c.split()[2]}" for c in calls}
    beyond = {f"{way} {node} {fact}" for way, program, node, fact, source in edges if program == name and source in calls}
    held = {f"{way} {call} {fact}" for way, program, call, fact in waits if program == name}
    wanted = tuple({w for w in text.split(", ") if w} for text in EXPECTED[name])
    assert (beyond, held) == wanted


def test_source_comes_back_from_a_call(found):
    done, edges, _ = found
    inside = {(n, f, s) for w, p, n, f, s in edges if p == "balanced_between" and n in ("hs", "he")}
    assert inside == {("hs", "a", None), ("he", "a", None)}
    assert {s for w, p, n, f, s in edges if (p, n) == ("balanced_between", "r")} == {"balanced_between.b"}
    left = {(r.call, r.forward, r.backward) for r in bi.departures(done).collect() if r.source == "one_of_two.b"}
    assert left == {("one_of_two.c1", True, False), ("one_of_two.c2", True, True)}


def test_no_seeds(spark):
    bare = {"p": "> flow a b 0 x | > exit m b | > ret c m b f x u | < ret c m a g y v"}
    found = bi.entangle(tables(spark, bare, ">"), tables(spark, bare, "<"))
    assert all(df.isEmpty() for df in found.values()) and bi.departures(found).isEmpty() and bi.waiting(found).isEmpty()


def test_rounds_look_up_what_they_need(spark):
    """Returns of calls that nothing enters are no part of what rounds hold against summaries."""
    many = " | ".join(f"> ret c{i} bar e f{i} x u" for i in range(20))
    text = {"p": PROGRAMS["balanced_between"] + " | " + many}
    forward, backward = tables(spark, text, ">"), tables(spark, text, "<")
    held = bi._both(forward, backward)
    assert {(r.call, r.callee) for r in held["back"].collect()} == {("p.k", "p.h")}
    assert held["leaving"].where("way = 'forward' and callee = 'p.bar'").distinct().count() == 21 and {r.node for r in held["ends"].collect()} == {"p.he"}
