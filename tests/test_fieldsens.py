"""Small programs of the field-sensitive tabulation, all analysed in one run."""

import pytest

from relafix.operators import fieldsens

#: Each case: its methods, the name that is tainted at the first line of ``main``, its path, and the lines of ``main`` that must show it.
CASES = {
    "read back": ({"main()": ["a.f = x", "y = a.f", "put y"]}, "x", "", {2}),
    "other field": ({"main()": ["a.f = x", "y = a.g", "put y"]}, "x", "", set()),
    "overwritten": ({"main()": ["a.f = x", "a.f := n", "y = a.f", "put y"]}, "x", "", set()),
    "other overwritten": ({"main()": ["a.f = x", "a.g := n", "y = a.f", "put y"]}, "x", "", {3}),
    "object is not its field": ({"main()": ["a.f = x", "put a"]}, "x", "", set()),
    "asked of the caller": ({"main()": ["a.f = x", "r = get a", "put r"], "get(p)": ["q = p.f", "return q"]}, "x", "", {2}),
    "caller has another": ({"main()": ["a.g = x", "r = get a", "put r"], "get(p)": ["q = p.f", "return q"]}, "x", "", set()),
    "callee overwrites": ({"main()": ["a.f = x", "r = clean a", "y = r.f", "put y", "z = r.g", "put z"], "clean(p)": ["p.f := n", "return p"]}, "x", "", set()),
    "callee spares": ({"main()": ["a.g = x", "r = clean a", "y = r.f", "put y", "z = r.g", "put z"], "clean(p)": ["p.f := n", "return p"]}, "x", "", {5}),
    "excluded then read": ({"main()": ["a.f = x", "r = odd a", "put r"], "odd(p)": ["p.f := n", "q = p.f", "return q"]}, "x", "", set()),
    "two callers": ({"main()": ["a.f = x", "b.g = x", "r = get a", "s = get b", "put r", "put s"], "get(p)": ["q = p.f", "return q"]}, "x", "", {4}),
    "through two calls": ({"main()": ["a.f = x", "b.g = a", "r = outer b", "put r"], "outer(p)": ["q = p.g", "r = inner q", "return r"], "inner(p)": ["q = p.f", "return q"]}, "x", "", {3}),
    "question handed on": ({"main()": ["a.f = x", "b.h = x", "r = outer a", "s = outer b", "put r", "put s"], "outer(p)": ["r = inner p", "return r"], "inner(p)": ["q = p.f", "return q"]}, "x", "", {4}),
    "handed on to nobody": ({"main()": ["a.h = x", "r = outer a", "put r"], "outer(p)": ["r = inner p", "return r"], "inner(p)": ["q = p.f", "return q"]}, "x", "", set()),
    "deeper than asked": ({"main()": ["a.f = x", "b.g = a", "c.h = b", "r = two c", "s = r.f", "put s", "put r"], "two(p)": ["q = p.h", "q = q.g", "return q"]}, "x", "", {5}),
    "written into the argument": ({"main()": ["call fill a x", "y = a.f", "put y", "put a"], "fill(p v)": ["p.f = v", "return p"]}, "x", "", {2}),
    "recursive reads": ({"main()": ["a.f = x", "b.f = a", "r = walk b", "put r", "put b"], "walk(p)": ["q = p.f", "r = walk q | q", "return r"]}, "x", "", {3}),
    "given path": ({"main()": ["y = x.f", "z = y.g", "put z", "put y"]}, "x", "f.g.", {2}),
    "loop stores into itself": ({"main()": ["y.f = x", "x = y | 0", "z = x.f", "put z"]}, "x", "", {3}),
}


def tables(spark, cases):
    rows = {n: [] for n in ("nodes", "cfg", "assigns", "kills", "overwrites", "calls", "returns", "starts", "exits", "args", "params", "seeds", "sinks")}
    for case, (methods, name, path, _) in cases.items():
        for head, body in methods.items():
            method, params = head.rstrip(")").split("(")
            method = f"{case}/{method}"

            def v(local, method=method):
                return f"{method}.{local}"

            rows["starts"].append((method, f"{method}:0"))
            rows["params"] += [(method, i, v(p)) for i, p in enumerate(params.split())]
            for i, line in enumerate(body):
                node, after = f"{method}:{i}", f"{method}:{i + 1}"
                rows["nodes"].append((node, method))
                line, _, extra = line.partition(" | ")
                words = line.replace(":=", "=").split()
                if words[0] == "return":
                    rows["exits"].append((method, node))
                    rows["params"].append((method, -2, v(words[1])))
                elif words[0] == "put":
                    rows["sinks"].append((node, v(words[1])))
                    rows["cfg"].append((node, after))
                elif words[0] == "call" or len(words) > 3:
                    to, callee, args = (None, words[1], words[2:]) if words[0] == "call" else (words[0], words[2], words[3:])
                    rows["calls"].append((node, f"{case}/{callee}"))
                    rows["args"] += [(node, j, v(a)) for j, a in enumerate(args)]
                    rows["returns"].append((node, after))
                    if to:
                        rows["args"].append((node, -2, v(to)))
                        rows["kills"].append((node, v(to)))
                    if extra:  # the callee may also do nothing
                        rows["assigns"].append((node, v(to), None, v(extra), None))
                else:
                    (base, _, field), (value, _, read) = words[0].partition("."), words[2].partition(".")
                    rows["cfg"].append((node, after))
                    if extra:
                        rows["cfg"].append((node, f"{method}:{extra}"))
                    if ":=" in line:
                        rows["overwrites"].append((node, v(base), field))
                    if value != "n":
                        rows["assigns"].append((node, v(base), field or None, v(value), read or None))
                    if not field:
                        rows["kills"].append((node, v(base)))
        rows["seeds"].append((f"{case}/main", f"{case}/main:0", f"{case}/main.{name}", path))
    schemas = {
        "nodes": "node string, method string",
        "cfg": "src string, dst string",
        "assigns": "node string, to_base string, to_field string, from_base string, from_field string",
        "kills": "node string, base string",
        "overwrites": "node string, base string, field string",
        "calls": "node string, callee string",
        "returns": "call string, site string",
        "starts": "method string, node string",
        "exits": "method string, node string",
        "args": "node string, pos int, base string",
        "params": "method string, pos int, base string",
        "seeds": "method string, node string, base string, path string",
        "sinks": "node string, base string",
    }
    made = {n: spark.createDataFrame(r, schemas[n]) for n, r in rows.items()}
    return fieldsens.Program(**{n: t for n, t in made.items() if n not in ("seeds", "sinks")}), made["seeds"], made["sinks"]


@pytest.fixture(scope="module")
def shown(spark):
    program, seeds, sinks = tables(spark, CASES)
    found = fieldsens.analyse(program, seeds, widen=4)
    rows = fieldsens.reached(found, sinks).select("node").distinct().collect()
    shown = {case: set() for case in CASES}
    for r in rows:
        case, place = r.node.split("/")
        method, line = place.split(":")
        if method == "main":
            shown[case].add(int(line))
    return shown, found


@pytest.mark.parametrize("case", CASES)
def test_fields(shown, case):
    assert shown[0][case] == CASES[case][3]


def test_questions_stay_as_deep_as_what_callers_hold(shown):
    asked = {r.prefix for r in shown[1]["asked"].where("method = 'recursive reads/walk'").collect()}
    assert max(p.count(".") for p in asked) == 3


def test_methods_are_entered_once_per_name(shown):
    begun = shown[1]["edge"].where("node = 'two callers/get:0'").collect()
    assert [(r.prefix, r.path) for r in begun] == [("", "")]


def test_nothing_to_start_from(spark):
    program, seeds, sinks = tables(spark, {"one": CASES["read back"]})
    found = fieldsens.analyse(program, seeds.limit(0))
    assert fieldsens.reached(found, sinks).count() == 0


def test_a_seed_in_a_callee_goes_to_all_callers(spark):
    methods = {"main()": ["r = make a", "y = r.f", "put y"], "make(p)": ["q.f = x", "return q"]}
    program, seeds, sinks = tables(spark, {"one": (methods, "x", "", set())})
    inner = spark.createDataFrame([("one/make", "one/make:0", "one/make.x", None)], seeds.schema)
    found = fieldsens.analyse(program, inner)
    assert [r.node for r in fieldsens.reached(found, sinks).collect()] == ["one/main:2"]
