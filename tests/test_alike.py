"""Methods that are alike: one is analysed, all are listed."""

from relafix.operators import alike, fieldsens


def test_one_of_each_kind_is_kept_and_findings_are_listed_for_all(spark):
    # m1 and m2 are alike, m3 copies another local, m4 misses a null field, m5 is called, a fixed name begins with m6's
    same = {m: (f"{m}:0", f"{m}.a", None, "g") for m in ("m1", "m2", "m4", "m5", "m6")}
    moves = [*same.values(), ("m3:0", "m3.b", None, "g")]
    moves[2] = ("m4:0", "m4.a", "g", None)
    nodes = spark.createDataFrame([(f"m{i}:0", f"m{i}") for i in range(1, 7)], "node string, method string")
    table = spark.createDataFrame([*moves, moves[0]], "node string, base string, field string, other string")
    less, copies = alike.kept({"moves": alike.Rows(table.distinct(), "node", ["base"])}, nodes, spark.createDataFrame([("m5",)], "callee string"), spark.createDataFrame([("m6.static",)], "base string"))
    assert {r.node for r in less["moves"].collect()} == {"m1:0", "m3:0", "m4:0", "m5:0", "m6:0"}
    found = less["moves"].select("node", "base", "other")
    want = {(node, base, other) for node, base, _, other in moves}
    assert {tuple(r) for r in copies.spread(found, {"node": ["base"]}).collect()} == want


def test_alike_callers_of_one_method_are_found_as_if_each_was_analysed(spark):
    rows = {n: [] for n in ("nodes", "cfg", "assigns", "kills", "calls", "returns", "starts", "exits", "args", "params", "seeds", "sinks")}
    for m, field in (("a1", "f"), ("a12", "f"), ("b", "f"), ("c", "h")):
        rows["nodes"] += [(f"{m}:{i}", m) for i in range(3)]
        rows["cfg"].append((f"{m}:0", f"{m}:1"))
        rows["assigns"].append((f"{m}:0", f"{m}.o", field, f"{m}.x", None))
        rows["calls"].append((f"{m}:1", "get"))
        rows["returns"].append((f"{m}:1", f"{m}:2"))
        rows["kills"].append((f"{m}:1", f"{m}.r"))
        rows["args"] += [(f"{m}:1", 0, f"{m}.o"), (f"{m}:1", -2, f"{m}.r")]
        rows["starts"].append((m, f"{m}:0"))
        rows["seeds"].append((m, f"{m}:0", f"{m}.x", ""))
        rows["sinks"].append((f"{m}:2", f"{m}.r"))
    rows["nodes"] += [("get:0", "get"), ("get:1", "get")]
    rows["cfg"].append(("get:0", "get:1"))
    rows["assigns"].append(("get:0", "get.q", None, "get.p", "f"))
    rows["starts"].append(("get", "get:0"))
    rows["exits"].append(("get", "get:1"))
    rows["params"] += [("get", 0, "get.p"), ("get", -2, "get.q")]
    names = {
        "nodes": "node, method", "cfg": "src, dst", "assigns": "node, to_base, to_field, from_base, from_field", "kills": "node, base", "calls": "node, callee", "returns": "call, site",
        "starts": "method, node", "exits": "method, node", "args": "node, pos, base", "params": "method, pos, base", "seeds": "method, node, base, path", "sinks": "node, base",
    }
    t = {n: spark.createDataFrame(rows[n], ", ".join(f"{c} {'int' if c == 'pos' else 'string'}" for c in cols.split(", "))) for n, cols in names.items()}
    seeds, sinks = t.pop("seeds"), t.pop("sinks")
    program = fieldsens.Program(overwrites=spark.createDataFrame([], "node string, base string, field string"), **t)
    got = sorted(tuple(r) for r in fieldsens.program_reached(program, seeds, sinks).collect())
    assert [r[:2] for r in got] == [("a12:2", "a12.r"), ("a1:2", "a1.r"), ("b:2", "b.r")]
    assert got == sorted(tuple(r) for r in fieldsens.reached(fieldsens.analyse(program, seeds), sinks).collect())
