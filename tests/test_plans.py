"""Graph queries over whole tables, held against brute force on small ones."""

import pytest

from relafix.plans import catalogue


@pytest.fixture
def small(spark, tmp_path):
    def put(name, schema, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("nation", "n_nationkey int, n_regionkey int", [(n, n % 2) for n in range(8)])
    put("customer", "c_custkey int, c_nationkey int", [(c, c % 7) for c in range(20)])
    put("supplier", "s_suppkey int, s_nationkey int", [(s, 6) for s in range(1, 5)])
    orders = [(o, (o * 3) % 20, 100.0 * o) for o in range(12)]
    lines = [(o, (o * 5) % 9, 1 + o % 4, float(o + 1)) for o in range(12)]
    put("orders", "o_orderkey int, o_custkey int, o_totalprice double", orders)
    put("lineitem", "l_orderkey int, l_partkey int, l_suppkey int, l_quantity double", lines)
    return str(tmp_path), orders, lines


def reached(edges, start):
    found, todo = set(), [start]
    while todo:
        node = todo.pop()
        new = {b for a, b in edges if a == node} - found
        found |= new
        todo += new
    return found


def test_closure_of_every_nation(spark, small):
    path, orders, _ = small
    edges = {(f"n{c % 7}", f"c{c}") for c in range(20)} | {(f"n{6}", f"s{s}") for s in range(1, 5)} | {(f"c{c}", f"o{o}") for o, c, _ in orders}
    want = {f"n{n}": len(reached(edges, f"n{n}")) for n in range(7)}
    assert {r.origin: r.n_reached for r in catalogue.QUERIES["closure_by_origin"](spark, path).collect()} == want


def test_reachability_and_components_use_all_lines(spark, small):
    path, orders, lines = small
    ties = {(f"p{p}", f"s{s}") for _, p, s, _ in lines}
    got = {r.node for r in catalogue.QUERIES["cyclic_reachability"](spark, path).collect()}
    assert got == reached(ties | {(b, a) for a, b in ties}, "s1") | {"s1"} and len(got) > 1
    customer = {o: c for o, c, _ in orders}
    ties = {(customer[o], s + 1_000_000) for o, _, s, _ in lines}
    both = ties | {(b, a) for a, b in ties}
    want = {node: min(reached(both, node) | {node}) for pair in ties for node in pair}
    assert {r.node: r.component for r in catalogue.QUERIES["connected_components"](spark, path).collect()} == want
