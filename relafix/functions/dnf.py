"""Boolean conditions in disjunctive normal form, as arrays of clauses of literals.

A clause is an array of (var, positive) in order of the variables; the condition
is true if one clause has only true literals.  No clauses: false.  An empty clause:
true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<array<struct<var:string,positive:boolean>>>"


def literal(var: Column, positive: Column) -> Column:
    return F.array(F.array(F.struct(var.alias("var"), positive.alias("positive"))))


def simplify(dnf: Column) -> Column:
    """Sorted literals, no repeated ones, no contradictory clauses, none that another stands for."""
    tidy = F.transform(dnf, lambda c: F.array_sort(F.array_distinct(c)))
    clash = F.filter(tidy, lambda c: F.size(F.array_distinct(F.transform(c, lambda x: x["var"]))) == F.size(c))
    unique = F.array_sort(F.array_distinct(clash))
    return F.filter(unique, lambda c: ~F.exists(unique, lambda d: (F.size(d) < F.size(c)) & (F.size(F.array_except(d, c)) == 0)))


def disjunction(a: Column, b: Column) -> Column:
    return simplify(F.concat(a, b))


def conjunction(a: Column, b: Column) -> Column:
    return simplify(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, y)))))


def negation(dnf: Column) -> Column:
    """De Morgan, then distribution clause by clause."""
    true = F.array(F.array().cast("array<struct<var:string,positive:boolean>>"))
    turned = F.transform(dnf, lambda c: F.transform(c, lambda x: F.array(F.struct(x["var"].alias("var"), (~x["positive"]).alias("positive")))))
    return F.aggregate(turned, true, lambda s, c: simplify(F.flatten(F.transform(s, lambda x: F.transform(c, lambda y: F.concat(x, y))))))


def assign(dnf: Column, values: Column) -> Column:
    """Literals of variables in the map ``values`` are replaced by what they come to."""

    def known(x: Column) -> Column:
        return F.try_element_at(values, x["var"]).isNotNull()

    alive = F.filter(dnf, lambda c: ~F.exists(c, lambda x: known(x) & (F.try_element_at(values, x["var"]) != x["positive"])))
    return simplify(F.transform(alive, lambda c: F.filter(c, lambda x: ~known(x))))


def evaluate(dnf: Column, values: Column) -> Column:
    """True, false, or null while a variable that matters has no value."""
    left = assign(dnf, values)
    return F.when(F.size(left) == 0, False).when(F.exists(left, lambda c: F.size(c) == 0), True)
