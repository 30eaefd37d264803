"""Scalar functions of the analysed language and of rule files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: descriptor of the signature form <class: ret name(args)>.
SIGNATURE = r"^<([^:]+):\s*(\S+)\s+([^\s(]+)\(([^)]*)\)>$"


def wrap_int(x: Column) -> Column:
    """A long reduced to 32 bits, as integer arithmetic of the language wraps."""
    low = x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def add(a: Column, b: Column) -> Column:
    return wrap_int(a.cast("long") + b.cast("long"))


def subtract(a: Column, b: Column) -> Column:
    return wrap_int(a.cast("long") - b.cast("long"))


def multiply(a: Column, b: Column) -> Column:
    return wrap_int(a.cast("long") * b.cast("long"))


def divide(a: Column, b: Column) -> Column:
    """Truncating; null for a zero divisor, which is not a constant."""
    x, y = a.cast("long"), b.cast("long")
    quotient = F.call_function("div", x, F.when(y != 0, y))
    return wrap_int(quotient)


def remainder(a: Column, b: Column) -> Column:
    """Sign of the dividend; null for a zero divisor."""
    return wrap_int(a.cast("long") % F.when(b != 0, b.cast("long")))


def negate(a: Column) -> Column:
    return wrap_int(-a.cast("long"))


def shift_left(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a.cast("int"), (n.cast("int").bitwiseAND(F.lit(31))))


def shift_right(a: Column, n: Column) -> Column:
    return F.call_function("shiftright", a.cast("int"), (n.cast("int").bitwiseAND(F.lit(31))))


def unsigned_shift_right(a: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", a.cast("int"), (n.cast("int").bitwiseAND(F.lit(31))))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def compare_float(a: Column, b: Column, nan: int) -> Column:
    """As ``compare``; ``nan`` (1 or -1) if either is not a number."""
    return F.when(F.isnan(a) | F.isnan(b), nan).otherwise(compare(a, b))


def fold(op: Column, a: Column, b: Column) -> Column:
    """The value of a binary operation on two integer constants; null if it is none."""
    table = {
        "+": add(a, b), "-": subtract(a, b), "*": multiply(a, b), "/": divide(a, b), "%": remainder(a, b),
        "&": a.bitwiseAND(b), "|": a.bitwiseOR(b), "^": a.bitwiseXOR(b),
        "<<": shift_left(a, b), ">>": shift_right(a, b), ">>>": unsigned_shift_right(a, b),
        "==": (a == b).cast("int"), "!=": (a != b).cast("int"), "<": (a < b).cast("int"), "<=": (a <= b).cast("int"), ">": (a > b).cast("int"), ">=": (a >= b).cast("int"), "cmp": compare(a, b),
    }
    out = F.lit(None).cast("int")
    for name, value in table.items():
        out = F.when(op == name, value.cast("int")).otherwise(out)
    return out


def parity(x: Column) -> Column:
    """Bits: 1 even, 2 odd."""
    return F.when(F.pmod(x, F.lit(2)) == 0, 1).otherwise(2)


def parity_of(op: Column, a: Column, b: Column) -> Column:
    """Parity bits of a sum, difference or product of parity bits; 3 where it is open."""
    same = F.when((a == 3) | (b == 3), 3).when(a == b, 1).otherwise(2)
    product = F.when((a == 1) | (b == 1), 1).when((a == 2) & (b == 2), 2).otherwise(3)
    return F.when(op.isin("+", "-"), same).when(op == "*", product).otherwise(3)


def signature(owner: Column, ret: Column, name: Column, params: Column) -> Column:
    """``<class: ret name(args)>``."""
    return F.concat(F.lit("<"), owner, F.lit(": "), subsignature(ret, name, params), F.lit(">"))


def subsignature(ret: Column, name: Column, params: Column) -> Column:
    return F.concat(ret, F.lit(" "), name, F.lit("("), F.array_join(params, ","), F.lit(")"))


def parse_signature(sig: Column) -> Column:
    """Struct of ``class, ret, name, params`` from a signature; null if it has not the form."""
    args = F.regexp_extract(sig, SIGNATURE, 4)
    params = F.when(F.trim(args) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(args, ","), F.trim))
    parts = F.struct(*[F.regexp_extract(sig, SIGNATURE, i).alias(n) for i, n in ((1, "class"), (2, "ret"), (3, "name"))], params.alias("params"))
    return F.when(sig.rlike(SIGNATURE), parts)


def is_system_class(name: Column) -> Column:
    """Fixed prefixes of platform packages."""
    return F.startswith(name, F.lit("android.")) | F.startswith(name, F.lit("java.")) | F.startswith(name, F.lit("sun."))


def expand_class_name(package: Column, name: Column) -> Column:
    """Component names that begin with a dot, or have none, are relative to the package."""
    return F.when(F.startswith(name, F.lit(".")), F.concat(package, name)).when(~F.contains(name, F.lit(".")), F.concat(package, F.lit("."), name)).otherwise(name)


def extra_type(method: Column) -> Column:
    """Type that an extra getter reads: ``getStringExtra`` to ``String``, arrays and lists marked."""
    pattern = r"^get(\w*?)(ArrayList|Array)?Extra$"
    kind = F.regexp_extract(method, pattern, 1)
    many = F.regexp_extract(method, pattern, 2)
    return F.when(method.rlike(pattern), F.concat(kind, F.when(many == "Array", F.lit("[]")).when(many == "ArrayList", F.lit("List")).otherwise(F.lit(""))))


def exported(attribute: Column, n_filters: Column, enabled: Column) -> Column:
    """A component is public by its attribute, else if it has an intent filter; disabled ones never are."""
    return F.coalesce(attribute, n_filters > 0) & F.coalesce(enabled, F.lit(True))


def sdk_below(target: Column, level: int) -> Column:
    """A missing target level counts as -1."""
    return F.coalesce(target, F.lit(-1)) < level
