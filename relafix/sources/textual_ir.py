"""Reader of textual three-address code: one file per class, facts as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relafix.storage import stage_table

# Fixed shapes of the language.
_CLASS = re.compile(r"^\s*((?:\w+ )*)(class|interface) ([\w.$']+)(?: extends ([\w.$']+))?(?: implements ([^{\n]+))?\s*\{?\s*$")
_FIELD = re.compile(r"^\s*((?:(?:public|private|protected|static|final|volatile|transient) )*)([\w.$\[\]]+) ([\w$<>']+);\s*$")
_METHOD = re.compile(r"^\s*((?:\w+ )*)([\w.$\[\]]+) ([\w$<>']+)\(([^)]*)\)(?: throws [^{;]+)?\s*(;?)\s*$")
_LOCALS = re.compile(r"^\s*([\w.$\[\]]+) ([\w$#, ]+);\s*$")
_LABEL = re.compile(r"^\s*(\w+):\s*$")
_INVOKE = re.compile(r"(virtual|interface|special|static|dynamic)invoke (?:([\w$#]+)\.)?(<[^<>]*(?:<\w*init>)?[^<>]*>)\((.*)\)")
_CATCH = re.compile(r"^\s*catch ([\w.$]+) from (\w+) to (\w+) with (\w+);")
_JUMP = re.compile(r"^(?:if (.+) )?goto (\w+)$")
_FIELD_REF = re.compile(r"(?:([\w$#]+)\.)?(<[\w.$']+: [^()<>]+>)")
_MODIFIERS = {"public": 1, "private": 2, "protected": 4, "static": 8, "final": 16, "synchronized": 32, "volatile": 64, "transient": 128, "native": 256, "interface": 512, "abstract": 1024}


def _bits(words: str) -> int:
    return sum(_MODIFIERS.get(w, 0) for w in words.split())


def _split(args: str) -> list[str]:
    """Arguments at commas outside of quotes."""
    return [a.strip() for a in re.findall(r'(?:"(?:\\.|[^"\\])*"|[^,"])+', args) if a.strip()]


def _kind(text: str) -> str:
    if text.startswith("if "):
        return "if"
    for word in ("goto", "return", "throw", "lookupswitch", "tableswitch", "entermonitor", "exitmonitor", "nop", "breakpoint"):
        if re.match(rf"{word}\b", text):
            return word
    if ":=" in text:
        return "identity"
    if re.match(r"\w+invoke ", text):
        return "invoke"
    return "assign" if " = " in text else "other"


@dataclass
class _Unit:
    text: str
    kind: str


def parse(text: str) -> Iterator[dict]:
    """Facts of one file as (relation, values)."""
    owner, method, units, labels, traps, switch = None, None, [], {}, [], None
    depth = 0
    for line in text.split("\n"):
        stripped = line.strip()
        if not stripped or stripped.startswith("//"):
            continue
        if owner is None:
            if m := _CLASS.match(line):
                owner = m[3]
                flags = _bits(m[1]) | (512 if m[2] == "interface" or "interface" in m[1].split() else 0)
                yield {"rel": "class", "name": owner, "super": m[4], "items": _split(m[5] or ""), "num": flags}
            continue
        if stripped == "{":
            depth += 1
            continue
        if switch is not None:
            switch.append(stripped)
            if stripped.startswith("}"):
                units.append(_Unit(" ".join(switch).rstrip(";"), _kind(switch[0])))
                switch = None
            continue
        if stripped == "}":
            if method is not None:
                yield from _body(method, units, labels, traps)
                method, units, labels, traps = None, [], {}, []
            continue
        if method is None:
            if (m := _METHOD.match(line)) and "=" not in line:
                params = _split(m[4])
                sub = f"{m[2]} {m[3]}({','.join(params)})"
                sig = f"<{owner}: {sub}>"
                yield {"rel": "method", "name": sig, "super": owner, "text": sub, "type": m[2], "items": params, "num": _bits(m[1]), "flag": not m[5]}
                method = None if m[5] else sig
            elif m := _FIELD.match(line):
                yield {"rel": "field", "name": f"<{owner}: {m[2]} {m[3]}>", "super": owner, "text": m[3], "type": m[2], "num": _bits(m[1])}
            continue
        if m := _LABEL.match(line):
            labels[m[1]] = len(units)
        elif m := _CATCH.match(line):
            traps.append(m.groups())
        elif re.match(r"(lookup|table)switch\b", stripped) and not stripped.endswith(";"):
            switch = [stripped]
        elif not units and (m := _LOCALS.match(line)) and not re.match(r"(return|goto|throw|entermonitor|exitmonitor)\b", stripped):
            for name in m[2].split(","):
                yield {"rel": "local", "method": method, "name": name.strip(), "type": m[1]}
        else:
            body = stripped.rstrip(";")
            units.append(_Unit(body, _kind(body)))


def _body(method: str, units: list[_Unit], labels: dict[str, int], traps: list[tuple]) -> Iterator[dict]:
    last = len(units) - 1
    for i, u in enumerate(units):
        yield {"rel": "unit", "method": method, "idx": i, "kind": u.kind, "text": u.text}
        targets = []
        if jump := _JUMP.match(u.text):
            targets.append((labels.get(jump[2]), "branch"))
        if u.kind.endswith("switch"):
            targets += [(labels.get(t), "branch") for t in re.findall(r"goto (\w+)", u.text)]
        if u.kind not in ("goto", "return", "throw") and not u.kind.endswith("switch") and i < last:
            targets.append((i + 1, "fall"))
        yield from ({"rel": "cfg", "method": method, "idx": i, "num": t, "kind": k} for t, k in dict.fromkeys(targets) if t is not None and t <= last)
        found = _INVOKE.search(u.text)
        if found:
            yield {"rel": "invoke", "method": method, "idx": i, "kind": found[1], "name": found[3], "super": found[2], "items": _split(found[4])}
        yield from _operands(method, i, u, found)
    for kind, begin, end, handler in traps:
        # labels of a range stand before their units; the end is exclusive
        yield {"rel": "trap", "method": method, "idx": labels.get(begin), "num": labels.get(end, len(units)), "type": kind, "name": str(labels.get(handler))}


def _operands(method: str, i: int, u: _Unit, invoke) -> Iterator[dict]:
    left, _, right = u.text.partition(" := " if u.kind == "identity" else " = ")
    if not right:
        left, right = "", u.text

    def one(text: str, role: str, pos: int) -> dict:
        text = text.strip()
        constant = re.fullmatch(r'-?[\d.]+(?:[eE]-?\d+)?[LFlf]?|#?(?:Infinity|NaN)\w*|".*"|null|class ".*"', text)
        field = _FIELD_REF.fullmatch(text)
        array = re.fullmatch(r"([\w$#]+)\[(.+)\]", text)
        kind = "const" if constant else "static_field" if field and not field[1] else "field" if field else "array" if array else "param" if text.startswith("@") else "local" if re.fullmatch(r"[\w$#]+", text) else "expr"
        return {"rel": "operand", "method": method, "idx": i, "num": pos, "role": role, "kind": kind, "text": text}

    if left and u.kind in ("assign", "identity"):
        yield one(left, "def", 0)
        if base := re.match(r"([\w$#]+)(?:\.<|\[)", left):
            yield one(base[1], "base", 0)
    if invoke:
        if invoke[2]:
            yield one(invoke[2], "base", 0)
        for pos, arg in enumerate(_split(invoke[4])):
            yield one(arg, "arg", pos)
    elif u.kind == "if":
        for pos, word in enumerate(re.split(r"\s*(?:==|!=|<=|>=|<|>)\s*", re.sub(r"^if | goto .*$", "", u.text))):
            yield one(word, "cond", pos)
    elif u.kind in ("assign", "identity"):
        cast = re.match(r"\(([\w.$\[\]]+)\) (.+)", right)
        value = cast[2] if cast else re.sub(r"^(lengthof|neg) ", "", right)
        parts = re.split(r" (?:\+|-|\*|/|%|&|\||\^|<<|>>>|>>|cmp|cmpl|cmpg|instanceof) ", value) if not _FIELD_REF.fullmatch(value) and '"' not in value else [value]
        for pos, part in enumerate(parts):
            yield one(part, "use", pos)
            if base := re.match(r"([\w$#]+)(?:\.<|\[)", part):
                yield one(base[1], "base", pos)
    elif u.kind in ("return", "throw", "entermonitor", "exitmonitor") and " " in right:
        yield one(right.partition(" ")[2], "use", 0)


_COLUMNS = ["rel", "method", "idx", "kind", "name", "super", "text", "type", "role", "num", "flag", "items"]
_SCHEMA = "rel string, method string, idx int, kind string, name string, super string, text string, type string, role string, num int, flag boolean, items array<string>"


def read_facts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables ``class, method, field, local, unit, operand, invoke, cfg, trap`` of all files under ``path``.

    A class is one file and is parsed as a whole; files are spread over tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [fact for text in b["value"] for fact in parse(text)]
            table = pd.DataFrame(rows, columns=_COLUMNS)
            yield table.astype({"idx": "Int32", "num": "Int32", "flag": "boolean"}).astype(object).where(table.notna(), None) if len(table) else pd.DataFrame(columns=_COLUMNS)

    raw = spark.read.text(path, wholetext=True).mapInPandas(run, _SCHEMA)
    facts = stage_table(raw, "facts")

    def rel(name: str) -> DataFrame:
        return facts.where(F.col("rel") == name)

    return {
        "class": rel("class").select("name", "super", "items", (F.col("num").bitwiseAND(512) > 0).alias("is_interface"), F.col("num").alias("modifiers")).withColumnRenamed("items", "interfaces"),
        "method": rel("method").select(F.col("name").alias("sig"), F.col("super").alias("class"), F.col("text").alias("subsig"), F.col("type").alias("ret"), F.col("items").alias("params"), F.col("num").alias("modifiers"), F.col("flag").alias("has_body")),
        "field": rel("field").select(F.col("name").alias("sig"), F.col("super").alias("class"), F.col("text").alias("name"), "type", F.col("num").alias("modifiers")),
        "local": rel("local").select("method", "name", "type"),
        "unit": rel("unit").select("method", "idx", "kind", "text"),
        "operand": rel("operand").select("method", "idx", F.col("num").alias("pos"), "role", "kind", "text"),
        "invoke": rel("invoke").select("method", "idx", "kind", F.col("name").alias("target_sig"), F.col("super").alias("base"), F.col("items").alias("args")),
        "cfg": rel("cfg").select("method", F.col("idx").alias("src"), F.col("num").alias("dst"), "kind"),
        "trap": rel("trap").select("method", F.col("idx").alias("begin"), F.col("num").alias("end"), F.col("name").cast("int").alias("handler"), "type"),
    }
