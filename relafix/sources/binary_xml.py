"""Reader of compiled XML (manifests, layouts) out of application archives.

``read_nodes`` gives the trees in long form; ``manifest`` turns a manifest's tree
into component, filter, permission and application tables.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relafix.functions.scalar import expand_class_name
from relafix.storage import stage_table

# Fixed chunk types of the format, and kinds of typed values.
_POOL, _RESOURCES, _XML, _START, _END, _TEXT = 0x0001, 0x0180, 0x0003, 0x0102, 0x0103, 0x0104
_NULL, _REFERENCE, _STRING, _FLOAT, _INT, _HEX, _BOOLEAN = 0x00, 0x01, 0x03, 0x04, 0x10, 0x11, 0x12
_NONE = 0xFFFFFFFF


def _length(data: bytes, at: int, wide: bool) -> tuple[int, int]:
    """A string's length and where it ends; the top bit says that it takes two units."""
    if wide:
        (n,) = struct.unpack_from("<H", data, at)
        if n & 0x8000:
            (low,) = struct.unpack_from("<H", data, at + 2)
            return ((n & 0x7FFF) << 16) | low, at + 4
        return n, at + 2
    n = data[at]
    return (((n & 0x7F) << 8) | data[at + 1], at + 2) if n & 0x80 else (n, at + 1)


def _strings(data: bytes, at: int) -> list[str]:
    head, _, count, _, flags, start = struct.unpack_from("<HIIIII", data, at + 2)
    out = []
    for i in range(count):
        (offset,) = struct.unpack_from("<I", data, at + head + 4 * i)
        place = at + start + offset
        if flags & 0x100:  # UTF-8: length in characters, then in bytes
            _, place = _length(data, place, False)
            n, place = _length(data, place, False)
            out.append(data[place : place + n].decode("utf-8", "replace"))
        else:
            n, place = _length(data, place, True)
            out.append(data[place : place + 2 * n].decode("utf-16-le", "replace"))
    return out


def _value(kind: int, raw: int, strings: list[str]) -> str | None:
    if kind == _STRING:
        return strings[raw] if raw < len(strings) else None
    if kind == _BOOLEAN:
        return "true" if raw else "false"
    if kind == _INT:
        return str(raw - (1 << 32) if raw & 0x80000000 else raw)
    if kind == _REFERENCE:
        return f"@{raw:08x}"
    if kind == _FLOAT:
        return repr(struct.unpack("<f", struct.pack("<I", raw))[0])
    return None if kind == _NULL else f"0x{raw:x}"


def parse(data: bytes) -> Iterator[tuple[int, int | None, str, dict[str, str | None]]]:
    """(node, parent, tag, attributes) in document order."""
    (kind, head, size) = struct.unpack_from("<HHI", data, 0)
    if kind != _XML:
        raise ValueError("not compiled XML")
    at, strings, stack, number = head, [], [], 0
    while at + 8 <= min(size, len(data)):
        kind, head, length = struct.unpack_from("<HHI", data, at)
        if length < 8:
            raise ValueError("a chunk without length")
        if kind == _POOL:
            strings = _strings(data, at)
        elif kind == _START:
            _, name, start, each, count = struct.unpack_from("<IIHHH", data, at + head)
            attributes = {}
            for i in range(count):
                _, key, raw, _, _, typed, value = struct.unpack_from("<IIIHBBI", data, at + head + start + i * each)
                attributes[strings[key]] = strings[raw] if raw != _NONE and raw < len(strings) else _value(typed, value, strings)
            yield number, stack[-1] if stack else None, strings[name], attributes
            stack.append(number)
            number += 1
        elif kind == _END and stack:
            stack.pop()
        at += length


def read_nodes(spark: SparkSession, path: str, entry: str = "AndroidManifest.xml") -> DataFrame:
    """``input, node, parent, tag, attributes, error`` of one entry of each archive (or of plain files) under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    data = bytes(content)
                    if data[:2] == b"PK":
                        with zipfile.ZipFile(io.BytesIO(data)) as archive:
                            data = archive.read(entry)
                    rows += [(name, *node, None) for node in parse(data)]
                except (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile) as e:
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["input", "node", "parent", "tag", "attributes", "error"]).astype({"node": "Int32", "parent": "Int32"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "input string, node int, parent int, tag string, attributes map<string,string>, error string")


def manifest(nodes: DataFrame) -> dict[str, DataFrame]:
    """Tables ``app``, ``component``, ``filter``, ``permission`` of manifests' nodes."""
    nodes = stage_table(nodes.where("error is null"), "nodes")

    def attribute(name: str):
        return F.try_element_at("attributes", F.lit(name))

    root = nodes.where("tag = 'manifest'").select("input", attribute("package").alias("package"))
    sdk = nodes.where("tag = 'uses-sdk'").groupBy("input").agg(F.max(F.try_to_number(attribute("targetSdkVersion"), F.lit("999999999"))).cast("int").alias("target_sdk"))
    flags = nodes.where("tag = 'application'").groupBy("input").agg(F.max(attribute("debuggable").cast("boolean")).alias("debuggable"), F.max(attribute("allowBackup").cast("boolean")).alias("allow_backup"))
    app = root.join(sdk, "input", "left").join(flags, "input", "left")
    parts = nodes.where(F.col("tag").isin("activity", "activity-alias", "service", "receiver", "provider")).join(root, "input")
    filters = nodes.where("tag = 'intent-filter'").select("input", F.col("node").alias("filter"), F.col("parent").alias("component"))
    count = filters.groupBy("input", F.col("component").alias("node")).agg(F.count("*").cast("int").alias("n_filters"))
    component = parts.join(count, ["input", "node"], "left").select(
        "input", "node", expand_class_name(F.col("package"), attribute("name")).alias("name"), F.col("tag").alias("type"),
        attribute("enabled").cast("boolean").alias("enabled"), attribute("exported").cast("boolean").alias("exported"), F.coalesce("n_filters", F.lit(0)).alias("n_filters"),
    )
    # the first filter of a component, and what it names first
    first = Window.partitionBy("input", "component").orderBy("filter")
    inside = nodes.where("tag in ('action', 'category')").select("input", F.col("parent").alias("filter"), F.col("tag").alias("what"), F.col("node"), attribute("name").alias("value"))
    detail = filters.withColumn("place", F.row_number().over(first)).join(inside, ["input", "filter"], "left")
    permission = nodes.where("tag = 'uses-permission'").select("input", attribute("name").alias("permission")).distinct()
    return {"app": app, "component": component, "filter": detail, "permission": permission}
