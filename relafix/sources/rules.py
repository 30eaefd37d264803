"""Readers of rule files: sources and sinks, permissions, wrapper rules, callbacks, logs, constant rules.

All of them read text with Spark's readers, so any path that Spark can open will do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relafix.functions.scalar import parse_signature

# Fixed line format: <Class: Ret name(args)> perm ... -> _KIND_
_SOURCE_SINK = r"^\s*(<[^>]*>)\s*(.*?)\s*->\s*_(SOURCE|SINK|NONE|BOTH)_(?:\|(.*))?\s*$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def source_sinks(spark: SparkSession, path: str, categories: Sequence[str] | None = None) -> DataFrame:
    """``sig, class, ret, name, params, perms, category, is_source, is_sink`` from a text file; ``%`` begins a comment.

    A signature on several lines is a source if one line says so, and likewise a sink.
    """
    parts = [F.regexp_extract("value", _SOURCE_SINK, i) for i in range(1, 5)]
    rows = _lines(spark, path).where(~F.startswith(F.ltrim("value"), F.lit("%")) & F.col("value").rlike(_SOURCE_SINK))
    rows = rows.select(parts[0].alias("sig"), F.filter(F.split(parts[1], r"\s+"), lambda p: p != "").alias("perms"), parts[2].alias("kind"), F.nullif(parts[3], F.lit("")).alias("category"))
    if categories is not None:
        rows = rows.where(F.col("category").isin(list(categories)))
    rows = rows.groupBy("sig").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("perms")))).alias("perms"), F.min("category").alias("category"), F.bool_or(F.col("kind").isin("SOURCE", "BOTH")).alias("is_source"), F.bool_or(F.col("kind").isin("SINK", "BOTH")).alias("is_sink"))
    return rows.withColumn("p", parse_signature(F.col("sig"))).select("sig", "p.*", "perms", "category", "is_source", "is_sink")


def source_sinks_xml(spark: SparkSession, path: str) -> DataFrame:
    """``sig, position, fields, types, is_source, is_sink`` from an XML file of methods with access paths.

    Positions are ``base``, ``return`` and ``param<i>``; an access path has ``field`` and
    ``type`` elements inside ``pathElement``.
    """
    path_type = "struct<_isSource:boolean,_isSink:boolean,pathElement:array<struct<_field:string,_type:string>>>"
    schema = f"_signature string, base struct<accessPath:array<{path_type}>>, `return` struct<accessPath:array<{path_type}>>, param array<struct<_index:int,accessPath:array<{path_type}>>>"
    rows = spark.read.format("xml").option("rowTag", "method").schema(schema).load(path)
    none = F.array().cast(f"array<struct<position:string,ap:{path_type}>>")

    def at(position, paths):
        return F.coalesce(F.transform(paths, lambda p: F.struct(position.alias("position"), p.alias("ap"))), none)

    params = F.coalesce(F.flatten(F.transform("param", lambda p: at(F.concat(F.lit("param"), p["_index"].cast("string")), p["accessPath"]))), none)
    every = F.concat(at(F.lit("base"), F.col("base.accessPath")), at(F.lit("return"), F.col("return.accessPath")), params)
    flat = rows.select(F.col("_signature").alias("sig"), F.explode(every).alias("x"))
    empty = F.array().cast("array<string>")
    return flat.select(
        "sig",
        "x.position",
        F.coalesce(F.col("x.ap.pathElement._field"), empty).alias("fields"),
        F.coalesce(F.col("x.ap.pathElement._type"), empty).alias("types"),
        F.coalesce("x.ap._isSource", F.lit(False)).alias("is_source"),
        F.coalesce("x.ap._isSink", F.lit(False)).alias("is_sink"),
    )


def permission_map(spark: SparkSession, path: str) -> DataFrame:
    """``sig, permission`` from lists that name a permission and then its methods (``Permission:NAME``, ``<sig> ...``)."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split("value", r"(?m)^Permission:"), lambda b: F.trim(b) != "")).alias("block"))
    name = F.trim(F.regexp_extract("block", r"^\s*(\S+)", 1))
    return blocks.select(F.explode(F.regexp_extract_all("block", F.lit(r"(?m)^\s*(<[^>\n]*>)"), F.lit(1))).alias("sig"), name.alias("permission"))


def permission_csv(spark: SparkSession, path: str) -> DataFrame:
    """``sig, permission`` from a CSV file with a signature and its permissions (separated by blanks)."""
    rows = spark.read.option("header", "false").schema("sig string, perms string").csv(path)
    return rows.select(F.trim("sig").alias("sig"), F.explode(F.filter(F.split("perms", r"\s+"), lambda p: p != "")).alias("permission"))


def wrapper_rules(spark: SparkSession, path: str) -> DataFrame:
    """``class, subsig, action``: ``~`` exclude, ``-`` kill, ``^`` include (a class prefix), ``%`` comment, else create."""
    rows = _lines(spark, path).select(F.trim("value").alias("v")).where(~F.startswith("v", F.lit("%")))
    first = F.substring("v", 1, 1)
    action = F.when(first == "~", "exclude").when(first == "-", "kill").when(first == "^", "include").otherwise("create")
    rest = F.when(action == "create", F.col("v")).otherwise(F.substring("v", 2, 1_000_000))
    named = rows.select(action.alias("action"), rest.alias("v"))
    whole = F.regexp_extract("v", r"^<([^:]+):\s*(.*)>$", 1)
    return named.select(F.when(F.col("action") == "include", F.col("v")).otherwise(whole).alias("class"), F.when(F.col("action") == "include", F.lit(None)).otherwise(F.regexp_extract("v", r"^<([^:]+):\s*(.*)>$", 2)).alias("subsig"), "action")


def names(spark: SparkSession, path: str, column: str = "name") -> DataFrame:
    """One trimmed name or signature a line: callback and capability lists."""
    return _lines(spark, path).select(F.trim("value").alias(column)).distinct()


def reflection_log(spark: SparkSession, path: str) -> DataFrame:
    """``kind, target, source_method, line`` of recorded reflective calls, fields separated by semicolons."""
    rows = spark.read.option("sep", ";").schema("kind string, target string, source_method string, line int, guard string").csv(path)
    return rows.select("kind", "target", "source_method", "line").distinct()


def constant_rules(spark: SparkSession, rows: Sequence[tuple[str, str, int, str, str, str]]) -> DataFrame:
    """``rule, sig, arg_idx, op, operand, desc``; ``op`` is ``eq``, ``regex`` or ``always``. Rules are data and never run as code."""
    return spark.createDataFrame(list(rows), "rule string, sig string, arg_idx int, op string, operand string, desc string")
