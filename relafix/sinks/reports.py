"""Findings as structured reports: JSON objects, text lines, graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of findings by number; reports carry the number.
KINDS = ("APIVULN", "CRASHVULN", "DATAFLOWINVULN", "GENERAL", "DATAFLOWOUTVULN", "REACHABILITYVULN")
FINDING = (
    "vuln_kind int, source_stmt string, source_method string, dest_stmt string, dest_method string, desc string, "
    "paths array<struct<stmt:string,method:string>>, custom string, score float"
)


def reports(findings: DataFrame, by: str = "md5hash") -> DataFrame:
    """``score, md5hash, results`` per input: the plain sum of scores and the findings in a fixed order."""
    fields = ["vuln_kind", "source_stmt", "source_method", "dest_stmt", "dest_method", "desc", "paths", "custom"]
    return findings.groupBy(by).agg(F.sum("score").cast("float").alias("score"), F.sort_array(F.collect_list(F.struct(*fields))).alias("results")).select("score", F.col(by).alias("md5hash"), "results")


def to_json(report: DataFrame) -> DataFrame:
    """``value``: each report as one JSON object with camel-case finding fields and the kind as its number."""
    names = {"vuln_kind": "vulnKind", "source_stmt": "sourceStmt", "source_method": "sourceMethod", "dest_stmt": "destStmt", "dest_method": "destMethod", "desc": "desc", "paths": "paths", "custom": "custom"}
    results = F.transform("results", lambda r: F.struct(*[r[old].alias(new) for old, new in names.items()]))
    return report.select(F.to_json(F.struct("score", "md5hash", results.alias("results")), {"ignoreNullFields": "false"}).alias("value"))


def write_json(report: DataFrame, path: str) -> None:
    """One JSON object a line, partitioned over files by Spark."""
    to_json(report).write.text(path)


def push(report: DataFrame, sink: Callable[[Iterable[str]], None]) -> None:
    """Hands each partition's JSON objects to ``sink``, for queues and lists outside Spark."""
    to_json(report).foreachPartition(lambda rows: sink(r["value"] for r in rows))


def result_lines(leaks: DataFrame) -> DataFrame:
    """``value``: a line per sink with its sources in order."""
    sources = F.array_join(F.sort_array(F.collect_set("origin")), ", ")
    return leaks.groupBy("sink").agg(sources.alias("sources"), F.count("*").alias("n")).select(F.format_string("%s <- %s (%d)", F.col("sink").cast("string"), "sources", "n").alias("value"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """``value``: Graphviz edge lines; the caller adds the first and the last line."""
    def quoted(name: str):
        return F.concat(F.lit('"'), F.regexp_replace(F.col(name).cast("string"), '"', '\\\\"'), F.lit('"'))

    return edges.select(F.concat(quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";")).alias("value"))


def fuzz_commands(components: DataFrame, extras: DataFrame) -> DataFrame:
    """``name, command``: a JSON launch command per exported component with the extras that it reads."""
    read = extras.groupBy("class").agg(F.sort_array(F.collect_set(F.struct("key", "type"))).alias("extras"))
    out = components.where("exported").join(read.withColumnRenamed("class", "name"), "name", "left")
    none = F.array().cast("array<struct<key:string,type:string>>")
    return out.select("name", F.to_json(F.struct(F.col("name").alias("component"), "type", F.coalesce("extras", none).alias("extras"))).alias("command"))
