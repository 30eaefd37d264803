"""URL filters as a sort-merge range join.

A rule (host, path prefix) covers an interval of canonical keys, the host's
labels reversed and then the path.  A rule opens at its key and closes behind all
keys that begin with it; openings, closings and urls are sorted together.  A sweep
over the order keeps the stack of rules open at each url: its height is the running
number of openings less closings, and its top is the last rule that was opened at
that height.  Intervals are nested or disjoint, so the top is the longest prefix.
The sweep runs in range partitions; what crosses them is the height at their ends
and the last rule opened at each height.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relafix.llm.ranges import range_sorted
from relafix.storage import stage_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table, for lists written in code."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _rule_intervals(rules: DataFrame) -> DataFrame:
    """``key, rule, host_len, verdict`` of each distinct rule."""
    host = F.translate("host", _UPPER, _LOWER)
    keyed = rules.where(F.col("host") != "").select(
        F.concat(F.array_join(_reversed_labels(host), "."), F.lit("/"), F.coalesce("path", F.lit(""))).alias("key"),
        F.concat(host, F.coalesce("path", F.lit(""))).alias("rule"),
        F.length(host).alias("host_len"),
        "verdict",
    )
    # of rules with one key, the smallest verdict counts: allow before block
    return keyed.groupBy("key").agg(F.min("rule").alias("rule"), F.min("host_len").alias("host_len"), F.min("verdict").alias("verdict"))


def _sweep(events: DataFrame) -> DataFrame:
    """``row, hit`` of the probes in ``events``: the top of the stack where it is not empty.

    ``events`` has ``key, turn, row, hit``: at one key openings (turn 0, with ``hit``)
    come before probes (turn 1).  A closing (turn 2) stands at the last key of its
    interval.
    """
    order = [F.col("key"), F.col("turn"), F.col("row")]
    step = F.when(F.col("turn") == 0, 1).when(F.col("turn") == 2, -1).otherwise(0)
    ranged = range_sorted(events.withColumn("step", step), *order)
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    starts = ranged.groupBy("pid").agg(F.sum("step").alias("n")).select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    upto = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = ranged.withColumn("n", F.sum("step").over(upto)).join(starts, "pid").withColumn("height", F.col("start") + F.col("n")).where("height > 0 and turn < 2")
    # the last rule opened at a height, in this partition or an earlier one
    level = Window.partitionBy("pid", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = high.withColumn("seen", F.last("hit", ignorenulls=True).over(level)).where("turn = 1")
    opened = high.where("turn = 0").groupBy("pid", "height").agg(F.max_by("hit", "key").alias("last"))
    marks = opened.select("pid", "height", "last").unionByName(seen.where("seen is null").select("pid", "height", F.lit(None).cast(opened.schema["last"].dataType).alias("last")).distinct())
    marks = marks.groupBy("pid", "height").agg(F.first("last", ignorenulls=True).alias("last"))
    earlier = Window.partitionBy("height").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("pid", "height", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    inside = seen.where("seen is not null").select("row", F.col("seen").alias("hit"))
    return inside.unionByName(seen.where("seen is null").join(carried, ["pid", "height"]).select("row", F.col("carried").alias("hit")))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url: ``page_id, host, path, rule, verdict``, one row per row of ``pages``.

    ``rules`` has ``verdict, host, path``; a rule fits its host and all its
    subdomains if the url's path starts with the rule's.  Of the rules that fit,
    the longest ``host + path`` wins, then the longer host.  Without a rule the
    verdict is ``default`` and the rule null.

    Null urls and urls without ``://`` have an empty host and path and fit no
    rule.  Repeated urls are spread by row, however many there are, because a
    row number breaks ties in the sorted order.  Empty tables give empty
    results, an empty rule table gives the default everywhere.  Other columns
    are not looked at.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rows = stage_table(rows.withColumn("row", F.monotonically_increasing_id()), "urls")  # written, so that row numbers stay
    labels = _reversed_labels(F.col("host"))
    # one probe for each domain above the host, itself included
    probes = rows.where(F.col("host") != "").select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit("/"), F.col("path")))).alias("key"),
        "row",
    )
    intervals = _rule_intervals(rules)
    hit = F.struct("rule", "host_len", "verdict").alias("hit")
    none = F.lit(None).cast("struct<rule:string,host_len:int,verdict:string>").alias("hit")
    no_row = F.lit(-1).cast("long").alias("row")
    key = F.col("key").cast("binary")
    opens = intervals.select(key.alias("key"), F.lit(0).alias("turn"), no_row, hit)
    # no text has a byte of 255, so this stands behind all keys that begin with the rule's
    closes = intervals.select(F.concat(key, F.lit(b"\xff")).alias("key"), F.lit(2).alias("turn"), no_row, none)
    hits = _sweep(opens.unionByName(closes).unionByName(probes.select(key.alias("key"), F.lit(1).alias("turn"), "row", none)))
    best = hits.groupBy("row").agg(F.max_by("hit", F.struct(F.length("hit.rule"), F.col("hit.host_len"))).alias("hit"))
    judged = rows.join(best, "row", "left")
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
