"""Distributed ordered scans: a range sort whose partitions have numbers.

Prefix sums, sorted sweeps and carried values all need one global order without
one global task.  ``range_sorted`` sorts by range, gives every row the number of
its partition and writes the rows to the shared folder, so that the numbers stay
the same in every later job, retries included.  What then crosses partitions is
one small row per partition and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relafix.storage import cut


def range_sorted(df: DataFrame, *order: Column, pid: str = "pid") -> DataFrame:
    """Rows dealt out by ranges of ``order`` with their partition's number in ``pid``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn(pid, F.spark_partition_id()))
