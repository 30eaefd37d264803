"""Where intermediate tables go, and how lineage is cut.

Everything written here lands under the folder that the session names in
``spark.checkpoint.dir``; a folder of our own is used only where that setting is
missing and the master is local, which is the case in tests.  ``localCheckpoint`` is never used: a
lost executor must not take an intermediate table with it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CONSTRAINTS = "spark.sql.constraintPropagation.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"
_PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints, set on the context if it was not yet."""
    context = spark.sparkContext
    root = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING)
    current = context._jsc.sc().getCheckpointDir()
    if root is None and current.isDefined():
        return current.get()
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="relafix-")
    if not current.isDefined():
        context.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably; partitions and their order are kept.

    Spark hands a plan's constraints on to its checkpoint and may then look for
    columns that the checkpoint no longer has, so none are derived meanwhile.
    """
    conf = df.sparkSession.conf
    checkpoint_root(df.sparkSession)
    before = conf.get(_CONSTRAINTS)
    conf.set(_CONSTRAINTS, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(_CONSTRAINTS, before)


@contextmanager
def partitions_for(spark: SparkSession, rows: int, a_task: int = 1_000_000) -> Iterator[None]:
    """Meanwhile shuffles of ``rows`` rows are dealt over so many partitions that a task gets some ``a_task`` of them.

    Never fewer than the session asks for; adaptive execution joins small ones again. A task's memory does not grow with the
    tables then. Only what is written inside counts: plans that are handed on run under the session's own number.
    """
    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(max(int(before), min(rows // a_task, 20_000))))
    try:
        yield
    finally:
        spark.conf.set(_PARTITIONS, before)


def stage_table(df: DataFrame, name: str = "stage", rows_a_file: int = 0, plain: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Smaller on disk than ``cut`` and with known sizes and columns, but the rows
    come back in partitions of Spark's choosing.  Spark reads and writes thousands of rows of a
    file at once; tables whose rows hold a megabyte each take files of few rows, ``rows_a_file``
    at most (0: no bound), so a task's memory does not grow with what it reads.
    With ``plain`` values are neither packed nor listed in dictionaries.  Spark takes a file's size for that of
    its rows when it decides on a broadcast, and keys that repeat pack to a fiftieth of what the driver would get.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/relafix-{uuid.uuid4().hex}/{name}"
    df.write.option("maxRecordsPerFile", rows_a_file).options(**(_PLAIN if plain else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty_table(spark: SparkSession, schema) -> DataFrame:
    """No rows under ``schema``, in a form that Spark's optimizer sees through: joins with it are planned away."""
    from pyspark.sql import functions as F

    return spark.range(0).limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def counted_table(df: DataFrame, name: str = "stage") -> tuple[DataFrame, int]:
    """``stage_table`` and how many rows were written, counted by the tasks that write them."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    rows = Observation()
    return stage_table(df.observe(rows, F.count(F.lit(1)).alias("n")), name, plain=True), rows.get["n"]


def counted_tables(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Several tables written by one job, so that plans they share run once, and the rows of each, counted meanwhile."""
    from functools import reduce

    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    spark = next(iter(tables.values())).sparkSession
    path = f"{checkpoint_root(spark)}/relafix-{uuid.uuid4().hex}/tables"
    # columns of one name may differ in type from table to table
    wide = [df.select(F.lit(name).alias("__table"), *[F.col(f"`{c}`").alias(f"{name}__{c}") for c in df.columns]) for name, df in tables.items()]
    rows = Observation()
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), wide)
    together.observe(rows, *[F.count_if(F.col("__table") == n).alias(n) for n in tables]).write.options(**_PLAIN).partitionBy("__table").parquet(path)
    counts, out = rows.get, {}
    for (name, df), own in zip(tables.items(), wide, strict=True):
        if counts[name]:
            read = spark.read.schema(own.drop("__table").schema).parquet(f"{path}/__table={name}")
            out[name] = read.toDF(*df.columns)
        else:
            out[name] = empty_table(spark, df.schema)
    return out, dict(counts)


def bounded_broadcast(df: DataFrame, max_rows: int, max_bytes: int = 256 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows and ``max_bytes`` bytes, else as it is.

    Rows are counted first, task by task, on a table that is written already or cheap
    to make; strings, arrays and binary columns are measured with them.  Beyond either
    bound the join that follows is a shuffled one.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    width = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))), F.lit(0))
        else:
            width = width + F.lit(8)
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df
