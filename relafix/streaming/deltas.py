"""Readers of growing fact tables: each micro-batch is the delta of a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relafix.operators.fixpoint import Relations, fixpoint


def read_new_rows(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """A stream of rows of Parquet files as they come in under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def counts_by_window(events: DataFrame, time_col: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per window and key; windows close once the watermark has passed them."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def maintain_reachability(edges: DataFrame, known_path: str, checkpoint: str, seeds: DataFrame) -> StreamingQuery:
    """Keeps ``known_path`` (Parquet, a folder per batch) closed under a stream of edges ``src, dst``.

    A batch follows its own edges out of nodes known so far, then all edges so far out of nodes that
    are new, and writes only those.  A batch that is run a second time writes its folders anew.
    """
    spark = edges.sparkSession

    def update(batch: DataFrame, number: int) -> None:
        batch.select("src", "dst").write.mode("overwrite").parquet(f"{known_path}/edges/batch={number}")
        every = spark.read.parquet(f"{known_path}/edges").where(F.col("batch") <= number)
        base = seeds.select("node")
        if number:
            base = base.unionByName(spark.read.parquet(f"{known_path}/nodes").where(F.col("batch") < number).select("node"))

        def step(known: Relations, delta: Relations) -> Relations:
            return {"r": unknown(delta["r"].join(every, F.col("node") == F.col("src")).select(F.col("dst").alias("node")))}

        def unknown(rows: DataFrame) -> DataFrame:
            return rows.join(base, "node", "left_anti") if number else rows

        # only what the new edges lead to is followed; nodes known before were followed before
        start = unknown(batch.join(base, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node"))) if number else base
        fixpoint({"r": start}, step)["r"].write.mode("overwrite").parquet(f"{known_path}/nodes/batch={number}")

    return edges.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
