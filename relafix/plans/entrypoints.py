"""Entry points of programs that a platform drives: lifecycle methods and callbacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relafix.operators.fixpoint import Relations, fixpoint
from relafix.storage import cut

# Lifecycle methods of the platform's component classes, in calling order.
LIFECYCLE = {
    "android.app.Activity": [
        "void onCreate(android.os.Bundle)", "void onStart()", "void onRestoreInstanceState(android.os.Bundle)", "void onPostCreate(android.os.Bundle)", "void onResume()", "void onPostResume()",
        "void onSaveInstanceState(android.os.Bundle)", "void onPause()", "void onStop()", "void onRestart()", "void onDestroy()",
    ],
    "android.app.Service": ["void onCreate()", "void onStart(android.content.Intent,int)", "int onStartCommand(android.content.Intent,int,int)", "android.os.IBinder onBind(android.content.Intent)", "void onRebind(android.content.Intent)", "boolean onUnbind(android.content.Intent)", "void onDestroy()"],
    "android.content.BroadcastReceiver": ["void onReceive(android.content.Context,android.content.Intent)"],
    "android.content.ContentProvider": ["boolean onCreate()"],
    "android.app.Application": ["void onCreate()", "void onTerminate()"],
}


def lifecycle_table(spark: SparkSession, listed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``base, stage, subsig`` of the component classes; ``stage`` is the place in calling order."""
    return spark.createDataFrame([(base, i, sub) for base, subs in (LIFECYCLE if listed is None else listed).items() for i, sub in enumerate(subs)], "base string, stage int, subsig string")


def lifecycle_calls(components: DataFrame, subtype: DataFrame, dispatch: DataFrame, listed: DataFrame) -> DataFrame:
    """``component, base, stage, target``: what the platform calls on each of ``components(name)``.

    ``subtype(sub, super)`` is closed and reflexive; ``dispatch(class, subsig, target)`` gives the
    method a class has.  Names that are no subtype of a listed base get no row.
    """
    kinds = components.select(F.col("name").alias("component")).distinct().join(subtype.select(F.col("sub").alias("component"), F.col("super").alias("base")), "component")
    return kinds.join(listed, "base").join(dispatch.withColumnRenamed("class", "component"), ["component", "subsig"]).select("component", "base", "stage", "target").distinct()


def lifecycle_order(calls: DataFrame) -> DataFrame:
    """``component, src, dst``: a component's methods in turn; from the last one back to the first, as the platform may start over."""
    order = Window.partitionBy("component", "base").orderBy("stage", "target")
    every = Window.partitionBy("component", "base")
    return calls.select("component", F.col("target").alias("src"), F.coalesce(F.lead("target").over(order), F.min_by("target", F.struct("stage", "target")).over(every)).alias("dst")).distinct()


def callbacks(entries: DataFrame, calls: DataFrame, made: DataFrame, subtype: DataFrame, dispatch: DataFrame, interfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``component, method`` that the platform's calls reach, and ``component, target`` of the callbacks among its starts.

    ``entries(component, method)`` start; ``calls(src, tgt)``; ``made(method, class)`` are objects a
    method creates.  A created class below one of ``interfaces(interface, subsig)`` gets its methods
    called back, in the component that created it; what these create counts as well.
    """
    calls = cut(calls.select("src", "tgt").distinct())
    listens = subtype.select(F.col("sub").alias("class"), F.col("super").alias("interface")).join(interfaces, "interface").join(dispatch, ["class", "subsig"]).select("class", "target").distinct()
    starts = cut(made.join(listens, "class").select(F.col("method").alias("src"), F.col("target").alias("tgt")).distinct())
    on = calls.union(starts).distinct()

    def step(known: Relations, delta: Relations) -> Relations:
        return {"r": delta["r"].join(on, F.col("method") == F.col("src")).select("component", F.col("tgt").alias("method"))}

    reached = fixpoint({"r": entries.select("component", "method")}, step)["r"]
    return reached, reached.join(starts, F.col("method") == F.col("src")).select("component", F.col("tgt").alias("target")).distinct()
