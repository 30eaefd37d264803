"""Mixing sources to target weights, by hash-random order and exact budgets.

Every row gets a random but repeatable key (a hash of its id).  A range sort by
(source, key) and a distributed prefix sum of token counts give each row the
tokens of its source that come before it, and each source is cut exactly where
its budget ends: whole epochs first, then a prefix of the random order, the last
document in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relafix.llm.ranges import range_sorted
from relafix.storage import cut

#: A token of the size count: a run of anything but space and the five control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked_sources(sizes: DataFrame) -> DataFrame:
    """Sources (code-point order, null last) numbered from 0, without a single-task sort."""
    ranged = range_sorted(sizes, F.col("source").asc_nulls_last())
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, however many sources there are
    starts = ranged.groupBy("pid").agg(F.count("*").alias("n")).select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())
    return ranged.join(starts, "pid").select("source", "size", (F.col("start") + F.row_number().over(within) - 1).alias("rank"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Water-filled targets of sources.

    ``sizes`` has ``source`` and ``size``, one row per source.  Sources in
    code-point order (null last) get the weights in turn, repeating; together
    they aim at ``share`` times all sizes; a target stops at ``cap`` times its
    source's size and the excess is reshared by weight among the others until
    none is above.  With no size at all every target is 0.  Adds ``target``.

    A target is ``min(weight * level, cap * size)``; the level rises to its fixed
    point over rounds, each one aggregate whose three numbers reach the driver.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut(_ranked_sources(sizes).withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("most", F.col("size") * float(cap)))
    total = ranked.agg(F.sum("size")).first()[0] or 0
    wanted, level, capped = share * total, 0.0, -1
    while wanted:
        full = F.col("most") < F.col("weight") * level
        held, free, n = ranked.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if n == capped:  # nothing new went above its cap
            break
        capped, level = n, (wanted - held) / free if free else float("inf")
    filled = F.col("most") if level == float("inf") else F.least(F.col("weight") * level, F.col("most"))
    return ranked.select("source", F.col("size").alias("source_size"), filled.alias("target"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"))
    rows = rows.withColumn("key", F.xxhash64(F.lit("mix"), "doc_id"))
    order = [F.col("key"), F.col("doc_id"), F.col("size"), F.col("tie")]
    ranged = range_sorted(rows, F.col("source").asc_nulls_last(), *order)
    before = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each source and partition: what the source has in earlier partitions
    part = cut(ranged.groupBy("pid", "source").agg(F.sum("size").alias("n")).select("pid", "source", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    targets = source_targets(part.groupBy("source").agg(F.sum("n").alias("size")), weights, share, cap)
    part = part.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("pid", F.col("p.source").alias("source"), "start", "source_size", "target")
    within = Window.partitionBy("pid", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("prefix", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("r")
    joined = summed.join(part.alias("p"), (F.col("r.pid") == F.col("p.pid")) & F.col("r.source").eqNullSafe(F.col("p.source")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start") - F.col("prefix")))
    return joined.select("doc_id", F.col("r.source").alias("source"), "size", "tie", "source_size", "target", taken.cast("long").alias("taken"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """What the mix takes of each row: ``doc_id, size, source, source_size, target, taken``.

    One row per row of ``docs``.  ``size`` is the text's words (null and empty
    texts: 0), ``taken`` the words that the mix takes of the row, repeats
    counted: ``floor(budget / source size)`` whole epochs, and one more for the
    rows that come first in random order until the budget is spent, the last one
    in part.  The budget is the target rounded to a whole word, so a source's
    taken words equal it exactly.

    Null sources form one source; null ids and repeated rows are rows like any
    other (equal rows may swap their parts, the result as a bag stays the same).
    An empty table gives an empty result.  Other columns are not looked at, so
    their names cannot clash.
    """
    return _plan(docs, id_col, text_col, source_col, weights, share, cap).drop("tie")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    chars_col: str = "n_chars",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """``docs`` as the mix has them: a row for each epoch, cut texts for those taken in part.

    Keeps the columns of ``docs``.  Rows of which nothing is taken go, except
    rows without words, which cost nothing and stay once.  A part of a text
    keeps its first words with the blanks between them.  ``chars_col``, where
    present, is counted anew.  Equal rows share out what the mix takes of them.
    """
    plan = _plan(docs, id_col, text_col, source_col, weights, share, cap)
    size = F.col("size")
    epochs = F.when(size > 0, F.floor(F.col("taken") / size)).otherwise(1).cast("int")
    plan = plan.withColumn("epochs", epochs).withColumn("part", F.when(size > 0, F.col("taken") - F.col("epochs") * size).otherwise(0))
    # equal rows differ by one epoch at most, and one of them may have a part
    lowest = F.min("epochs")
    same = plan.groupBy("doc_id", "source", "size", "tie").agg(
        F.count("*").alias("rows"), lowest.alias("epochs"), (F.sum("epochs") - lowest * F.count("*")).alias("more"), F.max("part").alias("part")
    ).alias("p")
    sized = docs.select(F.struct("*").alias("row"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie")).alias("d")
    on = F.col(f"d.row.{id_col}").eqNullSafe(F.col("p.doc_id")) & F.col(f"d.row.{source_col}").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d.tie") == F.col("p.tie"))
    joined = sized.join(same, on).select("row", "d.size", "d.tie", "p.doc_id", "p.source", "rows", "epochs", "more", "part")
    equal = Window.partitionBy("doc_id", "source", "size", "tie").orderBy("rows")
    numbered = joined.where("rows = 1").withColumn("nth", F.lit(1)).unionByName(joined.where("rows > 1").withColumn("nth", F.row_number().over(equal)))
    times = (F.col("epochs") + (F.col("nth") <= F.col("more")).cast("int")).cast("int")
    whole = F.array_repeat(F.lit(-1).cast("long"), times)
    pieces = F.when((F.col("part") > 0) & (F.col("nth") == F.col("more") + 1), F.concat(whole, F.array(F.col("part").cast("long")))).otherwise(whole)
    rows = numbered.select("row", F.explode(pieces).alias("keep"))
    words = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(F.col("keep") < 0, F.col(f"row.{text_col}")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("keep").cast("int")), ""))
    out = rows.select("row", text.alias("cut_text"))
    kinds = {f.name: f.dataType for f in docs.schema}
    return out.select(*[F.col("cut_text").alias(c) if c == text_col else F.length("cut_text").cast(kinds[c]).alias(c) if c == chars_col else F.col("row")[c].alias(c) for c in docs.columns])
