"""Embedding near-duplicates: an epsilon grid order join within each label.

Two vectors with cosine c are sqrt(2 - 2 c) apart once both have length 1, so the join
is one of unit vectors at a distance of at most epsilon.  Rows are turned to principal
axes and sorted by label and grid cell (cells are epsilon wide, the axis with the most
spread first).  Runs of the sorted sequence are blocks; runs of blocks are nodes of a
tree, each with the box that its vectors fill.  The join starts from each label's root
with itself and recursively replaces a pair of intervals by the pairs of their parts, one
Spark join a level and side.  A pair whose boxes are provably too far apart is skipped; a
pair whose boxes lie wholly within epsilon is linked without looking at its vectors, so
that a group of copies costs its nodes, not its pairs.  What is left are pairs of blocks,
compared by matrix products; they hand out a count for each row and the links of a
spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relafix.llm.components import connected_components
from relafix.llm.shingles import give_back, small_batches
from relafix.llm.vectors import directed, units
from relafix.storage import stage_table

_MARGIN = 1e-9
_BOX = "array<struct<lo:double,hi:double>>"


def _by_dim(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors: which rows have it, and those rows as one matrix."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(dim))


def _axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of the unit vectors of length ``dim`` as columns, the widest first."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            for _, x in _by_dim(b.column(0)):
                a = np.hstack([units(x), np.ones((len(x), 1))])
                total += a.T @ a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    parts = rows.where(F.size("vec") == dim).select("vec").mapInArrow(add_up, "i int, sums array<double>")
    merged = parts.select("i", F.posexplode("sums").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((dim + 1, dim + 1))
    for r in merged:  # one row for each pair of components
        total[r["i"], r["j"]] = r["s"]
    n, mean = max(1.0, total[dim, dim]), total[dim, :dim] / max(1.0, total[dim, dim])
    values, axes = np.linalg.eigh(total[:dim, :dim] / n - np.outer(mean, mean))
    return axes[:, np.argsort(-values)]


def _celled(rows: DataFrame, axes: np.ndarray, cell: float, leading: int) -> DataFrame:
    """Rows with ``dim`` and the grid ``cells`` of the leading axes; lengths other than that of ``axes`` keep their own."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("vec")
            cells: list = [None] * b.num_rows
            for at, x in _by_dim(vectors):
                u = units(x)
                u = u @ axes if u.shape[1] == len(axes) else u
                for i, c in zip(at, np.floor(u[:, :leading] / cell).astype(np.int32), strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), vectors, vectors.value_lengths().cast(pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["id", "label", "vec", "dim", "cells"])

    return rows.mapInArrow(place, f"id long, label {rows.schema['label'].dataType.simpleString()}, vec {rows.schema['vec'].dataType.simpleString()}, dim int, cells array<int>")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links ``a[i] - b[i]`` that join what was apart before them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]


def _roots(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Smallest id of each row's component within one block."""
    low = ids
    while True:
        nearer = np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (nearer == low).all():
            return low
        low = nearer


def _blocks(ordered: DataFrame, axes: np.ndarray, cosine: float, size: int) -> DataFrame:
    """One row a run of ``size`` rows of one label: its vectors, box, and what links within it."""
    kind = np.float32 if ordered.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64

    def make(ids: list, x: np.ndarray) -> dict:
        u, ids = units(x), np.array(ids, np.int64)
        linked = u @ u.T >= cosine
        np.fill_diagonal(linked, True)
        turned = u @ axes if u.shape[1] == len(axes) else u
        box = [{"lo": lo, "hi": hi} for lo, hi in zip(turned.min(axis=0), turned.max(axis=0), strict=True)]
        return {"n": len(ids), "ids": ids, "data": x.astype(kind).tobytes(), "box": box, "inner": linked.sum(axis=1) - 1, "roots": _roots(ids, linked)}

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, blk, ids, vectors, out = None, 0, [], [], []

        def close():
            nonlocal blk, ids, vectors
            if ids:
                out.append({"label": key[0], "dim": key[1], "pid": key[2], "blk": blk} | make(ids, np.stack(vectors)))
            blk, ids, vectors = blk + 1, [], []

        for b in batches:
            for label, dim, pid, i, v in b[["label", "dim", "pid", "id", "vec"]].itertuples(index=False):
                if (label, dim, pid) != key:
                    close()
                    key, blk = (label, dim, pid), 0
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    close()
            if len(out) >= 8:
                yield pd.DataFrame(out)
                out = []
        close()
        if out:
            yield pd.DataFrame(out)
        give_back()

    label = ordered.schema["label"].dataType.simpleString()
    return ordered.mapInPandas(cut_up, f"label {label}, dim int, pid long, blk long, n long, ids array<long>, data binary, box {_BOX}, inner array<long>, roots array<long>")


def _parents(nodes: DataFrame, fan: int, across: bool) -> DataFrame:
    """Runs of ``fan`` nodes: neighbouring blocks of a partition, or (``across``) neighbouring partitions."""
    pid, blk = (F.floor(F.col("pid") / fan), F.col("blk")) if across else (F.col("pid"), F.floor(F.col("blk") / fan))

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        boxes = parts["box"].tolist()
        box = [{"lo": min(b[i]["lo"] for b in boxes), "hi": max(b[i]["hi"] for b in boxes)} for i in range(len(boxes[0]))]
        head = parts.iloc[:1][["label", "dim", "pid", "blk"]]
        return head.assign(n=parts["n"].sum(), hub=parts["hub"].min(), box=[box])

    return nodes.withColumn("pid", pid).withColumn("blk", blk).groupBy("label", "dim", "pid", "blk").applyInPandas(merge, nodes.schema)


def _pairs_of_parts(pairs: DataFrame, nodes: DataFrame, up: tuple[Column, Column], epsilon: float) -> DataFrame:
    """All pairs of parts of the given pairs that may be near; ``entire`` marks those that are near as a whole."""
    part = nodes.select("label", "dim", up[0].alias("up_pid"), up[1].alias("up_blk"), "pid", "blk", "n", "hub", "box")
    for side in ("a", "b"):
        this = part.select(*[F.col(c).alias(f"{side}_{c}") for c in part.columns])
        on = [F.col("label") == F.col(f"{side}_label"), F.col("dim") == F.col(f"{side}_dim"), F.col(f"{side}_up_pid") == F.col(f"p{side}_pid"), F.col(f"{side}_up_blk") == F.col(f"p{side}_blk")]
        pairs = pairs.join(this, on).drop(f"{side}_label", f"{side}_dim", f"{side}_up_pid", f"{side}_up_blk")
    forward = (F.col("a_pid") < F.col("b_pid")) | ((F.col("a_pid") == F.col("b_pid")) & (F.col("a_blk") <= F.col("b_blk")))
    gap = lambda a, b: F.greatest(a["lo"] - b["hi"], b["lo"] - a["hi"], F.lit(0.0))
    reach = lambda a, b: F.greatest(a["hi"] - b["lo"], b["hi"] - a["lo"])
    square = lambda f: F.sqrt(F.aggregate(F.zip_with("a_box", "b_box", f), F.lit(0.0), lambda s, x: s + x * x))
    near = pairs.where(forward).withColumn("least", square(gap)).where(F.col("least") <= epsilon + _MARGIN)
    return near.withColumn("entire", square(reach) <= epsilon - _MARGIN).drop("a_box", "b_box", "least", "pa_pid", "pa_blk", "pb_pid", "pb_blk")


def _spread(pairs: DataFrame, blocks: DataFrame, side: str, share: int) -> DataFrame:
    """``pairs`` with the vectors of one side's blocks; a block of very many pairs is repeated for every ``share`` of them."""
    key = ["label", "dim", "pid", "blk"]
    mine = [F.col("label"), F.col("dim"), F.col(f"{side}_pid").alias("pid"), F.col(f"{side}_blk").alias("blk")]
    asked = pairs.groupBy(*mine).agg(F.ceil(F.count("*") / share).alias("copies"))
    held = blocks.join(asked, key).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    held = held.select(*[F.col(c).alias(f"{side}_{c}") for c in key], "copy", F.col("copies").alias("of"), *[F.col(c).alias(f"{side}_{c}") for c in ("ids", "data", "roots")])
    counts = asked.select(*[F.col(c).alias(f"{side}_{c}" if c in ("pid", "blk") else c) for c in key], "copies")
    dealt = pairs.join(counts, ["label", "dim", f"{side}_pid", f"{side}_blk"]).withColumn("copy", F.pmod(F.xxhash64("a_pid", "a_blk", "b_pid", "b_blk"), F.col("copies")))
    on = [F.col("label") == F.col(f"{side}_label"), F.col("dim") == F.col(f"{side}_dim"), dealt[f"{side}_pid"] == held[f"{side}_pid"], dealt[f"{side}_blk"] == held[f"{side}_blk"], dealt["copy"] == held["copy"]]
    keep = [dealt[c] for c in dealt.columns if c not in ("copy", "copies")]
    return dealt.join(held, on).select(*keep, f"{side}_ids", f"{side}_data", f"{side}_roots")


def _compared(pairs: DataFrame, blocks: DataFrame, cosine: float, kind: type, share: int) -> DataFrame:
    """What links pairs of blocks: ``id, n`` for rows, ``a, b`` for links of a spanning forest."""
    joined = _spread(_spread(pairs.select("label", "dim", "a_pid", "a_blk", "b_pid", "b_blk"), blocks, "a", share), blocks, "b", share)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, left, right = [], [], [], []
            for r in batch.to_pylist():
                ua, ub = (units(np.frombuffer(r[f"{s}_data"], kind).reshape(-1, r["dim"])) for s in "ab")
                linked = ua @ ub.T >= cosine
                if not linked.any():
                    continue
                for side, axis in (("a", 1), ("b", 0)):
                    n = linked.sum(axis=axis)
                    ids.append(np.array(r[f"{side}_ids"], np.int64)[n > 0])
                    counts.append(n[n > 0])
                i, j = np.nonzero(linked)
                met = np.unique(np.stack([np.array(r["a_roots"], np.int64)[i], np.array(r["b_roots"], np.int64)[j]]), axis=1)
                a, b = _forest(met[0], met[1])
                left.append(a)
                right.append(b)
            for names, columns in ((("id", "n"), (ids, counts)), (("a", "b"), (left, right))):
                if columns[0]:
                    have = {name: pa.array(np.concatenate(c).astype(np.int64)) for name, c in zip(names, columns, strict=True)}
                    rows = len(have[names[0]])
                    yield pa.RecordBatch.from_arrays([have.get(c, pa.nulls(rows, pa.int64())) for c in ("id", "n", "a", "b")], ["id", "n", "a", "b"])
        give_back()

    return joined.select("dim", "a_ids", "a_data", "a_roots", "b_ids", "b_data", "b_roots").mapInArrow(compare, "id long, n long, a long, b long")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    block: int = 256,
    fan: int = 16,
    leading: int = 8,
    share: int = 64,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two rows link when their labels are equal and not null and their cosine, in double
    precision, is at least ``cosine`` (above 0).  Vectors that are null, zero or hold null or
    non-finite components link with nothing, nor do rows with a null id or vectors of
    different lengths; any finite length of a vector will do.  Rows of one id are
    one node of the links' components and share their sum of links, yet each is a row of the
    result.  A row without links is its own component; a null id has a null component and is kept.  An empty
    table gives an empty result; other columns are not looked at.
    """
    small_batches(vectors.sparkSession)
    epsilon = float(np.sqrt(2.0 - 2.0 * cosine))
    element = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(element).alias("vec"))
    joined = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & directed(F.col("vec")))
    common = joined.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    out = rows.select("id")
    if common is None:
        return out.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    axes = _axes(joined, common["dim"])
    celled = _celled(joined, axes, epsilon, leading)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("label"), F.col("dim"), *[F.get("cells", F.lit(i)) for i in range(leading)], F.xxhash64("vec"), F.col("id")]
    ordered = celled.repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id().cast("long")).sortWithinPartitions("pid", *order)
    blocks = stage_table(_blocks(ordered, axes, cosine, block), "blocks")

    # the tree, from blocks upward: first within partitions, then across them
    levels = [blocks.select("label", "dim", "pid", "blk", "n", F.array_min("ids").alias("hub"), "box")]
    steps = []
    most = blocks.agg(F.max("blk"), F.max("pid")).first()
    for across, last in ((False, most[0]), (True, most[1])):
        while last > 0:
            levels.append(stage_table(_parents(levels[-1], fan, across), f"level{len(levels)}"))
            steps.append(across)
            last //= fan
    key = ["label", "dim", "pid", "blk"]
    root = levels[-1]
    whole = lambda df, level: df.where("entire").select("label", "dim", F.lit(level).alias("level"), *[f"{s}_{c}" for s in "ab" for c in ("pid", "blk", "n", "hub")])
    own = root.select("label", "dim", *[F.col(c).alias(f"p{s}_{c}") for s in "ab" for c in ("pid", "blk")])
    # the roots meet themselves as parts of nothing but themselves
    pairs = stage_table(_pairs_of_parts(own, root, (F.col("pid"), F.col("blk")), epsilon), "pairs")
    linked = [whole(pairs, len(levels) - 1)]
    for level in range(len(levels) - 2, -1, -1):
        up = (F.floor(F.col("pid") / fan), F.col("blk")) if steps[level] else (F.col("pid"), F.floor(F.col("blk") / fan))
        above = pairs.where(~F.col("entire")).select("label", "dim", *[F.col(f"{s}_{c}").alias(f"p{s}_{c}") for s in "ab" for c in ("pid", "blk")])
        pairs = stage_table(_pairs_of_parts(above, levels[level], up, epsilon), f"pairs{level}")
        linked.append(whole(pairs, level))
    same = (F.col("a_pid") == F.col("b_pid")) & (F.col("a_blk") == F.col("b_blk"))
    kind = np.float32 if element == "array<float>" else np.float64
    compared = stage_table(_compared(pairs.where(~F.col("entire") & ~same), blocks, cosine, kind, share), "compared")

    # pairs of nodes that link as a whole: each side gains the other's rows, and one link to it
    wholly = linked[0]
    for more in linked[1:]:
        wholly = wholly.unionByName(more)
    wholly = stage_table(wholly.where(~(same & (F.col("level") == 0))), "wholly")
    sides = [wholly.select("label", "dim", "level", F.col(f"{a}_pid").alias("pid"), F.col(f"{a}_blk").alias("blk"), F.when(same, F.lit(0)).otherwise(F.col(f"{b}_n")).alias("more"), F.when(same, F.col("a_n")).alias("self"), F.col(f"{b}_hub").alias("hub")).where(~same if a == "b" else F.lit(True)) for a, b in ("ab", "ba")]
    gains = sides[0].unionByName(sides[1]).groupBy("label", "dim", "level", "pid", "blk").agg(F.sum("more").alias("more"), F.max("self").alias("self"), F.min("hub").alias("hub"))
    ancestors = []
    pid, blk = F.col("own_pid"), F.col("own_blk")
    for level in range(len(levels)):
        ancestors.append(F.struct(F.lit(level).alias("level"), pid.cast("long").alias("pid"), blk.cast("long").alias("blk")))
        if level < len(steps):
            pid, blk = (F.floor(pid / fan), blk) if steps[level] else (pid, F.floor(blk / fan))
    named = blocks.select("label", "dim", F.col("pid").alias("own_pid"), F.col("blk").alias("own_blk"), "n")
    placed = named.withColumn("x", F.explode(F.array(*ancestors))).select("label", "dim", "own_pid", "own_blk", "n", "x.*")
    gained = placed.join(gains, ["label", "dim", "level", "pid", "blk"]).groupBy("label", "dim", F.col("own_pid").alias("pid"), F.col("own_blk").alias("blk")).agg(F.sum(F.col("more") + F.coalesce(F.col("self") - F.col("n"), F.lit(0))).alias("more"), F.collect_set("hub").alias("hubs"))
    held = stage_table(blocks.join(gained, key, "left").select("ids", "inner", "roots", F.coalesce("more", F.lit(0)).alias("more"), "hubs"), "held")

    counted = held.select(F.explode(F.arrays_zip("ids", "inner")).alias("r"), "more").select(F.col("r.ids").alias("id"), (F.col("r.inner") + F.col("more")).alias("n"))
    counts = counted.unionByName(compared.where("id is not null").select("id", "n")).groupBy("id").agg(F.sum("n").alias("n_links"))
    local = held.select(F.explode(F.arrays_zip("ids", "roots")).alias("r")).select(F.col("r.ids").alias("id"), F.col("r.roots").alias("root"))
    # an id in several places joins the components of all of them
    first = local.groupBy("id").agg(F.min("root").alias("first"), F.max("root").alias("last"))
    repeated = local.join(first.where("first < last").select("id", "first"), "id").where("root > first").select(F.col("root").alias("a"), F.col("first").alias("b"))
    hubs = held.select(F.explode(F.array_distinct("roots")).alias("a"), "hubs").select("a", F.explode("hubs").alias("b"))
    edges = compared.where("a is not null").select("a", "b").unionByName(hubs).unionByName(wholly.select(F.col("a_hub").alias("a"), F.col("b_hub").alias("b"))).unionByName(repeated)
    component = connected_components(edges)
    rooted = first.join(component, F.col("first") == F.col("node"), "left").select("id", F.coalesce("label", "first").alias("label"))
    found = out.join(counts, "id", "left").join(rooted, "id", "left")
    own_id = F.coalesce("label", "id")
    return found.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), own_id.alias("component_id"), own_id.eqNullSafe(F.col("id")).alias("kept"))
