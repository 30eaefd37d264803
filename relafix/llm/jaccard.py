"""N-gram Jaccard join as a blocked sparse matrix product.

Documents by n-grams form a sparse 0/1 matrix; the entries of its product with
its own transpose are overlap counts.  Only few can reach the threshold, so sizes
decide early what is multiplied at all:

1. Equal sets are one class; classes are what is compared from here on.
2. Column blocks (ranges of n-gram hashes).  In hash order, linked sets share at
   least ``need`` n-grams within a prefix whose length follows from their sizes.
   Each block finds the prefix n-grams that two classes have; classes with fewer
   than ``need`` of them cannot link and go.
3. Among the rest the n-grams are counted exactly.  A class must share its
   size-derived bound, and two that link share one of their rarest n-grams; such
   ties join classes into candidate groups.
4. Row blocks.  A candidate group is cut into blocks of bounded size, each pair of
   blocks is one product, overlap counts accumulate over chunks of columns, and
   pairs below the bound are discarded.  A pair of blocks leaves one row per
   class: how many documents it links, and a smaller class it is connected to.

No pair of documents is ever a row, and a group of any size is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relafix.llm.components import connected_components
from relafix.llm.shingles import give_back, set_digests, shingle_sets, small_batches
from relafix.storage import bounded_broadcast, stage_table

#: A prefix n-gram (the low half of its hash: a block holds so few that halves seldom meet, and a
#: false meeting only lets a class pass) and a class; of sums, a count and a class.
_ENTRY = np.dtype([("h", "<u4"), ("c", "<u8")])
_FEW = 8  # classes of an n-gram that a task sends one by one; more leave as one mark
_BATCH = 500_000  # entries that a task gathers before it sends them
_BLOCK_ENTRIES = 1_000_000
_BLOCK_ROWS = 512


def _least_overlap(n, num: int, den: int):
    """Smallest overlap that a set of ``n`` can link with, at a threshold of ``num / den``."""
    return -(-num * n // den)


def _reach(num: int, den: int) -> int:
    """How often the shortest prefix that says anything is lengthened: about 0.3 of a set in all."""
    return max(1, round(0.3 * den / (den - num)) - 1) if num < den else 1


def _prefix(n, num: int, den: int):
    """Length of the hash-order prefix that holds ``_need`` shared n-grams of any link."""
    return np.minimum(n, n - _least_overlap(n, num, den) + _reach(num, den) * (den - num) * n // den + 1)


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """Adds ``n_shingles, d1, d2`` to ``doc_id, tie``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second = [], [], []
            for _, grams, counts in shingle_sets(batch.column("text"), n):
                a, b = set_digests(grams, counts)
                sizes.append(counts)
                first.append(a)
                second.append(b)
            if sizes:
                arrays = [batch.column("doc_id"), batch.column("tie"), *[pa.array(np.concatenate(x)) for x in (sizes, first, second)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tie", "n_shingles", "d1", "d2"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, tie long, n_shingles long, d1 long, d2 long")


def _rows(keys, payloads) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(payloads, pa.binary())], names=["block", "payload"])


def _send(h: np.ndarray, c: np.ndarray, n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Entries of one task by column block; n-grams of many classes leave as a mark and credits."""
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    h, c = h[fresh], c[fresh]
    heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    sizes = np.diff(np.append(heads, len(h)))
    many = np.repeat(sizes > _FEW, sizes)
    credited, n = np.unique(c[many], return_counts=True)
    keep = ~many
    keep[heads[sizes > _FEW]] = True
    h, c = h[keep], np.where(many[keep], np.uint64(0), c[keep])
    entries = np.zeros(len(h), _ENTRY)
    entries["c"] = c
    entries["h"] = h & np.uint64(0xFFFFFFFF)
    block = ((h >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    cuts = np.searchsorted(block, np.arange(n_blocks + 1, dtype=np.uint64))
    full = [b for b in range(n_blocks) if cuts[b + 1] > cuts[b]]
    yield _rows(full, [entries[cuts[b] : cuts[b + 1]].tobytes() for b in full])
    if len(credited):
        credits = np.zeros(len(credited), _ENTRY)
        credits["h"], credits["c"] = n, credited
        yield _rows([-1 - int(h.sum() % np.uint64(n_blocks))], [credits.tobytes()])


def _possible(docs: DataFrame, n: int, num: int, den: int, n_blocks: int) -> DataFrame:
    """``cid, credit``: how many prefix n-grams of a class (by ``d1``) another class has too, or more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, classes, held = [], [], 0
        for batch in batches:
            for _, grams, counts in shingle_sets(batch.column("text"), n):
                first = np.cumsum(counts) - counts
                d1, _ = set_digests(grams, counts)
                lengths = _prefix(counts, num, den)
                place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                hashes.append(grams[np.repeat(first, lengths) + place])
                classes.append(np.repeat(d1.view(np.uint64), lengths))
                held += len(place)
                if held > _BATCH:
                    yield from _send(np.concatenate(hashes), np.concatenate(classes), n_blocks)
                    hashes, classes, held = [], [], 0
        if held:
            yield from _send(np.concatenate(hashes), np.concatenate(classes), n_blocks)
        hashes, classes = [], []
        give_back()

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(table.column("payload").to_pylist()), _ENTRY)
        if key[0].as_py() < 0:
            cid, credit = entries["c"], entries["h"].astype(np.int64)
        else:
            order = np.lexsort((entries["c"], entries["h"]))
            h, c = entries["h"][order], entries["c"][order]
            fresh = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
            h, c = h[fresh], c[fresh]
            sizes = np.diff(np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h)))
            cid, credit = np.unique(c[(np.repeat(sizes, sizes) > 1) & (c != 0)], return_counts=True)
        # packed by shard of the class, so that a class is not a row for each block it is in
        shard = cid % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        sums = np.zeros(len(cid), _ENTRY)
        sums["c"], sums["h"] = cid[order], credit[order]
        cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        full = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
        return pa.table({"shard": pa.array(full, pa.int32()), "payload": pa.array([sums[cuts[s] : cuts[s + 1]].tobytes() for s in full], pa.binary())})

    def total(key: tuple, table: pa.Table) -> pa.Table:
        sums = np.frombuffer(b"".join(table.column("payload").to_pylist()), _ENTRY)
        cid, at = np.unique(sums["c"], return_inverse=True)
        credit = np.bincount(at, weights=sums["h"].astype(np.float64)).astype(np.int64)
        return pa.table({"cid": pa.array(cid.view(np.int64)), "credit": pa.array(credit)})

    shards = n_blocks  # both grow with the entries, so that neither a block nor a shard outgrows a task
    entries = docs.mapInArrow(emit, "block int, payload binary")
    return entries.groupBy("block").applyInArrow(reduce, "shard int, payload binary").groupBy("shard").applyInArrow(total, "cid long, credit long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """``d1, d2, n, grams`` of each document that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, grams, counts in shingle_sets(batch.column("text"), n):
                d1, d2 = set_digests(grams, counts)
                ends = np.append(0, np.cumsum(counts)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(counts), lists], names=["d1", "d2", "n", "grams"])
        give_back()

    return docs.mapInArrow(run, "d1 long, d2 long, n long, grams array<long>").where("n > 0")


def _candidate_groups(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``node, label`` of classes (by their small number ``k``) that may link with another, grouped."""
    grams = sets.select("k", "n", F.explode("grams").alias("h"))
    counted = grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = grams.join(counted, "h")
    # classes hold no more rows than their text has words
    ranked = shared.selectExpr("k", "n", "h", "row_number() OVER (PARTITION BY k ORDER BY df, h) AS place", "count(*) OVER (PARTITION BY k) AS m")
    least = F.expr(f"({num} * n + {den - 1}) div {den}")
    prefix = stage_table(ranked.where((F.col("m") >= least) & (F.col("place") <= F.col("m") - least + 1)).select("k", "h"), "rare")
    hubs = prefix.groupBy("h").agg(F.min("k").alias("hub"))
    edges = prefix.join(hubs, "h").where("k <> hub").select(F.col("k").alias("a"), F.col("hub").alias("b")).distinct()
    return connected_components(edges)


def _products(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """``cid, links, root`` per class and pair of row blocks, from rows ``part, left, right, grp, side, cid, weight, grams``."""

    def group(ids, weights, sides, grams, same: bool) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(g) for g in grams], np.int64)
        flat = np.concatenate(grams)
        _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
        number = np.cumsum(counts > 1) - 1
        owner = np.repeat(np.arange(len(ids)), sizes)
        use = counts[column] > 1
        owner, column = owner[use], number[column[use]]
        left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1))
        row = np.zeros(len(ids), np.int64)
        row[right] = np.arange(len(right))
        row[left] = np.arange(len(left))
        overlap = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = 2048
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [at, at + width])
            part = np.zeros((len(ids), width), np.float32)
            part[owner[a:b], column[a:b] - at] = 1.0
            overlap += part[left] @ part[right].T
        both = overlap.astype(np.int64)
        linked = den * both >= num * (sizes[left][:, None] + sizes[right][None, :] - both)
        if same:
            np.fill_diagonal(linked, False)
        links, label = np.zeros(len(ids), np.int64), ids.copy()
        links[left] += linked @ weights[right]
        if not same:
            links[right] += linked.T @ weights[left]
        while True:
            old = label.copy()
            top = np.iinfo(np.int64).max
            label[left] = np.minimum(label[left], np.where(linked, label[right][None, :], top).min(axis=1, initial=top))
            label[right] = np.minimum(label[right], np.where(linked, label[left][:, None], top).min(axis=0, initial=top))
            if (label == old).all():
                return links, label

    def run(key: tuple, table: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()
        table = table.sort_by("grp")
        groups = table.column("grp").to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cuts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(groups)), strict=True):
            part = table.slice(a, b - a)
            lists = part.column("grams").combine_chunks()
            grams = [lists[i].values.to_numpy() for i in range(len(lists))]
            ids = part.column("cid").to_numpy()
            links, label = group(ids, part.column("weight").to_numpy(), part.column("side").to_numpy(), grams, same)
            some = links > 0
            out.append((ids[some], links[some], label[some]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        give_back()
        return pa.table({"cid": columns[0], "links": columns[1], "root": columns[2]})

    return blocks.groupBy("part", "left", "right").applyInArrow(run, "cid long, links long, root long")


def _block_rows(candidates: DataFrame, n_parts: int) -> DataFrame:
    """Rows of candidate groups dealt to pairs of row blocks; small groups share a part."""
    sizes = candidates.groupBy("grp").agg(F.count("*").alias("k"), F.sum("n").alias("entries"))
    blocks = F.greatest(F.ceil(F.col("k") / _BLOCK_ROWS), F.ceil(F.col("entries") / _BLOCK_ENTRIES)).cast("int")
    sized = candidates.join(sizes.select("grp", blocks.alias("blocks")), "grp")
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = sized.select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    part = F.when(F.col("blocks") > 1, F.col("grp")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(n_parts)))
    # a lone block is numbered -1, apart from the first block of a group that has several
    left, right = F.least("mine", "other"), F.greatest("mine", "other")
    lone = F.col("blocks") == 1
    return dealt.select(
        part.alias("part"),
        F.when(lone, -1).otherwise(left).alias("left"),
        F.when(lone, -1).otherwise(right).alias("right"),
        "grp",
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
        "cid",
        "weight",
        "grams",
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, broadcast_rows: int = 2_000_000) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``, and ``tie`` (a hash of the text), a row per row of ``docs``.

    Two documents link when ``den * overlap >= num * union`` of their sets of
    ``n``-word shingles.  ``n_links`` counts the other documents that one links
    with, equal ones included; ``component_id`` is the smallest id reachable by
    links.  Texts without words, null and empty ones, have no shingles and link
    with nothing, each its own component; whole texts of any length count.  Repeated rows are documents of their
    own that link.  Ids must be integers; a null id takes part, but a component
    is named by a null only if it has no other.  An empty table gives an empty
    result; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    signed = stage_table(_signatures(texts, n), "signatures")
    classes = stage_table(
        signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("weight"), F.max("n_shingles").alias("n")), "classes"
    )
    total = classes.agg(F.sum("n")).first()[0] or 0
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(spread, int(total * (1 + _reach(num, den)) * (den - num) / den) // _BLOCK_ENTRIES)
    credits = _possible(texts, n, num, den, n_blocks)
    need = F.expr(f"({_reach(num, den)} * {den - num} * {num} * n) div {den * den} + 1")
    # credits go by half of a class's digest: two classes that share it only let each other pass
    kept = classes.join(credits, F.col("d1") == F.col("cid")).where(F.col("credit") >= need).select("d1", "d2", "low_id", "weight")
    kept = stage_table(kept.withColumn("k", F.monotonically_increasing_id()), "possible")
    ids = bounded_broadcast(kept.select(F.col("low_id").alias("doc_id")).distinct(), broadcast_rows).alias("i")
    chosen = texts.alias("t").join(ids, F.col("t.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")
    sets = _sets(chosen, n).join(kept.select("d1", "d2", "k", "weight"), ["d1", "d2"])
    sets = stage_table(sets.groupBy("k").agg(F.first("n").alias("n"), F.max("weight").alias("weight"), F.first("grams").alias("grams")), "sets")
    groups = _candidate_groups(sets, num, den)
    candidates = sets.withColumnRenamed("k", "cid").join(groups.select(F.col("node").alias("cid"), F.col("label").alias("grp")), "cid")
    linked = stage_table(_products(_block_rows(candidates, spread), num, den), "links")
    counts = linked.groupBy(F.col("cid").alias("k")).agg(F.sum("links").alias("links"))
    final = connected_components(linked.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    tied = kept.select("d1", "d2", "k").join(final.select(F.col("node").alias("k"), "label"), "k").join(counts, "k").drop("k")
    named = classes.join(tied, ["d1", "d2"], "left")
    named = named.select("d1", "d2", "low_id", "weight", "label", F.col("label").isNull().alias("alone"), F.coalesce("links", F.lit(0)).alias("links"))
    named = stage_table(named, "named")
    lowest = named.where("not alone").groupBy("label").agg(F.min("low_id").alias("component_id"))
    named = named.join(lowest, "label", "left").select("d1", "d2", F.when(F.col("alone"), F.col("low_id")).otherwise(F.col("component_id")).alias("component_id"), (F.col("weight") - 1 + F.col("links")).alias("n_links"))
    worded = signed.where("n_shingles > 0").join(named, ["d1", "d2"]).select("doc_id", "tie", "n_shingles", "component_id", "n_links", "d1")
    bare = signed.where("n_shingles = 0").select("doc_id", "tie", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "d1")
    return worded.unionByName(bare)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 2_000_000, **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Texts without words stay, all of them.  Of rows with equal id and text one
    stays.  Null ids come last; components that have no other id keep one text each.
    """
    found = stage_table(jaccard_join(docs, id_col, text_col, broadcast_rows=broadcast_rows, **options), "membership")
    worded = found.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    # equal ids name the component; a component of null ids only falls apart into its classes
    label = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("d1")).alias("of")]
    firsts = worded.groupBy(*label).agg(first).select(F.col("first.doc_id").alias("doc_id"), F.col("first.tie").alias("tie")).distinct().alias("f")
    same = F.col("w.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("w.tie") == F.col("f.tie"))
    rest = worded.select("doc_id", "tie").distinct().alias("w").join(firsts, same, "left_anti")
    rest = bounded_broadcast(stage_table(rest, "rest"), broadcast_rows).alias("r")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie")).alias("d")
    rows = rows.join(rest, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.tie") == F.col("r.tie")), "left_anti")
    twice = worded.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "tie")
    twice = bounded_broadcast(stage_table(twice, "twice"), broadcast_rows).alias("x")
    again = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.tie") == F.col("x.tie"))
    once = rows.alias("d").join(twice, again, "left_anti").select("row")
    repeated = rows.alias("d").join(twice, again, "left_semi").dropDuplicates(["doc_id", "tie"]).select("row")
    return once.unionByName(repeated).select("row.*")
