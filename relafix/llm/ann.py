"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors are one node.  A first graph joins nodes that fall on the same side
of random hyperplanes; rounds of NN-descent then join each node with the neighbours
of its neighbours and keep the nearest, by Spark joins in which a row carries one
node with an 8-bit copy of its vector.  A query starts from the graph around its own
node and walks greedily: each round it opens its best unopened nodes, until every node
of its beam is opened.  All of the beam that can be among the nearest, given the error
of the 8-bit copies, is scored again in double precision.

For the graph, vectors get one more component that makes all of them equally long,
so that the nearest by angle have the largest inner products with a query.  The 8-bit
copies keep a scale for each row, and the graph takes vectors of over 1024 times the median
length as that long, so that very long vectors cost the others nothing, whatever their
length; the longest ones, far from all others in the graph, are on every query's first beam,
and in a small table all vectors are, so that its answers are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relafix.llm.shingles import give_back, small_batches
from relafix.llm.vectors import directed
from relafix.storage import stage_table

_LEAF = 256


#: How many times the median length a vector counts as in the graph, at most.
_REACH = 1024.0


def _length(vector: Column) -> Column:
    """Natural logarithm of a vector's length; finite for every finite vector but zero."""
    most = F.array_max(F.transform(vector, F.abs))
    return F.log(most) + F.log(F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x / most) * (x / most))) / 2


def _packed(x: np.ndarray, graph: float, unit: float) -> list[bytes]:
    """Each row's 8-bit direction, its scale in a search, its scale in the graph, and what its added component lacks to 1.

    ``graph`` is the logarithm of the length that counts as 1 in the graph, where longer ones
    count as 1 too; ``unit`` is the largest component of all, in which a search measures.
    """
    most = np.abs(x).max(axis=1)
    x = x / most[:, None]
    length = np.sqrt((x * x).sum(axis=1))
    part = np.exp(np.minimum(0.0, np.log(most) + np.log(length) - graph))
    square = part * part
    floats = np.stack([part / length / 127.0, square / (1.0 + np.sqrt(np.maximum(0.0, 1.0 - square)))], axis=1).astype(np.float32)
    q, scale = np.rint(x * 127.0).astype(np.int8), most / unit / 127.0
    return [r.tobytes() + s.tobytes() + f.tobytes() for r, s, f in zip(q, scale, floats, strict=True)]


def _unpacked(rows, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit directions, scales in a search, and (scale, lack) in the graph."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), dim + 16)
    scale = np.ascontiguousarray(raw[:, dim : dim + 8]).view(np.float64)[:, 0]
    return raw[:, :dim].view(np.int8).astype(np.float32), scale, np.ascontiguousarray(raw[:, dim + 8 :]).view(np.float32)


def _near(rows, dim: int) -> np.ndarray:
    """Inner products of the lengthened vectors less 1, which are half the squared distances below 0."""
    q, _, floats = _unpacked(rows, dim)
    x, lacks = q * floats[:, :1], floats[:, 1]
    half = (x * x).sum(axis=1) / 2
    return x @ x.T - half[:, None] - half[None, :] - (lacks[:, None] - lacks[None, :]) ** 2 / 2


def _nodes(vectors: DataFrame, graph: float, unit: float) -> DataFrame:
    """``node, vec, q8``: the vector and its 8-bit copy."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b["embedding"].tolist(), np.float64)
                yield pd.DataFrame({"node": b["node"], "members": b["members"], "length": b["length"], "vec": b["embedding"], "q8": _packed(x, graph, unit)})
        give_back()

    return vectors.mapInPandas(pack, "node long, members array<long>, length double, vec array<double>, q8 binary")


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best distinct ids, best first; of equal ids the first counts."""
    order = np.lexsort((ids, -sims))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)][:k]


def _leaves(nodes: DataFrame, n: int, k: int, trees: int, dim: int) -> DataFrame:
    """``node, ids, sims``: nearest ones among nodes on the same sides of random hyperplanes."""
    bits = max(0, int(np.ceil(np.log2(max(1, n) / _LEAF))))
    planes = np.random.default_rng(7).standard_normal((trees, max(1, bits), dim)).astype(np.float32)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, _, _ = _unpacked(b["q8"], dim)
            for t in range(trees):
                leaf = ((x @ planes[t, :bits].T > 0) @ (1 << np.arange(bits))) if bits else np.zeros(len(b), np.int64)
                yield pd.DataFrame({"tree": t, "leaf": leaf.astype(np.int64), "node": b["node"], "q8": b["q8"]})
        give_back()

    placed = nodes.select("node", "q8").mapInPandas(assign, "tree int, leaf long, node long, q8 binary")
    # a leaf that came out large is dealt to several parts
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (4 * _LEAF)).alias("parts"))
    placed = placed.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))

    def join(leaf: pd.DataFrame) -> pd.DataFrame:
        ids = leaf["node"].to_numpy()
        sims = _near(leaf["q8"], dim)
        np.fill_diagonal(sims, -np.inf)
        take = min(k, len(ids) - 1)
        best = np.argpartition(-sims, take - 1, axis=1)[:, :take] if take > 0 else np.zeros((len(ids), 0), np.intp)
        return pd.DataFrame({"node": ids, "ids": list(ids[best]), "sims": list(np.take_along_axis(sims, best, axis=1))})

    return placed.groupBy("tree", "leaf", "part").applyInPandas(join, "node long, ids array<long>, sims array<float>")


def _merged(graph: DataFrame | None, updates: DataFrame, k: int) -> DataFrame:
    """Each node's ``k`` nearest of the graph and the updates; ``fresh`` marks those the graph had not."""
    gathered = updates.groupBy("node").agg(F.flatten(F.collect_list("ids")).alias("new_ids"), F.flatten(F.collect_list("sims")).alias("new_sims"))
    if graph is None:
        rows = gathered.select("node", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("sims"), "new_ids", "new_sims")
    else:
        rows = graph.join(gathered, "node", "left").select("node", "ids", "sims", F.coalesce("new_ids", F.array().cast("array<long>")).alias("new_ids"), F.coalesce("new_sims", F.array().cast("array<float>")).alias("new_sims"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for node, ids, sims, new_ids, new_sims in b.itertuples(index=False):
                every, value = np.append(ids, new_ids).astype(np.int64), np.append(sims, new_sims).astype(np.float32)
                best = _top(every, value, k)
                out.append((node, every[best], value[best], ~np.isin(every[best], ids)))
            yield pd.DataFrame(out, columns=["node", "ids", "sims", "fresh"])
        give_back()

    return rows.mapInPandas(merge, "node long, ids array<long>, sims array<float>, fresh array<boolean>")


def _descend(graph: DataFrame, nodes: DataFrame, k: int, sample: int, dim: int, emit: int) -> DataFrame:
    """One round: the neighbours of a node, in both directions, meet each other at that node."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("node", F.col("e.ids").alias("to"), F.col("e.fresh").alias("fresh"))
    both = edges.select(F.col("node").alias("at"), F.col("to").alias("who"), "fresh", F.lit(0).alias("way")).unionByName(edges.select(F.col("to").alias("at"), F.col("node").alias("who"), "fresh", F.lit(1).alias("way")))
    # the sample of the algorithm: a few fresh and a few old ones in each direction
    drawn = Window.partitionBy("at", "fresh", "way").orderBy(F.xxhash64("at", "who"))
    both = both.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= sample).groupBy("at", "who").agg(F.max("fresh").alias("fresh"))
    worst = graph.select("node", F.when(F.size("ids") < k, F.lit(-float("inf"))).otherwise(F.array_min("sims")).cast("float").alias("worst"))
    known = nodes.select("node", "q8").join(worst, "node")
    met = both.join(known, both["who"] == known["node"]).groupBy("at").agg(F.collect_list(F.struct("who", "fresh", "q8", "worst")).alias("m"))
    met = met.select("at", F.col("m.who").alias("who"), F.col("m.fresh").alias("fresh"), F.col("m.q8").alias("q8"), F.col("m.worst").alias("worst"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nodes_out, ids_out, sims_out = [], [], []
            for _, who, fresh, q8, worst in b.itertuples(index=False):
                if len(who) < 2:
                    continue
                ids, fresh = np.asarray(who, np.int64), np.asarray(fresh, bool)
                sims = _near(q8, dim)
                sims[~(fresh[:, None] | fresh[None, :])] = -np.inf
                np.fill_diagonal(sims, -np.inf)
                sims[sims <= np.asarray(worst, np.float32)[:, None]] = -np.inf
                take = min(emit, len(ids) - 1)
                best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
                value = np.take_along_axis(sims, best, axis=1)
                for i in np.flatnonzero(np.isfinite(value).any(axis=1)):
                    good = np.isfinite(value[i])
                    nodes_out.append(ids[i])
                    ids_out.append(ids[best[i][good]])
                    sims_out.append(value[i][good])
            if nodes_out:
                yield pd.DataFrame({"node": nodes_out, "ids": ids_out, "sims": sims_out})
        give_back()

    return _merged(graph, met.mapInPandas(meet, "node long, ids array<long>, sims array<float>"), k)


def _search_graph(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``node, ids, near``: neighbours in both directions with their 8-bit vectors, end to end."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "sims")).alias("e")).select("node", F.col("e.ids").alias("to"), F.col("e.sims").alias("sim"))
    back = edges.select(F.col("to").alias("node"), F.col("node").alias("to"), "sim")
    nearest = Window.partitionBy("node").orderBy(F.desc("sim"), "to")
    back = back.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k).drop("place")
    both = edges.unionByName(back).select("node", "to").distinct()
    known = nodes.select(F.col("node").alias("to"), "q8")
    packed = both.join(known, "to").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("to", "q8"))).alias("m"))
    return packed.select("node", F.col("m.to").alias("ids"), F.col("m.q8").alias("near"))


def _walk(state: DataFrame, graph: DataFrame, beam: int, opened: int, dim: int) -> DataFrame:
    """One step of all queries: open the best ``opened`` unopened nodes of each beam."""
    opening = state.select("query", F.explode("frontier").alias("node")).join(graph, "node").groupBy("query").agg(F.flatten(F.collect_list("ids")).alias("got"), F.flatten(F.collect_list("near")).alias("near"))
    rows = state.join(opening, "query", "left")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for query, q, ids, sims, errs, done, frontier, got, near in b[["query", "q", "ids", "sims", "errs", "done", "frontier", "got", "near"]].itertuples(index=False):
                ids, sims, errs, done = np.asarray(ids, np.int64), np.asarray(sims, np.float64), np.asarray(errs, np.float64), np.asarray(done, bool)
                done = done | np.isin(ids, np.asarray(frontier, np.int64))
                if got is not None and len(got):
                    found, first = np.unique(np.asarray(got, np.int64), return_index=True)
                    # a node that left the beam is below it for good, so what is not in it may be scored again
                    fresh = ~np.isin(found, ids)
                    found, first = found[fresh], first[fresh]
                    if len(found):
                        x, scale, _ = _unpacked([near[i] for i in first], dim)
                        value = (x @ np.frombuffer(q, np.float32)).astype(np.float64) * scale
                        ids, sims, done = np.append(ids, found), np.append(sims, value), np.append(done, np.zeros(len(found), bool))
                        errs = np.append(errs, scale * (dim**0.5 / 2))
                        order = np.lexsort((ids, -sims))[:beam]
                        ids, sims, errs, done = ids[order], sims[order], errs[order], done[order]
                out.append((query, q, ids, sims, errs, done, ids[~done][:opened]))
            yield pd.DataFrame(out, columns=["query", "q", "ids", "sims", "errs", "done", "frontier"])
        give_back()

    return rows.mapInPandas(step, state.schema)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    top: int = 20,
    k: int = 24,
    trees: int = 8,
    rounds: int = 4,
    sample: int = 16,
    emit: int = 8,
    beam: int = 384,
    opened: int = 96,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` its ``top`` nearest others found.

    Every valid row is in the index.  Scores are inner products of the original
    vectors in double precision; ties go to the smaller id.  A query's own id is
    no candidate; if there are fewer candidates than ``top``, all are returned.
    Rows take no part if the id is null or the vector is null, zero, or holds
    null or non-finite components, or is not of the most common length (of equally
    common ones the longest).  ``beam`` nodes are kept in a search, which ends when all of
    them are opened, ``opened`` at a time over the first rounds.  A table of no more than ``beam`` different
    vectors is searched in full.  Rows with equal vectors tie and are all candidates.
    Repeated ids are one candidate for each different vector.  An empty table gives
    an empty result; other columns are not looked at.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), is_query.alias("asks")).where(F.col("id").isNotNull() & directed(F.col("embedding")))
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 1
    rows = stage_table(rows.where(F.size("embedding") == dim), "vectors")
    lengths = rows.select(_length(F.col("embedding")).alias("length"), F.array_max(F.transform("embedding", F.abs)).alias("most"))
    longest, median, unit = lengths.agg(F.max("length"), F.percentile_approx("length", 0.5), F.max("most")).first()
    unit = unit or 1.0
    # a query shows at most `top` members of a class besides itself
    lowest = Window.partitionBy("embedding").orderBy("id")
    few = rows.select("id", "embedding").distinct().withColumn("place", F.row_number().over(lowest)).where(F.col("place") <= top + 1)
    classes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("id")).alias("members")).withColumn("node", F.monotonically_increasing_id()).withColumn("length", _length(F.col("embedding")))
    graph_unit = min(longest, median + float(np.log(_REACH))) if common else 0.0
    nodes = stage_table(_nodes(classes, graph_unit, unit), "nodes")
    n = nodes.count()
    graph = stage_table(_merged(None, _leaves(nodes, n, k, trees, dim), k), "graph0")
    for i in range(rounds):
        graph = stage_table(_descend(graph, nodes, k, sample, dim, emit), f"graph{i + 1}")
    search = stage_table(_search_graph(graph, nodes, k), "search")
    asking = stage_table(rows.where("asks").select("id", "embedding").join(nodes.select("node", "vec"), F.col("embedding") == F.col("vec")).select("id", "node"), "asking")
    first = max(top + 1, beam // 4) if n > beam else n
    far = [(r["node"], np.array(r["vec"])) for r in nodes.select("node", "vec", "length").orderBy(F.desc("length"), "node").limit(first).collect()]

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            out = []
            for node, vec in zip(b["node"], b["vec"], strict=True):
                vec = np.asarray(vec, np.float64)
                q = vec / np.abs(vec).max()
                q = q / np.linalg.norm(q)
                others = [(i, x) for i, x in far if i != node]
                ids = np.array([node, *[i for i, _ in others]], np.int64)
                sims = np.array([vec / unit @ q, *[x / unit @ q for _, x in others]])
                order = np.lexsort((ids, -sims))
                out.append((node, q.astype(np.float32).tobytes(), ids[order], sims[order], np.zeros(len(ids)), np.zeros(len(ids), bool), ids[:1]))
            yield pd.DataFrame(out, columns=["query", "q", "ids", "sims", "errs", "done", "frontier"])

    asked = nodes.join(asking.select("node").distinct(), "node", "left_semi").select("node", "vec")
    state = asked.mapInPandas(begin, "query long, q binary, ids array<long>, sims array<double>, errs array<double>, done array<boolean>, frontier array<long>")
    ended = []
    while True:
        # a beam that has settled is opened in full, which must come anyway and takes fewer rounds
        wide = 1 if not ended else opened if len(ended) < 5 else beam
        state = stage_table(_walk(state, search, beam, wide, dim), "walk")
        ended.append(state.where(F.size("frontier") == 0).select("query", "ids", "sims", "errs"))
        state = state.where(F.size("frontier") > 0)
        if state.isEmpty():
            break
    state = reduce(DataFrame.unionByName, ended)
    # what may be nearer than the last of the nearest, as 8 bits may swap close ones
    sure = F.sort_array(F.zip_with("sims", "errs", lambda s, e: s - e), asc=False)
    least = F.coalesce(F.get(sure, F.lit(top)), F.lit(-float("inf")))
    short = state.withColumn("least", least).select("query", "least", F.explode(F.arrays_zip("ids", "sims", "errs")).alias("c"))
    short = short.where(F.col("c.sims") + F.col("c.errs") >= F.col("least")).select("query", F.col("c.ids").alias("node"))
    pairs = short.join(nodes.select("node", "vec", "members"), "node").join(nodes.select(F.col("node").alias("query"), F.col("vec").alias("asked")), "query")
    score = F.aggregate(F.zip_with("asked", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    found = pairs.select("query", "members", score.alias("score"))
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), F.get("members", F.lit(0)))
    found = found.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= top + 1).drop("place")
    answers = asking.join(found, asking["node"] == found["query"]).select(F.col("id").alias("query_id"), F.explode("members").alias("vec_id"), "score").where("query_id <> vec_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
