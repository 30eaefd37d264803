"""Vector code compression: product quantisation with integer codebooks.

Components become integers, vectors are cut into parts, and each part position has a
codebook of whole numbers.  A round broadcasts the codebooks; tasks go through their
Arrow batches, find every part's nearest entry from ``|c|^2 - 2 x.c`` by exact integer
matrix products, and add up the parts of each entry.  Tasks hand out one row an entry;
a grouped shuffle merges those, so what reaches the driver is the codebooks' size.
All arithmetic is on integers, so results do not depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relafix.llm.vectors import finite
from relafix.storage import bounded_broadcast, stage_table

_LARGEST = 1 << 61
_LONG = (1 << 63) - 1
_LOW = (1 << 31) - 1


def _integers(vectors: pa.Array, scale: int, width: int) -> np.ndarray:
    """``floor(scale * x)`` of equally long vectors, filled with zeros up to ``width`` components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    big = np.abs(scaled) >= _LARGEST
    out = np.where(big, 0.0, scaled).astype(np.int64)
    out[big] = np.where(scaled[big] > 0, _LARGEST, -_LARGEST)
    out = out.reshape(len(vectors), -1)
    return np.pad(out, ((0, 0), (0, width - out.shape[1])))


def _assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, ties to the lower index, and its squared distance; exact for any size of the integers."""
    parts, _, width = books.shape
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    if 4 * max(1, width) * most * most >= 1 << 62:
        x, books = x.astype(object), books.astype(object)
    codes, errors = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), x.dtype)
    for p in range(parts):
        part = x[:, p * width : (p + 1) * width]
        rest = (books[p] * books[p]).sum(axis=1)[None, :] - 2 * (part @ books[p].T)
        codes[:, p] = np.argmin(rest, axis=1)
        errors[:, p] = (part * part).sum(axis=1) + rest[np.arange(len(x)), codes[:, p]]
    return codes, errors


def _round(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: the codebooks after every entry moved to the mean of its parts."""
    parts, entries, width = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        n = np.zeros((parts, entries), np.int64)
        high, low = np.zeros_like(now), np.zeros_like(now)
        for b in batches:
            if not b.num_rows:
                continue
            x = _integers(b.column(0), scale, parts * width)
            codes, _ = _assign(x, now)
            for p in range(parts):
                hit = (codes[:, p, None] == np.arange(entries)).astype(np.int64)
                part = x[:, p * width : (p + 1) * width]
                n[p] += hit.sum(axis=0)
                # two halves, so that sums of the largest integers stay exact
                high[p] += hit.T @ (part >> 31)
                low[p] += hit.T @ (part & _LOW)
        used = np.argwhere(n > 0)
        if len(used):
            at = tuple(used.T)
            yield pa.RecordBatch.from_arrays([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(n[at]), pa.array(list(high[at]), pa.list_(pa.int64())), pa.array(list(low[at]), pa.list_(pa.int64()))], ["part", "entry", "n", "high", "low"])

    sums = kept.select("embedding").mapInArrow(add_up, "part int, entry int, n long, high array<long>, low array<long>")
    each = sums.select("part", "entry", "n", F.posexplode(F.arrays_zip("high", "low")).alias("place", "s"))
    wide = "decimal(20,0)"
    merged = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s.high").cast(wide)).alias("high"), F.sum(F.col("s.low").cast(wide)).alias("low"))
    after = books.copy()
    for r in merged.collect():  # parts x entries x width rows at most
        after[r["part"], r["entry"], r["place"]] = ((int(r["high"]) << 31) + int(r["low"])) // r["n"]
    sent.unpersist()
    return after


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every kept row.

    Rows go if the vector is null or holds null or non-finite components, or is not of
    the most common length (of equally common ones the longest).  Vectors are filled
    with zeros up to a multiple of ``parts``.  A part's codebook starts as that part of
    the first ``entries`` rows by id, null ids last, equal ids by vector; a smaller table
    has smaller codebooks.  Repeated rows count each time.  Integers beyond 2^61 become
    2^61; errors beyond 2^63 - 1 become that.  ``label_error`` sums over equal labels, null
    labels together.  An empty table gives an empty result; other columns are not looked at.

    ``vectors`` is read once a round, so hand in a written table.
    """
    vector = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), vector.alias("embedding"), F.col(label_col).alias("label")).where(finite(vector))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    rows = rows.where(F.size("embedding") == dim)
    width = -(-dim // parts)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    first = _integers(pa.array([r["embedding"] for r in seeds], pa.list_(pa.float64())), scale, parts * width) if seeds else np.zeros((0, parts * width), np.int64)
    books = np.ascontiguousarray(first.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if seeds else 0):
        books = _round(rows, books, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, errors = _assign(_integers(b.column("embedding"), scale, parts * width), sent.value)
            told = [c.tobytes().hex() for c in codes.astype(np.uint8)]
            total = pa.array([min(int(e), _LONG) for e in errors.sum(axis=1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(told, pa.string()), total], ["vec_id", "label", "code", "error"])

    coded = stage_table(rows.select("vec_id", "label", "embedding").mapInArrow(encode, schema), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(_LONG)).cast("long").alias("label_error"))
    by_label = bounded_broadcast(stage_table(by_label, "label_errors"), 1 << 20, 64 << 20)
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
