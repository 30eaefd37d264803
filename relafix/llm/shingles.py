"""Word shingles of whole texts as sorted 64-bit hashes, a batch of documents at a time.

A word is a run of bytes other than space and the five control blanks, A-Z
lower-cased; a shingle is ``n`` words in a row, or all words of a shorter text.
Two different shingles share a hash with a chance of 2^-64; sets are compared by
these hashes.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python workers in batches of 4 MB, unless the session sets ``spark.sql.execution.arrow.maxBytesPerBatch``.

    A batch of 10,000 rows, the other bound, has no limit of its own when texts are long.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, "4m")


def give_back() -> None:
    """Returns a worker's free memory to the machine at the end of a task, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(data: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and starting byte of each word of the texts laid end to end in ``data``."""
    blank = _BLANK[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[:1], before[1:] = True, blank[:-1]
    after[-1:], after[:-1] = True, blank[1:]
    inner = starts_of_texts[(starts_of_texts > 0) & (starts_of_texts < len(data))]
    before[inner] = True
    after[inner - 1] = True
    solid = ~blank
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = _BYTES[_LOWER[data[solid]]] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _ORDER[-1]), starts


def _runs(texts: pa.Array, at_once: int):
    """Runs of texts of about ``at_once`` bytes: the first's place, their bytes, and where each begins and ends."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + at_once, "right")) - 1)
        spans = offsets[at : end + 1]
        yield at, data[spans[0] : spans[-1]], spans - spans[0]
        at = end


def shingle_sets(texts: pa.Array, n: int, at_once: int = 1 << 19):
    """Yields (first text, flat sorted distinct hashes, counts) for runs of texts of about ``at_once`` bytes."""
    for at, data, spans in _runs(texts, at_once):
        yield at, *_sets(data, spans, n)


def word_counts(texts: pa.Array, at_once: int = 1 << 20):
    """Yields (first text, owner, hash, count) of the distinct words of each of a run of texts, by owner and hash."""
    for at, data, spans in _runs(texts, at_once):
        words, starts = _word_hashes(data, spans[:-1])
        owner = np.repeat(np.arange(len(spans) - 1), np.diff(np.searchsorted(starts, spans)))
        order = np.lexsort((words, owner))
        words, owner = words[order], owner[order]
        head = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (owner[1:] != owner[:-1]))) if len(words) else np.zeros(0, np.intp)
        yield at, owner[head], words[head], np.diff(np.append(head, len(words)))


def _sets(data: np.ndarray, spans: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    words, starts = _word_hashes(data, spans[:-1])
    edges = np.searchsorted(starts, spans)
    counts = np.diff(edges)
    text_of = np.repeat(np.arange(len(counts)), counts)
    whole = max(0, len(words) - n + 1)
    grams = np.zeros(whole, np.uint64)
    for j in range(n):
        grams += words[j : j + whole] * _ORDER[j]
    valid = text_of[:whole] == text_of[n - 1 : n - 1 + whole] if whole else np.zeros(0, bool)
    grams, owner = mix(grams[valid]), text_of[:whole][valid]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = [mix(np.array([(words[edges[i] : edges[i + 1]] * _ORDER[n : n + counts[i]]).sum(dtype=np.uint64) + _U(counts[i])], np.uint64))[0] for i in short]
        grams, owner = np.append(grams, np.array(extra, np.uint64)), np.append(owner, short)
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(counts) + 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            grams[a:b].sort()
    if len(grams):
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[fresh], owner[fresh]
    return grams, np.bincount(owner, minlength=len(counts)).astype(np.int64)


def set_digests(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set, as signed integers; empty sets have 0."""
    out = []
    first = np.cumsum(counts) - counts
    full = counts > 0
    for salt in _ORDER[40:42]:
        digest = np.zeros(len(counts), np.uint64)
        if full.any():
            digest[full] = mix(np.add.reduceat(mix(grams ^ salt), first[full]) + counts[full].astype(np.uint64))
        out.append(digest.view(np.int64))
    return out[0], out[1]
