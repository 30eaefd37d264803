"""Quality classifier by co-training two views of a document.

One classifier sees the text's content alone, the other the page's columns alone
(language, source, stated size).  Over some rounds each labels the unlabelled rows it
is surest about for the other.  A view is sure of a label where, calibrated on
labelled rows kept aside, it errs less than half as often as saying that label always
would.  A view that tells those rows no better than their base rate teaches nothing,
and a round after which either view tells them worse is undone.  All pseudo-labels together weigh at
most ``trust`` of the true ones, however large the table.  In the end a combination of
both calibrated views scores every document.

Labelled rows to fit on are a bounded sample (``max_labelled``), drawn by a hash of
the id, so that reruns agree.  Pseudo-labels are exchanged over all other rows: they
stay on the executors, which add up moments, gradients and curvatures.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relafix.llm.linear import Logistic, fit, sigmoid
from relafix.llm.shingles import give_back, small_batches
from relafix.storage import stage_table

_SIGNS = list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_GRAMS = 64  # classes that character trigrams are hashed to
_HASHED = 48
_KEEP_ASIDE = 4  # one labelled row in four calibrates
_BINS, _TOP = 4096, 35.0  # of the log-odds, to find the surest rows
_ROWS = 1024  # rows in a block of packed features
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def content_features(text: str) -> list[float]:
    """Lexical content: hashed character trigrams, shares of kinds of characters, how words repeat."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    words = text.split()
    total, distinct = max(1, len(words)), len(set(words))
    low = _FOLD[raw]
    hashed = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(26)
    grams = np.bincount(hashed, minlength=_GRAMS).astype(float)
    return [
        upper / max(1, upper + lower),
        counts[48:58].sum() / n,
        counts[128:].sum() / n,
        *(counts[_SIGNS] / n),
        distinct / total,
        distinct / total**0.8,
        len(text) / total,
        *(grams / max(1.0, float(np.sqrt((grams * grams).sum())))),
    ]


def metadata_features(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    """What the page's columns tell: language and source (hashed to fixed classes) and the size stated."""
    known = n_chars is not None and n_chars == n_chars
    kinds = [0.0] * _HASHED
    kinds[zlib.crc32(f"l{lang}".encode()) % 16] = 1.0
    kinds[16 + zlib.crc32(f"s{source}".encode()) % (_HASHED - 16)] = 1.0
    return [float(known), np.log1p(max(0.0, float(n_chars))) if known else 0.0, *kinds]


_N_CONTENT = len(content_features(""))


def _features(texts, langs, sources, sizes) -> np.ndarray:
    # filled row by row: lists of boxed numbers for a whole batch would stay with the worker
    x = np.empty((len(texts), _N_CONTENT + _HASHED + 2), np.float32)
    for i, (text, lang, source, size) in enumerate(zip(texts, langs, sources, sizes, strict=True)):
        x[i, :_N_CONTENT] = content_features(text or "")
        x[i, _N_CONTENT:] = metadata_features(lang, source, size)
    return x


@dataclass
class CoTrained:
    """Two views, their calibrations (slope, offset) and the combination of both."""

    content: Logistic
    metadata: Logistic
    calibration: tuple[Logistic, Logistic]
    combined: Logistic

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        views = self.content.z(x[:, :_N_CONTENT]), self.metadata.z(x[:, _N_CONTENT:])
        calibrated = [c.z(v[:, None]) for c, v in zip(self.calibration, views, strict=True)]
        return sigmoid(self.combined.z(np.stack(calibrated, axis=1))), sigmoid(calibrated[0]), sigmoid(calibrated[1])


_CUT = slice(None, _N_CONTENT), slice(_N_CONTENT, None)
Work = Callable[[np.ndarray, np.ndarray], np.ndarray]
Sure = tuple[float, float]  # least probability of a pseudo-label 0 and 1


class Rows:
    """Unlabelled rows in memory; each has a fixed number in [0, 1) that settles ties."""

    def __init__(self, x: np.ndarray):
        self.x, self.lot = x, np.arange(len(x)) * 0.6180339887498949 % 1.0

    def total(self, work: Work) -> np.ndarray:
        return work(self.x, self.lot)


class Blocks(Rows):
    """Unlabelled rows on the executors, ``n, x, lot`` packed by block; what leaves is one sum a task."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks

    def total(self, work: Work) -> np.ndarray:
        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0.0
            for b in batches:
                for n, x, lot in zip(b["n"], b["x"], b["lot"], strict=True):
                    total = total + work(np.frombuffer(x, np.float32).reshape(n, -1).astype(float), np.frombuffer(lot, np.float64))
            if np.ndim(total):
                yield pd.DataFrame({"total": [total.tobytes()]})
            give_back()

        parts = [np.frombuffer(r["total"]) for r in self.blocks.mapInPandas(added, "total binary").collect()]
        return np.sum(parts, axis=0) if parts else work(np.zeros((0, _width())), np.zeros(0))


def _width() -> int:
    return _N_CONTENT + _HASHED + 2


@dataclass
class _Round:
    """What a round took: its views and, by view and label, the last bin taken and its share of that bin."""

    views: list[Logistic]
    last: dict[tuple[int, int], tuple[int, float]]


def _bins(z: np.ndarray, sure: float) -> np.ndarray:
    """Bin of the log-odds, the surest highest; -1 for rows of which the view is less than ``sure``."""
    least = np.log(sure / (1 - sure))
    return np.where(z >= least, ((np.minimum(z, _TOP) - least) / (_TOP - least) * (_BINS - 1)).astype(int), -1)


def _given(x: np.ndarray, lot: np.ndarray, past: list[_Round], sure: Sure) -> tuple[np.ndarray, np.ndarray]:
    """Pseudo-labels of rows for each view (-1: none), and which rows are free yet."""
    labels, free = np.full((2, len(x)), -1), np.ones(len(x), bool)
    for r in past:
        taken = np.zeros(len(x), bool)
        for me in (0, 1):
            z = r.views[me].z(x[:, _CUT[me]])
            for label in (1, 0):
                bins, (last, part) = _bins(z if label else -z, sure[label]), r.last[me, label]
                hit = free & (bins >= 0) & ((bins > last) | ((bins == last) & (lot < part)))
                labels[1 - me][hit] = label
                taken |= hit
        free &= ~taken
    return labels, free


def _take(pool: Rows, views: list[Logistic], past: list[_Round], most: int, sure: Sure) -> _Round | None:
    """The surest free rows of each view and class, about ``most`` each; None if there are none."""

    def count(x: np.ndarray, lot: np.ndarray) -> np.ndarray:
        _, free = _given(x, lot, past, sure)
        out = []
        for me in (0, 1):
            z = views[me].z(x[free][:, _CUT[me]])
            for label in (1, 0):
                bins = _bins(z if label else -z, sure[label])
                out.append(np.bincount(bins[bins >= 0], minlength=_BINS))
        return np.concatenate(out).astype(float)

    counts = pool.total(count).reshape(2, 2, _BINS)
    last = {}
    for me in (0, 1):
        for label in (1, 0):
            n = counts[me, 1 - label]
            above = np.cumsum(n[::-1])[::-1] - n  # rows in surer bins
            bin_ = int(np.flatnonzero(above < most)[0])
            last[me, label] = bin_, float(min(1.0, (most - above[bin_]) / max(1.0, n[bin_])))
    return _Round(views, last) if counts.any() else None


def _fit_views(x: np.ndarray, y: np.ndarray, pool: Rows, past: list[_Round], sure: Sure, trust: float, l2: float = 1.0, rounds: int = 25, warm: list[Logistic] | None = None) -> list[Logistic]:
    """``fit`` for both views over labelled rows and pseudo-labelled ones, which weigh ``trust``, and together no more than that share of the others; starts from ``warm``."""

    def moments(x: np.ndarray, lot: np.ndarray) -> np.ndarray:
        labels, _ = _given(x, lot, past, sure)
        out = []
        for v in (0, 1):
            own = x[labels[v] >= 0][:, _CUT[v]]
            out += [[len(own), (labels[v] == 1).sum()], own.sum(axis=0), (own**2).sum(axis=0)]
        return np.concatenate(out).astype(float)

    sums, at, models, targets, weigh = pool.total(moments), 0, [], [], []
    for v in (0, 1):
        own = x[:, _CUT[v]]
        d = own.shape[1]
        n, likely = sums[at : at + 2]
        first, second = (own.sum(axis=0) + sums[at + 2 : at + 2 + d]) / (len(y) + n), ((own**2).sum(axis=0) + sums[at + 2 + d : at + 2 + 2 * d]) / (len(y) + n)
        at += 2 + 2 * d
        scale = np.sqrt(np.maximum(0.0, second - first**2))
        scale[scale < 1e-9] = 1.0
        weigh.append(trust * min(1.0, len(y) / max(1.0, n)))
        good, total = y.sum() + likely * weigh[v], len(y) + n * weigh[v]
        bias = np.log((good + 1.0) / (total + 1.0 - good))
        if warm:  # the same plane over the new means and scales
            old = warm[v]
            models.append(Logistic(first, scale, old.weights * scale / old.scale, float(old.bias + (first - old.mean) / old.scale @ old.weights)))
        else:
            models.append(Logistic(first, scale, np.zeros(d), float(bias)))
        targets.append(0 < y.sum() + likely < len(y) + n)

    def slopes(v: int, x: np.ndarray, y: np.ndarray, weight: float) -> np.ndarray:
        m = models[v]
        a = np.hstack([(x[:, _CUT[v]] - m.mean) / m.scale, np.ones((len(y), 1))])
        p = sigmoid(a @ np.append(m.weights, m.bias))
        return np.append(a.T @ (weight * (y - p)), (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a)

    open_ = [v for v in (0, 1) if targets[v]]
    for _ in range(rounds):
        if not open_:
            break

        def work(x: np.ndarray, lot: np.ndarray) -> np.ndarray:
            labels, _ = _given(x, lot, past, sure)
            return np.concatenate([slopes(v, x[labels[v] >= 0], labels[v][labels[v] >= 0], weigh[v]) for v in open_])

        sums, at = pool.total(work), 0
        for v in list(open_):
            d = len(models[v].weights) + 1
            both = slopes(v, x, y, 1.0) + sums[at : at + d + d * d]
            at += d + d * d
            penalty = np.append(np.full(d - 1, l2), 1e-6)
            step = np.linalg.solve(both[d:].reshape(d, d) + np.diag(penalty), both[:d] - penalty * np.append(models[v].weights, models[v].bias))
            step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            models[v] = Logistic(models[v].mean, models[v].scale, models[v].weights + step[:-1], models[v].bias + float(step[-1]))
            if np.abs(step).max() < 1e-6:
                open_.remove(v)
    return models


def co_train(x: np.ndarray, y: np.ndarray, pool: np.ndarray | Rows, aside: np.ndarray, rounds: int = 4, share: float = 0.05, sure: float = 0.9, trust: float = 0.5) -> CoTrained:
    """Fit on labelled ``x, y`` (rows ``aside`` only calibrate) and unlabelled ``pool``.

    A round moves at most about ``share`` of the pool per view and class, rows of which
    the view, calibrated on the rows ``aside``, is at least ``sure`` and errs less than half
    as often as the label's base rate would; they weigh ``trust`` of a true label.  A view that
    tells the rows ``aside`` no better than their base rate gives no labels, and a round after
    which either view tells them worse is undone and ends the exchange.  Without rows
    ``aside`` nothing is exchanged.
    """
    rate = float(y.mean()) if len(y) else 0.5
    least = max(sure, 1 - rate / 2), max(sure, 1 - (1 - rate) / 2)
    use = ~aside if (~aside).any() else np.ones(len(y), bool)
    judges = aside if aside.any() else use
    base = _log_loss(np.full(int(judges.sum()), _log_odds(y[judges])), y[judges])
    views = [fit(x[use][:, c], y[use]) for c in _CUT]
    sized, losses = _sized(views, x[judges], y[judges])
    pool = pool if isinstance(pool, Rows) else Rows(pool)
    most = max(1, int(share * pool.total(lambda x, lot: np.array([float(len(x))]))[0]))
    past: list[_Round] = []
    for _ in range(rounds if use.any() and aside.any() else 0):
        # a view that tells the kept rows no better than their base rate has nothing to teach
        teaches = [base - loss > _TELLS / judges.sum() for loss in losses]
        taken = _take(pool, [v if t else _silent(v) for v, t in zip(sized, teaches, strict=True)], past, most, least)
        if taken is None:
            break
        after = _fit_views(x[use], y[use], pool, [*past, taken], least, trust, warm=views)
        sized_after, losses_after = _sized(after, x[judges], y[judges])
        if any(new > old + 1e-9 for new, old in zip(losses_after, losses, strict=True)):
            break  # the round did harm: it is undone
        past, views, sized, losses = [*past, taken], after, sized_after, losses_after
    raw = [v.z(x[judges][:, c]) for v, c in zip(views, _CUT, strict=True)]
    calibration = tuple(fit(z[:, None], y[judges]) for z in raw)
    both = np.stack([c.z(z[:, None]) for c, z in zip(calibration, raw, strict=True)], axis=1)
    return CoTrained(views[0], views[1], calibration, fit(both, y[judges]))


#: What the log-likelihood of the kept rows must gain for a view to teach: a likelihood-ratio test of one slope at 1 %.
_TELLS = 3.32


def _log_odds(y: np.ndarray) -> float:
    return float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))


def _log_loss(z: np.ndarray, y: np.ndarray) -> float:
    """Mean log-loss of log-odds ``z``; 0 without rows."""
    return float(np.logaddexp(0.0, np.where(y > 0, -z, z)).mean()) if len(y) else 0.0


def _silent(view: Logistic) -> Logistic:
    """A view that is sure of nothing."""
    return Logistic(view.mean, view.scale, np.zeros_like(view.weights), 0.0)


def _sized(views: list[Logistic], x: np.ndarray, y: np.ndarray) -> tuple[list[Logistic], list[float]]:
    """The views with their log-odds calibrated on ``x, y``, and how well those then tell ``y``."""
    out, losses = [], []
    for v, c in zip(views, _CUT, strict=True):
        line = fit(v.z(x[:, c])[:, None], y)
        slope = float(line.weights[0] / line.scale[0])
        out.append(Logistic(v.mean, v.scale, v.weights * slope, float((v.bias - line.mean[0]) * slope + line.bias)))
        losses.append(_log_loss(out[-1].z(x[:, c]), y))
    return out, losses


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, most: int, where=None) -> DataFrame:
    """At most about ``most`` labelled ids, the same ones each time: one row per id, the larger label."""
    rows = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id is not null and __label is not null")
    if where is not None:
        rows = rows.where(where(F.col("__id")))
    rows = rows.groupBy("__id").agg(F.max("__label").alias("__label"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(1 << 40)) < int((1 << 40) * most / n))
    return rows


def _given_columns(docs: DataFrame, text_col: str, meta_cols: tuple[str, str, str]) -> list[Column]:
    """Text, language, source and size; columns that ``docs`` has not are null."""
    kinds = ("string", "string", "double")
    return [F.col(text_col).alias("text"), *[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(n) for c, k, n in zip(meta_cols, kinds, ("lang", "source", "n_chars"), strict=True)]]


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, meta_cols: tuple[str, str, str], max_labelled: int, rounds: int) -> CoTrained:
    chosen = F.broadcast(labelled_sample(labels, label_col, id_col, max_labelled))  # bounded by max_labelled
    rows = docs.select(F.col(id_col).alias("__id"), *_given_columns(docs, text_col, meta_cols))
    lot = (F.pmod(F.xxhash64(F.lit("pool"), "__id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("lot")
    rows = rows.join(chosen, "__id", "left").select(F.col("__id").cast("string").alias("__id"), "text", "lang", "source", "n_chars", lot, "__label")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _features(b["text"], b["lang"], b["source"], b["n_chars"])
            known = b["__label"].notna().to_numpy(bool)
            yield pd.DataFrame({"id": b["__id"][known], "label": b["__label"][known].astype(int), "n": 1, "x": [r.tobytes() for r in x[known]], "lot": b""})
            free = np.flatnonzero(~known)
            for at in range(0, len(free), _ROWS):
                part = free[at : at + _ROWS]
                yield pd.DataFrame({"id": [None], "label": [-1], "n": [len(part)], "x": [x[part].tobytes()], "lot": [b["lot"].to_numpy(float)[part].tobytes()]})
        give_back()

    packed = stage_table(rows.mapInPandas(features, "id string, label int, n int, x binary, lot binary"), "features")
    sample = packed.where("label >= 0").select("id", "label", "x").toPandas().drop_duplicates("id").sort_values("id")  # bounded by max_labelled
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(len(sample), _width()).astype(float)
    aside = np.array([zlib.crc32(i.encode()) % _KEEP_ASIDE == 0 for i in sample["id"]], bool)
    return co_train(x, sample["label"].to_numpy(float), Blocks(packed.where("label < 0").select("n", "x", "lot")), aside, rounds)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    meta_cols: tuple[str, str, str] = ("lang", "source", "n_chars"),
    max_labelled: int = 20_000,
    rounds: int = 4,
) -> DataFrame:
    """``docs`` with ``quality_score`` (1: good), ``content_score`` and ``metadata_score``.

    ``labels`` has ``id_col`` and ``label_col`` (1: good).  ``meta_cols`` name the
    language, the source and the size; each may be null or missing, a null or
    empty text has the features of an empty one, so every row gets a score.  Whole
    texts of any length are read.  Repeated labels of an id count once (the larger),
    repeated rows are scored alike, and ties in the exchange are settled by a hash of
    id and text.  Without labels all scores are 0.5; an empty table gives an empty
    result.  Columns of ``docs`` with the names of the scores are replaced.
    """
    small_batches(docs.sparkSession)
    model = _model(docs, labels, id_col, text_col, label_col, meta_cols, max_labelled, rounds)
    names = ("quality_score", "content_score", "metadata_score")

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def scored(text: pd.Series, lang: pd.Series, source: pd.Series, size: pd.Series) -> pd.DataFrame:
        x = _features(text, lang, source, size)
        return pd.DataFrame(dict(zip(names, model.scores(x), strict=True)))

    packed = docs.select(F.struct("*").alias("row"), scored(*_given_columns(docs, text_col, meta_cols)).alias("scores"))
    return packed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in names], "scores.*")


def reject_low_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, str, str] = ("lang", "source", "n_chars"), **options
) -> DataFrame:
    """The documents whose score is at least ``threshold``, with the columns of ``docs``; odd rows as in ``score_quality``."""
    used = [id_col, text_col, *[c for c in meta_cols if c in docs.columns]]
    marked = score_quality(docs.select(F.struct("*").alias("row"), *dict.fromkeys(used)), labels, id_col, text_col, meta_cols=meta_cols, **options)
    return marked.where(F.col("quality_score") >= threshold).select(*[F.col("row")[c].alias(c) for c in docs.columns])
