"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A term's weight in a text is ``(1 + ln tf) * idf * relevance``.  The IDF is counted
over all documents.  The relevance is what the term tells of the label: the absolute
log-odds ratio between toxic and clean training rows, with ``prior`` pseudo-rows at
the base rate, so that a term that says nothing, and one that no training row has,
weighs 0.  No term is cut, and a text's length is taken over all of its words.
(Without the relevance the nearest texts are those of the same language and topic.)

A bounded set of labelled examples forms an inverted index.  Postings lie in blocks of
examples, each with the largest weight of every term in it; terms that very many
examples have are full rows.  A search adds up the full rows, scores the blocks of the
highest upper bounds and then those whose bound reaches the k-th best score, so the
nearest ones are exact.  Votes weighted by distance and by the
inverse of each label's draw, calibrated on the examples themselves (each without its
own vote), give the score; the neighbours are the evidence.

Terms are handled as 64-bit hashes; two terms share one with a chance of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relafix.llm.linear import Logistic, fit, sigmoid
from relafix.llm.quality import labelled_sample
from relafix.llm.shingles import small_batches, word_counts
from relafix.storage import stage_table

_BASE_VOTES = 0.3  # weight of the base rate among the votes
_NEAR = 0.05  # what is added to a distance, so that an equal text has no endless vote
_FIRST_BLOCKS = 4  # blocks that are scored before any is ruled out
_FULL = 12  # a term that more than one example in so many has is a full row


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, one space between them."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``sizes`` of them, end to end."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def relevance(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int, prior: float = 10.0) -> np.ndarray:
    """Absolute log-odds ratio of terms from the training rows of each label that have them."""
    rate = (n_toxic + 0.5) / (n_clean + n_toxic + 1.0)
    return np.abs(np.log((toxic + prior * rate) / (clean + prior * (1 - rate)) * (1 - rate) / rate))


@dataclass
class Index:
    """Term weights, and examples as postings in blocks and as full rows."""

    vocabulary: np.ndarray  # sorted hashes
    weight: np.ndarray  # of each term of the vocabulary
    ids: np.ndarray
    labels: np.ndarray
    draw: np.ndarray  # training rows that an example stands for
    first: np.ndarray  # of a term's entries; an entry is a term in a block
    block: np.ndarray
    most: np.ndarray  # largest weight of an entry
    start: np.ndarray  # of an entry's postings
    place: np.ndarray  # example of a posting
    value: np.ndarray
    row: np.ndarray  # a term's full row, or -1
    full: np.ndarray  # row, example
    size: int  # examples in a block
    base_rate: float

    def vectors(self, owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owners, terms and unit-length weights of texts from their words, in the order given."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        owner, terms = owner[known], at[known]
        weights = (1.0 + np.log(counts[known])) * self.weight[terms]
        if len(owner):
            length = np.sqrt(np.bincount(owner, weights=weights * weights))
            some = length[owner] > 0
            owner, terms, weights = owner[some], terms[some], weights[some] / length[owner[some]]
        return owner, terms, weights

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples with a cosine above 0, ties to the earlier place."""
        if not len(self.ids):
            return np.zeros(0, np.intp), np.zeros(0)
        rows = self.row[terms]
        base = weights[rows >= 0] @ self.full[rows[rows >= 0]]
        terms, weights = terms[rows < 0], weights[rows < 0]
        sizes = self.first[terms + 1] - self.first[terms]
        entry, share = _ranges(self.first[terms], sizes), np.repeat(weights, sizes)
        block = self.block[entry]
        heads = np.arange(0, len(base), self.size)
        bounds = np.bincount(block, weights=self.most[entry] * share, minlength=len(heads)) + np.maximum.reduceat(base, heads)
        places, cosines = np.zeros(0, np.intp), np.zeros(0)
        chosen = np.zeros(len(bounds), bool)
        chosen[np.argsort(-bounds, kind="stable")[:_FIRST_BLOCKS]] = True
        chosen &= bounds > 0
        left = (bounds > 0) & ~chosen
        while chosen.any():
            use = chosen[block]
            e = entry[use]
            n = self.start[e + 1] - self.start[e]
            p = _ranges(self.start[e], n)
            scores = np.bincount(self.place[p], weights=self.value[p] * np.repeat(share[use], n), minlength=len(base)) + base
            live = np.flatnonzero((scores > 0) & np.repeat(chosen, self.size)[: len(base)])
            live = live[live != skip]
            if len(live) > 4 * k:  # far more than can be among the nearest
                live = live[scores[live] >= np.partition(scores[live], -k)[-k]]
            places, cosines = np.append(places, live), np.append(cosines, scores[live])
            order = np.lexsort((places, -cosines))[:k]
            places, cosines = places[order], cosines[order]
            # rounding may put a bound a hair under a score it covers
            chosen = left & (bounds * (1 + 1e-9) >= cosines[-1]) if len(places) == k else left
            left = np.zeros(len(bounds), bool)
        return places, cosines

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic votes; a vote falls with the distance, to nothing at a cosine of 0, and the base rate has one of its own."""
        w = (1.0 / (1.0 + _NEAR - np.minimum(cosines, 1.0)) - 1.0 / (1.0 + _NEAR)) * self.draw[places]
        # the draw evens out within the neighbourhood, so that the base rate's vote keeps its weight
        w = w / max(1e-300, self.draw[places].mean()) if len(places) else w
        return float((w @ self.labels[places] + _BASE_VOTES * self.base_rate) / (w.sum() + _BASE_VOTES))


def build_index(
    examples: list[tuple[int, int, np.ndarray, np.ndarray]], vocabulary: np.ndarray, weight: np.ndarray, base_rate: float, draw: tuple[float, float] = (1.0, 1.0), block: int = 64
) -> Index:
    """Index over (id, label, word hashes, counts); ``draw`` is what an example of each label stands for.

    Examples whose terms all weigh 0 are left out; nothing is near them.
    """
    none = np.zeros(0, np.intp)
    index = Index(vocabulary, weight, none, np.zeros(0), np.zeros(0), np.zeros(len(vocabulary) + 1, np.intp), none, np.zeros(0), np.zeros(1, np.intp), none, np.zeros(0), np.full(len(vocabulary), -1), np.zeros((0, 0)), block, base_rate)
    rows = []
    for i, label, hashes, counts in examples:
        _, terms, weights = index.vectors(np.zeros(len(hashes), np.intp), hashes, counts)
        if len(terms):
            rows.append((label, int(terms[np.argmax(weights)]), i, terms, weights))
    # examples of one label and one heaviest term lie together, which keeps the bounds of blocks apart
    rows.sort(key=lambda r: r[:3])
    if not rows:
        return index
    place = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
    terms, value = np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
    order = np.lexsort((place, terms))
    place, terms, value = place[order], terms[order], value[order]
    often = np.flatnonzero(np.bincount(terms, minlength=len(vocabulary)) * _FULL > len(rows))
    index.row[often] = np.arange(len(often))
    index.full = np.zeros((len(often), len(rows)))
    full = index.row[terms] >= 0
    index.full[index.row[terms[full]], place[full]] = value[full]
    place, terms, value = place[~full], terms[~full], value[~full]
    head = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (place[1:] // block != place[:-1] // block))) if len(terms) else np.zeros(0, np.intp)
    index.ids, index.labels = np.array([r[2] for r in rows]), np.array([r[0] for r in rows], float)
    index.draw = np.where(index.labels > 0, draw[1], draw[0])
    index.first = np.searchsorted(terms[head], np.arange(len(vocabulary) + 1))
    index.block, index.most = place[head] // block, np.maximum.reduceat(value, head) if len(head) else np.zeros(0)
    index.start, index.place, index.value = np.append(head, len(terms)), place, value
    return index


def _example_vectors(index: Index) -> list[tuple[np.ndarray, np.ndarray]]:
    if not len(index.ids):
        return []
    term_of, (row, place) = np.flatnonzero(index.row >= 0), np.nonzero(index.full)
    terms = np.append(np.repeat(np.repeat(np.arange(len(index.vocabulary)), np.diff(index.first)), np.diff(index.start)), term_of[row])
    value, place = np.append(index.value, index.full[row, place]), np.append(index.place, place)
    order = np.lexsort((terms, place))
    cuts = np.searchsorted(place[order], np.arange(1, len(index.ids)))
    return list(zip(np.split(terms[order], cuts), np.split(value[order], cuts), strict=True))


def calibrate(index: Index, k: int, blank: tuple[int, int]) -> Logistic:
    """Log-odds of the label from the vote, each example voting without itself and weighing what it stands for.

    ``blank`` counts clean and toxic training rows of which nothing is near; they have
    the base rate for a vote and weigh in with their numbers.
    """
    votes, labels, weights = [], list(index.labels), list(index.draw)
    for place, (terms, w) in enumerate(_example_vectors(index)):
        votes.append(index.vote(*index.nearest(terms, w, k, skip=place)))
    for label, n in zip((0.0, 1.0), blank, strict=True):
        if n:
            votes.append(index.vote(np.zeros(0, np.intp), np.zeros(0)))
            labels.append(label)
            weights.append(float(n))
    return fit(np.array(votes).reshape(-1, 1), np.array(labels), np.array(weights), l2=0.1)


def training_fold(doc_id: Column) -> Column:
    """True for the rows that labels may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, k: int, max_labelled: int, max_examples: int) -> tuple[Index, Logistic]:
    chosen = F.broadcast(labelled_sample(labels, label_col, id_col, max_labelled, training_fold))  # bounded by max_labelled
    train = docs.select(F.col(id_col).alias("__id"), plain_words(F.col(text_col)).alias("text")).join(chosen, "__id")
    train = stage_table(train.select(F.col("__id").cast("long").alias("id"), "text", (F.col("__label") > 0).cast("int").alias("label")), "training")

    def by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch's counts are summed before they leave, so that a frequent term is one row of it
        for b in batches:
            label = b.column("label").to_numpy()
            for at, owner, words, _ in word_counts(b.column("text")):
                terms, back = np.unique(words, return_inverse=True)
                toxic = np.bincount(back, weights=label[at + owner], minlength=len(terms)).astype(np.int64)
                n = np.bincount(back, minlength=len(terms))
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n - toxic), pa.array(toxic)], names=["term", "clean", "toxic"])

    counts = train.mapInArrow(by_term, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # words of max_labelled texts
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    hashes = counts["term"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    vocabulary = hashes[order]
    told = relevance(counts["clean"].to_numpy()[order], counts["toxic"].to_numpy()[order], n_clean, n_toxic)
    weight = told * _corpus_idf(docs, text_col, vocabulary)
    examples, drawn = _examples(train, sizes, max_examples)
    draw = tuple(sizes.get(y, 0) / max(1, drawn[y]) for y in (0, 1))
    index = build_index(examples, vocabulary, weight, (n_toxic + 0.5) / (n_clean + n_toxic + 1), draw)
    kept = [int((index.labels == y).sum()) for y in (0, 1)]
    return index, calibrate(index, k, tuple(round((drawn[y] - kept[y]) * draw[y]) for y in (0, 1)))


def _corpus_idf(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> np.ndarray:
    """IDF of each term of the vocabulary, counted over the whole texts of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(len(vocabulary) + 1, np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, _, words, _ in word_counts(b.column("text")):
                at = np.searchsorted(vocabulary, words)
                at = at[at < len(vocabulary)][vocabulary[at[at < len(vocabulary)]] == words[at < len(vocabulary)]]
                found += np.bincount(at, minlength=len(found))
        found[-1] = n
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], names=["term", "n"])

    parts = docs.select(plain_words(F.col(text_col)).alias("text")).mapInArrow(count, "term int, n long")
    rows = parts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # vocabulary + 1 rows
    found = np.zeros(len(vocabulary) + 1)
    found[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return np.log((1 + found[-1]) / (1 + found[:-1])) + 1.0


def _examples(train: DataFrame, sizes: dict[int, int], most: int) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], list[int]]:
    """At most about ``most`` training rows per label, drawn by a hash of the id, as word hashes and counts; how many were drawn."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, owner, words, n in word_counts(b.column("text")):
                cuts = np.searchsorted(owner, np.arange(b.num_rows - at + 1))
                size = int(owner[-1]) + 1 if len(owner) else 0
                packed = [(words[cuts[i] : cuts[i + 1]].tobytes(), n[cuts[i] : cuts[i + 1]].astype(np.int64).tobytes()) for i in range(size)]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, size), b.column("label").slice(at, size), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], names=["id", "label", "words", "counts"])

    rate = F.when(F.col("label") > 0, min(1.0, most / max(1, sizes.get(1, 0)))).otherwise(min(1.0, most / max(1, sizes.get(0, 0))))
    drawn = train.where(F.pmod(F.xxhash64(F.lit("example"), "id"), F.lit(1 << 40)) < rate * float(1 << 40))
    n = {r["label"]: r["n"] for r in drawn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = drawn.mapInArrow(vectors, "id long, label int, words binary, counts binary").collect()  # bounded by most
    return [(r["id"], r["label"], np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in rows], [n.get(y, 0) for y in (0, 1)]


_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    k: int = 15,
    max_labelled: int = 20_000,
    max_examples: int = 1_500,
) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence``, one row per row of ``docs``.

    Labels are learnt from rows of the training fold only, at most about
    ``max_labelled`` of them; the index holds at most about ``max_examples`` of
    these per label.  ``evidence`` lists the nearest examples (id, cosine, label),
    nearest first; examples at one cosine come in the fixed order of the index.
    Whole texts of any length are searched.  A document with no term that tells
    anything, a null or empty text among them, has no neighbours and the base
    rate for its vote.  Repeated rows score alike; repeated labels of an id count
    once, the larger.  A null id is held out of nothing (``held_out`` is false).
    Without labels the score is what the base rate says, and an empty table gives
    an empty result.  Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    index, calibration = _learn(docs, labels, id_col, text_col, label_col, k, max_labelled, max_examples)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.intp), np.zeros(0)
        for b in batches:
            votes, near, ends = np.full(b.num_rows, index.vote(*none)), [none] * b.num_rows, np.zeros(b.num_rows + 1, np.int32)
            for at, owner, words, n in word_counts(b.column("text")):
                owner, terms, weights = index.vectors(owner, words, n)
                cuts = np.append(np.unique(owner, return_index=True)[1], len(owner))
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    row = at + int(owner[a])
                    near[row] = found = index.nearest(terms[a:z], weights[a:z], k)
                    votes[row] = index.vote(*found)
            scores = sigmoid(calibration.z(votes[:, None]))
            ends[1:] = np.cumsum([len(p) for p, _ in near])
            places, cosines = (np.concatenate([x[i] for x in near]) if len(near) else none[i] for i in (0, 1))
            parts = [pa.array(index.ids[places].astype(np.int64)), pa.array(np.minimum(1.0, cosines)), pa.array(index.labels[places].astype(np.int32))]
            evidence = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(_EVIDENCE.value_type)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), evidence], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(~training_fold(F.col(id_col)), F.lit(False)).alias("held_out"), plain_words(F.col(text_col)).alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,label:int>>")
