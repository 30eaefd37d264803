"""Cross-tokenizer alignment: two tokenizers' cuts of one text, laid side by side.

A dangling-suffix transducer reads both token streams.  Its state is which side leads
and the bytes by which it does (the residual); it takes the next token of the side that
is behind, and each step's two current tokens overlap, which is one link.  Steps depend on
the residual and the next token only, so they are remembered; where the residual is empty,
both streams end at one byte and a group closes.

How often a pair of ids is linked is counted over the whole corpus: each task turns a run
of documents into one row with the run's distinct pairs, how many of its documents hold
each, and its documents as places in that list.  One shuffle adds the pairs up; a second
one hands each run the counts of its own pairs, which is far less than a row for every
pair of every document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relafix.llm.shingles import give_back, small_batches
from relafix.storage import stage_table

_MEMO = 1 << 20
#: A run of a million characters is about a megabyte as a row.
_RUNS_A_FILE = 16
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: How byte-level vocabularies of this form split a text before merging; fixed value.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteTokens:
    """A byte-level BPE in the JSON form; special tokens' strings are plain text.

    Where ids are the order of the merges and nothing but the byte-level split precedes them,
    ``tiktoken`` merges by those ids, five times as fast; else the ``tokenizers`` library encodes.
    """

    def __init__(self, path: str, ranked: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        self.bytes = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        form = json.loads(tokenizer.to_str())
        if ranked and self._is_ranked(form):
            ranks = {self.bytes[i]: i for i in form["model"]["vocab"].values()}
            merged = tiktoken.Encoding("ranked", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [merged.encode_ordinary(" " + t) for t in texts]
        else:
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    @staticmethod
    def _is_ranked(form: dict) -> bool:
        model, split = form["model"], form["pre_tokenizer"] or {}
        plain = form["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        return bool(plain) and model["type"] == "BPE" and not any(model.get(o) for o in options) and all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))


class PieceTokens:
    """A SentencePiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            byte = _BYTE.fullmatch(piece)
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _tokens(kind: type, path: str):
    return kind(path)


class Transducer:
    """Aligns two token streams of the same bytes.

    A state is a number: 0 for the empty residual, else that of a (side that leads, residual).
    """

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self._bytes = (a_bytes, b_bytes)
        self._names = [str(i) for i in range(max(len(a_bytes), len(b_bytes)))]
        self._forget()

    def _forget(self):
        self._states: list[tuple[int, bytes]] = [(0, b"")]
        self._numbers: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self._behind = [0]
        self._steps: tuple[dict, dict] = ({}, {})
        self._ones: dict[int, tuple[int, str]] = {}
        self._sizes = 0

    def _step(self, state: int, token: int) -> int:
        """The state after the side that is behind has taken ``token``; -1 if the bytes differ."""
        leads, residual = self._states[state]
        behind = self._behind[state]
        taken = self._bytes[behind][token]
        if residual.startswith(taken):
            after = (leads, residual[len(taken) :])
        elif taken.startswith(residual):
            after = (behind, taken[len(residual) :])
        else:
            return -1
        after = after if after[1] else (0, b"")
        number = self._numbers.setdefault(after, len(self._states))
        if number == len(self._states):
            self._states.append(after)
            self._behind.append(1 - after[0] if number else 0)
            self._sizes += len(after[1]) + 64
        return number

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], list[str]] | None:
        """The links as ``A id << 32 | B id`` and the groups' names, in order; None where the bytes differ."""
        if self._sizes + 100 * (len(self._steps[0]) + len(self._steps[1]) + len(self._ones)) > 100 * _MEMO:
            self._forget()
        steps, behind, names, ones = self._steps, self._behind, self._names, self._ones
        links, groups = [], []
        i = j = i0 = j0 = 0
        state = 0
        n_a, n_b = len(a), len(b)
        now_a = now_b = 0
        while i < n_a or j < n_b or state:
            if not state and i < n_a and j < n_b:
                # both steps at once where one token of each makes a group
                both = ones.get(a[i] << 17 | b[j])
                if both is not None:
                    links.append(both[0])
                    groups.append(both[1])
                    i += 1
                    j += 1
                    continue
                i0, j0 = i, j
            side = behind[state]
            if side == 0:
                if i == n_a:
                    return None
                token = now_a = a[i]
                i += 1
            else:
                if j == n_b:
                    return None
                token = now_b = b[j]
                j += 1
            key = state << 17 | token
            after = steps[side].get(key)
            if after is None:
                after = steps[side][key] = self._step(state, token)
            if after < 0:
                return None
            if state:
                links.append(now_a << 32 | now_b)
            elif not after:
                return None  # a token without bytes
            state = after
            if not state:
                name = ",".join([names[x] for x in a[i0:i]]) + "|" + ",".join([names[x] for x in b[j0:j]])
                groups.append(name)
                if i - i0 == 1 == j - j0:
                    ones[now_a << 17 | now_b] = (links[-1], name)
        return links, groups


_RUN = "run long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,pairs:int>>, pairs array<long>, held array<int>, places array<int>, times array<int>"


def _runs(docs: DataFrame, a_path: str, b_path: str, at_once: int) -> DataFrame:
    """One row for a run of documents of about ``at_once`` characters: their figures, and their pairs as places in the run's list."""

    def align(texts: list[str | None], transducer: Transducer, a_side, b_side):
        real = [t for t in texts if t]
        encoded = iter(zip(real, a_side.encode(real), b_side.encode(real), strict=True))
        for text in texts:
            if not text:
                yield None
                continue
            text, a, b = next(encoded)
            whole = (" " + text).encode()
            same = b"".join([a_side.bytes[x] for x in a]) == whole == b"".join([b_side.bytes[x] for x in b])
            found = transducer.align(a, b) if same else None
            yield (len(a), len(b), *found) if found else None

    def run_row(number: int, ids: list, texts: list, transducer: Transducer, a_side, b_side) -> dict:
        figures, pairs, times, owner = [], [], [], []
        for k, (doc_id, found) in enumerate(zip(ids, align(texts, transducer, a_side, b_side), strict=True)):
            if found is None:
                figures.append((doc_id, 0, 0, 0, 0, "", 0))
                continue
            n_a, n_b, links, groups = found
            distinct, often = np.unique(np.array(links, np.int64), return_counts=True)
            figures.append((doc_id, n_a, n_b, len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), len(distinct)))
            pairs.append(distinct)
            times.append(often)
        every, places = np.unique(np.concatenate(pairs), return_inverse=True) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held = np.bincount(places, minlength=len(every))
        names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs")
        return {"run": number, "docs": [dict(zip(names, f, strict=True)) for f in figures], "pairs": every, "held": held.astype(np.int32), "places": places.astype(np.int32), "times": np.concatenate(times).astype(np.int32) if times else np.zeros(0, np.int32)}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = _tokens(ByteTokens, a_path), _tokens(PieceTokens, b_path)
        transducer = Transducer(a_side.bytes, b_side.bytes)
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "") + 64
                if size >= at_once:
                    yield _one_row(run_row(number, ids, texts, transducer, a_side, b_side))
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield _one_row(run_row(number, ids, texts, transducer, a_side, b_side))
        give_back()

    return docs.mapInArrow(go, _RUN)


def _one_row(row: dict) -> pa.RecordBatch:
    lists = {c: pa.ListArray.from_arrays(pa.array([0, len(row[c])], pa.int32()), pa.array(row[c])) for c in ("pairs", "held", "places", "times")}
    figures = pa.struct([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string()), ("pairs", pa.int32())])
    return pa.RecordBatch.from_arrays([pa.array([row["run"]], pa.int64()), pa.array([row["docs"]], pa.list_(figures)), *lists.values()], ["run", "docs", *lists])


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", at_once: int = 1 << 20) -> DataFrame:
    """One row for each document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A is a byte-level BPE, which gets the text behind a space, B a SentencePiece model.
    Groups are the cuts at bytes where tokens of both end; links are the pairs of token
    occurrences whose bytes overlap.  A pair's count is in how many documents it is linked;
    ``count_sum`` adds it up over the links, ``n_best`` counts the links for which it is the
    highest of their A id.  Texts that are null or empty, or whose tokens do not give back their
    bytes, have no tokens: zeros and an empty digest.  Repeated rows are documents of their own
    and count as such; other columns are not looked at; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    runs = stage_table(_runs(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), a_path, b_path, at_once), "runs", _RUNS_A_FILE)
    asked = runs.select("run", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "p")).select("run", "place", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = stage_table(asked.groupBy("pair").agg(F.sum("held").alias("count")), "counts")
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("highest"))
    known = counts.join(highest, F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    told = asked.join(known, "pair").groupBy("run").agg(F.sort_array(F.collect_list(F.struct("place", "count", "best"))).alias("told"))
    told = told.select(F.col("run").alias("of"), F.col("told.count").alias("counts"), F.col("told.best").alias("best"))
    joined = runs.join(told, F.col("run") == F.col("of"), "left").select("docs", "places", "times", "counts", "best")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                docs_of = pa.RecordBatch.from_struct_array(b.column("docs")[k].values)
                places, times, counts, best = (np.zeros(0, np.int64) if b.column(c)[k].values is None else b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("places", "times", "counts", "best"))
                ends = np.cumsum(docs_of.column("pairs").to_numpy())
                sums = []
                for value in (best, counts):
                    running = np.append(0, np.cumsum(times.astype(np.int64) * value[places].astype(np.int64))) if len(places) else np.zeros(1, np.int64)
                    sums.append(running[ends] - running[ends - docs_of.column("pairs").to_numpy()])
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
                yield pa.RecordBatch.from_arrays([*[docs_of.column(c) for c in names], pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), docs_of.column("groups_sha256")], [*names, "n_best", "count_sum", "groups_sha256"])
        give_back()

    return joined.mapInArrow(score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
