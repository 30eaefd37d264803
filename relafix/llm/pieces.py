"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search runs over a whole text and keeps only the window of places that a piece
begun so far can end at, no wider than the longest piece.  Whenever
the backpointer paths of all places of the window meet in one boundary, the ids
up to that boundary are final and leave the window.  Memory is that of the part not
yet certain: a few widths, and only where paths keep apart (a long run of one
character, say) a number for each character of the run.

After a commit at the last character read the search is where it began: one boundary, nothing
open.  What it commits next depends on the text from there on alone, so the way from
one such boundary to the next is remembered by its characters and not searched again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relafix.llm.shingles import give_back, small_batches

SPACE = "▁"
#: Stands for a U+2581 of the text itself; a lone surrogate cannot be in a text.
_LITERAL = "\udfff"
#: Fixed value of the reference algorithm: an unknown character costs this much more than the worst piece.
_UNKNOWN_PENALTY = 10.0
_NEVER = float("-inf")
#: Pieces that begin at a place are remembered by so many characters; where longer ones may follow, the trie tells.
_SEEN = 4


class PieceModel:
    """Pieces with scores, and the search over them.

    The best segmentation has the highest sum of scores; of equal ones the one
    whose last differing piece is longer counts.  Characters that no piece covers
    fall back to byte pieces.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int], dummy_prefix: bool = True, cache: int = 600_000):
        self.ids = {p: i for p, _, i in pieces}
        self.byte_ids, self.dummy_prefix, self.cache_size = byte_ids, dummy_prefix, cache
        self.width = max((len(p) for p in self.ids), default=1)
        self.unknown = min((s for _, s, _ in pieces), default=0.0) - _UNKNOWN_PENALTY
        # of every prefix of a piece: what may follow it, and its score if it is a whole piece
        self.trie: list = [{}, None]
        for piece, score in self._undominated({p: s for p, s, _ in pieces}):
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, [{}, None])
            node[1] = score
        self.spanning = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        covered = {c for p in self.ids for c in p}
        self.lone = "".join(c for c in "\n\r\t" if c not in covered)
        # letters, and whatever may follow one in a piece: no piece goes on from these to another sign but a space
        pairs = {pair for p in self.ids for pair in pairwise(p) if pair[1] != SPACE}
        inner = new = {c for c in covered if c.isalpha()}
        while new:
            new = {b for a, b in pairs if a in inner and b not in inner}
            inner = inner | new
        word = re.escape("".join(sorted(inner - {SPACE})))
        # where commits are likely; whether the search does commit there, ``closed`` finds out
        other = f"[^{SPACE}{self.lone}{word}]+"
        runs = f"(?:[{word}]+|{other}[{word}]*)" if word else other
        self.words = re.compile(f"{SPACE}*{runs}|{SPACE}+" + (f"|[{self.lone}]" if self.lone else "")).findall
        # ways remembered lately, and those of the time before: used ones move over, the rest go, so common words stay
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.starts: dict[str, tuple] = {}
        self.ends: dict[tuple, tuple] = {}
        self.out: dict[int, bytes] = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.table = pa.array([self.out.get(i, b"") for i in range(max(self.out, default=-1) + 1)], pa.binary())

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(p.get_piece_size())
        plain = [(p.id_to_piece(i), p.get_score(i), i) for i in every if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        return cls(plain, [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def _undominated(self, scores: dict[str, float]) -> Iterator[tuple[str, float]]:
        """The pieces that a best path can hold: where the same characters in several pieces score higher, those take the place.

        Sums of integers are exact; others must differ by more than what sums may be rounded by.
        """
        slack = 0.0 if all(s == int(s) for s in scores.values()) else 1e-6 * max(1.0, -self.unknown)
        for piece, score in scores.items():
            best = [0.0]
            for end in range(1, len(piece) + 1):
                parts = [best[at] + scores[piece[at:end]] for at in range(end == len(piece), end) if piece[at:end] in scores]
                if piece[end - 1] not in scores and len(piece) > 1:
                    parts.append(best[-1] + self.unknown)
                best.append(max(parts, default=_NEVER))
            if best[-1] <= score + slack:
                yield piece, score

    def _starting(self, seen: str) -> tuple[tuple[tuple[int, float], ...], dict, bool]:
        """Lengths and scores of the pieces that ``seen`` begins with, what may follow where longer ones go on, and whether none is longer than one."""
        ends, kids = [], self.trie[0]
        for length, c in enumerate(seen, 1):
            node = kids.get(c)
            if node is None:
                kids = {}
                break
            kids, gain = node
            if gain is not None:
                ends.append((length, gain))
        # an unknown character is a path of its own, so every place is reached; a piece of one character is always better
        if not ends or ends[0][0] != 1:
            ends.insert(0, (1, self.unknown))
        if len(self.starts) >= 100_000:
            self.starts.clear()
            self.ends.clear()
        # most beginnings have their ends in common with others
        ends = self.ends.setdefault(tuple(ends), tuple(ends))
        self.starts[seen] = found = ends, kids, len(ends) == 1 and not kids
        return found

    def stream(self, chars: str, begin: int = 0, bare: list[int] | None = None) -> Iterator[tuple[int, int]]:
        """The pieces of ``chars`` from the boundary ``begin`` on as (start, end), committed as soon as they are certain.

        Committed boundaries beyond which nothing is open join ``bare`` before their pieces come out.
        """
        n, width, remembered = len(chars), self.width, self.starts.get
        bare = [] if bare is None else bare
        # score and first boundary of the best path to each place of the window, counted from ``done``
        blank = [_NEVER] * (2 * width + 2)
        done, far, look, score, back = begin, 0, begin + width, blank[:], blank[:]
        score[0] = 0.0
        for at in range(begin, n):
            seen = chars[at : at + _SEEN]
            ends, kids, alone = remembered(seen) or self._starting(seen)
            if alone and not far:  # nothing is open, and nothing but this character begins here
                done = at + 1
                bare.append(done)
                yield at, done
                continue
            place = at - done
            if place + width >= len(score):
                score += blank
                back += blank
            here = score[place]
            for length, gain in ends:
                value, reach = here + gain, place + length
                if value > score[reach]:
                    score[reach], back[reach] = value, at
            if kids:
                place += _SEEN
                for c in chars[at + _SEEN : at + width]:
                    node = kids.get(c)
                    if node is None:
                        break
                    kids, gain = node
                    place += 1
                    if gain is not None:
                        value, reach = here + gain, place
                        if value > score[place]:
                            score[place], back[place] = value, at
            if reach > far:
                far = reach
            if far + done == at + 1:
                meet = at + 1
            elif at + 1 >= look:
                meet = self._meeting([p + done for p in range(at + 1 - done, far + 1) if score[p] > _NEVER], back, done)
                look = at + 1 + width
            else:
                continue
            if meet > done:
                path, p = [meet], meet
                while p > done:
                    p = back[p - done]
                    path.append(p)
                path.reverse()
                if meet == far + done:
                    bare.append(meet)
                    yield from pairwise(path)
                    score[1 : far + 1] = blank[1 : far + 1] if far < len(blank) else [_NEVER] * far
                    far = 0
                else:
                    yield from pairwise(path)
                    base, gone = score[meet - done], meet - done
                    score, back, far = [s - base for s in score[gone:]], back[gone:], far - gone
                done, look = meet, at + 1 + width

    def closed(self, word: str) -> bool:
        """Whether the search commits at the end of ``word`` and has nothing open there, whichever sign of ``words`` follows."""
        if not self.spanning and word[-1] != SPACE:
            return True
        after = self.lone if word[-1] == SPACE else SPACE + self.lone
        for start in range(max(0, len(word) - self.width), len(word)):
            kids = self.trie[0]
            for c in word[start:]:
                node = kids.get(c)
                if node is None:
                    break
                kids = node[0]
            else:
                if any(c in kids for c in after):
                    return False
        return True

    @staticmethod
    def _meeting(states: list[int], back: list[int], done: int) -> int:
        """The last boundary that the paths of all ``states`` pass."""
        live = set(states)
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(back[top - done])
        return live.pop()

    def _searched(self, chars: str, begin: int, least: int) -> tuple[bytes, int]:
        """Ids from the boundary ``begin`` to the first one at or after ``least`` beyond which nothing is open, and that one."""
        out, ids, bare, end = [], self.ids, [begin], begin
        for start, end in self.stream(chars, begin, bare):
            found = ids.get(chars[start:end])
            if found is not None:
                out.append(found)
            else:
                raw = (SPACE if chars[start] == _LITERAL else chars[start]).encode("utf-8")
                out.extend(self.byte_ids[b] for b in raw)
            if end >= least and end == bare[-1]:
                break
        return array("i", out).tobytes(), end

    def chars(self, text: str) -> str:
        """What the search reads of a text: space signs for spaces, one more in front."""
        chars = text.replace(SPACE, _LITERAL).replace(" ", SPACE)
        return SPACE + chars if self.dummy_prefix else chars

    def _remember(self, word: str, part: bytes) -> None:
        if len(self.cache) >= self.cache_size // 2:
            self.cache, self.older = {}, self.cache
        self.cache[word] = part

    def _remembered(self, word: str) -> bytes | None:
        part = self.cache.get(word)
        if part is None and (part := self.older.get(word)) is not None:
            self._remember(word, part)
        return part

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers in the machine's order; an empty text has none."""
        if not text:
            return b""
        chars = self.chars(text)
        words = self.words(chars)
        parts = list(map(self.cache.get, words))
        missing = [i for i, part in enumerate(parts) if part is None]
        if not missing:
            return b"".join(parts)
        if not self.spanning and words[-1][-1] != SPACE and all(words[i][-1] != SPACE for i in missing):
            # no piece spans a boundary of these words, so each is searched for itself and the others stay as they are
            for i in missing:
                word = words[i]
                parts[i] = part = self._remembered(word)
                if part is None:
                    parts[i] = part = self._searched(word, 0, len(word))[0]
                    if len(word) <= 48:
                        self._remember(word, part)
            return b"".join(parts)
        out, at, end = [], 0, 0
        for word, part in zip(words, parts, strict=True):
            end += len(word)
            if at >= end:  # committed with what came before
                continue
            # the search stands at the word's first boundary with nothing open, or has passed it
            part = (part or self._remembered(word)) if at == end - len(word) else None
            if part is None:
                begin = at
                part, at = self._searched(chars, begin, end)
                if begin == end - len(word) and at == end and len(word) <= 48 and self.closed(word):
                    self._remember(word, part)
            else:
                at = end
            out.append(part)
        return b"".join(out)

    def encode(self, text: str) -> array:
        """Ids of a text."""
        return array("i", self.packed(text))

    def decode(self, ids) -> str:
        """The text of ids; exact for ids that ``encode`` made."""
        raw = b"".join(map(self.out.__getitem__, ids))
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def decoded(self, values: pa.Array, ends: list[int]) -> Iterator[bytes]:
        """The text of each list of ids as bytes; lists lie end to end in ``values``, from 0 to ``ends[1]`` and so on."""
        found = self.table.take(values)
        _, places, raw = found.buffers()
        places = np.frombuffer(places, np.int32)[found.offset :][ends].tolist()
        raw = memoryview(raw or b"")
        for start, end in pairwise(places):
            if self.dummy_prefix and raw[start : start + 1] == b" " and start < end:
                start += 1
            yield bytes(raw[start:end])


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel.load(path)


def _shipped(spark, model_path: str) -> str:
    """Sends the model file to all executors; returns its name there."""
    spark.sparkContext.addFile(model_path)
    return model_path.rpartition("/")[2]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_ids, ids, exact`` for each row of ``docs``.

    ``exact`` tells that decoding the ids gives the text again.  Null texts have
    null ids, no count and no ``exact``; empty texts have no ids.  Whole texts of
    any length are encoded; of segmentations with one score the one whose last
    differing piece is longer counts.  Rows are handled one by one, so null and
    repeated ids and repeated rows stay as they are; an empty table gives an empty
    result and other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    name = _shipped(docs.sparkSession, model_path)
    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([packed.schema["doc_id"], T.StructField("n_ids", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(SparkFiles.get(name))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, ends, sizes = [], [0], []
                texts = part.column("text").to_pylist()
                for text in texts:
                    ids = None if text is None else model.packed(text)
                    flat.append(ids or b"")
                    ends.append(ends[-1] + len(flat[-1]) // 4)
                    sizes.append(None if ids is None else len(ids) // 4)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(flat))])
                exact = [None if text is None else back == text.encode() for text, back in zip(texts, model.decoded(values, ends), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([s is None for s in sizes]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int32()), lists, pa.array(exact, pa.bool_())], names=["doc_id", "n_ids", "ids", "exact"])
        give_back()

    return packed.mapInArrow(run, schema)


def decode_texts(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` for each row of ids; null ids give a null text."""
    name = _shipped(encoded.sparkSession, model_path)
    packed = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    schema = T.StructType([packed.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(SparkFiles.get(name))
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return packed.mapInArrow(run, schema)
