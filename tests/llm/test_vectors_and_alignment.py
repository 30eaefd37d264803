"""Quantiser, near-duplicate join and alignment against brute force and on odd tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from relafix import storage
from relafix.llm import alignment, gridjoin, quantise
from relafix.llm.queries import BYTE_MODEL, PIECE_MODEL

LONG = (1 << 63) - 1
VECTORS = "label int, vec_id long, embedding array<double>, code string, n long, hub long, pid long, blk long"


def vector_table(spark, rows):
    """Rows of (id, vector, label) under further columns whose names the operators use themselves."""
    return spark.createDataFrame([(label, i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2, 3, 4) for i, v, label in rows], VECTORS)


# --- 11: vector codes


def codes_by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The quantiser with whole numbers of any size."""
    from fractions import Fraction
    from math import floor, isfinite

    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = [[floor(Fraction(float(x)) * scale) for x in v] for _, v, _ in kept]
    w = len(q[0]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for x in q]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        groups = defaultdict(list)
        for x in cut:
            for p in range(parts):
                groups[p, nearest(x[p], books[p])[1]].append(x[p])
        for (p, e), members in groups.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for (i, _, label), x in zip(kept, cut, strict=True):
        best = [nearest(x[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    total = Counter()
    for _, _, error, label in out:
        total[label] += error
    return sorted(((i, code, min(error, LONG), min(total[label], LONG), digest) for i, code, error, label in out), key=repr)


def random_rows(seed, n, dim=16, labels=(0, 1, None)):
    rng = np.random.default_rng(seed)
    return [(int(i), rng.standard_normal(dim).round(3).tolist(), labels[i % len(labels)]) for i in rng.permutation(n)]


@pytest.mark.parametrize("size", [3, 16, 90])
def test_codes_by_hand(spark, size):
    rows = random_rows(size, size) + [(1000, None, 0), (1001, [float("nan")] * 16, 0), (1002, [None] + [0.5] * 15, 1), (1003, [float("inf")] * 16, None)]
    rows += [(500, [0.25] * 16, 7)] * 40 + [(None, [0.0] * 16, None), (None, [-0.3] * 16, None)]
    got = quantise.compress(vector_table(spark, rows).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == codes_by_hand(rows)


def test_codes_of_large_components(spark):
    """Beyond what 64-bit products hold, and up to sums of the largest integers."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(8) * 10.0 ** (i % 9)).tolist(), i % 2) for i in range(60)]
    got = quantise.compress(vector_table(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == codes_by_hand(rows)
    huge = quantise.compress(vector_table(spark, [(1, [1e300] * 8, 0), (2, [-1e300] * 8, 0), (3, [0.0] * 8, 0)]), entries=1, rounds=1).collect()
    assert {r["error"] for r in huge} == {LONG, 0} and all(r["label_error"] == LONG for r in huge)


def test_codes_of_odd_tables(spark):
    none = vector_table(spark, [])
    assert quantise.compress(none).count() == 0
    assert quantise.compress(vector_table(spark, [(1, None, 1), (2, [float("nan")], 1)])).count() == 0
    # five components become eight; a vector of another length goes
    got = quantise.compress(vector_table(spark, [(1, [1, 2, 3, 4, 5], 0), (2, [1, 2, 3, 4, 6], 0), (3, [1, 2], 0)])).collect()
    assert sorted((r["vec_id"], r["error"]) for r in got) == [(1, 0), (2, 0)]
    assert [r["code"] for r in quantise.compress(vector_table(spark, [(1, [], 0)])).collect()] == ["00" * 8]


# --- 12: near duplicates


def links_by_hand(rows, cosine=0.98):
    """(id, links, component, kept) for rows with different ids."""
    usable = {i: (label, np.array(v, float)) for i, v, label in rows if label is not None and i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = {i: set() for i, _, _ in rows}
    unit = {}
    for i, (label, v) in usable.items():
        v = v / np.abs(v).max()
        unit[i] = (label, v / np.linalg.norm(v))
    for i, (label, v) in unit.items():
        near[i] = {j for j, (other, u) in unit.items() if j != i and other == label and len(u) == len(v) and u @ v >= cosine}
    out = []
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        low = None if i is None else min(seen)
        out.append((i, len(near[i]), low, low == i))
    return sorted(out, key=repr)


def clustered(seed, n, dim, noise):
    """Groups of near copies of all sizes, chains, exact copies, and rows on their own."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(2, n // 12), dim))
    rows = []
    for i in rng.permutation(n):
        c = centres[int(len(centres) * rng.random() ** 3)]
        spread = (0.0, noise, noise * 4)[i % 3]
        v = c + spread * rng.standard_normal(dim) if i % 7 else rng.standard_normal(dim)
        rows.append((int(i), (v * 10.0 ** rng.integers(-3, 4)).tolist(), int(i % 2)))
    return rows


@pytest.mark.parametrize(("n", "dim", "block", "fan"), [(120, 3, 4, 2), (300, 8, 16, 4), (500, 24, 7, 3)])
def test_links_by_hand(spark, n, dim, block, fan):
    rows = clustered(n, n, dim, 0.05)
    got = gridjoin.near_duplicates(vector_table(spark, rows).repartition(4), block=block, fan=fan)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == links_by_hand(rows)


def test_links_of_one_large_group(spark):
    """A group of copies links as whole nodes; its count is exact all the same."""
    same = [0.1, 0.2, -0.3, 0.4]
    rows = [(i, same, 1) for i in range(3000)] + [(5000 + i, [2 * x for x in same], 1) for i in range(10)] + [(9000, same, 2)]
    got = {r["vec_id"]: r for r in gridjoin.near_duplicates(vector_table(spark, rows), block=64, fan=4).collect()}
    assert len(got) == 3011 and got[9000]["n_links"] == 0 and got[9000]["kept"]
    assert all(r["n_links"] == 3009 and r["component_id"] == 0 and r["kept"] == (i == 0) for i, r in got.items() if i != 9000)


def test_links_of_odd_vectors(spark):
    rows = [(1, [1e200, 0.0], 0), (2, [1e-300, 0.0], 0), (3, [1.0, 1e-9], 0), (4, [0.0, 0.0], 0), (5, None, 0), (6, [float("nan"), 1.0], 0), (7, [None, 1.0], 0), (8, [1.0, 0.0], None), (9, [float("inf"), 0.0], 0), (10, [1.0], 0), (11, [5.0], 0), (12, [], 0), (None, [1.0, 0.0], 0), (13, [-1.0, 0.0], 0)]
    got = gridjoin.near_duplicates(vector_table(spark, rows)).collect()
    want = links_by_hand([r for r in rows if r[0] is not None]) + [(None, 0, None, True)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert gridjoin.near_duplicates(vector_table(spark, [])).count() == 0
    assert [tuple(r) for r in gridjoin.near_duplicates(vector_table(spark, [(3, None, 1)])).collect()] == [(3, 0, 3, True)]
    # repeated rows link with each other, and an id in two places joins both components
    rows = [(5, [1, 0, 0], 0), (5, [1, 0, 0], 0), (5, [0, 1, 0], 0), (2, [1, 0.01, 0], 0), (9, [0, 1, 0.01], 0), (8, [0, 0, 1], 0)]
    got = sorted(tuple(r) for r in gridjoin.near_duplicates(vector_table(spark, rows)).collect())
    assert got == [(2, 2, 2, True), (5, 5, 2, False), (5, 5, 2, False), (5, 5, 2, False), (8, 0, 8, True), (9, 1, 2, False)]


# --- 13: alignment


def aligned_by_hand(rows):
    """From byte spans of all tokens and every overlapping pair."""
    a, b = alignment.ByteTokens(BYTE_MODEL), alignment.PieceTokens(PIECE_MODEL)
    found, count = [], Counter()
    for i, text in rows:
        sides, whole = [], (" " + (text or "")).encode()
        for side in (a, b):
            at, spans = 0, []
            for t in side.encode([text])[0] if text else []:
                spans.append((at, at + len(side.bytes[t]), t))
                at += len(side.bytes[t])
            sides.append(spans)
        if not text or any(b"".join(s.bytes[t] for *_, t in spans) != whole for s, spans in zip((a, b), sides, strict=True)):
            found.append((i, None))
            continue
        ends = [0, *sorted({e for _, e, _ in sides[0]} & {e for _, e, _ in sides[1]})]
        groups = ["|".join(",".join(str(t) for s, e, t in spans if lo <= s and e <= hi) for spans in sides) for lo, hi in zip(ends, ends[1:])]
        links = [(x, y) for s, e, x in sides[0] for s2, e2, y in sides[1] if s < e2 and s2 < e]
        count.update(set(links))
        found.append((i, (len(sides[0]), len(sides[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(n, highest.get(x, 0))
    zero = (0, 0, 0, 0, 0, 0, "")
    return sorted(((i, *(zero if f is None else (*f[:3], len(f[3]), sum(count[p] == highest[p[0]] for p in f[3]), sum(count[p] for p in f[3]), f[4]))) for i, f in found), key=repr)


TEXTS = ["plain words of a text", "  leading and trailing  ", "", None, "plain words of a text", "a▁b has the piece sign", "<|endoftext|> and <s> are text </s>", "naïve café 😀😀 日本語", "\x00\x01\t\n\r\n", "x" * 3000, "supercalifragilistic " * 300, "1234567890 12345", "<0x41>", "﻿bom", "ＦＵＬＬ ｗｉｄｔｈ"]


def test_alignment_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r["doc_id"], r["text"][:4000] if r["text"] else r["text"]) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, "no id"), (7, "twice"), (7, "twice")]
    table = spark.createDataFrame([(t, i, "x", 1, 2) for i, t in rows], "text string, doc_id long, pairs string, run long, count long").repartition(3)
    want = aligned_by_hand(rows)
    for at_once in (1 << 20, 500):
        got = alignment.align_tokenizers(table, BYTE_MODEL, PIECE_MODEL, at_once=at_once)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(w[1] > 0 for w in want) > 60


def test_runs_are_written_a_few_to_a_file(spark, monkeypatch):
    """Readers take thousands of rows of a file at once; a run is a row of a megabyte."""
    written = []

    def spy(df, name="stage", *bounds):
        written.append(storage.stage_table(df, name, *bounds))
        return written[-1]

    monkeypatch.setattr(alignment, "stage_table", spy)
    rows = [(i, f"some words of text {i}") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert alignment.align_tokenizers(table, BYTE_MODEL, PIECE_MODEL, at_once=1).count() == 50
    files = written[0].groupBy(F.input_file_name().alias("file")).count().collect()
    assert sum(f["count"] for f in files) == 50 and max(f["count"] for f in files) <= 16


def test_alignment_of_no_documents(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), BYTE_MODEL, PIECE_MODEL).count() == 0
    got = alignment.align_tokenizers(spark.createDataFrame([(1, None)], "doc_id long, text string"), BYTE_MODEL, PIECE_MODEL).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_both_encoders_agree():
    """The ranked encoder gives the ids of the other one, for documents, odd texts and long runs."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t] + [t for t in TEXTS if t]
    texts += ["x" * 50_000, " " * 20_000 + "a", "7" * 30_001, "\n \t" * 9_999, "日本語é" * 9_999, "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x11000)]))]
    ranked, other = alignment.ByteTokens(BYTE_MODEL), alignment.ByteTokens(BYTE_MODEL, ranked=False)
    assert "merged" in ranked.encode.__code__.co_freevars
    assert ranked.encode(texts) == other.encode(texts)


def test_transducer_steps():
    """Both sides lead in turn; differing bytes and tokens without bytes give nothing."""
    t = alignment.Transducer([b"ab", b"c", b"abc", b""], [b"a", b"bc", b"abcabc", b"x"])
    assert t.align([0, 1], [0, 1]) == ([0 << 32 | 0, 0 << 32 | 1, 1 << 32 | 1], ["0,1|0,1"])
    assert t.align([2, 2], [2]) == ([2 << 32 | 2, 2 << 32 | 2], ["2,2|2"])
    assert t.align([2, 0, 1], [0, 1, 0, 1]) is not None
    assert t.align([2], [3]) is None and t.align([2], [0]) is None and t.align([0], [2]) is None and t.align([3], []) is None
    assert t.align([], []) == ([], [])
