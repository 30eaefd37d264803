"""Each operator against brute force, and on nulls, empties, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relafix.llm import ann, chat, jaccard, mixing, pieces, pii, quality, tiff, toxicity, urlfilter
from relafix.llm.queries import PIECE_MODEL, URL_RULES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["size", "key", "pid", "row", "tie", "found", "told", "score", "label", "grp", "h", "n", "cid", "__text", "__id", "seen", "members", "page", "held_out"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, blanks, repeats, ties and a long text, under many further columns."""
    rows = [(1, "one two three four five six seven eight", "en", "a", 39), (1, "one two three four five six seven eight", "en", "a", 39), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "null id here with some words", "en", None, 5), (None, "null id here with some words", "en", None, 5), (5, " \n\t ", "fr", "b", 4), (6, "word " * 30_000, "en", "b", 150_000), (7, "ONE two three four five six seven eight", "en", "c", 39), (9007199254740993, "é ▁ 😀 <|im_end|>", "en", "c", 9)]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def labels_of(spark, rows=((1, 1, 0), (1, 0, 1), (5, 0, 0), (None, 1, 1), (7, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# --- 1: chat


def cheapest(roles):
    """Least cost by trying every way, with up to two empty turns before each turn and at the end."""
    legal = {0: "su", 1: "u", 2: "a", 3: "u"}
    state_of = {"s": 1, "u": 2, "a": 3}
    from functools import lru_cache

    @lru_cache(None)
    def go(i, state, inserted):
        best = 10**9
        if inserted < 3:
            for q in legal[state]:
                best = min(best, 3 + go(i, state_of[q], inserted + 1))
        if i == len(roles):
            return 0 if state in (0, 3) else best
        if state and not inserted:
            best = min(best, (1 if roles[i] == "?sua"[state] else 3) + go(i + 1, state, 0))
        for q in legal[state]:
            best = min(best, (0 if roles[i] == q else 2) + go(i + 1, state_of[q], 0))
        return best

    return go(0, 0, 0)


def test_chat_costs_are_least(spark):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    cases = [c for n in range(1, 5) for c in itertools.product("suax", repeat=n)]
    rows = [(i, t, names[r], f"{i}-{t}") for i, c in enumerate(cases) for t, r in enumerate(c)]
    out = chat.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    cost, text = {}, {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.seq)):
        cost[r.conv_id] = cost.get(r.conv_id, 0) + r.cost
        text[r.conv_id] = text.get(r.conv_id, "") + r.rendered
    for i, c in enumerate(cases):
        assert cost[i] == cheapest(c), c
        turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text[i], re.S)
        assert re.fullmatch("(system )?(user assistant )+", "".join(f"{r} " for r, _ in turns)), c
        assert [t for _, body in turns for t in body.split("\n") if t] == [f"{i}-{t}" for t in range(len(c))]


def test_chat_spans_partitions_alike(spark):
    rng = random.Random(3)
    roles = [rng.choice(["system", "user", "assistant", "user", "tool"]) for _ in range(3000)]
    rows = [(1, t, r, str(t)) for t, r in enumerate(roles)] + [(2, 0, "assistant", None), (None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pid", F.lit(0)).withColumn("seq", F.lit(1))
    out = {}
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out[n] = sorted(tuple(r) for r in chat.repair_conversations(df).select("conv_id", "seq", "repaired_turn", "cost", "rendered").na.fill(-1).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r[:3] for r in out["1"]] == [r[:3] for r in out["16"]]
    assert sum(r[3] for r in out["1"]) == sum(r[3] for r in out["16"])
    assert "".join(r[4] for r in out["16"]).count("<|im_start|>") == "".join(r[4] for r in out["16"]).count("<|im_end|>")
    assert chat.repair_conversations(df.limit(0)).count() == 0


# --- 2: toxicity


@pytest.mark.parametrize("full", [2, 12, 10**9])
def test_block_max_search_is_exact(monkeypatch, full):
    monkeypatch.setattr(toxicity, "_FULL", full)
    rng = np.random.default_rng(1)
    words, weight = np.arange(100, 130, dtype=np.uint64), rng.uniform(0, 5, 30)
    weight[:3] = 0

    def text():
        return np.sort(rng.choice(words, rng.integers(1, 6), replace=False)), rng.integers(1, 4, 6)

    def unit(hashes, counts):
        x = np.zeros(30)
        x[(hashes - 100).astype(int)] = (1 + np.log(counts[: len(hashes)])) * weight[(hashes - 100).astype(int)]
        return x / (np.linalg.norm(x) or 1)

    examples = [(i, int(rng.integers(2)), h, c[: len(h)]) for i in range(500) for h, c in [text()]]
    index = toxicity.build_index(examples, words, weight, 0.3, block=16)
    by_id = {i: unit(h, c) for i, _, h, c in examples}
    dense = np.array([by_id[i] for i in index.ids])
    assert len(dense) == sum(v.any() for v in by_id.values())
    assert all(np.allclose(w, dense[p][t]) and (np.flatnonzero(dense[p]) == t[w > 0]).all() for p, (t, w) in enumerate(toxicity._example_vectors(index)))
    for _ in range(200):
        h, c = text()
        _, terms, w = index.vectors(np.zeros(len(h), int), h, c[: len(h)])
        scores = dense @ unit(h, c)
        want = [i for i in np.lexsort((np.arange(len(scores)), -scores)) if scores[i] > 1e-12][:10]
        places, cosines = index.nearest(terms, w, 10)
        assert np.allclose(cosines, scores[want]) and np.allclose(scores[places], scores[want])


def test_toxicity_matches_brute_force(spark, odd_docs):
    """All weights, cosines, votes and the calibration, by plain loops over the small tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, re.findall(r"[^\W_]+", (r.text or "").lower())) for r in docs.collect()]
    label = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    train = [(i, label[i], w) for i, w in rows if i in label]
    df, seen, n = {}, ({}, {}), [sum(y == v for _, y, _ in train) for v in (0, 1)]
    for _, words in rows:
        for t in set(words):
            df[t] = df.get(t, 0) + 1
    for _, y, words in train:
        for t in set(words):
            seen[y][t] = seen[y].get(t, 0) + 1
    rate = (n[1] + 0.5) / (sum(n) + 1)

    def vector(words):
        out = {}
        for t in set(words):
            odds = (seen[1].get(t, 0) + 10 * rate) / (seen[0].get(t, 0) + 10 * (1 - rate)) * (1 - rate) / rate
            out[t] = (1 + np.log(words.count(t))) * (np.log((1 + len(rows)) / (1 + df[t])) + 1) * abs(np.log(odds))
        size = np.sqrt(sum(v * v for v in out.values()))
        return {t: v / size for t, v in out.items()} if size else {}

    examples = [(i, y, vector(w)) for i, y, w in train]

    def nearest(words, skip=None):
        x = vector(words)
        scored = [(sum(v * e[2].get(t, 0.0) for t, v in x.items()), e[1]) for e in examples if e[0] != skip]
        return sorted((s for s in scored if s[0] > 1e-12), key=lambda s: -s[0])[:15]

    def vote(found):
        w = [1 / (1.05 - min(1.0, s)) - 1 / 1.05 for s, _ in found]
        return (sum(a * y for a, (_, y) in zip(w, found, strict=True)) + 0.3 * rate) / (sum(w) + 0.3)

    model = toxicity.fit(np.array([[vote(nearest(w, i))] for i, _, w in train]), np.array([float(y) for _, y, _ in train]), l2=0.1)
    out = toxicity.score_toxicity(docs, labels).collect()
    key = lambda x: -1 if x is None else x
    got = sorted((key(r.doc_id), r.score, [e.cosine for e in r.evidence]) for r in out)
    want = sorted((key(i), float(toxicity.sigmoid(model.z(np.array([[vote(f)]])))[0]), [s for s, _ in f]) for i, w in rows for f in [nearest(w)])
    for (i, score, cosines), (j, score_, cosines_) in zip(got, want, strict=True):
        assert i == j and len(cosines) == len(cosines_) and np.allclose(cosines, cosines_, atol=1e-7)
        assert abs(score - score_) < 0.01


def test_long_clean_text_with_one_insult(spark):
    rng = random.Random(5)
    clean = [f"w{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choices(clean, k=60) + (["idiot"] * 3 if toxic else [])), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, " ".join(rng.choices(clean, k=9000) + ["idiot"]), "en", "s", 1), (5001, "You, IDIOT!", "en", "s", 1)]
    out = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, DOCS), labels_of(spark, labels)).where("doc_id >= 5000").collect()}
    assert out[5000].predicted == 0 and out[5001].predicted == 1 and max(e.cosine for e in out[5000].evidence) < 0.5


def test_toxicity_learns_only_from_its_fold(spark):
    rng = random.Random(0)
    bad = ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.3
        words = [rng.choice("the of and to in for with on".split()) for _ in range(30)] + ([rng.choice(bad)] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1))
        # labels of the held-out fold are turned round: they must not matter
        labels.append((i, 1, int(toxic) if zlib.crc32(str(i).encode()) % 5 else int(not toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    out = toxicity.score_toxicity(docs, labels_of(spark, labels)).collect()
    truth = {i: any(b in t.split() for b in bad) for i, t, *_ in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    out = toxicity.score_toxicity(odd_docs, labels_of(spark)).collect()
    assert len(out) == odd_docs.count() and all(r.score is not None for r in out)
    assert {r.doc_id for r in out} == {1, 2, 3, None, 5, 6, 7, 9007199254740993}
    assert toxicity.score_toxicity(no_docs, labels_of(spark).limit(0)).count() == 0


# --- 3: mixing


def water(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check_mix(df):
    rows = df.collect()
    out = mixing.mix_sources(df).collect()
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((r.doc_id or -1, len(WORD.findall(r.text or ""))) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want = water(sizes)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in taken)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(df.repartition(3)).collect()))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    kept = mixed.collect()
    assert sum(len(WORD.findall(r.text or "")) for r in kept) == sum(r.taken for r in out)
    texts = [r.text or "" for r in rows]
    assert all(any(t.startswith(r.text or "") for t in texts) for r in kept)


def test_mixing(spark, odd_docs, no_docs):
    check_mix(spark.read.parquet(f"{SF}/documents.parquet"))
    check_mix(odd_docs)
    assert mixing.mix_sources(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


# --- 4: nearest neighbours


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16))
    x[100:140] = x[100]  # one vector many times
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (None, [1.0] * 16), (2080, [1.0] * 3), (2100, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("rank", F.lit(1))
    out = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 20)) and all(len(v) == 20 for v in found.values())
    hits = 0
    for q, got in found.items():
        scores = x @ x[q]
        want = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        assert [i for i, _ in got] == [i for i, _ in sorted(got, key=lambda p: (-p[1], p[0]))]
        assert np.allclose([s for _, s in got], scores[[i for i, _ in got]])
        hits += len(set(want) & {i for i, _ in got})
    assert hits >= 0.95 * 20 * len(found)
    few = ann.nearest_neighbours(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("length", [3e3, 1e25, 1e200])
def test_neighbours_beside_one_long_vector(spark, length):
    x = np.random.default_rng(1).standard_normal((1500, 16))
    x[7] *= length / np.linalg.norm(x[7])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 1500, 20):
        scores = x @ x[q]
        want = [i for i in np.argsort(-scores) if i != q][:20]
        hits += len(set(want) & found[q])
        assert (7 in want) == (7 in found[q])
    assert hits >= 0.95 * 20 * len(found)


def test_neighbours_of_lengths_of_all_sizes(spark):
    """Lengths spread over forty powers of ten: the longest ones of a query's side are nearest."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16)) * 10.0 ** rng.uniform(-20, 20, 1500)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(set([i for i in np.argsort(-(x @ x[q])) if i != q][:20]) & found[q]) for q in range(0, 1500, 20))
    assert hits >= 0.95 * 20 * 75


# --- 5: TIFF


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(compression)
    for kind, order in itertools.product((np.uint8, np.uint16), "<>"):
        pages = [rng.integers(0, 6, (37, 53)).astype(kind), rng.integers(0, 200, (70, 64)).astype(kind)]
        read = list(tiff.pages_of(tiff.encode(pages, compression, predictor, tile, 7, order)))
        assert [p["page"] for p in read] == [0, 1]
        for page, got in zip(pages, read, strict=True):
            assert got["error"] is None and got["samples"] == page.astype(page.dtype.newbyteorder(order)).tobytes()


def test_tiff_codecs_on_random_data():
    data = np.random.default_rng(0).integers(0, 256, 40_000).astype(np.uint8).tobytes()
    for text in (data, b"", b"a", b"aaaa" * 5000, b"ab" * 3000):
        assert tiff.lzw_expand(tiff.lzw_compress(text), len(text)) == text
        assert tiff.unpack_bits(tiff.pack_bits(text), len(text)) == text


def test_tiff_damaged_files(spark):
    good = tiff.encode([np.arange(64, dtype=np.uint8).reshape(1, 64)])
    files = spark.createDataFrame([(1, None), (2, b""), (3, b"not a file"), (4, good[:-8]), (5, good), (5, good)], "id int, media binary").withColumn("page_no", F.lit(1))
    out = tiff.read_pages(files, keep=("id",)).collect()
    assert sorted(r.id for r in out) == [1, 2, 3, 4, 5, 5]
    assert all((r.error is None) == (r.id == 5) for r in out)


def test_media_digest(odd_docs, no_docs):
    out = tiff.media_digest(odd_docs).collect()
    assert len(out) == odd_docs.count()
    want = []
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        body = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((r.doc_id or -1, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:])))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == sorted(want)
    assert tiff.media_digest(no_docs).count() == 0


# --- 6: n-gram Jaccard


def shingles(text, n):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_join(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    parent, links, index = list(range(len(rows))), [0] * len(rows), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        overlap = {}
        for g in s:
            for j in index.setdefault(g, []):
                overlap[j] = overlap.get(j, 0) + 1
            index[g].append(i)
        for j, o in overlap.items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    key = lambda x: -1 if x is None else x
    return sorted((key(d), len(sets[i]), key(low.get(find(i)) if sets[i] else d), links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "num", "rows_in_block"), [(3, 90, 512), (5, 80, 512), (3, 90, 7)])
def test_jaccard_matches_brute_force(spark, odd_docs, monkeypatch, n, num, rows_in_block):
    monkeypatch.setattr(jaccard, "_BLOCK_ROWS", rows_in_block)
    rng = random.Random(n)
    voc = [f"w{i}" for i in range(30)]
    base = [[rng.choice(voc) for _ in range(rng.randint(1, 60))] for _ in range(40)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for i in range(500):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(voc)
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.lit(1)).withColumn("h", F.lit(1))
    out = jaccard.jaccard_join(df, n=n, num=num).collect()
    key = lambda x: -1 if x is None else x
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id), r.n_links) for r in out) == brute_join(rows, n, num, 100)


def test_drop_near_duplicates(odd_docs, no_docs):
    out = jaccard.drop_near_duplicates(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 2, 3, 5, 6, 9007199254740993]
    assert jaccard.jaccard_join(no_docs).count() == 0 and jaccard.drop_near_duplicates(no_docs).count() == 0


# --- 7: quality


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = quality.score_quality(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    assert sum((r.quality_score >= 0.5) == (r.quality == 1) for r in out) >= 0.95 * len(out)
    assert all(r.quality_score >= 0.5 for r in out if r.quality == 1)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    out = quality.score_quality(odd_docs, labels_of(spark))
    assert out.count() == odd_docs.count() and out.where("quality_score is null").count() == 0
    assert quality.reject_low_quality(odd_docs, labels_of(spark)).columns == odd_docs.columns
    assert quality.score_quality(no_docs, labels_of(spark).limit(0)).count() == 0
    assert {r.quality_score for r in quality.score_quality(odd_docs, labels_of(spark).limit(0)).collect()} == {0.5}
    bare = odd_docs.select("doc_id", "text")
    scores = {}
    for r in quality.score_quality(bare, labels_of(spark)).collect():
        scores.setdefault((r.doc_id, r.text), set()).add(r.quality_score)
    assert len(scores) == 8 and all(len(s) == 1 for s in scores.values())


def test_views_share_nothing():
    x = quality._features(["a text", "another, longer text"], ["en", "en"], ["s", "s"], [5.0, 5.0])
    assert (x[0, quality._N_CONTENT :] == x[1, quality._N_CONTENT :]).all()
    x = quality._features(["a text", "a text"], ["en", "de"], ["s", None], [5.0, None])
    assert (x[0, : quality._N_CONTENT] == x[1, : quality._N_CONTENT]).all() and (x[0] != x[1]).any()


def test_quality_pool_is_the_whole_table(spark, monkeypatch):
    monkeypatch.setattr(quality, "_ROWS", 100)
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(20.0).alias("n_chars"))
    seen = []
    monkeypatch.setattr(quality, "co_train", lambda x, y, pool, *_: seen.append((len(y), pool.total(lambda x, lot: np.array([float(len(x)), x.sum(), len(set(lot))])))) or quality.CoTrained(*[None] * 4))
    quality.score_quality(docs, labels_of(spark, [(i, i % 2, 0) for i in range(50)]))
    (labelled, (n, _, lots)), = seen
    assert labelled == 50 and n == 11_950 and lots > 11_000


def co_train_by_hand(x, y, pool, aside, rounds, sure=0.9, trust=0.5):
    """The exchange with explicit lists of pseudo-labels; every sure row is taken at once."""
    odds = lambda p: np.log(p / (1 - p))
    loss = lambda z, y: np.logaddexp(0, np.where(y > 0, -z, z)).mean()
    rate = y.mean()
    least = {1: odds(max(sure, 1 - (1 - rate) / 2)), 0: odds(max(sure, 1 - rate / 2))}
    views = [quality.fit(x[~aside][:, c], y[~aside]) for c in quality._CUT]
    base = loss(np.full(aside.sum(), np.log((y[aside].sum() + 0.5) / (aside.sum() - y[aside].sum() + 0.5))), y[aside])

    def judged(views):
        lines = [quality.fit(v.z(x[aside][:, c])[:, None], y[aside]) for v, c in zip(views, quality._CUT)]
        return lines, [loss(line.z(v.z(x[aside][:, c])[:, None]), y[aside]) for v, c, line in zip(views, quality._CUT, lines)]

    lines, losses = judged(views)
    given, free, done = [dict(), dict()], set(range(len(pool))), 0
    for _ in range(rounds):
        new = [dict(), dict()]
        for me, c in enumerate(quality._CUT):
            if (base - losses[me]) * aside.sum() <= 3.32:
                continue
            z = lines[me].z(views[me].z(pool[:, c])[:, None])
            for i in free:
                if z[i] >= least[1] or -z[i] >= least[0]:
                    new[1 - me][i] = float(z[i] >= least[1])
        if not new[0] and not new[1]:
            break
        after, tried = [], [given[v] | new[v] for v in (0, 1)]
        for v, c in enumerate(quality._CUT):
            rows = sorted(tried[v])
            n = (~aside).sum()
            weight = np.append(np.ones(n), np.full(len(rows), trust * min(1, n / max(1, len(rows)))))
            after.append(quality.fit(np.vstack([x[~aside], pool[rows]])[:, c], np.append(y[~aside], [tried[v][i] for i in rows]), weight))
        lines_after, losses_after = judged(after)
        if any(b > a + 1e-9 for a, b in zip(losses, losses_after)):
            break
        views, given, lines, losses, free, done = after, tried, lines_after, losses_after, free - set(new[0]) - set(new[1]), done + 1
    return views, given, done


@pytest.mark.parametrize(("seed", "tells"), [(1, 1.0), (2, 1.0), (3, 0.0), (4, 0.3)])
def test_quality_exchange_by_hand(seed, tells):
    """Both views agree with the loop by hand; a view that tells nothing teaches nothing."""
    rng = np.random.default_rng(seed)
    y, hidden = (rng.random(400) < 0.7).astype(float), (rng.random(600) < 0.7).astype(float)

    def features(y):
        x = rng.standard_normal((len(y), quality._width()))
        x[:, 0] += 2.5 * y
        x[:, quality._N_CONTENT] += 3 * tells * y
        return x

    x, pool, aside = features(y), features(hidden), np.arange(400) % 4 == 0
    views, given, done = co_train_by_hand(x, y, pool, aside, 3)
    model = quality.co_train(x, y, pool, aside, rounds=3, share=1.0)
    for want, got, c in zip(views, (model.content, model.metadata), quality._CUT):
        assert np.allclose(want.z(pool[:, c]), got.z(pool[:, c]), atol=1e-3)
    assert tells or not given[0]
    if seed == 1:
        assert done and given[0] and given[1]


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_quality_exchange_does_no_harm(size):
    """Accuracy on the held-out fifth with the exchange is at least that without."""
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{SF[:-5]}{size}/documents.parquet").to_pandas()
    labels = pq.read_table(f"{SF[:-5]}{size}/labels.parquet").to_pandas().set_index("doc_id")["quality"]
    x = quality._features(docs["text"], docs["lang"], docs["source"], docs["n_chars"]).astype(float)
    y = docs["doc_id"].map(labels).to_numpy(float)
    crc = np.array([zlib.crc32(str(i).encode()) for i in docs["doc_id"]])
    train, test = ~np.isnan(y) & (crc % 5 != 0), ~np.isnan(y) & (crc % 5 == 0)
    right = {}
    for rounds in (0, 4):
        model = quality.co_train(x[train], y[train], x[np.isnan(y)], (crc % quality._KEEP_ASIDE == 0)[train], rounds)
        right[rounds] = ((model.scores(x[test])[0] >= 0.5) == (y[test] == 1)).mean()
    assert right[4] >= right[0] >= 0.95


def test_quality_fit_by_sums(monkeypatch):
    rng = np.random.default_rng(0)
    width = quality._width()
    true = rng.standard_normal(width)
    x, pool = rng.standard_normal((300, width)), rng.standard_normal((3000, width))
    y = (x @ true > 0).astype(float)
    views = [quality.fit(x[:, c], y) for c in quality._CUT]
    rows = quality.Rows(pool)
    past = [quality._take(rows, views, [], 150, (0.9, 0.9))]
    labels, free = quality._given(pool, rows.lot, past, (0.9, 0.9))
    taken = (labels >= 0).any(axis=0)
    assert (free == ~taken).all() and 300 < taken.sum() <= 620
    for v, got in enumerate(quality._fit_views(x, y, rows, past, (0.9, 0.9), 0.5)):
        own = labels[v] >= 0
        c, weight = quality._CUT[v], np.append(np.ones(300), np.full(own.sum(), 0.5 * min(1, 300 / own.sum())))
        want = quality.fit(np.vstack([x, pool[own]])[:, c], np.append(y, labels[v][own]), weight)
        assert np.allclose(got.weights, want.weights, atol=1e-5) and np.allclose(got.mean, want.mean)


# --- 8: url filters


def test_url_filters(spark):
    rng = random.Random(2)
    hosts = ["example.com", "a.Example.com", "com", "x.com", "example.net", "y.example.net", "org", "o.org", "notcom", "example.com.", "", "b.net:80"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/7', '/en/71?q#f', '/de/8', '/de/', '/es/x', '?a=/en/', '#/en/'])}" for _ in range(400)]
    urls += [None, "", "no scheme/en/", "://com/en/", "http://com/en/http://org/es/"]
    df = spark.createDataFrame([(i % 300, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("z")).withColumn("row", F.lit(1)).withColumn("key", F.lit(1))
    out = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urlfilter.filter_urls(df, urlfilter.rule_table(spark, URL_RULES)).collect())
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "", "allow"))
        want.append((i % 300, host, path, best[1], best[2]))
    assert out == sorted(want)
    empty = urlfilter.rule_table(spark, URL_RULES).limit(0)
    assert {r.verdict for r in urlfilter.filter_urls(df, empty).collect()} == {"allow"}
    assert urlfilter.filter_urls(df.limit(0), urlfilter.rule_table(spark, URL_RULES)).count() == 0


@pytest.mark.parametrize("parts", ["1", "13"])
def test_nested_rules_in_the_sweep(spark, parts):
    rng = random.Random(7)
    hosts, steps = ["a", "b.a", "c.b.a", "xa", "d.a"], ["/", "/x", "/x/", "/x/y", "/x/y/z", "/x/yy", "/w", "", "/x/\U0010ffff"]
    rules = sorted({(h, p): (rng.choice(["allow", "block"]), h, p) for h in hosts for p in steps if rng.random() < 0.7}.values())
    urls = [f"s://{rng.choice(hosts)}{rng.choice(steps)}{rng.choice(['', 'q', '/q', chr(0x10FFFF) * 3, '?'])}" for _ in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), urlfilter.rule_table(spark, rules)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for i, u in enumerate(urls):
        host, path = re.match(r"s://([^/?]*)([^?]*)", u).groups()
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow")), u


# --- 9: personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_spans(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_match_plain_patterns(spark, odd_docs):
    rng = random.Random(1)
    bits = ["a", "b@", "c.d", "@x.y", "1", "23", "456", ".", "-", " ", "+", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "001.2.3.4.5.6.7.8", "+1 (555) 123-4567", "é", "😀", "_", "%", "\n", "99", "(", ")"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(1500)]
    rows += [(5000, "a.b@c.d " * 2000), (5001, "a@b.c_d@e.f"), (5002, "9" * 50_000)] + [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = pii.personal_data_digest(spark.createDataFrame(rows, "doc_id long, text string"), support=10**6).collect()
    want = sorted((-1 if i is None else i, hashlib.sha256(brute_spans(t).encode()).hexdigest(), brute_spans(t)) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.base_sha256, r.spans) for r in out) == want


def test_disclosing_terms(spark, odd_docs, no_docs):
    rows = [(i, f"filler{i} words here alpha{i} beta{i} Zorblatt gamma{i} joe.smith@corp.com delta{i} epsilon{i} tail") for i in range(6)]
    rows += [(100 + i, f"plain text number{i} here and words tail corp") for i in range(200)] + [(999, "a mention of zorblatt alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).withColumn("found", F.lit(1)).withColumn("told", F.lit(2))
    told = {r.doc_id: r.spans for r in pii.personal_data_digest(df).collect()}
    assert told[999] == "term:13:21" and told[0] == "term:32:40,email:48:66" and told[100] == ""
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert "orblatt" not in clean[0].text and "[EMAIL]" in clean[0].text and clean[0].n_chars == len(clean[0].text) and clean[100].text == rows[6][1]
    general = {r.doc_id: r.text for r in pii.sanitise(df, remove_at=2.0).collect()}
    assert general[999] == "a mention of [EMAIL TERM] alone" and "[EMAIL TERM]" in general[0]
    assert pii.sanitise(odd_docs).columns == odd_docs.columns and pii.sanitise(odd_docs).count() == odd_docs.count()
    assert pii.sanitise(no_docs).count() == 0 and pii.personal_data_digest(no_docs).count() == 0


def test_disclosing_terms_of_whole_documents(spark):
    far = lambda i: " ".join(f"filler{i}x{j}" for j in range(30))
    rows = [(i, f"Zorblatt {far(i)} joe.smith@corp.com {far(i)} Li") for i in range(6)]
    rows += [(10 + i, f"Kim pat@corp.com {far(10 + i)}") for i in range(6)] + [(20 + i, f"{far(20 + i)} sam@corp.com 7even") for i in range(6)]
    rows += [(100 + i, f"plain text number{i} here and words tail corp") for i in range(300)] + [(999, "zorblatt li kim 7even alone")]
    told = {r.doc_id: r.spans for r in pii.personal_data_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert told[999] == "term:0:8,term:9:11,term:12:15,term:16:21" and told[100] == ""
    # copies of one text are one context
    copies = [(i, f"Zorblatt {far(0)} joe.smith@corp.com") for i in range(6)] + rows[18:-1]
    assert not any("term" in r.spans for r in pii.personal_data_digest(spark.createDataFrame(copies, "doc_id long, text string")).collect())


# --- 10: pieces


def full_viterbi(scores, unknown, chars):
    """The best path over all pairs of boundaries of the whole text."""
    longest = max(map(len, scores))
    best = [(0.0, 0)] + [None] * len(chars)
    for i in range(len(chars)):
        for j in range(i + 1, min(len(chars), i + longest) + 1):
            score = scores.get(chars[i:j])
            score = unknown if score is None and j == i + 1 else score
            if score is not None and (best[j] is None or best[i][0] + score > best[j][0]):
                best[j] = (best[i][0] + score, i)
    out, at = [], len(chars)
    while at:
        out.append((best[at][1], at))
        at = best[at][1]
    return out[::-1]


def test_streaming_search_is_the_full_search():
    rng = random.Random(0)
    toy = ["a", "b", "ab", "ba", "aab", "bbab", "abab", "▁", "▁a", "b▁a", "▁▁"]
    for seed in range(5):
        scores = {p: random.Random(seed * 100 + i).choice([-1.0, -2.0, -1.5, -3.0]) for i, p in enumerate(toy)}
        model = pieces.PieceModel([(p, s, i) for i, (p, s) in enumerate(scores.items())], list(range(100, 356)))
        for _ in range(300):
            chars = "".join(rng.choice("ab▁c") for _ in range(rng.randint(0, 90)))
            assert list(model.stream(chars)) == full_viterbi(scores, model.unknown, chars)


def test_remembered_ways_are_those_of_the_search():
    """Ids with the memo are those of one search, also where pieces span the places at which words are remembered."""
    rng = random.Random(1)
    toy = ["a", "b", "ab", "ba", "aab", "bbab", "▁", "▁a", "b▁a", "b▁", "▁▁", "a▁▁b", "\ta", "b\t"]
    for seed in range(8):
        draw = random.Random(seed)
        scores = {p: draw.choice([-1.0, -2.0, -3.0, -4.0]) for p in draw.sample(toy, 9)}
        model = pieces.PieceModel([(p, s, i) for i, (p, s) in enumerate(scores.items())], list(range(100, 356)), cache=40)
        for _ in range(300):
            text = "".join(rng.choice("aaabbb  \t\nc") for _ in range(rng.randint(1, 60)))
            want = []
            for a, b in full_viterbi(scores, model.unknown, model.chars(text)):
                piece = model.chars(text)[a:b]
                want += [model.ids[piece]] if piece in model.ids else [model.byte_ids[x] for x in piece.encode()]
            assert list(model.encode(text)) == want, (scores, text)


def test_prose_is_committed_while_it_streams(spark):
    """The search over whole texts, without the memo, commits prose word by word and holds no more than a few widths."""
    model = pieces.PieceModel.load(PIECE_MODEL)
    for text in [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 500 and 3000").limit(20).collect()]:
        chars, bare, last = model.chars(text), [], 0
        stream = model.stream(chars, 0, bare)
        for start, end in stream:
            assert start == last and len(stream.gi_frame.f_locals["score"]) <= 8 * model.width
            last = end
        assert last == len(chars) and len(bare) > len(text.split(" ")) / 2
        assert set(bare) >= {i for i in range(1, len(chars)) if chars[i] == "▁" != chars[i - 1]}


def test_window_stays_bounded():
    model = pieces.PieceModel([("a", -5.0, 0), ("b", -5.0, 1), ("ab", -1.0, 2), ("ba", -1.2, 3)], list(range(100, 356)))
    stream, last, held = model.stream("ab" * 3000), 0, 0
    for start, end in stream:
        assert start == last
        last = end
        held = max(held, len(stream.gi_frame.f_locals["score"]))
    assert last == 6000 and held <= 8 * model.width


@pytest.mark.parametrize("cache", [3, 500_000])
def test_pieces_of_the_real_model(spark, cache):
    """Ids through word runs and the memo against one plain search over the whole text."""
    model = pieces.PieceModel.load(PIECE_MODEL)
    model.cache_size = cache
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    scores = {w: p.get_score(i) for w, i in model.ids.items()}
    names = {i: w for w, i in model.ids.items()}
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1200").limit(40).collect()]
    texts += ["", " ", "  two  spaces ", "\t\n\r mixed\n\n", "é ▁ 😀 ﷺ", "a" * 400, "ab " * 200, "x" * 50 + "\n" + "x" * 50]
    for text in texts * 2:
        chars = "▁" + text.replace("▁", "\udfff").replace(" ", "▁") if text else ""
        want = []
        for a, b in full_viterbi(scores, model.unknown, chars):
            piece = chars[a:b]
            want += [model.ids[piece]] if piece in model.ids else [model.byte_ids[x] for x in piece.replace("\udfff", "▁").encode()]
        got = list(model.encode(text))
        assert got == want and model.decode(got) == text, text[:50]
    assert names


def test_pieces_round_trip(spark, odd_docs, no_docs):
    out = pieces.encode_texts(odd_docs, PIECE_MODEL)
    assert out.where("not exact").count() == 0
    back = pieces.decode_texts(out, PIECE_MODEL)
    assert sorted(map(str, back.select("text").collect())) == sorted(map(str, odd_docs.select("text").collect()))
    assert out.where("ids is null").select("doc_id").collect()[0].doc_id == 2
    assert pieces.encode_texts(no_docs, PIECE_MODEL).count() == 0


def test_pieces_part_where_no_piece_spans():
    """Signs that no piece joins to a letter are looked up apart, and words in use outlive a full memory."""
    model = pieces.PieceModel([("▁", -1.0, 0), ("a", -1.0, 1), ("b", -2.0, 2), ("ab", -1.5, 3), (".", -1.0, 4), ("..", -1.5, 5), ("(a", -1.0, 6), ("b'", -1.0, 7)], list(range(100, 356)), cache=8)
    assert model.words("▁ab...▁(ab'.▁é") == ["▁ab", "...", "▁(ab'", ".", "▁é"]
    for text in ("ab ab. ab.. ab... (ab'.", "é(a.b' ab'ab", "..ab"):
        chars = model.chars(text)
        found = [chars[start:end] for start, end in model.stream(chars)]
        wanted = [i for p in found for i in ([model.ids[p]] if p in model.ids else [model.byte_ids[x] for x in p.encode()])]
        assert list(model.encode(text)) == wanted and model.decode(model.encode(text)) == text
    for i in range(20):
        model.encode("ab " + "a" * (i + 2))
    assert "▁ab" in model.cache or "▁ab" in model.older


def test_only_missing_words_are_searched(monkeypatch):
    """A text with a new word searches that word alone; pieces that their own parts beat are not searched for; lists decode together."""
    import pyarrow as pa

    model = pieces.PieceModel([("▁", -1.0, 0), ("a", -1.0, 1), ("b", -1.0, 2), ("ab", -2.0, 3), ("ba", -3.0, 4), ("▁a", -1.0, 5)], list(range(100, 356)))
    assert dict(model._undominated({"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -3.0})) == {"a": -1.0, "b": -1.0, "ab": -2.0}
    searched, search = [], model._searched
    monkeypatch.setattr(model, "_searched", lambda chars, begin, least: searched.append(chars[begin:least]) or search(chars, begin, least))
    texts = ["ab ba", "ab bab ba é", "", " ", "\t"]
    packed = [model.packed(t) for t in texts]
    assert searched[:4] == ["▁ab", "▁ba", "▁bab", "▁é"]
    plain = [model.encode(t).tolist() for t in texts]
    ends = [sum(map(len, plain[:i])) for i in range(len(plain) + 1)]
    values = pa.array([i for ids in plain for i in ids], pa.int32())
    assert [list(memoryview(p).cast("i")) for p in packed] == plain and plain[1] == [5, 2, 0, 2, 3, 0, 2, 1, 0, 295, 269]
    assert list(model.decoded(values, ends)) == [t.encode() for t in texts]
    assert list(model.decoded(values[:0], [0, 0, 0])) == [b"", b""]
    empty = pa.Array.from_buffers(pa.int32(), 0, [None, pa.py_buffer(b"")])
    assert list(model.decoded(empty, [0, 0])) == [b""]
