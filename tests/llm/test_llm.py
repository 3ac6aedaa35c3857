"""Each operator of the subpackage against brute force, a library or a round trip, and
on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing
column names."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, chat, html_text, langid, ngram_join, packing, pivots, topk, toxicity, urls

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("word_bpe_49k.json")


# top-k


def brute_top(rows, k, every):
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: v for i, v in sorted(sound, key=lambda r: r[1], reverse=True) if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def test_top_k_is_exact(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.choice((-0.5, -0.25, 0.0, 0.25, rng.uniform(-1, 1))) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (304, []), (None, [1.0] * 6), (10, [0.5] * 6), (10, [0.25] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    exact = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v in rows]
    got = {tuple(r) for r in topk.search(df, df.where("vec_id % 10 = 0")).collect()}
    assert got == brute_top(exact, 5, 10)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    assert topk.search(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2


def test_top_k_of_large_components_and_every_width(spark, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(topk, "BLOCK", 32)
    big = [(i, [rng.choice((-1, 1)) * (2.0**30 + rng.randrange(3) * 128) for _ in range(8)]) for i in range(100)]
    huge = [(i, [rng.choice((-1, 1)) * rng.choice((3e38, 1.0, 2.0**64)) for _ in range(3)]) for i in range(100, 150)]
    small = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(150, 200)]
    df = spark.createDataFrame(big + huge + small, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk.search(df, df.where("vec_id % 10 = 0")).collect()}
    expected = set()
    for part in (big, huge, small):
        expected |= {(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute_top([(i, [float(np.float32(x)) for x in v]) for i, v in part], 5, 10)}
    assert got == expected


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (80, 5))
    lists, q = topk.Lists(x, np.arange(80)), rng.integers(-50, 50, (7, 5)).astype(float)
    for depth in (1, 5, 40, 80):
        low, high = lists.bounds(q, depth, np.arange(80))
        assert (low <= q @ x.T).all() and (q @ x.T <= high).all()
    assert (low == high).all()


def test_reading_stops_early_and_loses_nothing():
    rng = np.random.default_rng(14)
    x, q = rng.integers(-60, 60, (900, 12)), rng.integers(-60, 60, (20, 12)).astype(float)
    x[7] = x[8] = q[0]
    ids = np.arange(900)
    kth = np.sort(q @ x.T, axis=1)[:, -6].astype(float)
    depths = []
    for known in (None, kth):
        got = {}
        for at, found, scores, depth in topk.Lists(x, ids).search(q, np.full(20, -1), 5, known):
            got[at] = list(zip(found.tolist(), scores.tolist()))
            depths.append(depth)
        for i in range(20):
            scored = sorted(zip((-(q[i] @ x.T)).astype(int).tolist(), ids.tolist()))[:5]
            assert got[i] == [(j, -s) for s, j in scored]
    assert min(depths[20:]) < 1 and np.mean(depths[20:]) < np.mean(depths[:20])


# packing


def brute_padding(lengths, counts, buckets):
    best = None
    n = len(lengths)
    for mask in range(1 << (n - 1)):
        if bin(mask).count("1") < buckets:
            bounds = [lengths[i] for i in range(n) if i == n - 1 or mask >> i & 1]
            waste = sum(c * (min(b for b in bounds if b >= v) - v) for v, c in zip(lengths, counts))
            best = waste if best is None else min(best, waste)
    return best


def test_buckets_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 10)
        lengths = sorted(rng.sample(range(0, 200), n))
        counts = [rng.randint(1, 30) for _ in lengths]
        k = rng.randint(1, 5)
        bounds = packing.optimal(np.array(lengths), np.array(counts), k)
        assert len(bounds) <= k and bounds[-1] == lengths[-1]
        assert sum(c * (min(b for b in bounds if b >= v) - v) for v, c in zip(lengths, counts)) == brute_padding(lengths, counts, k)


def test_bounds_are_optimal_and_exact_for_long_rows(spark):
    rng = random.Random(10)
    lengths = sorted(rng.sample(range(257, 30000), 11))
    counts = [rng.randint(1, 20) for _ in lengths]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(v for v, c in zip(lengths, counts) for _ in range(c))], "doc_id long, length long")
    got = packing.pack(df, buckets=4).collect()
    assert sum(r.bucket_length - r.length for r in got) == brute_padding(lengths, counts, 4)
    assert {r.bucket_length for r in got} <= set(lengths)
    many = np.unique(np.random.default_rng(1).integers(0, 10**6, 60_000))
    assert packing.optimal(many, np.ones(len(many), int), 8)[-1] == many[-1]


def test_batches_fill_in_order_of_key(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice((0, 1, 5, 40, 300, 5000))) for i in rng.sample(range(20000), 900)] + [(7, None), (None, 3), (8, -2), (9, 40), (9, 40)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, length long, bucket string")
    got = packing.pack(df, buckets=3, budget=1000).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.bucket, r.bucket_length), []).append(r)
    for (_, bound), members in by.items():
        fit = max(1, 1000 // max(bound, 1))
        members.sort(key=lambda r: (r.batch, r.slot))
        assert [(r.batch, r.slot) for r in members] == [(i // fit, i % fit) for i in range(len(members))]
        assert [(r.doc_id is not None, r.doc_id) for r in members] == sorted(((r.doc_id is not None, r.doc_id) for r in members), key=lambda x: (x[0], x[1] or 0))
        assert all(r.length <= bound for r in members)
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind,keys", [("double", [2.0, 9.0, 10.0, 100.0, -1.5]), ("string", ["doc-2", "doc-10", "doc-1", "doc", ""]), ("long", [2**62, -(2**62), 5, 2**40, 0])])
def test_keys_of_any_kind_keep_their_order(spark, kind, keys):
    df = spark.createDataFrame([(k, 3) for k in keys * 40], f"doc_id {kind}, length int")
    got = sorted(packing.pack(df, budget=30).collect(), key=lambda r: (r.batch, r.slot))
    assert [r.doc_id for r in got] == sorted(keys * 40) and [(r.batch, r.slot) for r in got] == [(i // 10, i % 10) for i in range(200)]


def test_op2_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    length = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    values = sorted(set(length.values()))
    counts = np.array([sum(n == v for n in length.values()) for v in values])
    v = np.array(values)
    waste = np.full((packing.BUCKETS + 1, len(v) + 1), np.inf)  # least padding of the first j lengths in b buckets
    waste[:, 0] = 0
    for b in range(1, packing.BUCKETS + 1):
        for j in range(1, len(v) + 1):
            waste[b, j] = min(waste[b - 1, i] + (counts[i:j] * (v[j - 1] - v[i:j])).sum() for i in range(j))
    got = packing.op2_packing(spark, sf).collect()
    assert {r.doc_id: r.length for r in got} == length and len(got) == len(length)
    assert sum(r.bucket_length - r.length for r in got) == waste[packing.BUCKETS, len(v)]
    bounds = sorted({r.bucket_length for r in got})
    by = {}
    for i in sorted(length):
        by.setdefault(min(b for b in bounds if b >= length[i]), []).append(i)
    for r in got:
        at, fit = by[r.bucket_length].index(r.doc_id), max(1, packing.BUDGET // max(1, r.bucket_length))
        assert (bounds.index(r.bucket_length), at // fit, at % fit) == (r.bucket, r.batch, r.slot)


# toxicity


def toxic_rows():
    rng = random.Random(5)
    rows = []
    for i in range(400):
        said = [rng.choice(WORDS) for _ in range(rng.randint(5, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                said.insert(rng.randrange(len(said)), rng.choice(("zorg", "blarnak")) + rng.choice(("", "ish", "er", "ly")))
        rows.append((i, " ".join(said), int(bad)))
    return rows


def test_toxicity_learns_stems_and_folds(spark):
    rows = toxic_rows()
    texts = spark.createDataFrame([(i, t, "q", 0.1) for i, t, _ in rows] + [(900, None, "", 0.0), (None, "zorg", "", 0.0)], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows if i < 300] + [(900, 1), (None, 1), (901, 1), (5, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(texts, labels)
    assert {e.strip()[:4] for e in lexicon.entries} <= {"zorg", "blar"}
    got = {r.doc_id: r.score for r in toxicity.score(texts, lexicon).collect()}
    assert all((got[i] >= 0.5) == bool(b) for i, _, b in rows)
    assert got[900] < 0.5 and len(got) == 402
    disguised = ["alpha z0rg beta", "alpha ZОRG beta", "a bl@rn4k b", "ｚｏｒｇ", "zo​rg"]
    df = spark.createDataFrame(list(enumerate(disguised + ["", "0 5 $$$", "gorz alpha", "alpha " * 200000])), "doc_id int, text string")
    assert [r.score >= 0.5 for r in toxicity.score(df, lexicon).orderBy("doc_id").collect()] == [True] * 5 + [False] * 4
    spared = toxicity.Lexicon({"zorg ": 7.0}, ("zorg can",), (-4.0, 2.0, 1.0))
    assert spared.features(spared.matcher(), "a zorg can here") == (0.0, 0.0)
    assert spared.features(spared.matcher(), "a zorg cannot")[0] > 0
    empty = toxicity.learn(texts.limit(0), labels.limit(0))
    assert not empty.entries and toxicity.score(texts.limit(0), empty).count() == 0


def test_toxicity_against_plain_matching(spark, sf):
    documents, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn_documents(documents, labels)
    spared = [toxicity.words(p) for p in lexicon.exceptions]

    def plain(text):
        said, total = toxicity.words(text), 0.0
        free = {i + k for i in range(len(said)) for p in spared if said[i : i + len(p)] == p for k in range(len(p))}
        for i, w in enumerate(said):
            fits = [x for e, x in lexicon.entries.items() if (w + " ").startswith(e)]
            total += max(fits) if fits and i not in free else 0.0
        a, b, c = lexicon.coefficients
        return 1 / (1 + np.exp(-(a + b * np.log1p(total) + c * np.log1p(100 * total / max(1, len(said))))))

    got = {r.doc_id: r.score for r in toxicity.score(documents, lexicon).collect()}
    for r in documents.where("doc_id % 7 = 0").collect():
        assert got[r.doc_id] == pytest.approx(plain(r.text))


def test_toxicity_learns_exceptions(spark):
    rng = random.Random(13)
    rows = []
    for i in range(600):
        said = [rng.choice(WORDS) for _ in range(30)]
        if i % 4 == 0:
            said.insert(rng.randrange(30), "zorg")
        elif i % 100 == 1:
            said.insert(rng.randrange(30), "zorg lamp")
        rows.append((i, " ".join(said), int(i % 4 == 0)))
    both = [(0, 0), (4, 1), (4, 1)]  # a key with two labels, and a label twice
    texts, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, b) for i, _, b in rows] + both, "doc_id long, toxic int")
    lexicon = toxicity.learn(texts, labels)
    assert "zorg lamp" in lexicon.exceptions
    df = spark.createDataFrame([(1, "alpha zorg beta"), (2, "alpha zorg lamp beta"), (3, "alpha zorg lamp zorg beta")], "doc_id long, text string")
    assert [r.score >= 0.5 for r in toxicity.score(df, lexicon).orderBy("doc_id").collect()] == [True, False, True]


def test_toxicity_held_out_accuracy(spark, sf):
    large = sf.replace("0.001", "0.01")
    found = toxicity.op3_toxicity(spark, large).where("held_out")
    labels = spark.read.parquet(f"{large}/labels.parquet")
    rows = found.join(labels, "doc_id").select("predicted", "toxic").collect()
    assert len(rows) > 50 and sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.9


# chat


def test_chat_folds_events(spark):
    events = [
        (1, 1, "message", "a", "user", "hi"), (1, 2, "message", "b", "assistant", "he"), (1, 3, "delta", "b", None, "llo"), (1, 4, "edit", "a", "user", "hey"),
        (1, 5, "message", "c", "user", "next"), (1, 6, "regenerate", "b", None, ""), (1, 7, "delta", "b", None, "again"), (1, 8, "message", "d", "user", None),
        (2, 1, None, "x", None, "</s>[INST] \\l <|end|>"), (None, 1, "message", "n", "user", "null"),
    ]
    df = spark.createDataFrame([(*e, 0) for e in events], "conv_id int, seq int, kind string, msg_id string, role string, text string, position int")
    got = [tuple(r) for r in chat.fold(df).orderBy("conv", "position").collect()]
    assert got == [(None, 1, "user", "null"), (1, 1, "user", "hey"), (1, 2, "assistant", "again"), (1, 3, "user", ""), (2, 1, "", "</s>[INST] \\l <|end|>")]
    assert chat.render(chat.fold(df.limit(0))).count() == 0


def test_chat_reads_back(spark):
    rng = random.Random(6)
    bits = ["<|turn|>", "<|end|>", "\\", "\\l", "\\e", "[INST]", "</s>", "\n", "é", "🎉", "x", "<", "["]
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(("user", "assistant", "system", "od\nd<", None)), None if rng.random() < 0.1 else "".join(rng.choices(bits, k=rng.randint(0, 12)))))
    rows += [(99, 0, "assistant", "long " * 50000), (98, None, "user", "no turn"), (98, 1, "user", "one"), (97, 1, "user", "twice"), (97, 1, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id int, seq int, role string, text string").withColumns({"kind": F.lit("message"), "msg_id": F.monotonically_increasing_id()})
    done = chat.render(chat.fold(df)).select("conv", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans")
    for r in done.collect():
        raw = r.formatted.encode()
        assert [r.formatted[s.begin : s.begin + s.length] for s in r.loss_spans] == [raw[s["at"] : s["at"] + s["bytes"]].decode() for s in r.loss_spans]
        told = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv), key=lambda x: -1 if x[1] is None else x[1])]
        assert [(t.role, t.text) for t in r.turns] == told
        assert r.loss == "".join(t for role, t in told if role == "assistant")


# embeddings


@pytest.mark.parametrize("tile", [1024, 24])
def test_pivots_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(pivots, "TILE", tile)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 16))
    x = [base[i % 60] + rng.normal(size=16) * rng.choice((0.0, 0.03, 0.05, 0.6)) for i in range(400)]
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], i % 3 if i % 50 else None) for i in range(400)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [None] * 16, 1), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_classes(df).collect()}
    sound = {i: (np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(z is not None and np.isfinite(z) for z in v) and any(v)}
    links = {(a, b) for a, (u, p) in sound.items() for b, (w, q) in sound.items() if a != b and p == q and len(u) == len(w) and u @ w / np.sqrt((u @ u) * (w @ w)) >= 0.98}
    degree, root = {i: 0 for i in got}, {i: i for i in got}
    for a, _ in links:
        degree[a] += 1
    for _ in range(len(got)):
        changed = False
        for a, b in links:
            if root[a] < root[b]:
                root[b], changed = root[a], True
        if not changed:
            break
    found = sum(got[i][0] for i in got if i is not None)
    assert found <= len(links) and found >= 0.98 * len(links)
    assert all(got[i][0] <= degree[i] for i in got if i is not None)
    assert np.mean([got[i][:2] == (degree[i], root[i]) for i in got if i is not None]) >= 0.98
    assert got[None] == (0, None, False) and got[405] == (1, 405, True)
    assert pivots.near_classes(df.limit(0)).count() == 0


def test_pivots_recall_and_work(spark):
    """Planted pairs of cosine 0.98 to 0.99 among vectors of which most link with none."""
    rng = np.random.default_rng(12)
    n, planted = 12_000, 1_500
    x = rng.normal(size=(n, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(planted, 48))
    side -= (side * x[:planted]).sum(axis=1, keepdims=True) * x[:planted]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9801, 0.99, (planted, 1))
    x = np.vstack([x, cosine * x[:planted] + np.sqrt(1 - cosine**2) * side])
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in pivots.near_classes(df).where("n_links > 0").collect()}
    found = sum(i in got and n + i in got and got[i].component_id == got[n + i].component_id for i in range(planted))
    every = pivots.fit_pivots(df.select(F.col("embedding").alias("v")), int(np.ceil(pivots.EACH * np.sqrt(len(x)))))
    near = pivots.described(x, every)[:, : pivots.POSTED]
    lists = np.bincount(near.ravel()).astype(float)
    share = (lists * (lists - 1)).sum() / (len(x) * (len(x) - 1.0))
    print(f"planted pairs {planted}, found {found}, pairs that meet in lists {share:.3f} of all")
    assert found >= 0.98 * planted and share <= 0.1
    assert set(got) <= set(range(planted)) | set(range(n, n + planted))


def test_pivots_of_vectors_of_any_size(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.01e200], 1), (3, [1e-310, 1e-310], 1), (4, [-1.0, 1.0], 1), (4, [-1.0, 1.0], 1), (5, [3.0, -3.0], 1), (1, [5.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_classes(df).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True)]


# BPE


def test_bpe_as_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rng = random.Random(8)
    alphabet = list("abcXYZ é'’sS0٣½ \t\n\x1c\x85漢🎉İΣß.,!<|>") + ["<|endoftext|>", "<|startoftext|>", "'ll", "the ", "ing "]
    texts = ["", " ", None, "word" * 30000, "<|ENDOFTEXT|>"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    got = bpe.encode(df.unionByName(df.limit(1)), vocabulary()).orderBy("doc_id").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        e = library.encode(texts[r.doc_id] or "", add_special_tokens=False)
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == e.ids
        assert r.decoded == library.decode(e.ids, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), vocabulary()).count() == 0


def test_op6_digests(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op6_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# HTML

PAGE = """<html><head><title>Nope</title><style>p{}</style></head><body><nav><a href=x>Home page of this site</a></nav>
<div class="cookie-notice">We use cookies to make this site work well for all of our readers.</div>%s<div id="comments"><p>First! I like this very much, what a
nice long article this is.</p></div><aside>Elsewhere: other things to read that are long enough to count</aside><footer>&copy; 2024 The company with a long name</footer></body></html>"""
ARTICLE = "<h1>Short</h1><p>A paragraph with <b>bold</b> words\n and an entity &eacute; &amp; more.</p><p>Tiny.</p><p>Unclosed<br>line two<script>no()</script><ul><li>one<li>two</ul>"
EXPECTED = "Short\n\nA paragraph with bold words and an entity é & more.\n\nTiny.\n\nUnclosed\n\nline two\n\none\n\ntwo"


def test_html_keeps_the_article():
    assert html_text.main_text(PAGE % f"<article>{ARTICLE}</article>") == EXPECTED
    assert html_text.main_text(PAGE % f"<div class=post>{ARTICLE}</div>") == EXPECTED
    for empty in (None, "", "<", "<!-- x", "<p", "<script>a", "plain < text"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text("<article><p>only short") == "only short"


PARAGRAPHS = [f"Paragraph number {i} of the text, with words enough to make a surge of its own." for i in range(6)]
GAPS = (
    "<div class=ad><p>Buy now</p><p>Cheap and good</p><p>Only today</p></div>",
    "<ul><li><a href=a>One thing</a><li><a href=b>Another thing</a><li><a href=c>A third thing</a></ul>",
    "<p><a href=a>See this</a></p><p><a href=b>See that</a></p><p><a href=c>See more</a></p><p><a href=d>And more</a></p>",
)


@pytest.mark.parametrize("gap", GAPS)
def test_html_lines_without_weight_part_no_text(gap):
    said = [f"<p>{p}</p>" for p in PARAGRAPHS]
    body = "".join(said[:4]) + gap + said[4] + gap + "<p>Tiny.</p>" + gap + said[5]
    expected = "\n\n".join([*PARAGRAPHS[:5], "Tiny.", PARAGRAPHS[5]])
    for page in (body, PAGE % body, PAGE % f"<div class=post>{body}</div>"):
        assert html_text.main_text(page) == expected
    legal = f"<div class=legal>{GAPS[2]}<p>All rights to what stands on these pages are reserved by somebody.</p></div>"
    assert html_text.main_text(PAGE % f"<div class=post>{body}</div>{legal}") == expected


def test_html_container_only_where_the_text_lies_in_it():
    teaser = "<article><p>A teaser of another story, that is just long enough to be a surge.</p></article>"
    text = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    assert html_text.main_text(PAGE % f"<div class=post>{text}</div>{GAPS[2]}{teaser}") == "\n\n".join(PARAGRAPHS)
    halves = ["".join(f"<p>{p}</p>" for p in part) for part in (PARAGRAPHS[:2], PARAGRAPHS[2:])]
    for page in ("<article>%s</article><article>%s</article>", "<main><article>%s</article><article>%s</article></main>", "<main>%s<article>%s</article></main>"):
        assert html_text.main_text(PAGE % page % tuple(halves)) == "\n\n".join(PARAGRAPHS)


def test_html_malformed_pages_lose_nothing():
    text = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    expected = "\n\n".join(PARAGRAPHS)
    for name in ("object", "svg", "select", "noscript", "template"):
        assert html_text.main_text(PAGE % f"<article><{name} data=x>{text}</article>") == expected
        assert html_text.main_text(PAGE % f"<article><{name}><i>not this</i></{name}>{text}</article><{name}></{name}>") == expected
    assert html_text.main_text(PAGE % f'<article class="social-history">{text}</article>') == expected
    assert html_text.main_text(PAGE % f'<article>{text}<p class="social-history">On it.</p><p class="social-links">Not it.</p></article>') == expected + "\n\nOn it."
    assert html_text.main_text(PAGE % f"<article><p>{'</b></i>'.join(PARAGRAPHS)}") == "".join(PARAGRAPHS)
    deep = "<div>" * 20_000 + text
    assert html_text.main_text(deep) == expected


def test_html_time_is_linear():
    for bit in ("<p>x y z</i>", "<object><b>x y z</i><li>", "<li><b>k</li>", "<svg><p>x", "<div>x", "<article>y z", "<section class=a>a b<p>c"):
        began = time.perf_counter()
        html_text.main_text("<article>" + bit * 50_000)
        assert time.perf_counter() - began < 10


def test_stretches_against_brute_force():
    rng = random.Random(15)
    for _ in range(300):
        weight = [rng.choice((0, 0, 5, 15, 30, 60)) for _ in range(rng.randint(1, 25))]
        sums = [sum(weight[i : i + html_text.WINDOW]) for i in range(len(weight))]
        expected, i = [], 0
        while i < len(weight):
            if weight[i] and sums[i] > html_text.SURGE:
                j = next((j for j in range(i, len(weight)) if sums[j] <= html_text.DIVE), len(weight))
                expected.append((i, j))
                i = j
            i += 1
        assert html_text.stretches(np.array(weight, np.int64)) == expected


def test_html_text_does_not_rest_on_article_tags(spark, sf):
    """Line blocks alone find the same text, but on pages too short for a surge."""
    pages = [r.html for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect()]
    plain = [re.sub(r"(</?)(article|main)\b", r"\1div", p or "") for p in pages]
    same = [html_text.main_text(a) == html_text.main_text(b) for a, b in zip(pages, plain)]
    assert sum(same) >= 0.99 * len(same)


def test_html_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.op7_html_extraction(spark, sf).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html_text.entities.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:h1|p|br)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, "t"), (None, "", "t"), (2, "<article><p>" + "x " * 100000, "t"), (2, None, "t")], "page_id int, html string, text string")
    assert sorted(len(r.text) for r in html_text.extract(odd).collect()) == [0, 0, 0, 199999]
    assert html_text.extract(odd.limit(0)).count() == 0


# URLs


def test_urls_rules_and_parts(spark):
    cases = {
        "https://A.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7", "allow"), "http://x.com/en/8": ("x.com", "/en/8", "com/en/", "block"),
        "http://notcom/en/": ("notcom", "/en/", None, "allow"), "http://my.example.net/de/81": ("my.example.net", "/de/81", "example.net/de/8", "block"),
        "ftp://my.example.net/de/71": ("my.example.net", "/de/71", "net/de/", "allow"), "http://h.org?/es/": ("h.org", "", None, "allow"),
        "http://org/es/1#x": ("org", "/es/1", "org/es/", "block"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "://": ("", "", None, "allow"),
        "http://royal-poker-rooms.example.com/fr/1": ("royal-poker-rooms.example.com", "/fr/1", None, "block"), "http://www.bucket-list.example.com/fr/1": ("www.bucket-list.example.com", "/fr/1", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(cases)] * 2, "page_id int, url string, host string")
    got = urls.filter_urls(df).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r.host, r.path, r.rule) == list(cases.values())[r.page_id][:3]
        if r.host not in ("notcom", "h.org"):  # the model has never seen hosts of their kind
            assert r.verdict == list(cases.values())[r.page_id][3]
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_urls_accuracy_on_hosts_not_taught():
    """Five folds by host name: no name stands on both sides."""
    rows = list(zip(urls.names(), urls.training_table()))
    right = {0: [], 1: []}
    for fold in range(5):
        part = lambda name: zlib.crc32(name.encode()) % 5 == fold
        w = urls.train([r for (name, _), r in rows if not part(name)])
        for (name, _), (host, path, label) in rows:
            if part(name):
                f = urls.grams(host, path)
                right[label].append((w[f].sum() / len(f) ** 0.5 + w[-1] >= 0) == bool(label))
    print("hosts not taught:", {k: (sum(v), len(v)) for k, v in right.items()})
    assert all(sum(v) / len(v) >= 0.95 for v in right.values())


def brute_verdict(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls_of_all_pages_against_brute_force(spark, sf):
    w = urls.train(urls.training_table())
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = urls.op8_url_filters(spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(rows)
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", rows[r.page_id] or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        rule, verdict = brute_verdict(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        f = urls.grams(host, path)
        assert r.verdict == (verdict or ("block" if host + path and 1 / (1 + np.exp(-(w[f].sum() / len(f) ** 0.5 + w[-1]))) >= 0.5 else "allow"))
    odd = spark.createDataFrame([(1, "http://" + "a" * 300_000 + ".org/es/" + "b" * 300_000)], "page_id int, url string")
    assert urls.filter_urls(odd).first().rule == "org/es/"
    tied = urls.filter_urls(odd, rules=[("block", "org", "/es/"), ("allow", "org", "/es/")]).first()
    assert tied.verdict == "allow"  # of rules alike, allow


# language ID


def test_language_model_is_naive_bayes(spark):
    rng = random.Random(9)
    makes = {"aa": "abcd", "bb": "efgh", "cc": "éñçø"}
    rows = [(i, " ".join("".join(rng.choices(makes[lang], k=4)) for _ in range(rng.randint(1, 30))), lang) for i in range(300) for lang in (rng.choice(list(makes)),)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 !?", "bb"), (1003, "abcd " * 60000, None), (None, "efgh", "bb"), (1004, "ABCD", None)]
    df = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.fit(df, "doc_id", "text", "lang")
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    assert all(got[i][0] == lang for i, t, lang in rows if i is not None and i < 1000)
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0) and got[1003][0] == got[1004][0] == "aa"
    # brute force over n-grams of one text
    text = rows[0][1]
    padded = f" {text.lower()} "
    logs = model.prior.copy()
    for n in range(1, langid.LONGEST + 1):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and "  " not in g:
                logs += model.logs[langid.buckets(np.array([ord(c) for c in g], np.uint32))[-1]]
    p = np.exp(logs - logs.max())
    assert got[rows[0][0]][1] == pytest.approx(p.max() / p.sum())
    none = langid.fit(df.limit(0), "doc_id", "text", "lang")
    assert langid.identify(df, none).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(df.limit(0), model).count() == 0


def test_long_texts_in_stretches_count_once(monkeypatch):
    model = langid.Model(["a", "b"], np.zeros(2), np.random.default_rng(1).normal(size=(langid.BUCKETS, 2)) / 1e3)
    text = "some words of a text that is longer than a stretch " * 40
    whole = model.score([text, None, "x"])
    monkeypatch.setattr(langid, "STRETCH", 37)
    monkeypatch.setattr(langid, "HELD", 10)
    parts = model.score([text, None, "x"])
    assert whole[0] == parts[0] and whole[1] == pytest.approx(parts[1]) and whole[2] == pytest.approx(parts[2])


def test_language_held_out_accuracy(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.op9_language_id(spark, sf).where("held_out").join(documents, "doc_id").where("length(text) > 30").collect()
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95


# n-gram join


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def similar_rows(seed):
    rng = random.Random(seed)
    rows, shared = [], [rng.choice(WORDS) for _ in range(30)]
    for i in range(220):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows[-40:])[1] or "x").split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = [rng.choice(WORDS)]
        else:
            w = [rng.choice(WORDS) for _ in range(rng.choice((1, 3, 5, 7, 9, 12, 20, 40, 120)))]
            if rng.random() < 0.3:
                w += shared
        rows.append((i * 3, " ".join(w) or "y"))
    near = [rng.choice(WORDS) for _ in range(60)]
    for i in range(60):  # a large group of near copies, some of which link only through others
        w = list(near)
        for j in range(rng.randint(1, 4)):
            w[rng.randrange(60)] = f"n{i}x{j}"
        rows.append((1000 + i, " ".join(w)))
    return rows + [(2000, None), (2001, ""), (2002, " \t"), (2003, "A b\x0bC"), (2004, "a B c"), (2005, "É x"), (2006, "é x"), (2007, "a b c d e " * 20000), (2008, "a b c d e " * 20000)]


@pytest.mark.parametrize("seed,light,rounds,bits", [(1, None, 3, 64), (2, None, 0, 64), (3, 8, 3, 64), (4, 30, 0, 5), (5, 1000, 1, 64)])
def test_ngram_join_against_brute_force(spark, seed, light, rounds, bits, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "COUNTED", 2000)
    monkeypatch.setattr(ngram_join, "HOT", 3 if seed == 2 else 1 << 20)
    if light is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda *_: light)
    if seed == 3:  # rows and keys are joined instead of looked up in a map
        monkeypatch.setattr(ngram_join, "SLOTS_MAX", 0)
    rows = similar_rows(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_sets(df, bits=bits).collect()}
    assert got == brute_classes(rows)


def test_ngram_join_defined_cases(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (3, "a b c")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.link_sets(df.where("doc_id is not null")).collect()) == [(1, 1, 1), (1, 1, 1), (2, 0, 2), (3, 1, 1)]
    assert (None, 1, None) in [tuple(r) for r in ngram_join.link_sets(df).collect()]
    assert ngram_join.link_sets(df.limit(0)).count() == 0


def test_boundary_follows_cost():
    sizes = {4: 10, 8: 10, 16: 5, 40: 7, 200: 3}
    met = {4: 0.0, 8: 9.0, 16: 0.5, 40: 100.0, 200: 1.0}

    def cost(at):
        total = 0.0
        for n, sets in sizes.items():
            listed = sets * ngram_join.beginning(n, 1) * (1 + min(ngram_join.ROUNDS, met[n]))
            pairs = int(ngram_join.beginning(n, 2))
            total += (sets * pairs * (pairs - 1) / 2 if n <= at else 0) + (listed if n > at or n * 100 >= (at + 1) * 75 else 0)
        return total

    best = ngram_join.boundary(sizes, met)
    assert best in (0, *sizes) and cost(best) == min(map(cost, (0, *sizes)))
    assert ngram_join.boundary({}, {}) == 0


# SQL


@pytest.mark.parametrize("name", ["op1_top_k", "op4_chat_formatting", "op5_embedding_dedup", "op10_ngram_join"])
def test_query_against_its_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    from weftline.llm import queries

    assert name in queries.ORACLE_SQL
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    expected = c.execute(queries.ORACLE_SQL[name])
    columns = sorted(x[0] for x in expected.description)
    told = [dict(zip([x[0] for x in expected.description], r)) for r in expected.fetchall()]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r[x] for x in columns) for r in got.collect()) == sorted(tuple(r[x] for x in columns) for r in told)


# pipeline


def test_near_duplicates_go_by_row(spark):
    import corpus_pipeline

    a, b = "one two three four five six seven", "red green blue white black brown pink"
    rows = [(1, a), (2, a.upper()), (2, b), (3, b.upper()), (4, "x"), (4, "x"), (5, None), (5, ""), (None, a), (None, a), (6, "y y"), (6, "Y y")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, said string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len([r for r in kept if r[0] == 6]) == 1
    rest = [r for r in kept if r[0] != 6]
    assert sorted(rest, key=repr) == sorted([(1, a), (2, b), (4, "x"), (5, None), (5, ""), (None, a), (None, a)], key=repr)


def test_pipeline_against_its_parts(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.learn_documents(docs, labels)
    matcher = lexicon.matcher()
    left = {i: t for i, t in texts.items() if lexicon.score(lexicon.features(matcher, t)) < 0.5}
    model = langid.fit_documents(docs.where(F.col("doc_id").isin(list(left))))
    left = {i: t for (i, t), n, s, e in zip(left.items(), *model.score(list(left.values()))) if n != "und" and s >= 0.5 and e >= 0}
    classes = brute_classes(list(left.items()))
    left = {i: t for i, t in left.items() if classes[i][1] == i}
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(left)
    assert {r.doc_id: r.length for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in left.items()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert first.columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 4


def test_pipeline_of_odd_rows(spark, sf, tmp_path):
    """Nulls in any column, repeated rows, clashing column names, and no rows at all."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(9001, None, None, None, None), (None, "the cat", "en", "s", 7), (9002, "", "en", "s", 0), (9003, "12 34", None, None, 5), (None, None, None, None, None)]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars int").select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    more = more.unionByName(docs.limit(3)).unionByName(docs.limit(3))
    clash = {c: F.lit(i) for i, c in enumerate(("score", "key", "row", "name", "bucket", "length", "same", "lang_pred", "component_id"))}
    docs.unionByName(more).withColumns(clash).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").unionByName(spark.createDataFrame([(None, None, None), (9001, None, 1)], spark.read.parquet(f"{sf}/labels.parquet").schema)).write.parquet(f"{tmp_path}/odd/labels.parquet")
    plain = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    got = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()]
    assert len([i for i in got if i is not None]) == len({i for i in got if i is not None}) and not {9001, 9002, 9003} & set(got)
    assert plain - set(got) == set() or len(plain ^ {i for i in got if i is not None}) <= 2  # what was learnt differs a little
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_language_ties_and_repeated_rows(spark):
    rows = [(1, "ab ab", "xx"), (2, "ab ab", "aa")]
    df = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    model = langid.fit(df, "doc_id", "text", "lang")
    once = langid.fit(df.dropDuplicates(), "doc_id", "text", "lang")
    assert model.languages == once.languages == ["aa", "xx"] and (model.logs == once.logs).all() and (model.prior == once.prior).all()
    got = langid.identify(df, model).collect()
    assert len(got) == 6 and {(r.lang_pred, round(r.score, 6)) for r in got} == {("aa", 0.5)}
