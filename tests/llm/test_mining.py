"""Hard negatives, toxicity and collocations against brute force, gradients by differences and held-out accuracy."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palaver.llm import collocations, hard_negatives, toxicity

VECTORS = "vec_id long, label int, embedding array<float>, ANCHOR_ID string"


def mined(rows, positives=5, negatives=10):
    """All of it, by holding every anchor against every row."""
    good = []
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        good.append((i, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for anchor in sorted({i for i, _, _ in good if i % 100 == 0}):
        _, label, vector = min(r for r in good if r[0] == anchor)
        score = lambda v: sum(a * b for a, b in zip(v, vector, strict=False))  # noqa: B023, E731
        others = sorted((-score(v), i, own) for i, own, v in good if i != anchor)
        for p, positive, _ in [x for x in others if x[2] == label][:positives]:
            near = [(n, i) for n, i, own in others if own != label and 30 * -p <= 100 * -n <= 90 * -p][:negatives]
            out += [(anchor, positive, k + 1, i, -p, -n) for k, (n, i) in enumerate(near)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    rnd = random.Random(3)
    vector = lambda n=6: [rnd.gauss(0, 0.4) for _ in range(n)]
    rows = [(k, rnd.randrange(4), vector()) for k in range(1, 900)]
    hot = [0.5, 0.25, 0.1, -0.3, 0.2, 0.4]
    rows += [(1000 + k, k % 3, hot) for k in range(400)]
    rows += [(100_000, 1, None), (100_100, None, hot), (100_200, 1, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (100_300, 1, [float("nan")] * 6), (100_400, 2, [float("inf")] * 6)]
    rows += [(None, 1, hot), (100_500, 2, []), (100_600, 2, [0.0] * 6), (100_700, 1, [0.4, 0.3]), (-100, 1, vector()), (100_800, 99, vector()), (100_900, 99, vector())]
    df = spark.createDataFrame([(i, label, v, "x") for i, label, v in rows], VECTORS).repartition(7)
    found = hard_negatives.mine_embeddings(df)
    assert sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == mined(rows)
    empty = hard_negatives.mine_embeddings(df.limit(0))
    assert empty.collect() == [] and empty.columns == found.columns


def test_hard_negatives_of_repeated_rows(spark):
    rows = [(100, 1, [1.0, 0.5]), (100, 1, [0.5, 0.5]), (1, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.2]), (2, 2, [0.5, 0.2]), (3, 3, [0.7, 0.1])]
    df = spark.createDataFrame([(i, label, v, "x") for i, label, v in rows], VECTORS)
    found = hard_negatives.mine(df, df.filter("vec_id = 100"))
    assert {r["positive_id"] for r in found.collect()} == {1}
    assert sorted((r["positive_rank"], r["rank"], r["negative_id"]) for r in found.collect()) == [(p, k + 1, i) for p in (1, 2) for k, i in enumerate((3, 2, 2))]


def test_tree_gives_what_a_scan_gives_and_leaves_nodes_closed():
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 400, (12, 8))
    vectors = np.floor(centers[rng.integers(0, 12, 3000)] + rng.normal(0, 12, (3000, 8)))
    labels, ids = rng.integers(0, 5, 3000), rng.permutation(3000)
    pages = hard_negatives.str_pages(vectors, labels, ids, page=16)
    assert sorted(np.concatenate(pages).tolist()) == list(range(3000)) and max(map(len, pages)) <= 16
    leaves = [(ids[p], labels[p], vectors[p]) for p in pages]
    tree = hard_negatives.RTree(leaves, np.array([v.min(axis=0) for _, _, v in leaves]), np.array([v.max(axis=0) for _, _, v in leaves]))
    opened = 0
    for q in range(40):
        lower, upper = (x[0] for x in tree.intervals(vectors[q : q + 1]))
        score = (vectors @ vectors[q]).astype(int)
        for same, low, high in ((True, -math.inf, math.inf), (False, 0, 10**5), (False, 10**5, 10**6), (False, 10**9, 10**10)):
            seen: dict = {}
            found = tree.search(vectors[q], int(ids[q]), int(labels[q]), same, 10, lower, upper, low, high, seen)
            rows = np.flatnonzero(((labels == labels[q]) == same) & (ids != ids[q]) & (score >= low) & (score <= high))
            want = sorted((-score[r], ids[r]) for r in rows)[:10]
            assert [(-s, i) for s, i in found] == want
            opened += len(seen)
    assert opened < 0.5 * 160 * len(pages)  # boxes are of use where vectors lie in clusters


def brute_collocations(rows, least, limit):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                f.update((lang, *words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang in {x for x, *_ in f}:
        found = []
        for key, a in f.items():
            own, phrase = key[0], key[1:]
            if own != lang or len(phrase) < 2 or a < least:
                continue
            longer = [n for other, n in f.items() if other[0] == lang and len(other) == 4 and n >= least and len(phrase) == 2 and phrase in (other[1:3], other[2:4])]
            if any(100 * n >= 50 * a for n in longer):
                continue
            cuts = [(1_000_000 * a * a // (f[lang, *phrase[:k]] * f[lang, *phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), f[lang, *phrase[:k]], f[lang, *phrase[k:]]))
        out += [(lang, n + 1, p.decode(), -a, left, r, total[lang], -s) for n, (s, a, p, left, r) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def test_collocations_equal_brute_force(spark):
    rnd = random.Random(9)
    common = ["of", "the", "New", "york", "city", "hall", "é", "x y", "a'b", "-"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.7 else f"w{rnd.randrange(60)}"
    joint = lambda: rnd.choice([" ", "  ", "\t", ", ", ".", "\n", "; ", "\r\n", " ", " "])
    rows = [(lang, "".join(word() + joint() for _ in range(rnd.randrange(0, 120)))) for lang in ("en", "en", "de", None, "") for _ in range(40)]
    rows += [("en", None), (None, None), ("fr", ""), ("fr", " \t. "), ("fr", "no phrase twice here"), ("en", "new york city " * 20_000), ("en", "same same same same")]
    df = spark.createDataFrame([(lang, t, 1, 2) for lang, t in rows], "lang string, text string, rank int, N int").repartition(6)
    for least, limit in ((3, 60), (10, 2000)):
        found = collocations.collocations(df, least=least, limit=limit)
        assert sorted(map(tuple, found.collect())) == brute_collocations(rows, least, limit)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_tiles_count_dense_and_sparse_pairs():
    rng = np.random.default_rng(2)
    a, b = (np.r_[rng.zipf(1.3, 20_000) % 9000, rng.integers(0, 20, 20_000)] for _ in range(2))
    x, y, n = collocations.tiled(a, b)
    assert {(i, j): k for i, j, k in zip(x.tolist(), y.tolist(), n.tolist(), strict=True)} == Counter(zip(a.tolist(), b.tolist(), strict=True))
    keys = a * 1_000_003 + 7
    distinct = np.unique(keys)[::-1][:300]
    rank = {k: i for i, k in enumerate(distinct.tolist())}
    x, y, n = collocations.tiled(np.array([rank.get(k, -1) for k in keys.tolist()]), b, keys, distinct)
    assert {(i, j): k for i, j, k in zip(x.tolist(), y.tolist(), n.tolist(), strict=True)} == Counter(zip(keys.tolist(), b.tolist(), strict=True))


def test_scores_of_phrases_are_exact_past_64_bits(spark):
    rows = [(10**15 - 1, 10**15, 10**15 + 7), (3 * 10**12, 7 * 10**12, 3 * 10**12 + 1), (10, 10, 10), (10, 10**9, 10**9)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in df.collect())


def test_network_gradients_are_those_of_the_loss():
    words = toxicity.read_words(pa.array(["one two three four five one", "six two seven one", "é"]))
    network = toxicity.Network.fresh(np.sort(words.keys)[:4])
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    rng = np.random.default_rng(0)
    odds = rng.normal(0, 1, (len(words.keys), 4)).astype(np.float32)
    starts, ends, _ = toxicity.windows(words.texts)
    index = toxicity._index(words.places, starts, ends)
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, g = toxicity.loss_gradients(network, words, odds, index, target, weight)
    for name, p in network.p.items():
        picks = np.flatnonzero(g[name].reshape(-1)) if name in ("words", "chars") else np.arange(p.size)
        for k in rng.choice(picks, min(6, len(picks)), replace=False):
            flat, step = p.reshape(-1), 1e-3
            held = flat[k]
            flat[k] = held + step
            up, _ = toxicity.loss_gradients(network, words, odds, index, target, weight)
            flat[k] = held - step
            down, _ = toxicity.loss_gradients(network, words, odds, index, target, weight)
            flat[k] = held
            assert (up - down) / (2 * step) == pytest.approx(float(g[name].reshape(-1)[k]), rel=0.05, abs=2e-4), name


def test_windows_overlap_and_cover_all_words():
    texts = np.cumsum([0, 0, 1, 32, 33, 48, 49, 1000])
    starts, ends, own = toxicity.windows(texts)
    for i, (a, b) in enumerate(zip(texts[:-1], texts[1:], strict=True)):
        mine = [(s, e) for s, e, o in zip(starts, ends, own, strict=True) if o == i]
        assert sorted({k for s, e in mine for k in range(s, e)}) == list(range(a, b))
        assert all(e - s <= toxicity.WINDOW for s, e in mine)
        assert all(t == s + toxicity.STRIDE for (s, _), (t, _) in zip(mine, mine[1:], strict=False))


@pytest.fixture(scope="module")
def toxic_table(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["ta", "ro", "mi", "ne", "sol", "ka", "ver"]) for _ in range(rnd.randrange(1, 4)))
    rows, labels = [], []
    for k in range(900):
        words = [word() for _ in range(rnd.randrange(1, 150))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(1 + len(words) // 60):
                words[rnd.randrange(len(words))] = rnd.choice(["grrbad", "zzfoul", "grrmean", "Zzrude,"])
        rows.append((k, " ".join(words), "en", "s", 1, "x"))
        if k % 10 != 3:
            labels.append((k, int(toxic)))
    quiet = " ".join(word() for _ in range(30_000))
    rows += [(5000, None, None, "s", 0, "x"), (5001, "", "en", "s", 0, "x"), (5002, " .,! ", "en", "s", 0, "x"), (None, "grrbad", "en", "s", 0, "x")]
    rows += [(5003, quiet, "en", "s", 0, "x"), (5004, quiet + " grrbad zzfoul", "en", "s", 0, "x"), (5005, "ta grrbad", "en", "s", 0, "x"), (5005, "ta grrbad", "en", "s", 0, "x")]
    labels += [(5000, 1), (9999, 1), (None, 1), (7, None), (8, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, SCORE string").repartition(5)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_held_out_documents(toxic_table):
    docs, labels = toxic_table
    found = toxicity.score_documents(docs, labels)
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    right = [r.predicted == (r.doc_id % 6 == 0) for r in held]
    assert len(held) > 150 and sum(right) >= 0.95 * len(right)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[5000] == by[5001] == by[5002]
    assert by[5003][0] < 0.3 <= by[5004][0]  # a few words at the end of a very long text
    assert len(by[5005]) == 2 and by[5005][0] == by[5005][1] >= 0.3
    assert by[None][0] >= 0.3


def test_toxicity_without_labels_of_both_kinds(spark, toxic_table):
    docs, labels = toxic_table
    assert {r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.score_documents(docs, labels.filter("toxic = 1")).collect()} == {1.0}
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []
