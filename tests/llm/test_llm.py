"""The training-data operators against brute force, exact round trips and the libraries."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import (
    ann_tree, blocks, chat_format, decontaminate, graph, html_extract, language_id, line_dedup, near_dup, packing, sharding, token_count, words,
)
from palaver.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens_of(text):
    return SPLIT.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty, blank, very long, tied and repeated rows."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = [text(rnd.randrange(1, 60)) for _ in range(40)]
    rows = [(None, "a null id text here", None), (1, None, "en"), (2, "", "en"), (3, " \n\t\n ", None), (4, "one", "de"), (4, "one", "de"), (5, text(20_000), "en")]
    rows += [(5, "repeated id with another text", "en"), (6, "x" * 50_000, "en"), (7, "<|endoftext|> İß ſ Ⅷ \U0001f600", "fr")]
    for k in range(160):
        words_ = rnd.choice(base).split()
        for _ in range(rnd.randrange(0, 3)):
            words_[rnd.randrange(len(words_))] = rnd.choice(vocabulary)
        rows.append((100 + k, "\n".join([" ".join(words_), rnd.choice(base), "", rnd.choice(base).upper()][: rnd.randrange(1, 5)]), "en"))
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).repartition(5).cache()


def union(pairs, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() >= 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_registered_sql(name, spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for table in ("conversations", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r[n] for n in names) for r in QUERIES[name](spark, sf_dir).collect()) == sorted(cursor.fetchall())


def test_parity_maps_never_exceed_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(70, 700))
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        other = np.concatenate([base[int(rng.integers(0, n // 6)) :], rng.integers(0, 2**64, int(rng.integers(0, n // 6)), dtype=np.uint64)])
        wide = line_dedup.map_words(np.array([len(base), len(other)]))
        maps = []
        for values, w in zip((base, other), wide.tolist(), strict=True):
            odd = np.bincount((values & np.uint64(64 * w - 1)).astype(int), minlength=64 * w) & 1
            maps.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64))
        a, b = line_dedup._folded(np.concatenate(maps), np.array([0, wide[0]]), wide, np.array([0, 1]), int(wide.min()))
        assert np.bitwise_count(a ^ b).sum() <= len(set(base.tolist()) ^ set(other.tolist()))


def test_chat_round_trip(spark):
    probe = chat_format.PROBE_TEXT
    texts = ["hi", "", None, probe, "<\\|x", "<\\\\|", "a\n<|im_end|>\nb", "é\U0001f600" * 50]
    rows = [(c, k, ["system", "user", "assistant", "us\\n\ner"][(c + k) % 4], texts[(c * 3 + k) % len(texts)]) for c in range(12) for k in range(c)]
    rows += [(99, 0, None, None), (98, 1, "assistant", "a"), (98, 1, "assistant", "a"), (97, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.conversation_digest(df).collect()}
    turns = defaultdict(list)
    for c, k, role, text in rows:
        turns[c].append((-1 if k is None else k, role or "", text or ""))
    assert set(got) == set(turns)
    for c, own in turns.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat_format.expand_examples(df.filter("conv_id = 7")).collect()
    assert sum(e["loss_start"] is not None for e in examples) == sum(r[2] == "assistant" for r in rows if r[0] == 7)
    assert chat_format.conversation_digest(df.filter("false")).count() == 0


def test_packing_is_gapless_and_whole(odd_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack_documents(odd_docs, path).collect()
    library = Tokenizer.from_file(path)
    source = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in odd_docs.collect()]
    wanted = Counter((i, at, tuple(p.tolist())) for i, ids in source for at, p in packing.cut(np.array(ids), 2048))
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in rows) == wanted
    bins = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack_documents(odd_docs.filter("false"), path).count() == 0


def test_packing_needs_hardly_more_sequences_than_the_tokens_fill(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n in range(3):  # some hundred documents, over one task
        docs = docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 10 ** (6 + n)))
    rows = packing.pack_documents(docs.coalesce(1), tokenizer_path("byte_bpe_50k.json"), with_ids=False).select("sequence_id", "length").collect()
    least = math.ceil(sum(r["length"] for r in rows) / 2048)
    assert len({r["sequence_id"] for r in rows}) <= least + max(2, 0.005 * least)


def test_packer_closes_the_fullest():
    packer = packing.BitsetPacker(10, 2)
    assert [packer.place(n) for n in (7, 5, 4, 5, 3)] == [(0, 0), (1, 0), (1, 5), (2, 0), (0, 7)]
    rnd = random.Random(1)
    packer, used = packing.BitsetPacker(100, 8), Counter()
    for _ in range(5000):
        n = rnd.randrange(1, 101)
        at, offset = packer.place(n)
        assert offset == used[at]
        used[at] += n
        assert used[at] <= 100 and packer.n_open <= 8


def test_jump_hash(spark, odd_docs):
    def jump(key, n):
        key, b, j = key % 2**64, -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(10**12, 10**12 + 200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 17, 100, 3000):
        assert all(r["s"] == jump(r["k"], n) for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect())
    out = sharding.sharded_sizes(odd_docs).collect()
    assert len(out) == odd_docs.count()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + (1), zlib.crc32((r["text"] or "").encode()), jump(r["doc_id"] or 0, 16), jump(r["doc_id"] or 0, 17)) for r in odd_docs.collect())
    assert texts == Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in out)
    clash = sharding.assign_shards(odd_docs.withColumnRenamed("source", "slot"), "doc_id", 4)
    assert clash.columns == ["doc_id", "text", "lang", "n_chars", "shard", "slot", "grown_shard"]


def test_language_models_are_distributions_and_right(spark, sf_dir, odd_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = language_id.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in told if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert sum(r["accepted"] for r in told) >= 0.99 * len(told)
    model = language_id.learn(docs.select("doc_id", "text", "lang"))
    alphabet = sorted(set(language_id.fold([r["text"] for r in docs.select("text").collect()])[0].tolist()))
    for context in ("the", "ein", " qz"):
        points = np.array([[*map(ord, context), c] for c in alphabet], np.uint32).reshape(-1)
        logs = model.groups[0].position_scores(points, np.arange(len(alphabet)) * 4)
        assert np.all(np.exp(logs).sum(axis=0) < 1.0001) and np.all(np.exp(logs).sum(axis=0) > 0.9)
    odd = language_id.identify_documents(odd_docs).collect()
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in odd)
    blank = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify_documents(blank).collect()} == {"und"}


def test_language_scores_are_plain_kneser_ney(spark):
    """Against interpolated Kneser-Ney written out with dictionaries, for many languages and one text at a time."""
    rnd = random.Random(6)
    samples = {f"l{k:02d}": ["".join(rnd.choice("abcde"[k % 3 :] + "xyz "[: k % 4 + 1]) for _ in range(80)) for _ in range(6)] for k in range(11)}

    def plain(texts):
        tables = {4: Counter()}
        for t in texts:
            points = fold_plain(t)
            for i in range(3, len(points)):
                tables[4][points[i - 3 : i + 1]] += 1
        for order in (3, 2, 1):
            tables[order] = Counter(g[1:] for g in tables[order + 1])  # distinct characters before
        return tables

    def fold_plain(t):
        return "   " + "".join(f"{run} " for run in re.findall("[a-z]+", t.lower()))

    def prob(tables, gram, n_chars):
        if not gram:
            return 1 / n_chars
        table = tables[len(gram)]
        once, twice = (sum(c == k for c in table.values()) for k in (1, 2))
        discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95)
        same = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        below = prob(tables, gram[1:], n_chars)
        if not same:
            return below
        return max(table[gram] - discount, 0) / sum(same) * (gram in table) + discount * len(same) / sum(same) * below

    grams = {}
    for lang, texts in samples.items():
        counts = plain(texts)[4]
        grams[lang] = (np.array([[*map(ord, g)] for g in counts], np.uint32), np.array([*counts.values()]))
        order = np.lexsort(grams[lang][0].T[::-1])
        grams[lang] = (grams[lang][0][order], grams[lang][1][order])
    model = language_id._kneser_ney(grams)
    assert len(model.groups) == 2 and model.languages == sorted(samples)
    n_chars = len({c for g, _ in grams.values() for c in g.reshape(-1).tolist()}) + 1
    tested = ["abxed cq", "zzz", "deb ac", "q"]
    entropy, sizes, _ = model.entropies(tested)
    for i, text in enumerate(tested):
        points = fold_plain(text)
        for j, lang in enumerate(model.languages):
            tables = plain(samples[lang])
            total = sum(math.log(prob(tables, points[k - 3 : k + 1], n_chars)) for k in range(3, len(points)))
            assert entropy[i, j] == pytest.approx(-total / (len(points) - 3))


def test_languages_reject_noise_and_other_scripts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) between 200 and 5000").select("doc_id", "text", "lang")
    model = language_id.learn(docs)
    rnd = random.Random(1)
    own = [r["text"] for r in docs.limit(40).collect()]
    noise = ["".join(rnd.sample(t, len(t))) for t in own]
    other = ["съешь же ещё этих мягких французских булок да выпей чаю " * 5, "你好世界今天天气很好我们去公园玩" * 5]
    told = spark.createDataFrame([(t, k) for k, group in enumerate((own, noise, other)) for t in group], "text string, kind int")
    got = told.select("kind", language_id.identify_text(F.col("text"), model).alias("own")).groupBy("kind").agg(F.avg(F.col("own.accepted").cast("int"))).collect()
    assert {r[0]: r[1] for r in got} == {0: 1.0, 1: 0.0, 2: 0.0}
    many = docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 60).cast("string")))
    assert len(language_id.learn(many).languages) == many.select("lang").distinct().count() > 100


def docs_of(like, rows):
    return like.sparkSession.createDataFrame(rows, DOCS)


def brute_lines(rows, threshold=80):
    lines = [(-(2**63) if i is None else i, k, frozenset(tokens_of(x))) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    lines = sorted({x for x in lines if x[2]}, key=lambda x: x[:2])
    first = {}
    for i, k, s in lines:
        first.setdefault(s, (i, k))
    classes = sorted((at, s) for s, at in first.items())
    links, earlier = Counter(), set()
    for a, (at, s) in enumerate(classes):
        for other, u in classes[:a]:
            both = len(s & u)
            if 100 * both >= threshold * (len(s) + len(u) - both):
                links[at] += 1
                links[other] += 1
                earlier.add(at)
    return {(i, k, len(s)): (first[s], links[first[s]], first[s] == (i, k) and (i, k) not in earlier) for i, k, s in lines}


def test_line_dedup_is_the_brute_force(odd_docs):
    wanted = brute_lines([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    low = -(2**63)
    got = {}
    for r in line_dedup.similar_lines(odd_docs).collect():
        own = low if r["doc_id"] is None else r["doc_id"]
        of = low if r["class_doc"] is None else r["class_doc"]
        got[own, r["line_no"], r["n_tokens"]] = ((of, r["class_line"]), r["n_links"], r["kept"])
    assert got == wanted
    kept = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(odd_docs.filter("doc_id >= 100")).collect()}
    own = brute_lines([(r["doc_id"], r["text"]) for r in odd_docs.filter("doc_id >= 100").collect()])
    for r in odd_docs.filter("doc_id >= 100").collect():
        left = [x for k, x in enumerate(r["text"].split("\n")) if own.get((r["doc_id"], k, len(set(tokens_of(x)))), (0, 0, True))[2]]
        if any(tokens_of(x) for x in left):
            assert kept[r["doc_id"]]["text"] == "\n".join(left) and kept[r["doc_id"]]["n_chars"] == len("\n".join(left))
        else:
            assert r["doc_id"] not in kept
    assert line_dedup.similar_lines(odd_docs.filter("false")).count() == 0
    # a line that goes from one text of a repeated id stays in the other
    rows = [(1, "a b c d e f", "", "", 0), (2, "a b c d e f\ng h i j k l", "", "", 0), (2, "m n o p q r\ns t u v w x", "", "", 0), (None, "y z y1 z1", "", "", 0)]
    texts = [r["text"] for r in line_dedup.drop_repeated_lines(docs_of(odd_docs, rows)).collect()]
    assert sorted(texts) == ["a b c d e f", "g h i j k l", "m n o p q r\ns t u v w x", "y z y1 z1"]


def test_prefixes_are_long_enough():
    n = np.arange(1, 400)
    for t in (0.5, 0.8, 0.9):
        assert np.array_equal(line_dedup.prefix_length(n, t), [k - math.ceil(round(t * k, 9)) + 1 for k in n])


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_are_the_brute_force(odd_docs, width):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]  # ids repeat, with the same text and with another

    def shingle_set(text):
        w = tokens_of(text)
        return frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))) if w else frozenset()

    sets = sorted({shingle_set(t) for i, t in rows if i is not None} - {frozenset()}, key=sorted)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = union(pairs, range(len(sets)))
    of = {s: group[k] for k, s in enumerate(sets)}
    first = {}
    for i, t in rows:
        s = shingle_set(t)
        if i is not None and s:
            first[of[s]] = min(first.get(of[s], i), i)
    wanted = Counter()
    for i, t in rows:
        s = shingle_set(t)
        c = first[of[s]] if i is not None and s else i
        wanted[i, len(s), c, i == c] += 1
    got = near_dup.near_duplicates(odd_docs, width=width).collect()
    assert Counter(tuple(r) for r in got) == wanted
    # one row of each group stays, and one of equal rows; a text that only shares an id with a copy is not lost
    kept = Counter((r["doc_id"], r["text"]) for r in near_dup.drop_near_duplicates(odd_docs, width=width).collect())
    assert max(kept.values()) == 1
    assert Counter(of[shingle_set(t)] for i, t in kept if i is not None and shingle_set(t)) == Counter(set(of.values()))
    assert {(i, t) for i, t in kept if i is None or not shingle_set(t)} == {(i, t) for i, t in rows if i is None or not shingle_set(t)}
    assert all(i == first[of[shingle_set(t)]] for i, t in kept if i is not None and shingle_set(t))
    assert near_dup.near_duplicates(odd_docs.filter("false")).count() == 0


def test_near_duplicates_keep_what_only_shares_an_id(odd_docs):
    t, u, x = "a b c d e f g h", "i j k l m n o p", "q r s t u v w x"
    docs = docs_of(odd_docs, [(1, t, "", "", 0), (5, t, "", "", 0), (5, u, "", "", 0), (7, x, "", "", 0), (7, x, "", "", 0)])
    assert sorted((r["doc_id"], r["text"]) for r in near_dup.drop_near_duplicates(docs).collect()) == [(1, t), (5, u), (7, x)]


def test_large_groups_are_worked_through_in_proportion(odd_docs, monkeypatch):
    """Blocks and pivots: the same groups as all pairs, and rows sent in proportion to a group's size."""
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(60)]

    def copies(n, first):
        rows = []
        for k in range(n):
            w = [*base]
            w[rnd.randrange(60)] = f"x{first + k}"
            rows.append((first + k, " ".join(w), "", "", 0))
        return rows

    for name in ("SKETCH_BLOCK", "SET_BLOCK"):
        monkeypatch.setattr(near_dup, name, 16)
    sent = []
    linked = blocks._linked

    def counted(placed, *rest):
        placed = placed.cache()
        sent.append(placed.selectExpr("sum(size(blocks))").first()[0] or 0)
        return linked(placed, *rest)

    monkeypatch.setattr(blocks, "_linked", counted)
    totals = []
    chain = [(10_000 + k, " ".join(f"c{j}" for j in range(3 * k, 3 * k + 60)), "", "", 0) for k in range(80)]  # near only to its neighbours
    for n in (200, 800):
        sent.clear()
        rows = copies(n, 0) + chain
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs_of(odd_docs, rows), width=1).collect()}
        assert got == {**{k: 0 for k in range(n)}, **{10_000 + k: 10_000 for k in range(80)}}
        totals.append(sum(sent))
    assert totals[1] < 5 * totals[0]


def test_odd_sketch_distance_follows_similarity():
    rnd = np.random.default_rng(3)
    far = near_dup.largest_distance(0.8)
    for similarity, below in ((0.8, True), (0.95, True), (0.1, False)):
        distances = []
        for _ in range(40):
            common = rnd.integers(0, 2**63, int(1000 * similarity), dtype=np.uint64)
            rest = rnd.integers(0, 2**63, (2, (1000 - len(common)) // 2), dtype=np.uint64)
            values = np.concatenate([common, rest[0], common, rest[1]])
            at = np.array([0, len(values) // 2, len(values)])
            a, b = near_dup.odd_sketches(near_dup.signatures(values, at))
            distances.append(int(np.bitwise_count(a ^ b).sum()))
        assert (max(distances) <= far) if below else (np.median(distances) > far)


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(rnd.randrange(5000, 5200), rnd.randrange(5000, 5200)) for _ in range(80)]
    ids = sorted({x for p in pairs for x in p if p[0] != p[1]})
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == union([p for p in pairs if p[0] != p[1]], ids)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_join_what_is_linked():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        n, m = int(rnd.integers(1, 60)), int(rnd.integers(0, 60))
        a, b = rnd.integers(0, n, m), rnd.integers(0, n, m)
        rows, roots = blocks.stars(n, a, b)
        wanted = union(list(zip(a.tolist(), b.tolist(), strict=True)), range(n))
        assert dict(zip(rows.tolist(), roots.tolist(), strict=True)) == {i: r for i, r in wanted.items() if i != r}


def test_search_recall_and_edges(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    data = rnd.normal(size=(3000, 16)).astype("float32")
    data[1000:2000] = data[0]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0] * 15 + [None]), (5200, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit("clash"))
    got = defaultdict(list)
    for r in ann_tree.nearest_five(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    exact = data.astype("float64")
    norm = np.sqrt((exact * exact).sum(axis=1))
    hits = 0
    for q in range(0, 3000, 50):
        score = (exact * exact[q]).sum(axis=1) / (norm * norm[q])
        score[q] = -2
        best = np.lexsort((np.arange(3000), -score))[:5]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        hits += len({v for _, v, _ in own} & set(best.tolist()))
        for _, v, s in own:
            assert abs(s - score[v]) < 1e-12
    assert set(got) == set(range(0, 3000, 50)) and hits >= 0.9 * 5 * 60
    assert [v for _, v, _ in sorted(got[1000])] == [0, 1001, 1002, 1003, 1004]
    monkeypatch.setattr(ann_tree, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann_tree, "BLOCK", 50)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in ann_tree.nearest_five(df).collect()} == {(q, r, v) for q, own in got.items() for r, v, _ in own}
    # doubles are scored as doubles; a repeated row counts as often as it is there
    fine = [(k, [1.0, k * 1e-12, 0.0]) for k in range(40)] + [(41, [1.0, 2e-13, 0.0])] * 2
    near = ann_tree.nearest_five(spark.createDataFrame(fine, "vec_id long, embedding array<double>")).collect()
    assert [r["vec_id"] for r in sorted(near, key=lambda r: r["rank"])] and all(abs(r["score"] - 1) < 1e-15 for r in near)
    tiny = np.array([1.0, 0.1, 0.2]), np.array([1.0, 0.1 + 1e-12, 0.2])
    pair = ann_tree.nearest_five(spark.createDataFrame([(0, tiny[0].tolist()), (1, tiny[1].tolist())], "vec_id long, embedding array<double>")).first()
    assert pair["score"] == (tiny[0] * tiny[1]).sum() / (np.sqrt((tiny[0] ** 2).sum()) * np.sqrt((tiny[1] ** 2).sum()))
    few = ann_tree.nearest_five(df.filter("vec_id in (0, 1, 2)")).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]
    assert ann_tree.nearest_five(df.filter("false")).count() == 0


def test_token_counts_are_the_librarys(odd_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    source = Counter((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    got = token_count.document_tokens(odd_docs, path, 2048).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == source
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    tricky = ["don't I'M we'LL", "a" * 3000, "ab" * 2000, "x<|endoftext|>y<|startoftext|>", "ΣΑΣ ΟΔΟΣ", "İ ǅ ﬁ", "日本語 ½ Ⅷ", "   a\x85b", "%%%***&&&", "é" * 40]
    assert token_count.merger(path).counts(tricky) == [len(library.encode(t, add_special_tokens=False).ids) for t in tricky]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><aside class="sidebar">Side</aside>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>,<br>second&nbsp;line &lt;x&gt; &#233;<p>Unclosed
 para<div class="ad-slot">Buy</div><form><input value="q"><button>Go</button></form><ul><li>item</ul>
<section class="comments"><p>Nice post!</p></section><footer>By</footer></article><div id="comments">More</div><footer>&copy; 2024</footer></body></html>"""


def test_token_counts_of_every_code_point():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    texts = [f"a{c}b 1{c}{c} {c}. {c}x" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    wanted = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert token_count.merger(path).counts(texts) == wanted


def test_html_of_a_marked_article(spark):
    rows = [(1, "http://a.example.com/x/1", PAGE), (2, None, None), (3, "http://a.example.com/x/2", ""), (4, "no url", "plain <b>text</b>"), (5, "http://a.example.com/x/1", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extract.extract_pages(df).collect()}
    wanted = "Head & line\n\nFirst bold, second line <x> é\n\nUnclosed para\n\nitem"
    assert got[1]["text"] == wanted == got[5]["text"] and got[1]["n_chars"] == len(wanted)
    assert (got[2]["text"], got[3]["text"], got[4]["text"]) == ("", "", "plain text")
    assert html_extract.extract_pages(df.filter("false")).count() == 0


def test_html_without_an_article_loses_shared_lines(spark):
    page = "<html><body><div>Shop | News | About</div><p>{a}</p><p>Shared in the middle</p><p>{b}</p><div>All rights reserved</div></body></html>"
    rows = [(k, f"https://h.example.org/blog/{k}", page.format(a=f"start {k}", b=f"end {k}")) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
    assert got == {k: f"start {k}\n\nend {k}" for k in range(6)}


LOOSE_PAGE = "<html><body><div>Shop | News | About</div><p>{a}</p><p>Shared in the middle</p><p>{b}</p><div>All rights reserved</div></body></html>"


def test_html_differencing_knows_no_range_edges_and_no_copy_groups(spark):
    rows = [(k, f"https://h.example.org/blog/{k}", LOOSE_PAGE.format(a=f"start {k}", b=f"end {k}")) for k in range(6)]
    rows += [(100 + k, f"https://h.example.org/blog/3?s={k:02}", rows[3][2]) for k in range(40)]
    wanted = {i: f"start {3 if i >= 100 else i}\n\nend {3 if i >= 100 else i}" for i, _, _ in rows}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()} == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_html_differencing_decides_in_articles_too(spark):
    page = "<body><article><h1>Title {k}</h1><p>Follow us on all channels</p><p>Text {k}</p>{more}</article></body>"
    rows = [(k, f"http://h.example.org/{k}", page.format(k=k, more="<p>A passage of two</p>" if k in (3, 4) else "")) for k in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\n\nText {k}" + ("\n\nA passage of two" if k in (3, 4) else "") for k in range(8)}


def test_html_menus_and_article_headers():
    menu = "<body><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a> <li>An item with <a href='/c'>a link</a></ul><p>Body</p></body>"
    assert [t for t, _ in html_extract.page_lines(menu)] == ["An item with a link", "Body"]
    titled = "<article><div class='post-header'><h1>Title</h1></div><div class='share-bar'>Share</div><p>Text</article><div class='header'>Top</div>"
    assert [t for t, z in html_extract.page_lines(titled) if z == html_extract.ARTICLE] == ["Title", "Text"]
    assert html_extract.page_lines("<nav><p>open menu<article><p>Text") == [("Text", html_extract.ARTICLE)]


def test_html_articles_keep_what_only_sounds_like_furniture():
    kept = ["<h2 id='related-work'>A</h2>", "<section id='social-history'><p>B</section>", "<p class='notice'>C", "<div id='search-algorithms'>D</div>", "<p class='byline'>E"]
    kept += ["<p>F <math><mi>x</mi></math>", "<dialog open>G</dialog>", "<section id='navigation'><h2 class='header'>H</h2></section>", "<div class='comment-theory'>I</div>"]
    gone = ["<div class='related-posts'>x</div>", "<div role='navigation'>x</div>", "<div id='comments'>x</div>", "<div class='comments'>x</div>", "<div class='adSlot'>x</div>", "<ul class='share_buttons'><li>x</ul>"]
    got = [t for t, _ in html_extract.page_lines("<article>" + "".join(kept + gone) + "</article>")]
    assert got == ["A", "B", "C", "D", "E", "F x", "G", "H", "I"]


def test_html_link_lists_go_only_if_shared(spark):
    page = "<body><ul><li><a href='/'>Home</a></ul><p>Text {k}</p><ul><li><a href='/{k}'>Source {k}</a></ul></body>"
    rows = [(k, f"http://h.example.org/{k}", page.format(k=k)) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Text {k}\n\nSource {k}" for k in range(3)}


@pytest.mark.parametrize("cells", [1 << 26, 8])
def test_alignment_is_a_longest_common_subsequence(cells, monkeypatch):
    monkeypatch.setattr(html_extract, "TABLE_CELLS", cells)  # the small one divides every table
    rnd = random.Random(0)
    for _ in range(800):
        a = [rnd.choice("abcde") for _ in range(rnd.randrange(0, 13))]
        b = [rnd.choice("abcdef") for _ in range(rnd.randrange(0, 13))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        common = [x for x, f in zip(a, html_extract.aligned(a, b), strict=True) if f]
        rest = iter(b)
        assert len(common) == table[-1][-1] and all(x in rest for x in common)


def test_pages_of_very_many_lines_are_aligned_in_bounded_memory():
    import tracemalloc

    rnd = random.Random(3)
    a, b = ([rnd.randrange(500) for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    common = [x for x, f in zip(a, html_extract.aligned(a, b), strict=True) if f]
    assert tracemalloc.get_traced_memory()[1] < 32 << 20 and len(common) > 500
    tracemalloc.stop()
    rest = iter(b)
    assert all(x in rest for x in common)


def plain_smith_waterman(item, window):
    table = np.zeros((len(item) + 1, len(window) + 1))
    for i, x in enumerate(item):
        for j, y in enumerate(window):
            table[i + 1, j + 1] = max(0, table[i, j] + (2 if x == y else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
    return table.max() / (2 * len(item))


def test_alignment_scores():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        item, window = rnd.integers(0, 6, rnd.integers(1, 12)), rnd.integers(0, 6, rnd.integers(1, 25))
        assert decontaminate.align(item, window)[0] == pytest.approx(plain_smith_waterman(item, window))


def test_decontamination_finds_copies_and_edits(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").unionByName(spark.createDataFrame([(900, None), (901, "tiny item"), (902, "w9 w11 w10 w12"), (903, ".")], "item_id long, text string"))
    rnd = random.Random(3)
    texts = [(r["item_id"], r["text"]) for r in items.filter("text is not null").collect() if len(r["text"].split()) > 12]
    filler = " ".join(f"w{k}" for k in range(400))
    rows, wanted = [(0, None), (1, ""), (2, filler), (3, "a tiny item"), (None, texts[0][1])], {(None, texts[0][0]), (4, 901), (5, 902)}
    rows += [(4, "Tiny, item!"), (5, f"{filler} w9 w11 w10, w12 {filler}")]
    for k in range(60):
        i, text = rnd.choice(texts)
        w = text.split()
        for _ in range(len(w) * (k % 3) // 12):
            w[rnd.randrange(len(w))] = "changed"
        rows.append((10 + k, f"{filler} {' '.join(w).upper() if k % 2 else ', '.join(w)} {filler}"))
        wanted.add((10 + k, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == wanted
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()} == {0, 1, 2, 3}
    assert decontaminate.contaminated(docs, items.filter("false")).count() == 0
    assert decontaminate.drop_contaminated(docs.filter("false"), items).count() == 0


def test_decontamination_finds_edits_that_are_copied_often(spark):
    item = [f"q{k}" for k in range(20)]
    edited = item[:6] + [w if k % 3 else f"new{k}" for k, w in enumerate(item[6:])]  # keeps the first four trigrams only
    filler = " ".join(f"w{k}" for k in range(30))
    rows = [(0, f"{filler} {' '.join(item)}")] + [(1 + k, f"{filler} {' '.join(edited)} {filler}") for k in range(2000)]
    rows += [(3000, f"{filler} {' '.join(item[:6])} {filler}")]  # seeds, but no leak
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()} == set(range(2001))
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()] == [3000]


def test_contaminated_pairs_are_the_brute_force(spark):
    """Every pair of a document and an item that shares a trigram and scores enough by plain Smith-Waterman, and no other."""
    rnd = random.Random(8)
    vocabulary = [f"v{k}" for k in range(40)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 14)))) for k in range(12)]
    docs = []
    for k in range(60):
        w = rnd.choice(items)[1].split()
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        docs.append((k, " ".join([rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 20))] + w + [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 20))])))
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    code = {v: k for k, v in enumerate(vocabulary)}
    scores = {}
    for i, text in docs:
        for j, item in items:
            if grams(text.split()) & grams(item.split()):
                scores[i, j] = plain_smith_waterman([code[w] for w in item.split()], [code[w] for w in text.split()])
    wanted = {pair: score for pair, score in scores.items() if score >= 0.5}
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in found}
    # two alignments that share no hit may lie in windows of their own: then the better one counts, as it does here
    assert got == pytest.approx(wanted) and len(wanted) > 30
    for r in found:
        w, item = docs[r["doc_id"]][1].split(), dict(items)[r["item_id"]].split()
        span = [code[x] for x in w[r["start_word"] : r["end_word"]]]
        assert plain_smith_waterman([code[x] for x in item], span) == pytest.approx(r["score"])


def test_words_of_scripts_without_spaces_and_signs():
    import pyarrow as pa

    texts = ["«Hola» mundo—bien", "你好，世界 abc", "ภาษา", "l’eau d'or", "À É à é", "", None]
    words_, at = decontaminate.words_of(pa.array(texts))
    assert [int(at[i + 1] - at[i]) for i in range(len(texts))] == [3, 5, 4, 4, 4, 0, 0]
    assert words_[at[4]] == words_[at[4] + 2] and words_[at[4] + 1] == words_[at[4] + 3]


def test_long_items_are_aligned_in_the_memory_of_a_window():
    import tracemalloc

    rnd = np.random.default_rng(2)
    item = rnd.integers(0, 10**9, 4000)
    window = np.r_[rnd.integers(0, 10**9, 3000), np.delete(item, slice(0, 4000, 7)), rnd.integers(0, 10**9, 3000)]
    tracemalloc.start()
    score, start, end = decontaminate.align(item, window)
    assert tracemalloc.get_traced_memory()[1] < 4 << 20 and 0.6 < score < 0.9 and (start, end) == (3000, len(window) - 3000)
    tracemalloc.stop()


def test_no_alignment_passes_its_bound():
    rnd = np.random.default_rng(6)
    for _ in range(300):
        item, window = rnd.integers(0, 9, rnd.integers(5, 12)), rnd.integers(0, 12, rnd.integers(3, 40))
        assert decontaminate.align(item, window)[0] <= decontaminate.reachable(np.sort(item), window)


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["A b\tc", None, "", "a  B", "éa É", "a\x0bb\x1cc"]
    hashed, at = words.hashed_words(pa.array(texts))
    flat = [w for t in texts for w in tokens_of(t)]
    assert len(hashed) == len(flat) and len(set(hashed.tolist())) == len(set(flat))
    assert [at[i + 1] - at[i] for i in range(len(texts))] == [len(tokens_of(t)) for t in texts]


def test_pipeline_takes_odd_documents(spark, odd_docs, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and ids, clashing names, and an empty table."""
    import corpus_pipeline

    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = docs_of(odd_docs, [(9001, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 5)])
    docs = odd_docs.unionByName(leak).withColumns({"component": F.lit("clash"), "cut": F.lit(1), "kept": F.lit(True), "id": F.lit(0)})
    last = None
    for data in (docs, docs.filter("false")):
        held = data
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = held
            held = stage(spark, held, str(tmp_path))
            path = str(tmp_path / f"{name}{data is docs}")
            held.write.parquet(path)
            held = spark.read.parquet(path)
            if k < 4:
                assert held.columns == docs.columns
                assert {r["doc_id"] for r in held.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
            if name == "decontaminate" and data is docs:
                last = {r["doc_id"] for r in held.collect()}
        assert (held.count() > 0) == (data is docs)
    assert last and 9001 not in last


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < docs.count() <= before
        before = docs.count()
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
