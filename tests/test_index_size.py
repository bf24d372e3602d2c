"""What building and reading the text index moves: blocks of postings, never occurrences."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

from palaver.operators import search
from palaver.sources import textindex


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_index_shuffles_blocks_and_holds_every_place(spark, tmp_path):
    texts = [(k, "run the RUNNING " * 200 + f"word{k % 5} runs") for k in range(60)] + [(7, "runs again"), (None, "running"), (90, None), (91, "the of")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(2)
    want = collections.Counter()
    for k, text in texts:
        for pos, w in enumerate((text or "").lower().split()):
            if w not in search.STOP_WORDS:
                want[("run" if w.startswith("run") else w, k, pos)] += 1
    rows = search.blocks(docs, "id", "text")
    assert rows.count() <= 2 * search.WRITERS * 8 < len(want) / 100  # words of a batch, not occurrences
    textindex.create(docs, str(tmp_path / "ix"), "id", "text", buckets=4)
    for index in (search.postings(docs, "id", "text"), textindex.read(spark, str(tmp_path / "ix"), "id")):
        held = index.collect()
        assert collections.Counter((r["term"], r["id"], p) for r in held for p in r["positions"]) == want
        assert all(list(r["positions"]) == sorted(r["positions"]) and r["tf"] == len(r["positions"]) for r in held)
        assert len({(r["term"], r["id"]) for r in held}) == len(held)


def test_reading_a_changed_index_sorts_no_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "SENT_BYTES", 0)  # more changed ids than may be sent
    path = str(tmp_path / "ix")
    frame = lambda ids, text: spark.createDataFrame([(k, f"{text} {k}") for k in ids], "id long, text string")
    textindex.create(frame(range(50), "old"), path, "id", "text", buckets=4)
    textindex.upsert(frame(range(0, 50, 2), "new"), path, "id", "text")
    index = textindex.read(spark, path, "id")
    assert {r["id"] for r in index.filter("term = 'old'").collect()} == set(range(1, 50, 2))
    assert "SortMergeJoin" not in _plan(index)


def test_snippets_shuffle_texts_as_they_are(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(100)) + " hit hits " + "x " * 60 + "hit") for k in range(5)], "id long, text string")
    hits = search.match(search.postings(docs, "id", "text").cache(), "id", required=["hit"])
    got = search.snippets(hits, docs, "id", "text", length=240)
    assert "SortMergeJoin" not in _plan(got) and "ShuffledHashJoin" in _plan(got)
    first, second = got.filter("id = 3").first()["snippet"].split(" ... ")
    assert first.count("<b>hit</b>") == first.count("<b>hits</b>") == 1 and first.startswith("w88 ") and second.endswith("<b>hit</b>")
    assert got.select(F.count_distinct("id")).first()[0] == 5
