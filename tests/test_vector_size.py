"""What vector searches hold and emit: blocks of bounded size, and of a block a query's best codes only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from palaver.operators import search
from palaver.sources import vectorindex


def test_scores_of_a_few_queries_are_held_at_once(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 4)
    data = np.random.default_rng(1).normal(size=(300, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "message_id long, embedding array<double>")
    asked = rows.filter("message_id < 30").select(F.col("message_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r["query_id"], r["rank"]): r["message_id"] for r in search.vector_topk_batch(rows, asked, k=3).collect()}
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(30):
        assert [got[q, k + 1] for k in range(3)] == np.argsort(-(unit @ unit[q]))[:3].tolist()


def test_an_index_has_few_files_and_equal_codes_go_by_id(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = np.tile(rng.normal(size=(60, 8)), (50, 1))  # every vector fifty times
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "message_id long, embedding array<double>")
    vectorindex.build(rows, str(tmp_path / "ix"))
    book = vectorindex._open(spark, str(tmp_path / "ix"))[0]
    assert len(list((tmp_path / "ix" / "rows").rglob("*.parquet"))) <= search.WRITERS * book.parts < len(book.centroids)
    asked = rows.filter("message_id < 60").select(F.col("message_id").alias("query_id"), F.col("embedding").alias("query"))
    found = {(r["query_id"], r["rank"]): r["id"] for r in vectorindex.search(spark, str(tmp_path / "ix"), asked, k=5).collect()}
    assert found == {(q, k + 1): q + 60 * k for q in range(60) for k in range(5)}
