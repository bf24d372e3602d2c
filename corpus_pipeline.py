"""The corpus pipeline: each stage works on all that the stage before it kept.

Language identification drops what it rejects; line dedup removes repeated lines; near-dedup keeps
one document of each group; decontamination drops documents that hold a test item; the rest is
packed into sequences.  Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import decontaminate, language_id, line_dedup, near_dup, packing
from palaver.llm.queries import tokenizer_path
from palaver.llm.tables import bound_batches, fresh_name, read_table, store

#: Some stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    own = fresh_name(docs, "own")
    learned = docs.filter(~language_id.held_out() & F.col("doc_id").isNotNull())
    model = language_id.learn(learned.select("doc_id", "text", "lang"))
    told = docs.withColumn(own, language_id.identify_text(F.col("text"), model))
    return told.filter(F.col(own)["accepted"]).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return line_dedup.drop_repeated_lines(docs, threshold=0.8)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return near_dup.drop_near_duplicates(docs, width=5, threshold=0.8)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dup", dedup_documents),
    ("decontaminate", drop_test_items),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
