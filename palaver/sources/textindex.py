"""A stored text index that is kept up by segments.

A folder holds segments of postings, a block for each term and part of the ids, each written once: ``segment=N`` by bucket of the terms, and
``replaced=N``, the ids whose earlier postings segment N makes void (changed and deleted ones).  Reading
takes, for every id, the postings of segments not older than its last replacement.  When there are many segments
they are merged into one, ``whole=N``, which stands for all up to N; readers that began before go on with the files they
listed.  So an upsert reads and writes its own messages only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import SENT_BYTES, WRITERS, blocks, bucket_of, gathered, listed, termed
from .shared import discard, finished, planned_bytes, stored

#: Bytes of text that a bucket of terms stands for, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 4_096
#: Tasks that may write one bucket: a term that is everywhere is not written by one.
BUCKET_WRITERS = WRITERS
#: Bytes of stored blocks that a task gathers and writes.
TASK_BYTES = 4 << 20
#: Segments beyond which an index is merged.
SEGMENTS = 8


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/settings").first()["buckets"]


def _write(rows: DataFrame, path: str, buckets: int, size: int) -> None:
    """Writes blocks of ``size`` bytes, dealt out by bucket and part of the ids, as one block for each term and part."""
    tasks = min(buckets * BUCKET_WRITERS, max(1, math.ceil(size / TASK_BYTES)))
    dealt = rows.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartition(tasks, "bucket", "_writer").sortWithinPartitions("bucket", "term", "_writer")
    gathered(dealt, "bucket int, term string, _writer int").drop("_writer").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _index(messages: DataFrame, path: str, id_col: str, text_col: str, buckets: int) -> None:
    """Indexes messages under ``path``: one shuffle, of blocks of postings."""
    spark = messages.sparkSession
    held = stored(blocks(messages, id_col, text_col), "blocks")
    rows = termed(held)
    _write(rows, path, buckets, planned_bytes(held))
    for at in (held.stored_at, rows.stems_at):
        discard(spark, at)


def create(messages: DataFrame, path: str, id_col: str, text_col: str, *, buckets: int | None = None) -> None:
    """Indexes all messages in a new folder; the number of buckets follows the size of their texts."""
    if buckets is None:
        size = messages.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        buckets = min(MOST_BUCKETS, 1 << max(3, math.ceil(math.log2(size / BUCKET_BYTES + 1))))
    messages.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/settings")
    _index(messages, f"{path}/whole=0", id_col, text_col, buckets)


def upsert(changed: DataFrame, path: str, id_col: str, text_col: str, *, deleted: DataFrame | None = None) -> None:
    """Indexes changed and new messages as a segment of their own and voids what earlier ones hold of them and of ``deleted`` ids."""
    spark = changed.sparkSession
    n = 1 + max([*finished(spark, path, "whole"), *finished(spark, path, "replaced")])
    ids = changed.select(id_col) if deleted is None else changed.select(id_col).unionByName(deleted.select(id_col))
    _index(changed, f"{path}/segment={n}", id_col, text_col, _buckets(spark, path))
    ids.distinct().write.mode("overwrite").parquet(f"{path}/replaced={n}")  # last: only now the segment counts
    if n - finished(spark, path, "whole")[-1] > SEGMENTS:
        merge(spark, path, id_col)


def read(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """The postings that hold, with their ``bucket``; filters on it and on ``term`` reach the scans."""
    whole = finished(spark, path, "whole")[-1]
    later = [n for n in finished(spark, path, "replaced") if n > whole]
    base = spark.read.parquet(f"{path}/whole={whole}")
    columns = ["term", "ids", "places", "bucket"]
    kinds = base.select(*columns).schema
    out = listed(base.select(*columns), id_col)
    if later:
        every = base.select(*columns, F.lit(whole).alias("_segment"))
        replaced = []
        for n in later:
            own = spark.read.schema(kinds).parquet(f"{path}/segment={n}")
            every = every.unionByName(own.select(*columns, F.lit(n).alias("_segment")))
            replaced.append(spark.read.parquet(f"{path}/replaced={n}").select(id_col, F.lit(n).alias("_last")))
        last = replaced[0]
        for part in replaced[1:]:
            last = last.unionByName(part)
        small = planned_bytes(last) <= SENT_BYTES
        last = last.groupBy(id_col).agg(F.max("_last").alias("_last"))
        # postings are not sorted for the join: the ids are sent or hashed
        held = listed(every, id_col).join(F.broadcast(last) if small else last.hint("shuffle_hash"), id_col, "left")
        out = held.filter(F.col("_last").isNull() | (F.col("_segment") >= F.col("_last"))).select(*out.columns)
    out.buckets = _buckets(spark, path)
    return out


def merge(spark: SparkSession, path: str, id_col: str) -> None:
    """Rewrites the postings that hold as one segment; those it stands for are deleted."""
    whole, replaced = finished(spark, path, "whole"), finished(spark, path, "replaced")
    upto = max([*whole, *replaced])
    if upto == whole[-1]:
        return
    rows, size = read(spark, path, id_col), sum(planned_bytes(spark.read.parquet(f"{path}/{x}")) for x in [f"whole={whole[-1]}", *(f"segment={n}" for n in replaced)])
    each = rows.select("term", F.pmod(F.xxhash64(id_col), F.lit(BUCKET_WRITERS)).cast("int").alias("_writer"), F.array(id_col).alias("ids"), F.array(F.size("positions")).alias("tfs"), F.col("positions").alias("pos"))
    _write(each, f"{path}/whole={upto}", _buckets(spark, path), size)
    for old in whole:
        discard(spark, f"{path}/whole={old}")
    for old in replaced:
        discard(spark, f"{path}/segment={old}")
        discard(spark, f"{path}/replaced={old}")
