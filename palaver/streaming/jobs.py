"""Structured Streaming jobs; each runs what is there to its end and returns the table that it wrote.

A job's folder holds its offsets and what it wrote: one folder for each micro-batch, named by the
batch's number and overwritten if the batch is run again.  A job that is started again on its folder
goes on where it stopped and leaves no row twice.  An empty source gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from ..operators import filters, latest, lifecycle, payloads, rollups, tokens
from ..operators.ingest import parse_lines
from ..plans import views
from ..sources.capture import checked
from ..sources.shared import discard, finished, scratch
from . import keyed

__all__ = ["hourly_stream", "lifecycle_stream", "next_poll", "project_stream", "replay_stream", "scratch", "start_projection", "timer_stream"]

#: A query's lateness bound: later rows are left to the rollup's repair.
WATERMARK = "1 hour"
#: Batches of a keyed job's log beyond which it is merged when it is read.
MERGED_AFTER = 32
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, every: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/offsets").foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _read(spark: SparkSession, path: str, empty: DataFrame) -> DataFrame:
    """What the batches under ``path`` wrote; ``empty`` gives the columns."""
    parts = [f"{path}/batch={k}" for k in finished(spark, path, "batch")]
    return spark.read.schema(empty.schema).parquet(*parts) if parts else spark.createDataFrame([], empty.schema)


def parquet_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of a Parquet table (a file, or a folder of files), at most ``files`` in a micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        path, reader = folder, reader.option("pathGlobFilter", name)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _fan_out(messages: DataFrame) -> dict[str, DataFrame]:
    rows = tokens.with_tokens(payloads.parse_payload(messages))
    tags = rows.select("message_id", F.explode(F.array(F.concat(F.lit("author"), "author_id"), F.lit("chat"))).alias("tag"))
    return {
        "messages": filters.project(rows).drop("tokens"), "references": tokens.reference_rows(rows),
        "attachments": payloads.attachment_rows(rows), "embeds": payloads.embed_rows(rows), "tags": tags,
    }


class Projection(NamedTuple):
    """What a stream of rows is projected to, the most rows that are flushed as one, and how long rows wait at most."""

    tables: Callable[[DataFrame], dict[str, DataFrame]]
    rows: int
    every: str


#: The bounds of a flush, by what is projected.
PROJECTIONS = {
    "messages": Projection(_fan_out, 2_000, "10 seconds"),
    "channels": Projection(lambda changed: {"channels": filters.project_channels(changed)}, 50, "2 seconds"),
    "guilds": Projection(
        lambda changed: {
            "guilds": changed.filter("name <> ''").select("guild_id", "name", F.col("updated_on").alias("updated_at")),
            "roles": changed.select("guild_id", F.explode("roles").alias("r")).select("guild_id", F.col("r.id").alias("role_id"), "r.name"),
        },
        10, "2 seconds",
    ),
}


def start_projection(rows: DataFrame, folder: str, *, kind: str = "messages", every: str | None = "") -> StreamingQuery:
    """Starts the fan-out of a stream of messages, channels or guilds into their tables under ``folder``.

    A micro-batch is flushed when its time is over (``every``, by default the kind's own; None: what is there, then the end) or when the
    stream's own bound on a batch is reached.  It is written in files of no more rows than the kind flushes as one, so a reader that
    takes a file at a time meets the same bound.  A batch's rows are persisted once for all its tables.
    """
    projection = PROJECTIONS[kind]

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for name, part in projection.tables(held).items():
                part.write.mode("overwrite").option("maxRecordsPerFile", projection.rows).parquet(f"{folder}/{name}/batch={batch_id}")
        finally:
            held.unpersist()

    return _start(rows, write, folder, projection.every if every == "" else every)


def project_stream(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Messages fanned out to five tables; returns the rows of each."""
    folder = folder or scratch(spark, "projected")
    stream = parquet_stream(spark, path).selectExpr(*views.VIEWS["messages"][1])
    start_projection(stream, folder, every=None).awaitTermination()
    return rollups.store_counts(projected(spark, folder, stream))


def projected(spark: SparkSession, folder: str, like: DataFrame, kind: str = "messages") -> dict[str, DataFrame]:
    """The tables that projections of rows like these have written so far."""
    empty = PROJECTIONS[kind].tables(spark.createDataFrame([], like.schema))
    return {name: _read(spark, f"{folder}/{name}", table) for name, table in empty.items()}


def hourly_stream(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Hourly counts by entity of the hours that the watermark has closed, each written once.

    Hours that end after the last fact's time less ``WATERMARK`` are still open: they are written when later facts close
    them, in this run or the next one on the folder.
    """
    folder = folder or scratch(spark, "hourly")
    facts = parquet_stream(spark, path).selectExpr(*views.VIEWS["facts"][1]).withWatermark("ts", WATERMARK)
    counts = facts.groupBy(F.window("ts", "1 hour"), "entity_id").agg(F.count("*").alias("n"))
    flat = counts.select(F.col("entity_id").alias("channel_id"), F.col("window.start").alias("bucket"), "n")
    _start(flat, lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/hours/batch={k}"), folder).awaitTermination()
    return _read(spark, f"{folder}/hours", flat)


def replay_stream(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """A capture log as a stream at full speed; returns its records by kind."""
    folder = folder or scratch(spark, "replayed")
    records = checked(parse_lines(spark.readStream.text(f"{path}/*/*").select("value")))
    _start(records, lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/records/batch={k}"), folder).awaitTermination()
    return _read(spark, f"{folder}/records", records).groupBy("kind").agg(F.count("*").alias("n"))


def _log(spark: SparkSession, path: str, empty: DataFrame, keys: list[str]) -> DataFrame:
    """What a keyed job's batches wrote: the newest row by ``keys``.  A long log is first merged into one table."""
    merged, parts = finished(spark, path, "merged"), finished(spark, path, "batch")
    upto = merged[-1] if merged else -1
    folders = [f"{path}/merged={upto}"] * bool(merged) + [f"{path}/batch={k}" for k in parts if k > upto]
    if not folders:
        return spark.createDataFrame([], empty.schema)
    newest = latest.dedup_last(spark.read.schema(empty.schema).parquet(*folders), keys, "step")
    if len(folders) <= MERGED_AFTER:
        return newest
    newest.write.mode("overwrite").parquet(f"{path}/merged={parts[-1]}")
    for old in merged:
        discard(spark, f"{path}/merged={old}")
    for old in parts:
        discard(spark, f"{path}/batch={old}")
    return spark.read.schema(empty.schema).parquet(f"{path}/merged={parts[-1]}")


def _keyed(facts: DataFrame, key: str, processor: StatefulProcessor, schema: StructType, keys: list[str], folder: str, delay: str) -> DataFrame:
    """Runs a keyed job to its end; returns the newest of its rows by ``keys``."""
    spark = facts.sparkSession
    path, provider = f"{folder}/rows", "spark.sql.streaming.stateStore.providerClass"
    grouped = facts.withWatermark("at", delay).groupBy(key)
    rows = grouped.transformWithState(processor, outputStructType=schema, outputMode="Update", timeMode="EventTime")
    before = spark.conf.get(provider)
    spark.conf.set(provider, STATE_STORE)
    try:
        writer = rows.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/offsets")
        query = writer.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/batch={k}")).trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before)
    query.awaitTermination()
    return _log(spark, path, spark.createDataFrame([], schema), keys)


def lifecycle_stream(
    facts: DataFrame, key: str, rules: lifecycle.Transitions, folder: str | None = None, *, delay: str = WATERMARK, request: keyed.Request | None = None
) -> DataFrame:
    """A lifecycle over a stream of facts in keyed state; returns the states it ended with, as ``lifecycle.fold`` does.

    Facts need ``seq``, ``kind`` and ``at``, their event time, and may come in any order within ``delay``; later ones are
    dropped.  With a ``request``, one that is not answered in time becomes a fact of kind ``timeout`` by an event-time timer.  State and offsets
    lie in ``folder``: a job that died goes on from there, and a batch costs what its own keys cost.
    """
    spark = facts.sparkSession
    step = next(step for known, step in keyed.STEPS if known is rules)
    like = lifecycle.fold(lifecycle.guild_facts(spark.createDataFrame([], facts.schema), key) if rules is lifecycle.GUILD else spark.createDataFrame([], facts.schema), key, rules)
    start = spark.range(1).selectExpr(*[f"{field.start} AS {name}" for name, field in rules.items()]).first().asDict()
    fields = [like.schema[name] for name in rules]
    count = StructField("n_facts", IntegerType())
    state = StructType([StructField("step", LongType()), StructField("deadline", TimestampType()), count, *fields])
    out = StructType([like.schema[key], StructField("step", LongType()), count, *fields])
    fact = StructType([f for f in facts.schema if f.name != key])
    processor = keyed.Lifecycle(state, fact, out, step, start, request)
    return _keyed(facts, key, processor, out, [key], folder or scratch(spark, "states"), delay).drop("step")


def timer_stream(
    facts: DataFrame, key: str, *, sets: tuple[str, ...], seconds: float, cancels: bool = True, folder: str | None = None, delay: str = WATERMARK
) -> DataFrame:
    """Timers that facts set, replace and cancel: ``key``, ``seq`` (unique by key), ``due`` and ``status``, the last known.

    A status is ``cancelled`` (or replaced) by a fact in time, ``fired`` by one that came late or by the watermark, or ``open``.
    """
    spark = facts.sparkSession
    facts = facts.select(key, "seq", "kind", "at")
    due = [StructField("seq", facts.schema["seq"].dataType), StructField("due", TimestampType())]
    state = StructType([StructField("step", LongType()), *due])
    out = StructType([facts.schema[key], StructField("step", LongType()), *due, StructField("status", StringType())])
    processor = keyed.Timers(state, StructType(facts.schema.fields[1:]), out, sets, seconds, cancels)
    return _keyed(facts, key, processor, out, [key, "seq"], folder or scratch(spark, "timers"), delay).drop("step")


def next_poll(results: DataFrame, key: str, at: str, minutes: int = 5) -> DataFrame:
    """When each entity is due again: some minutes after its last result."""
    return results.groupBy(key).agg((F.max(at) + F.expr(f"interval {minutes} minutes")).alias("due"))
