"""Sinks for upserted, replaced and time-partitioned tables.

A versioned table is hashed by its key into buckets.  A batch rewrites the buckets that its keys fall into, as
``version=N/bucket=B``, and then writes ``manifest=N``, which says for every bucket the version that holds it:
a version counts once its manifest is there, so readers see the last whole one, and what a batch
costs follows its keys and not the table.  The writer of a batch names the version: writing the same batch again starts from
the version before it and overwrites its own, so a retried batch leaves the same table.

A weekly table is partitioned by the week of a time column.  A batch touches only its own weeks: they are
merged into a staging folder first and then replace the partitions, so a writer that dies in
between can be run again.  Readers filter by ``between``, which prunes partitions.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import latest
from .shared import children, discard, finished, planned_buckets

#: Committed versions that stay beside the newest, for readers that have begun.
KEPT_VERSIONS = 1
#: Tasks that may write one bucket of child rows, or one week: a parent may have any number of children.
WRITERS = 8


class Manifest(NamedTuple):
    """Which version holds each bucket that has rows, of how many, and the table's schema."""

    held: dict[int, int]
    buckets: int
    schema: StructType


def _manifest(spark: SparkSession, path: str, version: int) -> Manifest:
    rows = spark.read.parquet(f"{path}/manifest={version}").collect()
    whole = next(r for r in rows if r["bucket"] < 0)
    return Manifest({r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}, whole["version"], StructType.fromJson(json.loads(whole["schema"])))


def _newest(spark: SparkSession, path: str, before: int | None = None) -> Manifest | None:
    versions = [v for v in finished(spark, path, "manifest") if before is None or v < before]
    return _manifest(spark, path, versions[-1]) if versions else None


def _rows(spark: SparkSession, path: str, manifest: Manifest, buckets: set[int] | None = None) -> DataFrame:
    """The rows of all buckets, or of some; no other folder is listed."""
    folders = [f"{path}/version={v}/bucket={b}" for b, v in sorted(manifest.held.items()) if buckets is None or b in buckets]
    return spark.read.schema(manifest.schema).parquet(*folders) if folders else spark.createDataFrame([], manifest.schema)


def read_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest committed version (before one, if given), or None."""
    manifest = _newest(spark, path, before)
    return None if manifest is None else _rows(spark, path, manifest)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(fresh: DataFrame, keys: list[str], touching: DataFrame, path: str, version: int, merged: Callable[[DataFrame], DataFrame], spread: bool, buckets: int | None) -> DataFrame:
    """Writes the buckets of ``touching`` anew: ``merged`` makes their rows of those that they held."""
    if "bucket" in (c.lower() for c in fresh.columns):
        raise ValueError("a versioned table has no column of its own named bucket")
    spark = fresh.sparkSession
    before = _newest(spark, path, version)
    n = before.buckets if before else buckets or planned_buckets(fresh)
    touched = {r["bucket"] for r in touching.select(_bucket(keys, n).alias("bucket")).distinct().collect()}
    rows = fresh if before is None else merged(_rows(spark, path, before, touched))
    placed = rows.select(*fresh.columns, _bucket(keys, n).alias("bucket"))
    dealt = placed.repartition("bucket", F.pmod(F.xxhash64(*fresh.columns), F.lit(WRITERS))) if spread else placed.repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={version}")
    there = {int(x.split("=", 1)[1]) for x in children(spark, f"{path}/version={version}") if x.startswith("bucket=")}
    held = {b: v for b, v in (before.held if before else {}).items() if b not in touched} | dict.fromkeys(there, version)
    lines = [(-1, n, fresh.schema.json()), *((b, v, None) for b, v in held.items())]
    spark.createDataFrame(lines, "bucket int, version int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest={version}")
    _tidy(spark, path)
    return _rows(spark, path, Manifest(held, n, fresh.schema))


def _tidy(spark: SparkSession, path: str) -> None:
    """Deletes what no kept manifest refers to."""
    manifests = finished(spark, path, "manifest")
    kept = manifests[-1 - KEPT_VERSIONS :]
    if kept == manifests:
        return
    used = {(v, b) for m in kept for b, v in _manifest(spark, path, m).held.items()}
    for old in manifests[: -len(kept)]:
        discard(spark, f"{path}/manifest={old}")
    for v in finished(spark, path, "version"):
        if v > kept[-1]:
            continue
        own = {b for version, b in used if version == v}
        if not own:
            discard(spark, f"{path}/version={v}")
            continue
        for name in children(spark, f"{path}/version={v}"):
            if name.startswith("bucket=") and int(name.split("=", 1)[1]) not in own:
                discard(spark, f"{path}/version={v}/{name}")


def write_upsert(batch: DataFrame, path: str, keys: list[str], seq: str, *, version: int, buckets: int | None = None) -> DataFrame:
    """The table after the batch's last row of each key took the place of the key's row; returns it as read back.

    ``buckets`` is fixed by the first version (by default, by the size of its batch).
    """
    fresh = latest.dedup_last(batch, keys, seq).drop(seq)
    return _write(fresh, keys, batch.select(*keys), path, version, lambda held: latest.upsert(held, batch, keys, seq), False, buckets)


def write_children(batch: DataFrame, parents: DataFrame, path: str, parent: str, *, version: int, buckets: int | None = None) -> DataFrame:
    """The table after the rows of all touched parents gave way to the batch's."""
    touching = batch.select(parent).unionByName(parents.select(parent))
    return _write(batch, [parent], touching, path, version, lambda held: latest.replace_children(held, batch, parents, parent), True, buckets)


def week_of(at: str) -> Column:
    return F.floor(F.unix_seconds(at) / 604800).cast("int")


def write_weeks(batch: DataFrame, path: str, keys: list[str], seq: str, at: str) -> None:
    """Upserts a batch into a weekly table; a key's rows have one week, as its time is part of what it names."""
    spark = batch.sparkSession
    fresh = batch.withColumn("week", week_of(at))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    merged = latest.dedup_last(fresh, [*keys, "week"], seq).drop(seq)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        touched = spark.read.parquet(path).join(fresh.select("week").distinct(), "week", "left_semi")
        merged = latest.upsert(touched, fresh, [*keys, "week"], seq)
    staging = f"{path}_staging"
    merged.write.mode("overwrite").parquet(staging)
    whole = spark.read.parquet(staging)
    # a week is written by several tasks
    whole.repartition("week", F.pmod(F.xxhash64(*keys), F.lit(WRITERS))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").parquet(path)
    discard(spark, staging)


def between(spark: SparkSession, path: str, at: str, start: str, end: str) -> DataFrame:
    """Rows of a weekly table from ``start`` to before ``end``; other weeks are not read."""
    low, high = (F.lit(x).cast("timestamp") for x in (start, end))
    week = lambda t: F.floor(F.unix_seconds(t) / 604800).cast("int")
    return spark.read.parquet(path).filter((F.col("week") >= week(low)) & (F.col("week") <= week(high)) & (F.col(at) >= low) & (F.col(at) < high))
