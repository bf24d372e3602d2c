"""Where derived tables and logs are written."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (single-machine tests).
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"


def _root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
        found = LOCAL_CHECKPOINT_DIR
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/palaver"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that driver and executors share."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def kept_at(spark: SparkSession, name: str, make: Callable[[str], None], there: Callable[[str], bool]) -> str:
    """The folder ``name`` in the shared folder, made where it is not there yet; it appears under its name only when it is whole."""
    path = f"{_root(spark)}/{name}"
    if not there(path):
        made = scratch(spark, name)
        make(made)
        at, fs = _folder(spark, path)
        fs.delete(at, True)
        if not fs.rename(_folder(spark, made)[0], at) and not there(path):
            raise RuntimeError(f"{made} could not be renamed to {path}")
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` written in buckets of a column, so that joins on it shuffle the other side only; deleted in the end."""
    spark = df.sparkSession
    path, name = scratch(spark, "buckets"), f"palaver_{uuid.uuid4().hex}"
    n = planned_buckets(df)
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, path)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str, key: str) -> list[int]:
    """The numbers N of the folders ``key=N`` under ``path`` whose write was committed, in order."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{key}=")]
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=", 1)[1]) for p in done)


def discard(spark: SparkSession, path: str) -> None:
    at, fs = _folder(spark, path)
    fs.delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder."""
    at, fs = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


#: Bytes (by the optimizer's estimate) that a bucket stands for, and the fewest and most buckets.
BUCKET_BYTES, FEWEST_BUCKETS, MOST_BUCKETS = 64 << 20, 8, 4_096
#: Estimates from here on say that the size is not known (rows that come from Python have none); and the buckets then.
NOT_KNOWN, BUCKETS_NOT_KNOWN = 1 << 55, 32


def planned_buckets(df: DataFrame) -> int:
    """How many buckets a table is cut into, by the estimated size of its plan; no job is run."""
    size = planned_bytes(df)
    return BUCKETS_NOT_KNOWN if size >= NOT_KNOWN else min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length()))


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size: of a stored one, that of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
