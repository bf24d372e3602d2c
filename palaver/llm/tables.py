"""Input tables and shared scratch tables."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (single-machine tests).
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"


#: Rows of an Arrow batch between Spark and a Python worker: texts are long.
BATCH_ROWS = 2_000


def bound_batches(spark: SparkSession) -> None:
    """Holds Arrow batches of the session to ``BATCH_ROWS`` rows, unless it asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside: a row of some tables holds megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
        found = LOCAL_CHECKPOINT_DIR
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    It cuts the lineage (a lost executor costs a re-read, not a recomputation), keeps the
    columns prunable and gives the optimizer the true size of what follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palaver/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(stored: DataFrame) -> None:
    """Deletes a table that ``store`` wrote; nothing that is still to be computed may read it."""
    path = stored.sparkSession._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(stored.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps now.

    Spark removes them once the driver has collected what refers to them, which a driver with
    little to do puts off; until then each step's files stay on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its own names."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name += "_"
    return name
