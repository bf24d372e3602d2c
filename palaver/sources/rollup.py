"""A stored hourly rollup that is refreshed where it was touched.

The rollup is a table of counts partitioned by day.  Batches of messages note the hours that they touch, late
ones too, in a log; a refresh counts the noted hours of its window anew and replaces the days that hold them, so
the files of other days stay as they are, and only messages of those hours are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollups import hourly_counts
from .shared import discard, finished


def note(batch: DataFrame, path: str, number: int, at: str = "created_at") -> None:
    """Notes the hours of batch ``number``; a batch that is noted again leaves the same log."""
    hours = batch.select(F.date_trunc("hour", at).alias("bucket")).distinct()
    hours.write.mode("overwrite").parquet(f"{path}/touched/batch={number}")


def _by_day(counts: DataFrame, path: str) -> None:
    counts.withColumn("day", F.to_date("bucket")).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/counts")


def create(counts: DataFrame, path: str) -> None:
    _by_day(counts, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/counts").drop("day")


def refresh(messages: DataFrame, path: str, *, now: str, days: int = 7, open_hours: int = 1) -> DataFrame:
    """Counts the noted hours from ``now`` less ``days`` to ``now`` less ``open_hours`` anew; other noted hours wait for a later refresh.

    The new days are staged before they replace the old ones, and the log is shortened last: a refresh that died is run again.
    """
    spark = messages.sparkSession
    noted = finished(spark, f"{path}/touched", "batch")
    if not noted:
        return read(spark, path)
    log = spark.read.parquet(*[f"{path}/touched/batch={n}" for n in noted]).distinct()
    end = F.date_trunc("hour", F.lit(now).cast("timestamp") - F.expr(f"interval {open_hours} hour"))
    start = F.date_trunc("hour", F.lit(now).cast("timestamp") - F.expr(f"interval {days} day"))
    inside = (F.col("bucket") >= start) & (F.col("bucket") < end)
    due = log.filter(inside)
    bounds = due.agg(F.min("bucket").alias("low"), (F.max("bucket") + F.expr("interval 1 hour")).alias("high")).first()
    if bounds["low"] is not None:
        near = messages.filter((F.col("created_at") >= F.lit(bounds["low"])) & (F.col("created_at") < F.lit(bounds["high"])))
        fresh = hourly_counts(near).join(due, "bucket", "left_semi")
        touched = due.select(F.to_date("bucket").alias("day")).distinct()
        held = spark.read.parquet(f"{path}/counts").join(touched, "day", "left_semi").drop("day")
        staging = f"{path}/staging"
        held.join(due, "bucket", "left_anti").select(*fresh.columns).unionByName(fresh).write.mode("overwrite").parquet(staging)
        _by_day(spark.read.parquet(staging), path)
        discard(spark, staging)
    log.filter(~inside).coalesce(1).write.mode("overwrite").parquet(f"{path}/touched/batch={noted[-1] + 1}")
    for n in noted:
        discard(spark, f"{path}/touched/batch={n}")
    return read(spark, path)
