"""The capture log: JSON lines of ``kind`` and ``data``, with a header line for each session.

A log is a folder of text files (plain or gzip), one subfolder for each guild, so that sessions and
guilds are written and read in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import SCHEMA_VERSION, parse_lines


def write_log(records: DataFrame, path: str, *, session: str) -> None:
    """Appends records (``kind``, ``data`` as JSON text) as a session of the log, with its header."""
    line = F.concat(F.lit('{"kind":"'), "kind", F.lit('","data":'), F.coalesce("data", F.lit("null")), F.lit("}"))
    guild = F.coalesce(F.get_json_object("data", "$.guildId"), F.lit("none"))
    lines = records.select(line.alias("value"), guild.alias("guild_id"))
    header = F.to_json(F.struct(F.lit("header").alias("kind"), F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(session).alias("capturedAt")))
    head = records.sparkSession.range(1).select(header.alias("value"), F.lit("header").alias("guild_id"))
    lines.unionByName(head).withColumn("session", F.lit(session)).write.mode("append").partitionBy("session", "guild_id").text(path)


def checked(records: DataFrame) -> DataFrame:
    """Records without headers; a header of a later schema version fails the read."""
    late = (F.col("kind") == "header") & (F.col("schema_version") > SCHEMA_VERSION)
    fail = F.raise_error(F.concat(F.lit("capture log of schema version "), F.col("schema_version").cast("string"))).cast("string")
    return records.withColumn("kind", F.when(late, fail).otherwise(F.col("kind"))).filter("kind <> 'header'").select("kind", "data")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return checked(parse_lines(spark.read.text(path).select("value")))
