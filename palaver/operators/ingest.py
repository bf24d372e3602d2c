"""Capture-log records by kind, sync plans and key correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The record kinds and the typed fields of their bodies.
KINDS = {
    "messageCaptured": "messageId string, messageSnowflake bigint, channelId bigint, guildId bigint, authorId bigint, currentState string, updatedOn timestamp, payloadJson string, authorIsBot boolean, homeChannelName string",
    "messageEditObserved": "messageSnowflake bigint, channelId bigint, guildId bigint, editedAt timestamp, updatedPayloadJson string",
    "channelChanged": "channelId bigint, guildId bigint, name string, topic string, channelType int, parentId bigint, isPresent boolean, updatedOn timestamp",
    "guildChanged": "guildId bigint, name string, roles array<struct<id: bigint, name: string>>, isPresent boolean, updatedOn timestamp",
}
SCHEMA_VERSION = 1


def _field(record: Column, name: str) -> Column:
    """A field of a parsed JSON object by its name in any letter case (of several, the last); nested values are JSON text."""
    same = F.map_filter(record, lambda k, v: F.lower(k) == name.lower())
    return F.try_element_at(F.map_values(same), F.lit(-1))


def _typed(record: Column, fields: T.StructType) -> Column:
    """A struct of the given fields; what cannot be read as its type is null."""

    def value(f: T.StructField) -> Column:
        text = _field(record, f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.transform(F.from_json(text, "array<map<string, string>>"), lambda m: _typed(m, f.dataType.elementType))
        return text.try_cast(f.dataType)

    return F.struct(*[value(f).alias(f.name) for f in fields])


def parse_lines(lines: DataFrame) -> DataFrame:
    """Log lines (``value``) to ``kind`` and ``data``; blank lines drop out, a line that is no JSON object is an error.

    Field names are read in any letter case.
    """
    bad = F.raise_error(F.concat(F.lit("unreadable line in a capture log: "), F.substring("value", 1, 200))).cast("map<string, string>")
    record = F.from_json("value", "map<string, string>")
    rows = lines.filter(F.trim("value") != "").select(F.when(record.isNull(), bad).otherwise(record).alias("e"))
    e = F.col("e")
    return rows.select(
        F.coalesce(_field(e, "kind"), F.lit("")).alias("kind"), _field(e, "data").alias("data"), _field(e, "schemaVersion").try_cast("int").alias("schema_version")
    )


def demux(records: DataFrame, kind: str) -> DataFrame:
    """The typed rows of one kind; records of unknown kinds belong to none.  A body that is null or no object is an error."""
    fields = T.StructType.fromDDL(KINDS[kind])
    rows = records.filter(F.col("kind") == kind)
    body = F.from_json("data", "map<string, string>")
    bad = F.raise_error(F.lit(f"{kind} without a body")).cast("map<string, string>")
    typed = rows.select(F.when(body.isNull(), bad).otherwise(body).alias("b"))
    return typed.select(_typed(F.col("b"), fields).alias("b")).select("b.*")


def sync_plan(channels: DataFrame, cursors: DataFrame) -> DataFrame:
    """One row for each channel to sync, from its cursor or from 0."""
    return channels.join(cursors, "channel_id", "left").withColumn("cursor", F.coalesce("cursor", F.lit(0)))


def heartbeat_fanout(heartbeats: DataFrame, entities: DataFrame) -> DataFrame:
    """Every heartbeat (``beat_at``, ``cutoff``) with the present, idle entities that last synced before its cutoff.

    A heartbeat is one row for each tick, so the nested loop is over ticks, not over entities.
    """
    due = (F.col("last_synced") < F.col("cutoff")) & F.col("is_present") & (F.col("state") != "Syncing")
    return entities.join(heartbeats, due)


def correlate(facts: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Facts of known entities; facts that match none are discarded."""
    return facts.join(entities, key)
