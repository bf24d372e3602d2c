"""Names, tags and labels joined to messages.

Dimension tables are left for the optimizer to broadcast by their measured size; nothing is forced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import render


def resolve_channels(refs: DataFrame, channels: DataFrame) -> DataFrame:
    """Names for channel references (``ref_id``); one's own channel by ``home_name`` where given.

    Empty names count as missing; what stays unknown says so.
    """
    named = channels.filter("name <> ''").select(F.col("channel_id").alias("ref_id"), F.col("name").alias("found"))
    home = F.when(F.col("ref_id") == F.col("home_id"), F.col("home_name"))
    return refs.join(named, "ref_id", "left").withColumn("name", F.coalesce(home, "found", F.lit("<unknown channel>")))


def resolve_roles(refs: DataFrame, roles: DataFrame) -> DataFrame:
    named = roles.filter("name <> ''").select("guild_id", "role_id", F.col("name").alias("found"))
    return refs.join(named, ["guild_id", "role_id"], "left").withColumn("name", F.coalesce("found", F.lit("<unknown role>")))


def label_channels(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Adds ``channel``: the channel's name, else its id as text."""
    names = channels.select("channel_id", F.col("name").alias("__name"))
    return messages.join(names, "channel_id", "left").withColumn("channel", F.coalesce("__name", F.col("channel_id").cast("string"))).drop("__name")


def tag_rows(messages: DataFrame) -> DataFrame:
    return messages.select("message_id", F.explode("tags").alias("tag"))


def attach_tags(messages: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds each message's sorted tags; none: an empty array."""
    grouped = tags.groupBy("message_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return messages.join(grouped, "message_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def hydrate(hits: DataFrame, messages: DataFrame) -> DataFrame:
    """Hits with their messages; hits without a message drop out."""
    return hits.join(messages, "message_id")


def _viewed(messages: DataFrame, tags: DataFrame, channels: DataFrame, fmt: str | None, names: dict[str, DataFrame]) -> DataFrame:
    labelled = label_channels(attach_tags(messages, tags), channels)
    return labelled if fmt is None else render.render(labelled, channels, fmt=fmt, **names)


def message_lookup(messages: DataFrame, tags: DataFrame, channels: DataFrame, message_id: int, *, fmt: str | None = None, **names: DataFrame) -> DataFrame:
    """One message with its tags, channel label and, in a format, its body (``names``: ``users``, ``roles``); or nothing."""
    one = messages.filter(F.col("message_id") == message_id)
    return _viewed(one, tags.filter(F.col("message_id") == message_id), channels, fmt, names)


def recent_messages(messages: DataFrame, *, channel_id: int | None = None, count: int = 50) -> DataFrame:
    """The newest messages of each channel, or of one; ties by the larger id.

    The rank bound is applied before the shuffle as well, so a busy channel ships few rows.
    """
    rows = messages if channel_id is None else messages.filter(F.col("channel_id") == channel_id)
    w = Window.partitionBy("channel_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= count)


def recent_view(
    messages: DataFrame, tags: DataFrame, channels: DataFrame, *, channel_id: int | None = None, count: int = 50, fmt: str = "plain", **names: DataFrame
) -> DataFrame:
    """The newest messages of each channel, or of one, with tags, channel label and body in a format."""
    recent = recent_messages(messages, channel_id=channel_id, count=count)
    few = tags.join(recent.select("message_id"), "message_id", "left_semi")
    return _viewed(recent, few, channels, fmt, names)
