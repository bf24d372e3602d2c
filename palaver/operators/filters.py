"""Predicates and row projections over message, channel and entity tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_substantive, json_field, normalize_tags
from . import payloads
from .tokens import has_code

#: Channel types that hold text, and those that are threads.
TEXT_TYPES = (0, 5, 10, 11, 12)
THREAD_TYPES = (10, 11, 12)


def conjunctive(
    *, guild_id: int | None = None, channel_id: int | None = None, author_id: int | None = None,
    after: str | None = None, before: str | None = None, any_tags: Sequence[str] | None = None,
) -> Column:
    """The conditions that are given, all of them; both time bounds are strict, and an absent or
    empty parameter adds none.  The result reaches the Parquet scan as pushed filters."""
    parts = [F.col(name) == value for name, value in (("guild_id", guild_id), ("channel_id", channel_id), ("author_id", author_id)) if value is not None]
    if after is not None:
        parts.append(F.col("created_at") > F.lit(after).cast("timestamp"))
    if before is not None:
        parts.append(F.col("created_at") < F.lit(before).cast("timestamp"))
    if any_tags:
        parts.append(F.arrays_overlap("tags", F.array(*map(F.lit, any_tags))))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def text_like(channels: DataFrame) -> DataFrame:
    return channels.filter(F.col("type").isin(*TEXT_TYPES))


def thread_root(channels: DataFrame) -> DataFrame:
    """A thread's id and root channel; other channels are their own root."""
    thread = F.col("type").isin(*THREAD_TYPES)
    return channels.withColumns(
        {"thread_id": F.when(thread, F.col("channel_id")), "root_channel_id": F.when(thread, F.col("parent_id")).otherwise(F.col("channel_id"))}
    )


def bot_flag(declared: Column, document: Column) -> Column:
    return F.coalesce(declared, F.lit(False)) | payloads.author_is_bot(document)


def analyze(messages: DataFrame) -> DataFrame:
    """Adds ``is_bot``, ``is_substantive`` and ``language``; needs ``plain_text`` and ``doc``."""
    bot = bot_flag(F.col("is_bot") if "is_bot" in messages.columns else F.lit(False), F.col("doc"))
    out = messages.withColumn("is_bot", bot)
    return out.withColumns({"is_substantive": is_substantive(F.col("plain_text"), F.col("is_bot")), "language": F.lit("en")})


def project(messages: DataFrame) -> DataFrame:
    """Message rows of the read table, from parsed payloads and tokens."""
    d = F.col("doc")
    good = F.filter(payloads.json_array(d, "$.attachments"), lambda a: json_field(a, "$.id", "string").isNotNull())
    embeds = F.filter(payloads.json_array(d, "$.embeds"), lambda e: F.schema_of_variant(e).startswith("OBJECT"))
    return messages.select(
        "message_id", "channel_id", "guild_id",
        payloads.author_id(d).alias("author_id"),
        "created_at",
        payloads.edited_at(d).alias("edited_at"),
        payloads.reply_context(d)["message_id"].alias("reply_to_id"),
        "tokens", "plain_text",
        has_code(F.col("tokens")).alias("has_code"),
        (F.size(good) > 0).alias("has_attachments"),
        (F.size(embeds) > 0).alias("has_embeds"),
        "is_bot",
    )


def project_channels(changed: DataFrame) -> DataFrame:
    return changed.select("channel_id", "guild_id", "name", F.col("channel_type").alias("type"), "parent_id", F.col("updated_on").alias("updated_at"))


def parse_labels(df: DataFrame, reply: str) -> DataFrame:
    """A model's JSON reply to ``tags`` and ``substantive``; what does not parse gives none and false."""
    doc = F.try_parse_json(reply)
    texts = F.transform(payloads.json_array(doc, "$.tags"), lambda t: json_field(t, "$", "string"))
    return df.withColumns(
        {"tags": normalize_tags(texts), "substantive": F.coalesce(json_field(doc, "$.substantive", "boolean"), F.lit(False))}
    )


def stale(entities: DataFrame, cutoff: str) -> DataFrame:
    """Present entities that last synced before the cutoff and are not syncing now."""
    return entities.filter((F.col("last_synced") < F.lit(cutoff).cast("timestamp")) & F.col("is_present") & (F.col("state") != "Syncing"))


def invalidated(entities: DataFrame, model_column: str, model: str, cutoff: str) -> DataFrame:
    """Enriched entities of another model (or none) that were indexed before the cutoff."""
    other = ~F.col(model_column).eqNullSafe(F.lit(model))
    return entities.filter((F.col("state") == "Enriched") & other & (F.col("indexed_at") < F.lit(cutoff).cast("timestamp")))


def replay_selection(entities: DataFrame, phase: str | None = None) -> DataFrame:
    """Faulted entities of a phase, with the ``route`` on which each is tried again."""
    bare, tagless = F.col("embedding").isNull(), F.col("embedding").isNotNull() & F.col("tags").isNull()
    chosen = {"tag": bare, "classify": tagless}.get(phase or "", F.lit(True))
    route = F.when(bare, "tag").when(tagless, "classify").otherwise("unroutable")
    return entities.filter((F.col("state") == "Faulted") & chosen).withColumn("route", route)


def presence_ratchet(sightings: DataFrame, key: str) -> DataFrame:
    """Once absent, an entity stays absent."""
    return sightings.groupBy(key).agg(F.bool_and("is_present").alias("is_present"))


def inaccessible_events(outcomes: DataFrame) -> DataFrame:
    """The two facts of a scan that was refused (status 403 or 404)."""
    refused = outcomes.filter(F.col("status").isin(403, 404))
    changed = F.struct(F.lit("changed").alias("fact"), F.lit(False).alias("is_present"), F.lit("").alias("name"), F.lit(None).cast("long").alias("cursor"), F.lit(None).cast("long").alias("n_new"), F.lit(None).cast("boolean").alias("caught_up"))
    done = F.struct(F.lit("completed").alias("fact"), F.lit(None).cast("boolean").alias("is_present"), F.lit(None).cast("string").alias("name"), F.col("cursor").alias("cursor"), F.lit(0).cast("long").alias("n_new"), F.lit(True).alias("caught_up"))
    return refused.select("channel_id", F.explode(F.array(changed, done)).alias("f")).select("channel_id", "f.*")
