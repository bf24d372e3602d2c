"""Typed columns from verbatim JSON payloads.

A payload that is not JSON, or whose fields are missing or of another kind, gives nulls and
empty arrays, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import id_to_timestamp, json_field, strict_id


def parse_payload(df: DataFrame, payload: str = "payload", into: str = "doc") -> DataFrame:
    return df.withColumn(into, F.try_parse_json(payload))


def json_array(document: Column, path: str) -> Column:
    """The elements of a JSON array field; empty for anything else."""
    return F.coalesce(F.try_variant_get(document, path, "array<variant>"), F.array().cast("array<variant>"))


def author_id(document: Column) -> Column:
    return F.coalesce(strict_id(json_field(document, "$.author.id", "string")), F.lit(0).cast("long"))


def author_is_bot(document: Column) -> Column:
    return F.coalesce(json_field(document, "$.author.bot", "boolean"), F.lit(False))


def edited_at(document: Column) -> Column:
    return F.try_to_timestamp(json_field(document, "$.edited_timestamp", "string"))


def reply_context(document: Column) -> Column:
    """``message_id``, ``channel_id``, ``author_id`` of the replied-to message; null unless its id parses."""
    target = strict_id(json_field(document, "$.referenced_message.id", "string"))
    return F.when(
        target.isNotNull(),
        F.struct(
            target.alias("message_id"),
            strict_id(json_field(document, "$.referenced_message.channel_id", "string")).alias("channel_id"),
            strict_id(json_field(document, "$.referenced_message.author.id", "string")).alias("author_id"),
        ),
    )


def attachment_rows(messages: DataFrame) -> DataFrame:
    """One row for each attachment with an id; needs ``message_id`` and the parsed ``doc``."""
    each = messages.select("message_id", F.explode(json_array(F.col("doc"), "$.attachments")).alias("a"))
    rows = each.select(
        "message_id",
        strict_id(json_field(F.col("a"), "$.id", "string")).alias("attachment_id"),
        json_field(F.col("a"), "$.url", "string").alias("url"),
        json_field(F.col("a"), "$.content_type", "string").alias("content_type"),
        json_field(F.col("a"), "$.size", "number").alias("size_bytes"),
    )
    return rows.filter("attachment_id is not null and url is not null")


def embed_rows(messages: DataFrame) -> DataFrame:
    """One row for each embed that is an object; the index counts skipped elements too."""
    each = messages.select("message_id", F.posexplode(json_array(F.col("doc"), "$.embeds")).alias("embed_index", "e"))
    objects = each.filter(F.schema_of_variant("e").startswith("OBJECT"))
    return objects.select(
        "message_id",
        "embed_index",
        json_field(F.col("e"), "$.type", "string").alias("embed_type"),
        json_field(F.col("e"), "$.url", "string").alias("url"),
        json_field(F.col("e"), "$.title", "string").alias("title"),
        json_field(F.col("e"), "$.description", "string").alias("description"),
    )


def mention_names(document: Column) -> Column:
    """A map from user id to display name: the global name, else the user name."""
    entries = F.transform(
        json_array(document, "$.mentions"),
        lambda m: F.struct(
            strict_id(json_field(m, "$.id", "string")).alias("id"),
            F.coalesce(json_field(m, "$.global_name", "string"), json_field(m, "$.username", "string")).alias("name"),
        ),
    )
    named = F.filter(entries, lambda e: e["id"].isNotNull() & e["name"].isNotNull())
    # a user may be mentioned twice: the first name stands
    firsts = F.filter(named, lambda e, i: ~F.exists(F.slice(named, F.lit(1), i), lambda d: d["id"] == e["id"]))
    return F.map_from_entries(firsts)


def explode_page(pages: DataFrame) -> DataFrame:
    """JSON array pages (``page``, with the caller's ``channel_id`` and ``guild_id``) to message rows."""
    each = pages.select(
        "channel_id", "guild_id", F.explode(F.coalesce(F.try_parse_json("page").cast("array<variant>"), F.array().cast("array<variant>"))).alias("m")
    )
    rows = each.withColumn("message_id", strict_id(json_field(F.col("m"), "$.id", "string"))).filter("message_id is not null")
    return rows.select(
        "message_id",
        "channel_id",
        "guild_id",
        id_to_timestamp(F.col("message_id")).alias("created_at"),
        edited_at(F.col("m")).alias("edited_at"),
        F.to_json("m").alias("payload"),
    )


def extract_channels(raw: DataFrame) -> DataFrame:
    """Channel payloads to rows: the caller's guild where none is given, type 0, no parent, name ''."""
    d = F.col("doc")
    rows = raw.withColumn("doc", F.try_parse_json("payload"))
    return rows.select(
        strict_id(json_field(d, "$.id", "string")).alias("channel_id"),
        F.coalesce(strict_id(json_field(d, "$.guild_id", "string")), F.col("caller_guild_id")).alias("guild_id"),
        F.coalesce(json_field(d, "$.type", "number"), F.lit(0)).cast("int").alias("type"),
        strict_id(json_field(d, "$.parent_id", "string")).alias("parent_id"),
        F.coalesce(json_field(d, "$.name", "string"), F.lit("")).alias("name"),
    ).filter("channel_id is not null")


def explode_roles(raw: DataFrame) -> DataFrame:
    """Guild payloads to (guild, role) rows, without ids that do not parse and the guild's own."""
    each = raw.select("guild_id", F.explode(json_array(F.try_parse_json("payload"), "$.roles")).alias("r"))
    rows = each.select(
        "guild_id",
        strict_id(json_field(F.col("r"), "$.id", "string")).alias("role_id"),
        F.coalesce(json_field(F.col("r"), "$.name", "string"), F.lit("")).alias("name"),
    )
    return rows.filter("role_id is not null and role_id <> guild_id")
