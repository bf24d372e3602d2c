"""Column functions over message tables; all run in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The epoch of message ids in milliseconds, and the namespace of entity keys.
ID_EPOCH_MS = 1420070400000
KEY_NAMESPACE = "fdc7d4142df7543498d5154d1776e052"

#: Short replies that carry no content (compared in lower case).
TRIVIAL_REPLIES = (
    "ok", "okay", "okk", "kk", "k", "lol", "lmao", "rofl", "haha", "hahaha",
    "yep", "yup", "nope", "nah", "yeah", "yes", "no", "sure", "same", "true", "false",
    "nice", "cool", "oof", "rip", "gg", "wp", "ez", "good", "bad", "fine",
    "thanks", "thx", "ty", "tysm", "yw", "np",
    "+1", "-1", ":)", ":(", ":/", ":d", "xd", "^_^", "o/", "\\o",
)


def id_to_timestamp(message_id: Column) -> Column:
    """When an id was made: its upper bits count milliseconds from the id epoch."""
    return F.timestamp_millis(F.shiftright(message_id, 22) + F.lit(ID_EPOCH_MS))


def uuid5_key(entity_id: Column, namespace: str = KEY_NAMESPACE) -> Column:
    """The version-5 UUID of a 64-bit id (eight bytes, big-endian) in a namespace (32 hex digits)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.unhex(F.lpad(F.hex(entity_id), 16, "0"))))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        F.lit("89ab").substr(nibble % 4 + 1, F.lit(1)), F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def strict_id(text: Column) -> Column:
    """A 64-bit id from a string of digits only; else null."""
    return F.when(text.rlike("^[0-9]+$"), F.try_to_number(text, F.lit("9" * 19)).cast("long"))


def json_field(document: Column, path: str, kind: str) -> Column:
    """A field of a VARIANT if its JSON kind is ``kind`` ('string', 'number', 'boolean'); else null."""
    value = F.try_variant_get(document, path, "variant")
    shape = F.schema_of_variant(value)
    if kind == "string":
        return F.when(shape == "STRING", F.try_variant_get(document, path, "string"))
    if kind == "boolean":
        return F.when(shape == "BOOLEAN", F.try_variant_get(document, path, "boolean"))
    if kind == "number":
        return F.when(shape.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(document, path, "long"))
    raise ValueError(f"unknown JSON kind {kind!r}")


def html_escape(text: Column) -> Column:
    out = text
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def normalize_tags(tags: Column) -> Column:
    """Trimmed, lower-case tags without empty ones and nulls."""
    return F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")


def is_trivial(text: Column, replies: tuple[str, ...] = TRIVIAL_REPLIES) -> Column:
    """Blank, under three characters, a stock reply, or without two ASCII letters in a row."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    return (F.length(trimmed) < 3) | F.lower(trimmed).isin(*replies) | ~trimmed.rlike("[A-Za-z]{2}")


def is_substantive(text: Column, is_bot: Column) -> Column:
    return ~is_trivial(text) & ~F.coalesce(is_bot, F.lit(False))


def snippet_words(length: int) -> int:
    """Words of a snippet: a tenth of the wanted length, which is held between 60 and 1000."""
    return min(max(length, 60), 1000) // 10


def reference_kind(kind: Column) -> Column:
    """Stored codes of references: user 0, role 1, everyone 2, here 3, channel 10."""
    codes = {"user": 0, "role": 1, "everyone": 2, "here": 3, "channel": 10}
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[kind].cast("short")
