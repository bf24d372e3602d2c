"""Queries on messages: scalars, predicates, projections and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dims, filters, payloads as P, tokens as K
from .registry import Tables, query

M, C = ("messages",), ("channels",)


@query("id_to_timestamp", M, "SELECT message_id, make_timestamp(((((message_id << 22) + 7) >> 22) + 1420070400000) * 1000) AS created_at FROM messages")
def _(t: Tables):
    snow = F.shiftleft("message_id", 22) + 7
    return t.messages.select("message_id", S.id_to_timestamp(snow).alias("created_at"))


@query(
    "uuid5_key", M,
    """, h AS (SELECT message_id, sha1(unhex('fdc7d4142df7543498d5154d1776e052') || unhex(printf('%016x', message_id))) AS d FROM messages)
    SELECT message_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
      CASE WHEN substr(d, 17, 1) IN ('0','4','8','c') THEN '8' WHEN substr(d, 17, 1) IN ('1','5','9','d') THEN '9'
           WHEN substr(d, 17, 1) IN ('2','6','a','e') THEN 'a' ELSE 'b' END || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS entity_key FROM h""",
)
def _(t: Tables):
    return t.messages.select("message_id", S.uuid5_key(F.col("message_id")).alias("entity_key"))


@query(
    "json_fields", ("facts",),
    "SELECT seq, CASE WHEN seq % 3 = 0 THEN kind END AS name, CASE WHEN seq % 3 = 1 THEN CAST(entity_id AS BIGINT) END AS number, "
    "CASE WHEN seq % 3 = 2 THEN seq % 2 = 0 END AS flag FROM facts",
)
def _(t: Tables):
    value = (
        F.when(F.col("seq") % 3 == 0, F.concat(F.lit('"'), "kind", F.lit('"')))
        .when(F.col("seq") % 3 == 1, F.col("entity_id").cast("string"))
        .otherwise((F.col("seq") % 2 == 0).cast("string"))
    )
    doc = t.facts.withColumn("doc", F.try_parse_json(F.concat(F.lit('{"v":'), value, F.lit("}"))))
    field = {k: S.json_field(F.col("doc"), "$.v", k) for k in ("string", "number", "boolean")}
    return doc.select("seq", field["string"].alias("name"), field["number"].alias("number"), field["boolean"].alias("flag"))


@query("html_escape", M, "SELECT message_id, replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM messages")
def _(t: Tables):
    return t.messages.select("message_id", S.html_escape(F.col("content")).alias("escaped"))


@query("normalize_tags", ("vectors",), "SELECT message_id, tag || ',x' AS tags FROM vectors")
def _(t: Tables):
    raw = F.array(F.concat(F.lit(" "), F.upper("tag")), F.lit("  "), F.lit("X "), F.lit(None).cast("string"))
    return t.vectors.select("message_id", F.array_join(S.normalize_tags(raw), ",").alias("tags"))


@query(
    "parse_labels", M,
    "SELECT message_id, CASE WHEN message_id % 4 = 0 THEN '' ELSE 'a,b' END AS tags, message_id % 4 = 1 AS substantive FROM messages",
)
def _(t: Tables):
    reply = (
        F.when(F.col("message_id") % 4 == 0, F.lit('{"tags": ["a"'))
        .when(F.col("message_id") % 4 == 1, F.lit('{"tags": [" A", 7, "b", ""], "substantive": true}'))
        .when(F.col("message_id") % 4 == 2, F.lit('{"tags": ["a", "B "], "substantive": "true"}'))
        .otherwise(F.lit('{"tags": ["a", "b"], "substantive": false}'))
    )
    parsed = filters.parse_labels(t.messages.select("message_id", reply.alias("reply")), "reply")
    return parsed.select("message_id", F.array_join("tags", ",").alias("tags"), "substantive")


def _trivial(x: str) -> str:
    return (
        f"(length(trim(coalesce({x}, ''))) < 3 OR lower(trim(coalesce({x}, ''))) IN ('ok', 'okay', 'lol', 'haha', 'thanks', 'yes', 'nope') "
        f"OR NOT regexp_matches(coalesce({x}, ''), '[A-Za-z]{{2}}'))"
    )


@query(
    "substantive_flag", (),
    "WITH m AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' LOL ' WHEN 1 THEN '12 34 !!' WHEN 2 THEN 'ok' ELSE text END AS x FROM documents) "
    f"SELECT doc_id, NOT {_trivial('x')} AND doc_id % 7 <> 0 AS substantive FROM m",
)
def _(t: Tables):
    d = F.col("doc_id")
    text = F.when(d % 5 == 0, " LOL ").when(d % 5 == 1, "12 34 !!").when(d % 5 == 2, "ok").otherwise(F.col("text"))
    return t.documents.select("doc_id", S.is_substantive(text, d % 7 == 0).alias("substantive"))


@query("bot_flag", M, "SELECT message_id, is_bot OR turn % 5 = 0 AS bot FROM messages")
def _(t: Tables):
    m = P.parse_payload(t.messages)
    return m.select("message_id", filters.bot_flag(F.col("turn") % 5 == 0, F.col("doc")).alias("bot"))


@query("author_extract", M, "SELECT message_id, CASE WHEN turn % 6 = 5 THEN 0 ELSE author_id END AS author_id, CASE WHEN turn % 6 = 5 THEN false ELSE is_bot END AS author_is_bot FROM messages")
def _(t: Tables):
    broken = t.messages.withColumn("payload", F.when(F.col("turn") % 6 == 5, F.lit("{oops")).otherwise(F.col("payload")))
    m = P.parse_payload(broken)
    return m.select("message_id", P.author_id(F.col("doc")).alias("author_id"), P.author_is_bot(F.col("doc")).alias("author_is_bot"))


@query("analyze_messages", M, f"SELECT message_id, NOT {_trivial('plain_text')} AND NOT is_bot AS is_substantive, is_bot, 'en' AS language FROM messages")
def _(t: Tables):
    return filters.analyze(P.parse_payload(t.messages)).select("message_id", "is_substantive", "is_bot", "language")


@query("filter_conjunctive", M, "SELECT message_id, author_id FROM messages WHERE guild_id = 2 AND created_at > TIMESTAMP '2024-01-02 00:00:00' AND created_at < TIMESTAMP '2024-03-01 00:00:00'")
def _(t: Tables):
    keep = filters.conjunctive(guild_id=2, after="2024-01-02 00:00:00", before="2024-03-01 00:00:00")
    return t.messages.filter(keep).select("message_id", "author_id")


@query("filter_any_tags", ("vectors",), "SELECT message_id FROM vectors WHERE tag IN ('t1', 't4') AND guild_id = 1")
def _(t: Tables):
    v = t.vectors.withColumn("tags", F.array("tag"))
    return v.filter(filters.conjunctive(guild_id=1, any_tags=["t4", "t1", "zz"])).select("message_id")


@query("text_like_channels", C, "SELECT channel_id, type, false AS is_thread FROM channels WHERE type IN (0, 5, 10, 11, 12) UNION ALL SELECT channel_id + 100, 11, true FROM channels WHERE parent_id IS NOT NULL")
def _(t: Tables):
    threads = t.channels.filter("parent_id is not null").select((F.col("channel_id") + 100).alias("channel_id"), F.lit(11).alias("type"), F.lit(True).alias("is_thread"))
    return filters.text_like(t.channels.select("channel_id", "type", F.lit(False).alias("is_thread")).unionByName(threads))


@query("project_messages", M, "SELECT message_id, channel_id, guild_id, author_id, created_at, CASE WHEN turn % 4 = 3 THEN TIMESTAMP '2024-03-01 00:00:00' END AS edited_at, CASE WHEN turn > 0 AND turn % 5 <> 4 THEN reply_to_id END AS reply_to_id, turn % 3 = 0 AS has_code, turn % 2 = 0 AS has_attachments, turn % 3 = 1 AS has_embeds FROM messages")
def _(t: Tables):
    return filters.project(K.with_tokens(P.parse_payload(t.messages))).drop("tokens", "plain_text", "is_bot")


@query("content_flags", M, "SELECT message_id, turn % 3 = 0 AS has_code, turn % 2 = 0 AS has_attachments, turn % 3 = 1 AS has_embeds FROM messages")
def _(t: Tables):
    return filters.project(K.with_tokens(P.parse_payload(t.messages))).select("message_id", "has_code", "has_attachments", "has_embeds")


@query("project_channels", C, "SELECT channel_id, guild_id, name, type, parent_id, TIMESTAMP '2024-01-01 00:00:00' + channel_id * INTERVAL '1' DAY AS updated_at FROM channels")
def _(t: Tables):
    raw = t.channels.selectExpr("*", "type AS channel_type", "timestamp'2024-01-01 00:00:00' + channel_id * interval '1' day AS updated_on", "true AS is_present").drop("type")
    return filters.project_channels(raw)


@query("attachment_rows", M, "SELECT message_id, message_id * 10 + 1 AS attachment_id, 'https://cdn.example.com/' || CAST(turn AS STRING) AS url, 'image/png' AS content_type, CAST(100 + turn AS BIGINT) AS size_bytes FROM messages WHERE turn % 2 = 0")
def _(t: Tables):
    return P.attachment_rows(P.parse_payload(t.messages))


@query("embed_rows", M, "SELECT message_id, 1 AS embed_index, 'rich' AS embed_type, 'https://e.example.com/' || CAST(turn AS STRING) AS url, 'T' || CAST(conv_id AS STRING) AS title, CAST(NULL AS STRING) AS description FROM messages WHERE turn % 3 = 1")
def _(t: Tables):
    return P.embed_rows(P.parse_payload(t.messages))


@query("reply_context", M, "SELECT message_id, reply_to_id AS reply_message, channel_id AS reply_channel, CAST(77 AS BIGINT) AS reply_author FROM messages WHERE turn > 0 AND turn % 5 <> 4")
def _(t: Tables):
    r = P.parse_payload(t.messages).select("message_id", P.reply_context(F.col("doc")).alias("r")).filter("r is not null")
    return r.select("message_id", F.col("r.message_id").alias("reply_message"), F.col("r.channel_id").alias("reply_channel"), F.col("r.author_id").alias("reply_author"))


@query("tag_rows", ("vectors",), "SELECT message_id, tag FROM vectors UNION ALL SELECT message_id, 'even' FROM vectors WHERE message_id % 2 = 0")
def _(t: Tables):
    tags = F.when(F.col("message_id") % 2 == 0, F.array("tag", F.lit("even"))).otherwise(F.array("tag"))
    return dims.tag_rows(t.vectors.select("message_id", tags.alias("tags")))


@query("thread_root", C, "SELECT channel_id, CASE WHEN type IN (10, 11, 12) THEN channel_id END AS thread_id, CASE WHEN type IN (10, 11, 12) THEN parent_id ELSE channel_id END AS root_channel_id FROM channels")
def _(t: Tables):
    return filters.thread_root(t.channels).select("channel_id", "thread_id", "root_channel_id")


@query("resolve_channels", ("messages", "channels"), "SELECT m.message_id, m.channel_id AS ref_id, CASE WHEN m.turn = 0 THEN 'home' ELSE coalesce(c.name, '<unknown channel>') END AS name FROM messages m LEFT JOIN channels c ON c.channel_id = m.channel_id")
def _(t: Tables):
    refs = K.with_tokens(t.messages).select("message_id", "turn", "channel_id", F.explode("tokens").alias("k")).filter("k.kind = 'channel'")
    refs = refs.select("message_id", F.col("k.ref_id").alias("ref_id"), F.when(F.col("turn") == 0, F.lit("home")).alias("home_name"), F.col("channel_id").alias("home_id"))
    return dims.resolve_channels(refs, t.channels).select("message_id", "ref_id", "name")


@query("resolve_roles", ("messages",), "SELECT message_id, author_id AS role_id, CASE WHEN author_id < 8 AND author_id <> guild_id THEN CASE WHEN author_id % 2 = 0 THEN '<unknown role>' ELSE 'role ' || CAST(author_id AS STRING) END ELSE '<unknown role>' END AS name FROM messages")
def _(t: Tables):
    members = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit('{"id":"'), i.cast("string"), F.lit('","name":"'), F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("role "), i.cast("string"))), F.lit('"}'))), ",")
    raw = t.guilds.select("guild_id", F.concat(F.lit('{"roles":[{"id":9},'), members, F.lit("]}")).alias("payload"))
    refs = t.messages.select("message_id", "guild_id", F.col("author_id").alias("role_id"))
    return dims.resolve_roles(refs, P.explode_roles(raw)).select("message_id", "role_id", "name")


@query("resolve_users", M, "SELECT message_id, 1 + conv_id % 7 AS user_id, CASE WHEN conv_id % 2 = 0 THEN 'Name ' ELSE 'user' END || CAST(1 + conv_id % 7 AS STRING) AS name FROM messages UNION ALL SELECT message_id, 99, NULL FROM messages")
def _(t: Tables):
    m = P.parse_payload(t.messages).withColumn("names", P.mention_names(F.col("doc")))
    ids = m.select("message_id", "names", F.explode(F.array((1 + F.col("conv_id") % 7).cast("long"), F.lit(99).cast("long"))).alias("user_id"))
    return ids.select("message_id", "user_id", F.try_element_at("names", "user_id").alias("name"))


@query("channel_label", ("messages", "channels"), "SELECT m.message_id, coalesce(c.name, CAST(m.channel_id AS STRING)) AS channel FROM messages m LEFT JOIN channels c ON c.channel_id = m.channel_id")
def _(t: Tables):
    return dims.label_channels(t.messages, t.channels).select("message_id", "channel")


@query("attach_tags", ("messages", "vectors"), "SELECT m.message_id, coalesce(g.tags, '') AS tags FROM messages m LEFT JOIN (SELECT message_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT message_id * 1000 AS message_id, tag FROM vectors UNION ALL SELECT message_id * 1000, 'seen' FROM vectors) GROUP BY message_id) g ON g.message_id = m.message_id")
def _(t: Tables):
    tags = t.vectors.select((F.col("message_id") * 1000).alias("message_id"), F.explode(F.array("tag", F.lit("seen"))).alias("tag"))
    return dims.attach_tags(t.messages.select("message_id"), tags).select("message_id", F.array_join("tags", ",").alias("tags"))


@query("hydrate_hits", ("messages", "vectors"), "SELECT m.message_id, v.channel_id AS hit_channel, m.author_id FROM vectors v JOIN messages m ON m.message_id = v.message_id * 1000")
def _(t: Tables):
    hits = t.vectors.select((F.col("message_id") * 1000).alias("message_id"), F.col("channel_id").alias("hit_channel"))
    return dims.hydrate(hits, t.messages.select("message_id", "author_id"))


_BODY = """'@' || CAST(1 + m.conv_id % 7 AS STRING) || ' ' || m.plain_text || ' #' || coalesce(k.name, '<unknown channel>') || CASE WHEN turn % 3 = 0 THEN ' x = <@1>' ELSE ' https://example.com/a' END"""
_SEEN = "coalesce(c.name, CAST(m.channel_id AS STRING)) AS channel, coalesce(v.tags, '') AS tags"
_WITH = (
    "LEFT JOIN channels c ON c.channel_id = m.channel_id LEFT JOIN channels k ON k.channel_id = m.conv_id % 30 "
    "LEFT JOIN (SELECT message_id * 1000 AS message_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM vectors GROUP BY 1) v ON v.message_id = m.message_id"
)


def _tags(t: Tables):
    return t.vectors.select((F.col("message_id") * 1000).alias("message_id"), "tag")


@query("message_lookup", ("messages", "channels", "vectors"), f"SELECT m.message_id, m.author_id, m.created_at, {_SEEN}, m.plain_text, {_BODY} AS body FROM messages m {_WITH} WHERE m.message_id = 5000")
def _(t: Tables):
    one = dims.message_lookup(t.messages, _tags(t), t.channels, 5000, fmt="plain")
    return one.select("message_id", "author_id", "created_at", "channel", F.array_join("tags", ",").alias("tags"), "plain_text", "body")


@query(
    "recent_messages", ("messages", "channels", "vectors"),
    f"SELECT m.message_id, m.channel_id, m.created_at, place, {_SEEN}, {_BODY} AS body FROM (SELECT *, CAST(row_number() OVER (PARTITION BY channel_id ORDER BY created_at DESC, message_id DESC) AS INT) AS place FROM messages) m {_WITH} WHERE place <= 5",
)
def _(t: Tables):
    recent = dims.recent_view(t.messages, _tags(t), t.channels, count=5)
    return recent.select("message_id", "channel_id", "created_at", "place", "channel", F.array_join("tags", ",").alias("tags"), "body")
