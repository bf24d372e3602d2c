"""Queries on captured records, cursors and table upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, ingest as I, latest as L, payloads as P, rollups as R
from ..sources import capture, sinks
from ..streaming import jobs
from . import message_queries, token_queries  # noqa: F401  (their SQL is counted below)
from .registry import ORACLE_SQL, Tables, query

M, C = ("messages",), ("channels",)


def _lines(t: Tables):
    captured = F.to_json(F.struct(
        F.lit("messageCaptured").alias("kind"),
        F.struct(F.col("message_id").alias("messageSnowflake"), F.col("channel_id").alias("channelId"), F.col("guild_id").alias("guildId"), F.col("author_id").alias("authorId"), F.col("payload").alias("payloadJson"), F.col("is_bot").alias("authorIsBot")).alias("data"),
    ))
    edited = F.to_json(F.struct(F.lit("messageEditObserved").alias("kind"), F.struct(F.col("message_id").alias("messageSnowflake"), F.col("created_at").alias("editedAt")).alias("data")))
    odd = F.lit('{"kind":"somethingElse","data":{"a":1}}')
    return t.messages.select(F.explode(F.array(captured, F.when(F.col("turn") % 2 == 1, edited).otherwise(F.lit("  ")), odd)).alias("value"))


@query("event_demux", M, "SELECT 'messageCaptured' AS kind, message_id, channel_id, guild_id FROM messages UNION ALL SELECT 'messageEditObserved', message_id, NULL, NULL FROM messages WHERE turn % 2 = 1")
def _(t: Tables):
    records = I.parse_lines(_lines(t))
    parts = [
        I.demux(records, kind).select(F.lit(kind).alias("kind"), F.col("messageSnowflake").alias("message_id"), F.col("channelId").alias("channel_id"), F.col("guildId").alias("guild_id"))
        for kind in ("messageCaptured", "messageEditObserved")
    ]
    return parts[0].unionByName(parts[1])


_RECORD_KINDS = "SELECT 'messageCaptured' AS kind, count(*) AS n FROM messages UNION ALL SELECT 'messageEditObserved', count(*) FROM messages WHERE turn % 2 = 1 UNION ALL SELECT 'somethingElse', count(*) FROM messages"


@query("capture_sink", M, _RECORD_KINDS)
def _(t: Tables):
    path = jobs.scratch(t.spark, "capture")
    capture.write_log(I.parse_lines(_lines(t)).filter("kind <> ''"), path, session="20240101T000000")
    return capture.read_log(t.spark, path).groupBy("kind").agg(F.count("*").alias("n"))


@query("capture_scan", M, "SELECT message_id, author_id FROM messages")
def _(t: Tables):
    path = jobs.scratch(t.spark, "capture")
    capture.write_log(I.parse_lines(_lines(t)).filter("kind <> ''"), path, session="20240101T000000")
    return I.demux(capture.read_log(t.spark, path), "messageCaptured").select(F.col("messageSnowflake").alias("message_id"), F.col("authorId").alias("author_id"))


@query("page_explode", M, "SELECT message_id, channel_id, guild_id, make_timestamp(((message_id >> 22) + 1420070400000) * 1000) AS created_at, CASE WHEN turn % 4 = 3 THEN TIMESTAMP '2024-03-01 00:00:00' END AS edited_at FROM messages")
def _(t: Tables):
    page = F.concat(F.lit('[{"id":"x"},'), F.array_join(F.sort_array(F.collect_list("payload")), ","), F.lit("]"))
    pages = t.messages.groupBy("conv_id", "channel_id", "guild_id").agg(page.alias("page"))
    return P.explode_page(pages).drop("payload")


@query("channel_extract", C, "SELECT channel_id, CASE WHEN channel_id % 2 = 0 THEN guild_id ELSE 77 END AS guild_id, CASE WHEN channel_id % 3 = 0 THEN type ELSE 0 END AS type, parent_id, CASE WHEN channel_id % 5 = 0 THEN '' ELSE name END AS name FROM channels")
def _(t: Tables):
    c = F.col("channel_id")
    payload = F.concat(
        F.lit('{"id":"'), c.cast("string"), F.lit('"'),
        F.when(c % 2 == 0, F.concat(F.lit(',"guild_id":"'), F.col("guild_id").cast("string"), F.lit('"'))).otherwise(""),
        F.when(c % 3 == 0, F.concat(F.lit(',"type":'), F.col("type").cast("string"))).otherwise(""),
        F.when(F.col("parent_id").isNotNull(), F.concat(F.lit(',"parent_id":"'), F.col("parent_id").cast("string"), F.lit('"'))).otherwise(""),
        F.when(c % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(',"name":"'), F.col("name"), F.lit('"'))),
        F.lit("}"),
    )
    return P.extract_channels(t.channels.select(payload.alias("payload"), F.lit(77).cast("long").alias("caller_guild_id")))


@query("roles_explode", ("guilds",), "SELECT guild_id, k AS role_id, CASE WHEN k % 2 = 0 THEN '' ELSE 'r' || CAST(k AS STRING) END AS name FROM guilds, (SELECT unnest(range(6)) AS k) WHERE k <> guild_id")
def _(t: Tables):
    role = lambda i: F.concat(F.lit('{"id":"'), i.cast("string"), F.lit('"'), F.when(i % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(',"name":"r'), i.cast("string"), F.lit('"'))), F.lit("}"))
    roles = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), role), ",")
    return P.explode_roles(t.guilds.select("guild_id", F.concat(F.lit('{"roles":[{"id":4},{"id":"x1"},'), roles, F.lit("]}")).alias("payload")))


_CURSORS = ", k AS (SELECT channel_id, max(message_id) - 2000 AS cursor FROM messages WHERE channel_id % 3 <> 0 GROUP BY 1)"


def _cursors(t: Tables):
    return t.messages.filter("channel_id % 3 <> 0").groupBy("channel_id").agg((F.max("message_id") - 2000).alias("cursor"))


@query("incremental_scan", M, _CURSORS + " SELECT m.message_id, m.channel_id FROM messages m LEFT JOIN k ON k.channel_id = m.channel_id WHERE m.message_id > coalesce(k.cursor, 0)")
def _(t: Tables):
    return L.incremental_scan(t.messages.select("message_id", "channel_id"), _cursors(t))


@query(
    "cursor_advance", M,
    _CURSORS + """, s AS (SELECT channel_id, max(message_id) AS newest, count(*) AS n FROM messages WHERE turn = 0 GROUP BY 1)
    SELECT coalesce(k.channel_id, s.channel_id) AS channel_id, greatest(coalesce(cursor, 0), coalesce(newest, 0)) AS cursor, coalesce(n, 0) AS n_new, coalesce(n, 0) < 100 AS short_pass
    FROM k FULL JOIN s ON s.channel_id = k.channel_id""",
)
def _(t: Tables):
    return L.advance_cursors(_cursors(t), t.messages.filter("turn = 0"))


@query("upsert_merge", ("facts",), "SELECT entity_id, kind, CAST(max_by(seq, seq) AS BIGINT) AS last_seq FROM facts WHERE seq % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT entity_id, kind, CAST(-1 AS BIGINT) FROM facts GROUP BY 1, 2 HAVING count(*) FILTER (WHERE seq % 2 = 0) = 0")
def _(t: Tables):
    target = t.facts.select("entity_id", "kind", F.lit(-1).cast("long").alias("last_seq")).distinct()
    batch = t.facts.filter("seq % 2 = 0").select("entity_id", "kind", F.col("seq").alias("last_seq"), "seq")
    path = jobs.scratch(t.spark, "facts")
    sinks.write_upsert(target.withColumn("seq", F.lit(0)), path, ["entity_id", "kind"], "seq", version=0)
    return sinks.write_upsert(batch, path, ["entity_id", "kind"], "seq", version=1)


@query("replace_by_key", M, "SELECT message_id, author_id, CASE WHEN turn % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM messages")
def _(t: Tables):
    target = t.messages.select("message_id", "author_id", F.lit("old").alias("version"))
    batch = t.messages.filter("turn % 2 = 0").select("message_id", "author_id", F.explode(F.array(F.lit("stale"), F.lit("new"))).alias("version"))
    path = jobs.scratch(t.spark, "messages")
    sinks.write_upsert(target.withColumn("seq", F.lit(0)), path, ["message_id"], "seq", version=0)
    return sinks.write_upsert(batch.withColumn("seq", F.when(F.col("version") == "new", 2).otherwise(1)), path, ["message_id"], "seq", version=1)


@query("replace_children", M, "SELECT message_id, ordinal FROM messages, (SELECT unnest([0, 1]) AS ordinal) WHERE turn % 2 = 1 OR ordinal = 0")
def _(t: Tables):
    target = t.messages.select("message_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"))
    touched = t.messages.filter("turn % 2 = 0")
    path = jobs.scratch(t.spark, "children")
    sinks.write_children(target, target, path, "message_id", version=0)
    return sinks.write_children(touched.select("message_id", F.lit(0).alias("ordinal")), touched, path, "message_id", version=1)


@query("vector_upsert", ("vectors",), "SELECT message_id, channel_id, CASE WHEN message_id % 3 = 0 THEN 'changed' ELSE tag END AS tag FROM vectors")
def _(t: Tables):
    rows = t.vectors.select("message_id", "channel_id", "tag", "embedding")
    batch = rows.filter("message_id % 3 = 0").withColumns({"tag": F.lit("changed"), "seq": F.lit(1)})
    path = jobs.scratch(t.spark, "vectors")
    sinks.write_upsert(rows.withColumn("seq", F.lit(0)), path, ["message_id"], "seq", version=0)
    return sinks.write_upsert(batch, path, ["message_id"], "seq", version=1).drop("embedding")


@query("sync_plan", ("messages", "channels"), _CURSORS + " SELECT c.channel_id, c.name, coalesce(k.cursor, 0) AS cursor FROM channels c LEFT JOIN k ON k.channel_id = c.channel_id")
def _(t: Tables):
    return I.sync_plan(t.channels.select("channel_id", "name"), _cursors(t))


@query("dedup_capture", ("facts",), "SELECT entity_id, kind, min(seq) AS seq FROM facts GROUP BY 1, 2")
def _(t: Tables):
    return L.dedup_last(t.facts.select("entity_id", "kind", "seq", (-F.col("seq")).alias("back")), ["entity_id", "kind"], "back").drop("back")


@query("poll_due", ("facts",), "SELECT entity_id, max(ts) + INTERVAL '5' MINUTE AS due FROM facts WHERE kind = 'view' GROUP BY 1")
def _(t: Tables):
    return jobs.next_poll(t.facts.filter("kind = 'view'"), "entity_id", "ts")


@query("inaccessible_events", C, "SELECT channel_id, 'changed' AS fact, false AS is_present, '' AS name, NULL AS cursor, NULL AS n_new, NULL AS caught_up FROM channels WHERE channel_id % 4 IN (1, 2) UNION ALL SELECT channel_id, 'completed', NULL, NULL, channel_id * 10, 0, true FROM channels WHERE channel_id % 4 IN (1, 2)")
def _(t: Tables):
    status = F.when(F.col("channel_id") % 4 == 1, 403).when(F.col("channel_id") % 4 == 2, 404).otherwise(200)
    return filters.inaccessible_events(t.channels.select("channel_id", status.alias("status"), (F.col("channel_id") * 10).alias("cursor")))


def _rows_of(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS table_name, count(*) AS n FROM ({sql})"


@query(
    "stream_project", (),
    " UNION ALL ".join(
        _rows_of(name, sql)
        for name, sql in (
            ("messages", "SELECT * FROM conversations"), ("tags", "SELECT unnest([1, 2]) FROM conversations"),
            ("references", ORACLE_SQL["reference_rows"]), ("attachments", ORACLE_SQL["attachment_rows"]), ("embeds", ORACLE_SQL["embed_rows"]),
        )
    ),
)
def _(t: Tables):
    return jobs.project_stream(t.spark, f"{t.sf_dir}/conversations.parquet")


@query(
    "stream_project_dims", (),
    "SELECT 'channels' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'guilds', count(*) FROM region UNION ALL SELECT 'roles', CAST(sum(r_regionkey % 3) AS BIGINT) FROM region",
)
def _(t: Tables):
    on = "timestamp'2024-01-01 00:00:00' AS updated_on"
    channels = jobs.parquet_stream(t.spark, f"{t.sf_dir}/nation.parquet").selectExpr("n_nationkey AS channel_id", "n_regionkey AS guild_id", "n_name AS name", "0 AS channel_type", "CAST(NULL AS BIGINT) AS parent_id", on, "true AS is_present")
    roles = "transform(slice(array(1L, 2L, 3L), 1, CAST(r_regionkey % 3 AS INT)), i -> named_struct('id', i, 'name', concat('r', i))) AS roles"
    guilds = jobs.parquet_stream(t.spark, f"{t.sf_dir}/region.parquet").selectExpr("r_regionkey AS guild_id", "r_name AS name", roles, on)
    tables = {}
    for kind, stream in (("channels", channels), ("guilds", guilds)):
        folder = jobs.scratch(t.spark, kind)
        jobs.start_projection(stream, folder, kind=kind, every=None).awaitTermination()
        tables |= jobs.projected(t.spark, folder, stream, kind)
    return R.store_counts(tables)


@query(
    "stream_hourly", ("facts",),
    """, h AS (SELECT entity_id AS channel_id, date_trunc('hour', ts) AS bucket, count(*) AS n FROM facts GROUP BY 1, 2)
    SELECT * FROM h WHERE bucket + INTERVAL '1' HOUR <= (SELECT max(ts) - INTERVAL '1' HOUR FROM facts)""",
)
def _(t: Tables):
    return jobs.hourly_stream(t.spark, f"{t.sf_dir}/events.parquet")


@query("replay_stream", M, _RECORD_KINDS)
def _(t: Tables):
    path = jobs.scratch(t.spark, "capture")
    capture.write_log(I.parse_lines(_lines(t)).filter("kind <> ''"), path, session="20240101T000000")
    return jobs.replay_stream(t.spark, path)
