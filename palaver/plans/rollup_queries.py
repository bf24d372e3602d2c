"""Queries that count, rank and compare over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latest as L, rollups as R
from ..sources import rollup, sinks
from ..sources.shared import scratch
from .registry import Tables, query

_ACTIVE = """, h AS (SELECT channel_id, date_trunc('hour', created_at) AS bucket, count(*) AS n FROM messages GROUP BY 1, 2)
SELECT c.channel_id, c.name, CAST(sum(h.n) AS BIGINT) AS total, max(h.bucket) + INTERVAL '1' HOUR AS last_active
FROM h JOIN channels c ON c.channel_id = h.channel_id
WHERE c.guild_id IN (1, 2, 3) AND h.bucket >= TIMESTAMP '2024-01-03 00:00:00' - INTERVAL '72' HOUR GROUP BY 1, 2"""


@query("active_channels", ("messages", "channels"), _ACTIVE)
def _(t: Tables):
    dim = t.channels.filter("guild_id in (1, 2, 3)")
    return R.active_channels(R.hourly_counts(t.messages), dim, since_hours=72, now="2024-01-03 00:00:00")


@query("hourly_counts", ("messages",), "SELECT channel_id, date_trunc('hour', created_at) AS bucket, count(*) AS n FROM messages GROUP BY 1, 2")
def _(t: Tables):
    return R.hourly_counts(t.messages)


@query("hourly_event_counts", ("facts",), "SELECT entity_id AS channel_id, date_trunc('hour', ts) AS bucket, count(*) AS n FROM facts GROUP BY 1, 2")
def _(t: Tables):
    return R.hourly_counts(t.facts.withColumnRenamed("entity_id", "channel_id"), at="ts")


@query(
    "rollup_refresh", ("facts",),
    """SELECT entity_id AS channel_id, date_trunc('hour', ts) AS bucket, CASE WHEN date_trunc('hour', ts) >= TIMESTAMP '2024-01-13 12:00:00'
      AND date_trunc('hour', ts) < TIMESTAMP '2024-01-20 11:00:00' THEN count(*) ELSE 7 * count(*) END AS n FROM facts GROUP BY 1, 2""",
)
def _(t: Tables):
    messages = t.facts.select(F.col("entity_id").alias("channel_id"), F.col("ts").alias("created_at"))
    stale = R.hourly_counts(messages).withColumn("n", F.col("n") * 7)
    path = scratch(t.spark, "rollup")
    rollup.create(stale, path)
    rollup.note(messages.filter("channel_id % 2 = 0"), path, 0)
    rollup.note(messages.filter("channel_id % 2 = 1"), path, 1)
    return rollup.refresh(messages, path, now="2024-01-20 12:00:00").select("channel_id", "bucket", "n")


@query("chunk_counts", ("messages",), "SELECT CAST(floor(epoch(created_at) / 604800) AS BIGINT) AS week, count(*) AS n FROM messages GROUP BY 1")
def _(t: Tables):
    path = scratch(t.spark, "weekly")
    rows = t.messages.select("message_id", "channel_id", "created_at", F.lit(0).alias("seq"))
    sinks.write_weeks(rows, path, ["message_id"], "seq", "created_at")
    return t.spark.read.parquet(path).groupBy(F.col("week").cast("long").alias("week")).agg(F.count("*").alias("n"))


@query("week_range", ("messages",), "SELECT message_id, channel_id, created_at FROM messages WHERE created_at >= TIMESTAMP '2024-01-04 12:00:00' AND created_at < TIMESTAMP '2024-01-12 06:00:00'")
def _(t: Tables):
    path = scratch(t.spark, "weekly")
    rows = t.messages.select("message_id", "channel_id", "created_at", F.lit(0).alias("seq"))
    sinks.write_weeks(rows, path, ["message_id"], "seq", "created_at")
    return sinks.between(t.spark, path, "created_at", "2024-01-04 12:00:00", "2024-01-12 06:00:00").drop("week")


@query("state_counts", ("orders_log",), "SELECT 'order' AS entity, state, count(*) AS n FROM orders_log GROUP BY 2 UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY 2")
def _(t: Tables):
    orders = t.orders_log.select(F.lit("order").alias("entity"), "state")
    return R.state_counts(orders.unionByName(t.facts.select(F.lit("event").alias("entity"), F.col("kind").alias("state"))))


@query("syncing_count", ("orders_log",), "SELECT CAST(coalesce(sum(CASE WHEN state = 'P' THEN 1 ELSE 0 END), 0) AS BIGINT) AS in_progress FROM orders_log")
def _(t: Tables):
    return t.orders_log.agg(F.count_if(F.col("state") == "P").alias("in_progress"))


_LATENCY = """SELECT l_orderkey, l_linenumber, CAST(epoch(CAST(l_shipdate AS TIMESTAMP)) - epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS gap,
 CAST(CASE WHEN l_linenumber % 3 <> 0 THEN epoch(CAST(l_shipdate AS TIMESTAMP)) - epoch(CAST(o_orderdate AS TIMESTAMP)) - 86400 END AS BIGINT) AS dwell, l_returnflag
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


def _latency(t: Tables):
    log = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    published = F.col("o_orderdate").cast("timestamp")
    log = log.select(
        "l_orderkey", "l_linenumber", "l_returnflag", published.alias("published"), F.col("l_shipdate").cast("timestamp").alias("received"),
        F.when(F.col("l_linenumber") % 3 != 0, published + F.expr("interval 1 day")).alias("enqueued"),
    )
    return R.transport_latency(log)


@query("transport_latency", (), f"SELECT l_orderkey, l_linenumber, gap, dwell FROM ({_LATENCY})")
def _(t: Tables):
    return _latency(t).select("l_orderkey", "l_linenumber", "gap", "dwell")


@query(
    "latency_percentiles", (),
    f"SELECT l_returnflag, quantile_disc(gap, 0.5) AS p50, quantile_disc(gap, 0.95) AS p95, quantile_disc(gap, 0.99) AS p99 FROM ({_LATENCY}) GROUP BY 1",
)
def _(t: Tables):
    return R.percentiles(_latency(t), "gap", by="l_returnflag")


@query("gap_violations", (), f"SELECT l_returnflag, count(*) AS n, max(gap) AS largest FROM ({_LATENCY}) WHERE gap > 100 * 86400 GROUP BY 1")
def _(t: Tables):
    return R.gap_violations(_latency(t), "gap", 100 * 86400, by="l_returnflag")


@query("store_counts", (), "SELECT 'messages' AS table_name, count(*) AS n FROM conversations UNION ALL SELECT 'channels', count(*) FROM nation UNION ALL SELECT 'guilds', count(*) FROM region UNION ALL SELECT 'vectors', count(*) FROM embeddings")
def _(t: Tables):
    return R.store_counts({"messages": t.conversations, "channels": t.nation, "guilds": t.region, "vectors": t.embeddings})


@query("entity_snapshots", ("guilds",), "SELECT guild_id, name, CASE WHEN guild_id % 2 = 0 THEN CAST(guild_id AS INT) ELSE 0 END AS n_roles FROM guilds")
def _(t: Tables):
    roles = F.when(F.col("guild_id") % 2 == 0, F.slice(F.sequence(F.lit(1), F.lit(9)), F.lit(1), F.col("guild_id").cast("int")))
    return R.entity_snapshots(t.guilds.withColumn("roles", roles)).select("guild_id", "name", "n_roles")


@query(
    "set_fingerprint", ("messages",),
    """SELECT channel_id, sha256(string_agg(CAST(message_id AS STRING) || ':' || CASE WHEN turn % 2 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' ELSE '' END, '|' ORDER BY message_id)) AS fingerprint
    FROM messages GROUP BY 1""",
)
def _(t: Tables):
    pins = t.messages.withColumn("edited_at", F.when(F.col("turn") % 2 == 0, F.col("created_at")))
    return L.set_fingerprint(pins, ["channel_id"], "message_id", "edited_at")


@query("pin_counts", ("messages",), "SELECT channel_id, count(*) AS n_pins, CAST(sum(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_edited FROM messages GROUP BY 1")
def _(t: Tables):
    edited = F.when(F.col("turn") % 2 == 0, F.col("created_at"))
    return t.messages.groupBy("channel_id").agg(F.count("*").alias("n_pins"), F.count(edited).alias("n_edited"))


@query("pin_edits", ("messages",), "SELECT message_id, channel_id, CAST(0 AS BIGINT) AS author_id, created_at AS edited_at FROM messages WHERE turn % 2 = 0")
def _(t: Tables):
    pins = t.messages.withColumn("edited_at", F.when(F.col("turn") % 2 == 0, F.col("created_at")))
    return pins.filter("edited_at is not null").select("message_id", "channel_id", F.lit(0).cast("long").alias("author_id"), "edited_at")


@query("dedup_last_single", ("facts",), "SELECT entity_id, kind, seq FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1")
def _(t: Tables):
    return L.dedup_last(t.facts.select("entity_id", "kind", "seq"), ["entity_id"], "seq")


@query("dedup_last_composite", ("facts",), "SELECT entity_id, kind, seq, round(value, 4) AS value FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, kind ORDER BY seq DESC) = 1")
def _(t: Tables):
    last = L.dedup_last(t.facts.select("entity_id", "kind", "seq", "value"), ["entity_id", "kind"], "seq")
    return last.withColumn("value", F.round("value", 4))


@query("current_snapshot", ("orders_log",), "SELECT entity_id, seq, state FROM orders_log QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY placed_at DESC, seq DESC) = 1")
def _(t: Tables):
    rows = t.orders_log.withColumn("order", F.struct("placed_at", "seq")).select("entity_id", "seq", "state", "order")
    return L.dedup_last(rows, ["entity_id"], "order").drop("order")


@query(
    "snapshot_changes", ("facts",),
    "SELECT entity_id, seq, kind FROM (SELECT *, lag(kind) OVER w AS before, row_number() OVER w AS n FROM facts WINDOW w AS (PARTITION BY entity_id ORDER BY seq)) WHERE n = 1 OR before IS DISTINCT FROM kind",
)
def _(t: Tables):
    return L.snapshot_changes(t.facts, "entity_id", "seq", ["kind"]).select("entity_id", "seq", "kind")


def _daily_changes(facts):
    daily = facts.withColumns({"day": F.date_trunc("day", "ts"), "none": F.lit(None).cast("timestamp")})
    return L.fingerprint_changes(L.set_fingerprint(daily, ["entity_id", "day"], "seq", "none"), "entity_id", "day")


_DAILY = """, d AS (SELECT entity_id, date_trunc('day', ts) AS day, sha256(string_agg(CAST(seq AS STRING) || ':', '|' ORDER BY seq)) AS fingerprint FROM facts GROUP BY 1, 2)
    SELECT entity_id, day, fingerprint FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY entity_id ORDER BY day) AS before FROM d) WHERE before IS DISTINCT FROM fingerprint"""


@query("fingerprint_changes", ("facts",), _DAILY)
def _(t: Tables):
    return _daily_changes(t.facts)


@query("fingerprint_changes_whole", ("facts",), _DAILY)
def _(t: Tables):
    return _daily_changes(t.facts)
