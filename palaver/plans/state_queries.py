"""Queries on entity states and lifecycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import uuid5_key
from ..operators import filters, ingest as I, lifecycle as Y, models, rollups as R
from ..streaming import jobs
from . import views
from .registry import Tables, query

_KINDS = (
    "CASE kind WHEN 'signup' THEN 'captured' WHEN 'view' THEN CASE WHEN seq % 2 = 0 THEN 'analyzed' ELSE 'projected' END "
    "WHEN 'click' THEN CASE WHEN seq % 2 = 0 THEN 'tagged' ELSE 'classified' END WHEN 'purchase' THEN 'edit' "
    "ELSE CASE seq % 4 WHEN 0 THEN 'fault' WHEN 1 THEN 'replay' WHEN 2 THEN 'tags_invalidated' ELSE 'classify_invalidated' END END"
)
_CHANNEL_KINDS = "CASE kind WHEN 'signup' THEN 'sync_due' WHEN 'view' THEN 'completed' WHEN 'click' THEN 'changed' WHEN 'error' THEN 'pins' ELSE CASE WHEN seq % 3 = 0 THEN 'poll' ELSE 'seen' END END"
_GUILD_KINDS = "CASE kind WHEN 'signup' THEN 'sync_due' WHEN 'click' THEN 'changed' WHEN 'view' THEN 'heartbeat' WHEN 'error' THEN 'heartbeat' ELSE 'seen' END"
_OK, _PRESENT = "seq % 5 <> 0", "seq % 97 <> 0"
#: What channel and guild facts carry beside their kind, in the SQL that Spark and the oracle share.
_CARRIED = (
    "ts AS at", "seq AS number", "seq % 7 AS size", "concat('n', CAST(seq % 10 AS STRING)) AS name", "CAST(seq % 3 AS INT) AS type",
    "CASE WHEN seq % 2 = 0 THEN seq END AS parent", "concat('d', CAST(seq % 5 AS STRING)) AS digest",
    "CASE WHEN seq % 4 <> 0 THEN ts - INTERVAL '2' HOUR END AS synced_at", "ts - INTERVAL '30' HOUR AS cutoff",
)

# The oracle's SQL is written from the lifecycles' tables by hand, apart from the library's rules: a transition is a
# row (state, kind, guard, next state, what it does), and a fact without a row changes nothing.
_WALK = """, q AS (SELECT entity_id, {kinds} AS kind, {ok} AS ok, {carried}, row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS k FROM facts),
  tr AS (SELECT * FROM (VALUES {moves}) x({columns}))"""

_MESSAGE_MOVES = """
  ('', 'captured', '', 'AnalyzePending', ''),
  ('AnalyzePending', 'analyzed', 'ok', 'ProjectPending', ''), ('AnalyzePending', 'analyzed', 'not ok', 'Excluded', 'settle'),
  ('AnalyzePending', 'fault', '', 'Faulted', 'settle'), ('AnalyzePending', 'timeout', '', 'Faulted', 'settle'),
  ('ProjectPending', 'fault', '', 'Faulted', 'settle'), ('ProjectPending', 'timeout', '', 'Faulted', 'settle'),
  ('ProjectPending', 'projected', 'edited', 'ProjectPending', 'again'), ('ProjectPending', 'projected', 'clean', 'Tagging', 'reset'),
  ('Tagging', 'tagged', 'edited', 'ProjectPending', 'discard'), ('Tagging', 'tagged', 'clean', 'Classifying', 'embed'), ('Tagging', 'fault', '', 'Faulted', 'settle'),
  ('Classifying', 'classified', 'edited', 'ProjectPending', 'discard'), ('Classifying', 'classified', 'clean', 'Enriched', 'enrich'), ('Classifying', 'fault', '', 'Faulted', 'settle'),
  ('Enriched', 'edit', '', 'ProjectPending', ''), ('Enriched', 'tags_invalidated', '', 'Tagging', ''), ('Enriched', 'classify_invalidated', '', 'Classifying', ''),
  ('Faulted', 'replay', 'no vector', 'Tagging', ''), ('Faulted', 'replay', 'no tags', 'Classifying', ''),
  ('AnalyzePending', 'edit', '', 'AnalyzePending', 'queue'), ('ProjectPending', 'edit', '', 'ProjectPending', 'queue'),
  ('Tagging', 'edit', '', 'Tagging', 'queue'), ('Classifying', 'edit', '', 'Classifying', 'queue')"""
_MESSAGE_WALK = (
    views.cte("facts").replace("WITH ", "WITH RECURSIVE ", 1) + _WALK.format(kinds=_KINDS, ok=_OK, carried="ts AS at", moves=_MESSAGE_MOVES, columns="a, kind, guard, b, does")
    + """, s AS (SELECT DISTINCT entity_id, CAST(0 AS BIGINT) AS k, '' AS state, false AS pending, false AS embedded, false AS tagged, 0 AS n_coalesced, 0 AS n_enriched,
      CAST(NULL AS TIMESTAMP) AS created_on, CAST(NULL AS TIMESTAMP) AS updated_on, CAST(NULL AS TIMESTAMP) AS settled_on FROM q
    UNION ALL
    SELECT s.entity_id, f.k, coalesce(tr.b, s.state),
      CASE WHEN tr.does = 'queue' THEN true WHEN tr.does IN ('again', 'discard', 'reset', 'embed', 'enrich') THEN false ELSE s.pending END,
      CASE tr.does WHEN 'embed' THEN true WHEN 'reset' THEN false WHEN 'discard' THEN false ELSE s.embedded END,
      CASE WHEN tr.does = 'enrich' THEN true WHEN tr.does = 'reset' OR (tr.does = 'discard' AND s.state = 'Classifying') THEN false ELSE s.tagged END,
      s.n_coalesced + CASE WHEN tr.does IN ('again', 'discard') THEN 1 ELSE 0 END, s.n_enriched + CASE WHEN tr.does = 'enrich' THEN 1 ELSE 0 END,
      coalesce(s.created_on, CASE WHEN tr.b IS NOT NULL THEN f.at END), CASE WHEN s.state <> '' OR tr.b IS NOT NULL THEN f.at ELSE s.updated_on END,
      CASE WHEN tr.does IN ('settle', 'enrich') THEN f.at ELSE s.settled_on END
    FROM s JOIN q f ON f.entity_id = s.entity_id AND f.k = s.k + 1
    LEFT JOIN tr ON tr.a = s.state AND tr.kind = f.kind AND CASE tr.guard WHEN 'ok' THEN f.ok WHEN 'not ok' THEN NOT f.ok WHEN 'edited' THEN s.pending WHEN 'clean' THEN NOT s.pending
      WHEN 'no vector' THEN NOT s.embedded WHEN 'no tags' THEN s.embedded AND NOT s.tagged ELSE true END)
  SELECT entity_id, {columns} FROM s QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY k DESC) = 1"""
)

_CHANNEL_WALK = (
    views.cte("facts").replace("WITH ", "WITH RECURSIVE ", 1)
    + _WALK.format(
        kinds=_CHANNEL_KINDS, ok=_PRESENT, carried=", ".join(_CARRIED), columns="a, kind, b",
        moves="""('', 'sync_due', 'Syncing'), ('CaughtUp', 'sync_due', 'Syncing'), ('Syncing', 'completed', 'CaughtUp'),
  ('Syncing', 'sync_due', 'Syncing'), ('Syncing', 'changed', 'Syncing'), ('Syncing', 'pins', 'Syncing'), ('Syncing', 'poll', 'Syncing'),
  ('CaughtUp', 'completed', 'CaughtUp'), ('CaughtUp', 'changed', 'CaughtUp'), ('CaughtUp', 'pins', 'CaughtUp'), ('CaughtUp', 'poll', 'CaughtUp')""",
    )
    + """, s AS (SELECT DISTINCT entity_id, CAST(0 AS BIGINT) AS k, '' AS state, CAST(0 AS BIGINT) AS cursor, false AS caught_up, true AS is_present, CAST(NULL AS BIGINT) AS last_count,
      CAST(NULL AS STRING) AS name, CAST(NULL AS INT) AS type, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS STRING) AS pins, CAST(NULL AS TIMESTAMP) AS last_synced,
      CAST(NULL AS TIMESTAMP) AS created_on, CAST(NULL AS TIMESTAMP) AS updated_on, CAST(NULL AS TIMESTAMP) AS settled_on FROM q
    UNION ALL
    SELECT s.entity_id, f.k, coalesce(tr.b, s.state), CASE WHEN done AND f.number > s.cursor THEN f.number ELSE s.cursor END,
      CASE WHEN done THEN f.ok WHEN s.state = 'CaughtUp' AND tr.b = 'Syncing' THEN false ELSE s.caught_up END,
      CASE WHEN tr.kind = 'changed' AND NOT f.ok THEN false ELSE s.is_present END, CASE WHEN done THEN f.size ELSE s.last_count END,
      CASE WHEN done THEN f.name ELSE s.name END, CASE WHEN done THEN f.type ELSE s.type END, CASE WHEN done THEN f.parent ELSE s.parent_id END,
      CASE WHEN tr.kind = 'pins' AND s.state = 'CaughtUp' THEN f.digest ELSE s.pins END, CASE WHEN done THEN f.at ELSE s.last_synced END,
      CASE WHEN s.state = '' AND tr.b IS NOT NULL THEN f.at ELSE s.created_on END, CASE WHEN tr.b IS NOT NULL THEN f.at ELSE s.updated_on END, CASE WHEN done THEN f.at ELSE s.settled_on END
    FROM s JOIN q f ON f.entity_id = s.entity_id AND f.k = s.k + 1
    LEFT JOIN (SELECT *, a = 'Syncing' AND kind = 'completed' AS done FROM tr) tr ON tr.a = s.state AND tr.kind = f.kind)
  SELECT entity_id, state, cursor, caught_up, is_present, last_count, name, type, parent_id, pins, last_synced, created_on, updated_on, settled_on
  FROM s QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY k DESC) = 1"""
)

_GUILD_WALK = (
    views.cte("facts").replace("WITH ", "WITH RECURSIVE ", 1)
    + _WALK.format(
        kinds=_GUILD_KINDS, ok=_PRESENT, columns="a, kind, b",
        carried=", ".join(_CARRIED) + ", CASE seq % 3 WHEN 0 THEN 'r0' WHEN 1 THEN 'r0,r1' ELSE 'r0,r1,r2' END AS roles",
        moves="""('', 'sync_due', 'Syncing'), ('Synced', 'sync_due', 'Syncing'), ('Syncing', 'sync_due', 'Syncing'),
  ('Synced', 'heartbeat', 'Syncing'), ('Syncing', 'changed', 'Synced'), ('Synced', 'changed', 'Synced')""",
    )
    + """, s AS (SELECT DISTINCT entity_id, CAST(0 AS BIGINT) AS k, '' AS state, true AS is_present, CAST(NULL AS TIMESTAMP) AS last_synced, CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS roles,
      CAST(NULL AS TIMESTAMP) AS created_on, CAST(NULL AS TIMESTAMP) AS updated_on, CAST(NULL AS TIMESTAMP) AS settled_on FROM q
    UNION ALL
    SELECT s.entity_id, f.k, coalesce(tr.b, s.state), CASE WHEN tr.kind = 'changed' AND NOT f.ok THEN false ELSE s.is_present END,
      CASE WHEN tr.kind = 'changed' THEN coalesce(f.synced_at, f.at) ELSE s.last_synced END,
      CASE WHEN tr.kind = 'changed' THEN f.name ELSE s.name END, CASE WHEN tr.kind = 'changed' THEN f.roles ELSE s.roles END,
      CASE WHEN s.state = '' AND tr.b IS NOT NULL THEN f.at ELSE s.created_on END, CASE WHEN tr.b IS NOT NULL THEN f.at ELSE s.updated_on END,
      CASE WHEN tr.a = 'Syncing' AND tr.b = 'Synced' THEN f.at ELSE s.settled_on END
    FROM s JOIN q f ON f.entity_id = s.entity_id AND f.k = s.k + 1
    LEFT JOIN tr ON tr.a = s.state AND tr.kind = f.kind AND (f.kind <> 'heartbeat' OR (s.is_present AND (s.last_synced IS NULL OR s.last_synced < f.cutoff))))
  SELECT entity_id, state, is_present, last_synced, name, roles, created_on, updated_on, settled_on
  FROM s QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY k DESC) = 1"""
)

_STAMPS = "created_on", "updated_on", "settled_on"


def _message_facts(facts):
    return facts.selectExpr("entity_id", "seq", f"{_KINDS} AS kind", f"{_OK} AS ok", "ts AS at")


@query("message_lifecycle", (), _MESSAGE_WALK.format(columns="k AS n_facts, state, embedded, tagged, n_enriched, created_on, updated_on, settled_on"))
def _(t: Tables):
    last = Y.fold(_message_facts(t.facts), "entity_id", Y.MESSAGE)
    return last.select("entity_id", "n_facts", "state", "embedded", "tagged", "n_enriched", *_STAMPS)


@query("stream_lifecycle", (), _MESSAGE_WALK.format(columns="k AS n_facts, state, n_enriched, settled_on"))
def _(t: Tables):
    stream = jobs.parquet_stream(t.spark, f"{t.sf_dir}/events.parquet").selectExpr(*views.VIEWS["facts"][1])
    return jobs.lifecycle_stream(_message_facts(stream), "entity_id", Y.MESSAGE).select("entity_id", "n_facts", "state", "n_enriched", "settled_on")


@query("pending_edits", (), _MESSAGE_WALK.format(columns="pending, n_coalesced"))
def _(t: Tables):
    return Y.fold(_message_facts(t.facts), "entity_id", Y.MESSAGE).select("entity_id", "pending", "n_coalesced")


@query("channel_lifecycle", (), _CHANNEL_WALK)
def _(t: Tables):
    facts = t.facts.selectExpr("entity_id", "seq", f"{_CHANNEL_KINDS} AS kind", f"{_PRESENT} AS ok", *_CARRIED)
    return Y.fold(facts, "entity_id", Y.CHANNEL).drop("n_facts").select("*", "profile.*").drop("profile")


@query("channel_snapshots", (), "SELECT entity_id AS channel_id, entity_id % 5 AS guild_id, name, type, state, cursor, last_synced, caught_up, last_count, pins FROM (" + _CHANNEL_WALK + ") WHERE entity_id % 5 = 2")
def _(t: Tables):
    facts = t.facts.selectExpr("entity_id", "seq", f"{_CHANNEL_KINDS} AS kind", f"{_PRESENT} AS ok", *_CARRIED)
    states = Y.fold(facts, "entity_id", Y.CHANNEL).select("*", "profile.*").withColumns({"channel_id": F.col("entity_id"), "guild_id": F.col("entity_id") % 5})
    return R.channel_snapshots(states, guild_id=2)


@query("message_state", (), "SELECT * FROM (" + _MESSAGE_WALK.format(columns="state, pending, embedded, tagged, n_enriched, created_on, updated_on, settled_on") + ") WHERE entity_id = 7")
def _(t: Tables):
    states = Y.fold(_message_facts(t.facts.filter("entity_id = 7")), "entity_id", Y.MESSAGE)
    return R.message_state(states, "entity_id", 7).select("entity_id", "state", "pending", "embedded", "tagged", "n_enriched", *_STAMPS)


@query("guild_lifecycle", (), _GUILD_WALK)
def _(t: Tables):
    roles = "transform(sequence(0, seq % 3), i -> named_struct('id', i, 'name', concat('r', i))) AS roles"
    facts = t.facts.selectExpr("entity_id", "seq", f"{_GUILD_KINDS} AS kind", f"{_PRESENT} AS ok", *_CARRIED, roles)
    last = Y.fold(Y.guild_facts(facts, "entity_id"), "entity_id", Y.GUILD)
    return last.select("entity_id", "state", "is_present", "last_synced", "profile.name", F.array_join("profile.roles.name", ",").alias("roles"), *_STAMPS)


@query(
    "lifecycle_timeouts", ("facts",),
    "SELECT entity_id, seq, ts + INTERVAL '30' SECOND AS timeout_at FROM (SELECT *, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts, seq) AS n FROM facts) WHERE kind IN ('signup', 'view') AND (n IS NULL OR n > ts + INTERVAL '30' SECOND)",
)
def _(t: Tables):
    return Y.timeouts(t.facts, "entity_id", "ts", pending=("signup", "view"))


def _timer_facts(t: Tables):
    stream = jobs.parquet_stream(t.spark, f"{t.sf_dir}/events.parquet").selectExpr(*views.VIEWS["facts"][1])
    return stream.select("entity_id", "seq", "kind", F.col("ts").alias("at"))


@query(
    "stream_timeouts", ("facts",),
    "SELECT entity_id, seq, ts + INTERVAL '30' SECOND AS timeout_at FROM (SELECT *, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts, seq) AS n FROM facts) WHERE kind IN ('signup', 'view') AND (n IS NULL OR n > ts + INTERVAL '30' SECOND)",
)
def _(t: Tables):
    timers = jobs.timer_stream(_timer_facts(t), "entity_id", sets=("signup", "view"), seconds=30)
    return timers.filter("status <> 'cancelled'").select("entity_id", "seq", F.col("due").alias("timeout_at"))


@query(
    "stream_polls", ("facts",),
    "SELECT entity_id, seq, ts + INTERVAL '5' MINUTE AS due FROM (SELECT *, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts, seq) AS n FROM facts WHERE kind = 'view') WHERE n IS NULL OR n > ts + INTERVAL '5' MINUTE",
)
def _(t: Tables):
    timers = jobs.timer_stream(_timer_facts(t), "entity_id", sets=("view",), seconds=300, cancels=False)
    return timers.filter("status <> 'cancelled'").select("entity_id", "seq", "due")


_GUILD_STATES = "SELECT o_custkey AS entity_id, CASE o_orderstatus WHEN 'P' THEN 'Syncing' WHEN 'F' THEN 'Enriched' ELSE 'Faulted' END AS state, CAST(o_orderdate AS TIMESTAMP) AS last_synced, o_orderkey % 5 <> 0 AS is_present, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' END AS model FROM orders"


def _states(t: Tables):
    state = F.when(F.col("o_orderstatus") == "P", "Syncing").when(F.col("o_orderstatus") == "F", "Enriched").otherwise("Faulted")
    k = F.col("o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("entity_id"), state.alias("state"), F.col("o_orderdate").cast("timestamp").alias("last_synced"), (k % 5 != 0).alias("is_present"),
        k.alias("seq"), F.when(k % 3 == 0, "m1").when(k % 3 == 1, "m2").alias("model"),
    )


@query("stale_guilds", (), f"SELECT seq, entity_id FROM ({_GUILD_STATES}) WHERE last_synced < TIMESTAMP '1996-01-01 00:00:00' AND is_present AND state <> 'Syncing'")
def _(t: Tables):
    return filters.stale(_states(t), "1996-01-01 00:00:00").select("seq", "entity_id")


@query("invalidate_tags", (), f"SELECT seq FROM ({_GUILD_STATES}) WHERE state = 'Enriched' AND model IS DISTINCT FROM 'm2' AND last_synced < TIMESTAMP '1996-01-01 00:00:00'")
def _(t: Tables):
    rows = _states(t).withColumnRenamed("last_synced", "indexed_at")
    return filters.invalidated(rows, "model", "m2", "1996-01-01 00:00:00").select("seq")


@query("invalidate_classify", (), f"SELECT seq FROM ({_GUILD_STATES}) WHERE state = 'Enriched' AND model IS DISTINCT FROM 'm1' AND last_synced < TIMESTAMP '1997-01-01 00:00:00'")
def _(t: Tables):
    rows = _states(t).withColumnRenamed("last_synced", "indexed_at")
    return filters.invalidated(rows, "model", "m1", "1997-01-01 00:00:00").select("seq")


@query("replay_selection", (), f"SELECT seq, CASE WHEN seq % 3 = 0 THEN 'tag' WHEN seq % 3 = 1 THEN 'classify' ELSE 'unroutable' END AS route FROM ({_GUILD_STATES}) WHERE state = 'Faulted'")
def _(t: Tables):
    rows = _states(t).withColumns({"embedding": F.when(F.col("seq") % 3 != 0, F.array(F.lit(1.0))), "tags": F.when(F.col("seq") % 3 == 2, F.array(F.lit("x")))})
    return filters.replay_selection(rows).select("seq", "route")


@query("presence_ratchet", (), f"SELECT entity_id, bool_and(is_present) AS is_present FROM ({_GUILD_STATES}) GROUP BY 1")
def _(t: Tables):
    return filters.presence_ratchet(_states(t), "entity_id")


@query("heartbeat_fanout", (), f"SELECT r_regionkey AS beat, seq FROM region JOIN ({_GUILD_STATES}) e ON e.last_synced < TIMESTAMP '1996-01-01 00:00:00' + r_regionkey * INTERVAL '30' DAY AND is_present AND state <> 'Syncing'")
def _(t: Tables):
    beats = t.region.selectExpr("r_regionkey AS beat", "timestamp'1996-01-01 00:00:00' + r_regionkey * interval '30' day AS cutoff")
    return I.heartbeat_fanout(beats, _states(t)).select("beat", "seq")


@query("correlate_events", ("facts",), "SELECT f.seq, c.c_custkey AS entity_id FROM facts f JOIN customer c ON c.c_custkey = f.entity_id WHERE c.c_custkey % 2 = 0")
def _(t: Tables):
    known = t.customer.filter("c_custkey % 2 = 0").select(uuid5_key(F.col("c_custkey")).alias("key"), F.col("c_custkey").alias("entity_id"))
    facts = t.facts.select(uuid5_key(F.col("entity_id")).alias("key"), "seq")
    return I.correlate(facts, known, "key").select("seq", "entity_id")


@query("embed_batch", ("messages",), "SELECT message_id, CAST(len(list_filter(regexp_split_to_array(lower(coalesce(plain_text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS DOUBLE) AS mass, 'words-64' AS model_version FROM messages")
def _(t: Tables):
    made = models.embed_batch(t.messages, "plain_text", model="words-64")
    return made.select("message_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("mass"), "model_version")


@query(
    "classify_batch", (),
    """WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS word FROM documents)
    SELECT DISTINCT doc_id, 'n' || CAST(n_regionkey AS STRING) AS tag FROM w JOIN (SELECT CASE n_nationkey % 5 WHEN 0 THEN 'the' WHEN 1 THEN 'der' WHEN 2 THEN 'de' WHEN 3 THEN 'los' ELSE 'whst' END AS word, n_regionkey FROM nation) k ON k.word = w.word""",
)
def _(t: Tables):
    word = F.when(F.col("n_nationkey") % 5 == 0, "the").when(F.col("n_nationkey") % 5 == 1, "der").when(F.col("n_nationkey") % 5 == 2, "de").when(F.col("n_nationkey") % 5 == 3, "los").otherwise("whst")
    keywords = t.nation.select(word.alias("word"), F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("tag")).distinct()
    return models.classify_batch(t.documents, "doc_id", "text", keywords, model="keywords").select("doc_id", "tag")


_RERUN = """, e AS (SELECT message_id, turn % 4 <> 3 AS enriched, turn % 3 = 0 AS fresh, turn % 2 = 0 AS labelled, created_at < TIMESTAMP '2024-01-15 00:00:00' AS due,
    list_contains(regexp_split_to_array(lower(coalesce(plain_text, '')), '[^\\p{L}\\p{N}]+'), 'the') AS said FROM messages),
  r AS (SELECT *, enriched AND due AND NOT fresh AS vector, enriched AND due AND (NOT fresh OR NOT labelled) AS again FROM e)
SELECT CASE WHEN vector OR fresh THEN 'words-64' ELSE 'old' END AS embed_version, CASE WHEN again OR labelled THEN 'keywords' ELSE 'old' END AS classify_version,
  CASE WHEN NOT again THEN 'kept' WHEN said THEN 'english' ELSE '' END AS tags, count(*) AS n FROM r GROUP BY 1, 2, 3"""


@query("reenrich", ("messages",), _RERUN)
def _(t: Tables):
    entities = t.messages.select(
        "message_id", F.when(F.col("turn") % 4 != 3, "Enriched").otherwise("Faulted").alias("state"), F.col("created_at").alias("indexed_at"),
        F.array(F.lit(0.0).cast("float")).alias("embedding"), F.when(F.col("turn") % 3 == 0, "words-64").otherwise("old").alias("embed_version"),
        F.array(F.lit("kept")).alias("tags"), F.when(F.col("turn") % 2 == 0, "keywords").otherwise("old").alias("classify_version"),
    )
    keywords = t.spark.createDataFrame([("the", "english")], "word string, tag string")
    done = models.reenrich(entities, t.messages, "plain_text", keywords, embed_model="words-64", classify_model="keywords", cutoff="2024-01-15 00:00:00")
    return done.groupBy("embed_version", "classify_version", F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("n"))
