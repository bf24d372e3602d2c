"""Keyed lifecycles as ordered folds of facts.

A lifecycle is a table of transitions in SQL over the state ``s`` and the fact ``f``.  Facts are
dealt out by key and folded in the order of ``seq`` by one native aggregate expression; a fact
that a state does not know changes nothing.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, stored


class Field(NamedTuple):
    """A field of a state: its value at first, the next one, and how two runs of facts combine.

    ``by``: "sum", "max", "first" or "last" (null until a run touches it); without one the field has few
    values (a string of ``THEN``s, or a boolean) and decides what the next facts do.
    """

    start: str
    then: str
    by: str = ""


Transitions = dict[str, Field]

_TIME = "CAST(NULL AS TIMESTAMP)"


def _stamps(handled: str, settled: str) -> Transitions:
    """``created_on`` once, ``updated_on`` at every fact that is handled, ``settled_on`` where it settles."""
    return {
        "created_on": Field(_TIME, f"coalesce(s.created_on, CASE WHEN {handled} THEN f.at END)", "first"),
        "updated_on": Field(_TIME, f"CASE WHEN {handled} THEN coalesce(f.at, s.updated_on) ELSE s.updated_on END", "last"),
        "settled_on": Field(_TIME, f"CASE WHEN {settled} THEN coalesce(f.at, s.settled_on) ELSE s.settled_on END", "last"),
    }


_ENRICHED = "s.state = 'Classifying' AND f.kind = 'classified' AND NOT s.pending"
_COALESCED = """s.pending AND ((s.state = 'ProjectPending' AND f.kind = 'projected') OR (s.state = 'Tagging' AND f.kind = 'tagged')
          OR (s.state = 'Classifying' AND f.kind = 'classified'))"""
_KNOWN = "('captured', 'analyzed', 'projected', 'tagged', 'classified', 'edit', 'fault', 'timeout', 'replay', 'tags_invalidated', 'classify_invalidated')"

MESSAGE: Transitions = {
    "state": Field(
        "''",
        """CASE WHEN s.state = '' THEN CASE WHEN f.kind = 'captured' THEN 'AnalyzePending' ELSE '' END
        WHEN s.state = 'AnalyzePending' AND f.kind = 'analyzed' THEN CASE WHEN f.ok THEN 'ProjectPending' ELSE 'Excluded' END
        WHEN s.state IN ('AnalyzePending', 'ProjectPending') AND f.kind IN ('fault', 'timeout') THEN 'Faulted'
        WHEN s.state = 'ProjectPending' AND f.kind = 'projected' THEN CASE WHEN s.pending THEN 'ProjectPending' ELSE 'Tagging' END
        WHEN s.state = 'Tagging' AND f.kind = 'tagged' THEN CASE WHEN s.pending THEN 'ProjectPending' ELSE 'Classifying' END
        WHEN s.state = 'Classifying' AND f.kind = 'classified' THEN CASE WHEN s.pending THEN 'ProjectPending' ELSE 'Enriched' END
        WHEN s.state IN ('Tagging', 'Classifying') AND f.kind = 'fault' THEN 'Faulted'
        WHEN s.state = 'Enriched' AND f.kind = 'edit' THEN 'ProjectPending'
        WHEN s.state = 'Enriched' AND f.kind = 'tags_invalidated' THEN 'Tagging'
        WHEN s.state = 'Enriched' AND f.kind = 'classify_invalidated' THEN 'Classifying'
        WHEN s.state = 'Faulted' AND f.kind = 'replay' AND NOT s.embedded THEN 'Tagging'
        WHEN s.state = 'Faulted' AND f.kind = 'replay' AND NOT s.tagged THEN 'Classifying'
        ELSE s.state END""",
    ),
    "pending": Field(
        "false",
        """CASE WHEN s.state IN ('AnalyzePending', 'ProjectPending', 'Tagging', 'Classifying') AND f.kind = 'edit' THEN true
        WHEN (s.state = 'ProjectPending' AND f.kind = 'projected') OR (s.state = 'Tagging' AND f.kind = 'tagged')
          OR (s.state = 'Classifying' AND f.kind = 'classified') THEN false ELSE s.pending END""",
    ),
    "embedded": Field(
        "false",
        """CASE WHEN s.state = 'ProjectPending' AND f.kind = 'projected' AND NOT s.pending THEN false
        WHEN s.state = 'Tagging' AND f.kind = 'tagged' THEN NOT s.pending
        WHEN s.state = 'Classifying' AND f.kind = 'classified' AND s.pending THEN false ELSE s.embedded END""",
    ),
    "tagged": Field(
        "false",
        """CASE WHEN s.state = 'ProjectPending' AND f.kind = 'projected' AND NOT s.pending THEN false
        WHEN s.state = 'Classifying' AND f.kind = 'classified' THEN NOT s.pending ELSE s.tagged END""",
    ),
    "n_coalesced": Field("0", f"CASE WHEN {_COALESCED} THEN s.n_coalesced + 1 ELSE s.n_coalesced END", "sum"),
    "n_enriched": Field("0", f"CASE WHEN {_ENRICHED} THEN s.n_enriched + 1 ELSE s.n_enriched END", "sum"),
    **_stamps(
        f"(s.state <> '' OR f.kind = 'captured') AND f.kind IN {_KNOWN}",
        f"""(s.state = 'AnalyzePending' AND f.kind = 'analyzed' AND NOT coalesce(f.ok, false)) OR ({_ENRICHED})
        OR (s.state IN ('AnalyzePending', 'ProjectPending') AND f.kind IN ('fault', 'timeout')) OR (s.state IN ('Tagging', 'Classifying') AND f.kind = 'fault')""",
    ),
}

_DONE = "f.kind = 'completed' AND s.state = 'Syncing'"

#: Facts: sync_due, completed (``number``: the cursor, ``ok``: caught up, ``size``, ``name``, ``type``, ``parent``),
#: changed (``ok``: present), pins (``digest``), poll.
CHANNEL: Transitions = {
    "state": Field("''", f"CASE WHEN f.kind = 'sync_due' AND s.state IN ('', 'CaughtUp') THEN 'Syncing' WHEN {_DONE} THEN 'CaughtUp' ELSE s.state END"),
    "cursor": Field("CAST(0 AS BIGINT)", f"CASE WHEN {_DONE} THEN greatest(s.cursor, coalesce(f.number, s.cursor)) ELSE s.cursor END", "max"),
    "caught_up": Field("false", f"CASE WHEN {_DONE} THEN coalesce(f.ok, false) WHEN f.kind = 'sync_due' AND s.state = 'CaughtUp' THEN false ELSE s.caught_up END"),
    "is_present": Field("true", "s.is_present AND NOT (f.kind = 'changed' AND s.state <> '' AND NOT coalesce(f.ok, true))"),
    "last_count": Field("CAST(NULL AS BIGINT)", f"CASE WHEN {_DONE} THEN coalesce(f.size, s.last_count) ELSE s.last_count END", "last"),
    "profile": Field(
        "CAST(NULL AS STRUCT<name: STRING, type: INT, parent_id: BIGINT>)",
        f"CASE WHEN {_DONE} THEN named_struct('name', f.name, 'type', f.type, 'parent_id', f.parent) ELSE s.profile END", "last",
    ),
    "pins": Field("CAST(NULL AS STRING)", "CASE WHEN f.kind = 'pins' AND s.state = 'CaughtUp' THEN coalesce(f.digest, s.pins) ELSE s.pins END", "last"),
    "last_synced": Field(_TIME, f"CASE WHEN {_DONE} THEN coalesce(f.at, s.last_synced) ELSE s.last_synced END", "last"),
    **_stamps("f.kind = 'sync_due' OR (s.state <> '' AND f.kind IN ('completed', 'changed', 'pins', 'poll'))", _DONE),
}

_BEAT = "f.kind = 'heartbeat' AND s.state = 'Synced' AND s.is_present AND coalesce(f.stale, false)"

#: Facts (by way of ``guild_facts``): sync_due, changed (``ok``: present, ``name``, ``roles``), heartbeat.
GUILD: Transitions = {
    "state": Field(
        "''",
        f"""CASE WHEN f.kind = 'sync_due' AND s.state IN ('', 'Synced') THEN 'Syncing' WHEN {_BEAT} THEN 'Syncing'
        WHEN f.kind = 'changed' AND s.state = 'Syncing' THEN 'Synced' ELSE s.state END""",
    ),
    "is_present": Field("true", "s.is_present AND NOT (f.kind = 'changed' AND s.state <> '' AND NOT coalesce(f.ok, true))"),
    "last_synced": Field(_TIME, "CASE WHEN f.kind = 'changed' AND s.state <> '' THEN coalesce(f.synced_at, f.at, s.last_synced) ELSE s.last_synced END", "last"),
    "profile": Field(
        "CAST(NULL AS STRUCT<name: STRING, roles: ARRAY<STRUCT<id: BIGINT, name: STRING>>>)",
        "CASE WHEN f.kind = 'changed' AND s.state <> '' THEN named_struct('name', f.name, 'roles', f.roles) ELSE s.profile END", "last",
    ),
    **_stamps(f"f.kind = 'sync_due' OR (s.state <> '' AND f.kind = 'changed') OR ({_BEAT})", "f.kind = 'changed' AND s.state = 'Syncing'"),
}


def guild_facts(facts: DataFrame, key: str, before: DataFrame | None = None) -> DataFrame:
    """Guild facts with ``stale``: whether the guild's last sync lies before a heartbeat's ``cutoff``.

    A ``changed`` counts after the guild's first ``sync_due``.  Facts are dealt out by ranges of key and ``seq``, and the last
    sync of the ranges before is carried over, so a guild may have any number of facts, and the fold needs no more than a
    boolean.  ``before``: states that earlier facts led to.
    """
    ranged = stored(facts.repartitionByRange(key, "seq").withColumn("_part", F.spark_partition_id()), "ranges")
    due = ranged.filter("kind = 'sync_due'").groupBy(F.col(key).alias("_key")).agg(F.min("seq").alias("_due"))
    held = ranged.join(due, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    if before is not None:
        states = before.select(F.col(key).alias("_key"), F.col("last_synced").alias("_held"), (F.col("state") != "").alias("_known"))
        held = held.join(states, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    else:
        held = held.withColumns({"_held": F.expr(_TIME), "_known": F.lit(False)})
    known = F.coalesce("_known", F.lit(False)) | F.coalesce(F.col("seq") > F.col("_due"), F.lit(False))
    held = held.withColumn("_sync", F.when(known & (F.col("kind") == "changed"), F.coalesce("synced_at", "at")))
    inside = Window.partitionBy("_part", key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = held.filter("_sync is not null").groupBy("_part", key).agg(F.max_by("_sync", "seq").alias("_end"))
    parts = held.select("_part", key).distinct().join(ends.select(F.col("_part").alias("_p"), F.col(key).alias("_key"), "_end"), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    parts = parts.select(F.col("_part").alias("_p"), F.col(key).alias("_key"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    held = held.withColumn("_last", F.last("_sync", ignorenulls=True).over(inside))
    held = held.join(parts, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")))
    synced = F.coalesce("_last", "_carried", "_held")
    stale = F.when(F.col("kind") == "heartbeat", synced.isNull() | (synced < F.col("cutoff")))
    return held.withColumn("stale", stale).select(*facts.columns, "stale")


#: Facts of a key that are folded as one array; a busier key's are cut into runs of about so many.
CHUNK = 100_000


def _struct(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in values.items()) + ")"


def _step(rules: Transitions) -> str:
    return _struct({name: field.then for name, field in rules.items()})


def _starts(rules: Transitions) -> str:
    """An array of every state a run of facts may start in, with its counters and marks untouched."""
    states = sorted({x for field in rules.values() for x in re.findall(r"(?:THEN|ELSE) '(\w*)'", field.then)} | {""})
    values = []
    for field in rules.values():
        flags = ["true", "false", *["CAST(NULL AS BOOLEAN)"] * (" f.ok" in field.then and "coalesce(f.ok" not in field.then)]
        values.append([field.start] if field.by else [f"'{x}'" for x in states] if field.start == "''" else flags)
    return "array(" + ", ".join(_struct(dict(zip(rules, x, strict=True))) for x in itertools.product(*values)) + ")"


def _fact(facts: DataFrame, key: str) -> Column:
    """All that a fact has, in the order of ``seq`` (ties: by the rest)."""
    return F.struct("seq", *[c for c in facts.columns if c not in ("seq", key)]).alias("fact")


def _fold_busy(facts: DataFrame, key: str, rules: Transitions, n: int) -> DataFrame:
    """The runs of busy keys, each as a map from the state before it to the state after, in an array by key."""
    k = -(-n // CHUNK)
    cuts = facts.agg(F.percentile_approx("seq", [i / k for i in range(1, k)], max(10_000, 20 * k))).first()[0] if k > 1 else []

    @F.pandas_udf("int")
    def run_of(seq: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, "int64"), seq.fillna(-(1 << 53)).astype("int64")), dtype="int32")

    runs = facts.select(key, run_of(F.col("seq").cast("long")).alias("run"), _fact(facts, key)).groupBy(key, "run").agg(F.sort_array(F.collect_list("fact")).alias("facts"))
    ends = F.expr(f"transform({_starts(rules)}, x -> named_struct('from', x, 'to', aggregate(facts, x, (s, f) -> {_step(rules)})))")
    runs = runs.select(key, "run", F.size("facts").alias("n"), ends.alias("ends"))
    return runs.groupBy(key).agg(F.sum("n").alias("n_new"), F.sort_array(F.collect_list(F.struct("run", "ends"))).alias("runs"))


def fold(facts: DataFrame, key: str, rules: Transitions, before: DataFrame | None = None) -> DataFrame:
    """The last state of each key of ``facts``, which need ``seq``, ``kind`` and what the rules read of a fact.

    ``before`` holds the states that earlier facts led to (as this function returns them); keys without
    one begin anew.  A key's facts meet in one place up to ``CHUNK``.  A busier key is cut by ``seq`` into
    runs that are folded in separate tasks from every state they may start in and then strung together,
    so memory is bounded by a run and its states (facts of one ``seq`` are one run).
    """
    first = _struct({name: field.start for name, field in rules.items()})
    counts = facts.groupBy(F.col(key).alias("_busy")).agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK)
    names = stored(counts, "busy_keys")  # its size tells the optimizer how to join it
    busy = names.agg(F.sum("n")).first()[0] or 0
    some = facts
    if busy:
        there = F.col(key).eqNullSafe(F.col("_busy"))
        some = facts.join(names, there, "left_anti")
        many = _fold_busy(facts.join(names, there, "left_semi"), key, rules, busy)
    else:
        discard(facts.sparkSession, names.stored_at)

    def end(grouped: DataFrame, size: str, folded: str) -> DataFrame:
        start, grouped = first, grouped.withColumn("n_before", F.lit(0))
        if before is not None:
            held = before.select(F.col(key), F.struct(*rules).alias("held"), F.col("n_facts").alias("n_before"))
            grouped, start = grouped.drop("n_before").join(held, key, "left"), f"coalesce(held, {first})"
        count = F.expr(f"CAST({size} + coalesce(n_before, 0) AS INT)")
        done = grouped.select(key, count.alias("n_facts"), F.expr(folded.format(start=start)).alias("s"))
        return done.select(key, "n_facts", *[F.col("s")[name].alias(name) for name in rules])

    whole = some.select(key, _fact(facts, key)).groupBy(key).agg(F.sort_array(F.collect_list("fact")).alias("facts"))
    out = end(whole, "size(facts)", f"aggregate(facts, {{start}}, (s, f) -> {_step(rules)})")
    if not busy:
        return out
    same = " AND ".join(f"e.from.{name} <=> s.{name}" for name, field in rules.items() if not field.by)
    hit = f"filter(r.ends, e -> {same})[0].to"
    how = {"": "{1}.{0}", "sum": "s.{0} + {1}.{0}", "max": "greatest(s.{0}, {1}.{0})", "first": "coalesce(s.{0}, {1}.{0})", "last": "coalesce({1}.{0}, s.{0})"}
    then = _struct({name: how[field.by].format(name, hit) for name, field in rules.items()})
    return out.unionByName(end(many, "n_new", f"aggregate(runs, {{start}}, (s, r) -> {then})"))


def timeouts(facts: DataFrame, key: str, at: str, *, pending: tuple[str, ...], seconds: int = 30) -> DataFrame:
    """Requests that no fact of their key followed in time, with the moment at which each times out.

    Facts are dealt out by ranges of key and time; a range's last fact of a key is followed by the key's first one in the ranges after.
    """
    ranged = stored(facts.select(key, at, "seq", "kind").repartitionByRange(key, at, "seq").withColumn("_part", F.spark_partition_id()), "ranges")
    inside = F.lead(at).over(Window.partitionBy("_part", key).orderBy(at, "seq"))
    firsts = ranged.groupBy("_part", key).agg(F.min(at).alias("_first"))
    after = firsts.select(F.col("_part").alias("_p"), F.col(key).alias("_key"), F.lead("_first").over(Window.partitionBy(key).orderBy("_part")).alias("_after"))
    marked = ranged.withColumn("_next", inside).join(after, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")))
    following, due = F.coalesce("_next", "_after"), F.col(at) + F.expr(f"interval {seconds} seconds")
    waiting = marked.filter(F.col("kind").isin(*pending) & (following.isNull() | (following > due)))
    return waiting.select(key, "seq", due.alias("timeout_at"))
