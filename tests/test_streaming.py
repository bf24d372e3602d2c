"""Keyed state and timers of streams: against the table rules, the batch fold and hand-made cases."""

from __future__ import annotations

import datetime
import itertools

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from palaver.operators import lifecycle
from palaver.plans import state_queries as Q
from palaver.plans.registry import Tables
from palaver.streaming import jobs, keyed

T0 = datetime.datetime(2024, 1, 1)
FACT = "id long, seq long, kind string, at timestamp, ok boolean"
WIDE = {
    "seq": "long", "kind": "string", "at": "timestamp", "ok": "boolean", "number": "long", "size": "long", "name": "string", "type": "int", "parent": "long",
    "digest": "string", "synced_at": "timestamp", "cutoff": "timestamp", "roles": "array<struct<id: bigint, name: string>>",
}


def at(seconds):
    return None if seconds is None else T0 + datetime.timedelta(seconds=seconds)


def values(row, names):
    return tuple(row[n].asDict(recursive=True) if isinstance(row[n], Row) else row[n] for n in names)


@pytest.mark.parametrize(("rules", "step"), keyed.STEPS, ids=["message", "channel", "guild"])
def test_rules_for_one_fact_are_those_for_tables(spark, rules, step):
    """Every state and flag, with every kind of fact and with and without its values."""
    kinds = [*keyed.MESSAGE_KINDS, "sync_due", "completed", "changed", "pins", "poll", "heartbeat", "else"]
    starts = spark.range(1).selectExpr(f"explode({lifecycle._starts(rules)}) AS s").collect()
    starts = [r["s"] for r in starts if all(r["s"][n] is not None for n, f in rules.items() if not f.by)]
    full = {"seq": 5, "at": at(100), "number": 7, "size": 3, "name": "n", "type": 1, "parent": 9, "digest": "d", "synced_at": at(50), "cutoff": at(20), "roles": [Row(id=1, name="r")]}
    facts = [Row(**(full | {"kind": k, "ok": ok})) for k in kinds for ok in (True, False)] + [Row(**(dict.fromkeys(full) | {"seq": 6, "kind": k, "ok": None})) for k in kinds]
    later = {"created_on": at(1), "updated_on": at(2), "settled_on": at(3), "last_synced": at(10), "cursor": 100, "last_count": 4, "pins": "old"}
    states = [s.asDict() for s in starts] + [s.asDict() | {k: v for k, v in later.items() if k in rules} for s in starts]
    pairs = list(itertools.product(states, facts))
    like = spark.range(1).selectExpr(f"{lifecycle._struct({n: f.start for n, f in rules.items()})} AS s").schema["s"].dataType.simpleString()
    fact = "struct<" + ", ".join(f"{n}: {kind}" for n, kind in WIDE.items()) + ">"
    df = spark.createDataFrame([(k, tuple(s[n] for n in rules), tuple(f[n] for n in WIDE)) for k, (s, f) in enumerate(pairs)], f"k long, s {like}, f {fact}")
    if rules is lifecycle.GUILD:
        df = df.withColumn("f", F.col("f").withField("stale", F.expr("s.last_synced IS NULL OR s.last_synced < f.cutoff")))
    found = {r["k"]: r["out"] for r in df.select("k", F.expr(lifecycle._step(rules)).alias("out")).collect()}
    for k, (s, f) in enumerate(pairs):
        assert values(step(s, f), rules) == values(found[k], rules), (s, f)


def shuffled(facts, path, files, spread):
    """Facts in so many files, dealt by their time plus up to ``spread`` seconds."""
    seconds = F.unix_timestamp("at") + F.pmod(F.xxhash64("seq"), F.lit(spread))
    low, high = facts.agg(F.min(seconds), F.max(seconds)).first()
    for k in range(files):
        part = facts.filter(((seconds - low) * files / (high - low + 1)).cast("int") == k)
        part.orderBy(F.xxhash64("seq")).coalesce(1).write.mode("append").parquet(path)
        yield k


def test_lifecycle_of_facts_shuffled_across_batches_and_restarts(spark, sf_dir, tmp_path):
    facts = Q._message_facts(Tables(spark, sf_dir).facts).cache()
    source, folder = str(tmp_path / "facts"), str(tmp_path / "job")
    run = lambda: jobs.lifecycle_stream(jobs.parquet_stream(spark, source, files=1), "entity_id", lifecycle.MESSAGE, folder, delay="4 days")
    last = None
    for k in shuffled(facts, source, 6, 3 * 86_400):
        last = run() if k in (1, 2, 5) else last  # started anew twice
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in lifecycle.fold(facts, "entity_id", lifecycle.MESSAGE).collect()}


def test_a_batch_touches_the_state_of_its_own_keys(spark, tmp_path):
    seen = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):  # noqa: N802
            pass

        def onQueryProgress(self, event):  # noqa: N802
            seen.extend((event.progress.numInputRows, o.numRowsUpdated, o.numRowsTotal) for o in event.progress.stateOperators)

        def onQueryTerminated(self, event):  # noqa: N802
            seen.append(None)

    source, folder = str(tmp_path / "facts"), str(tmp_path / "job")
    listener = Listener()
    spark.streams.addListener(listener)
    try:
        for n, seconds in ((400, 0), (3, 50)):
            rows = [(k, 1 + seconds, "captured" if seconds == 0 else "analyzed", at(seconds), True) for k in range(n)]
            spark.createDataFrame(rows, FACT).coalesce(1).write.mode("append").parquet(source)
            states = jobs.lifecycle_stream(jobs.parquet_stream(spark, source, files=1), "id", lifecycle.MESSAGE, folder, delay="0 seconds")
        found = {r["id"]: r["state"] for r in states.collect()}
        for _ in range(100):
            if seen.count(None) == 2:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert found == {k: "ProjectPending" if k < 3 else "AnalyzePending" for k in range(400)}
    small = [x for x in seen if x and x[0] == 3]
    assert small and all(updated <= 40 < total for _, updated, total in small)


@pytest.mark.parametrize(
    ("facts", "state", "n"),
    [
        ([("captured", 0)], "Faulted", 1),  # the watermark passes the deadline
        ([("captured", 0), ("analyzed", 30)], "Faulted", 2),  # in time, but the next request has no answer
        ([("captured", 0), ("analyzed", 31)], "Faulted", 2),  # late: it meets Faulted
        ([("captured", 0), ("analyzed", 10), ("projected", 20)], "Tagging", 3),  # cancelled
        ([("captured", 0), ("analyzed", 10), ("projected", 41)], "Faulted", 3),
        ([("captured", 0), ("edit", 5), ("analyzed", 10), ("projected", 35), ("projected", 60)], "Tagging", 5),  # asked anew at 35
        ([("captured", 0), ("edit", 5), ("analyzed", 10), ("projected", 35), ("projected", 66)], "Faulted", 5),
        ([("captured", 0), ("analyzed", 10), ("projected", 20), ("tagged", 500)], "Classifying", 4),  # no deadline there
    ],
)
def test_requests_time_out_in_the_stream(spark, tmp_path, facts, state, n):
    rows = [(1, k, kind, at(s), True) for k, (kind, s) in enumerate(facts)]
    clock = [(2, 100 + k, "captured", at(1000 * k), True) for k in range(1, 3)]  # another key moves the watermark
    source = str(tmp_path / "facts")
    for part in (rows[::2], rows[1::2], clock[:1], clock[1:]):
        if part:
            spark.createDataFrame(part, FACT).coalesce(1).write.mode("append").parquet(source)
    request = keyed.Request(keyed.message_asks, ("AnalyzePending", "ProjectPending"), 30)
    stream = jobs.parquet_stream(spark, source, files=1)
    found = {r["id"]: r for r in jobs.lifecycle_stream(stream, "id", lifecycle.MESSAGE, str(tmp_path / "job"), delay="600 seconds", request=request).collect()}
    assert (found[1]["state"], found[1]["n_facts"]) == (state, n)
    if len(facts) == 1:
        assert found[1]["settled_on"] == at(30)
    assert found[2]["state"] == "Faulted" and found[2]["updated_on"] == at(2000)  # its own request of 1000 timed out at 1030


def test_timers_are_set_replaced_and_cancelled(spark, sf_dir, tmp_path):
    facts = Tables(spark, sf_dir).facts.select("entity_id", "seq", "kind", F.col("ts").alias("at")).cache()
    source = str(tmp_path / "facts")
    for _ in shuffled(facts, source, 4, 86_400):
        pass
    for sets, seconds, cancels in ((("signup", "view"), 3 * 3600, True), (("view",), 6 * 3600, False)):
        stream = jobs.parquet_stream(spark, source, files=1)
        found = jobs.timer_stream(stream, "entity_id", sets=sets, seconds=seconds, cancels=cancels, folder=str(tmp_path / f"{cancels}"), delay="2 days")
        rows = found.collect()
        wanted = lifecycle.timeouts(facts if cancels else facts.filter("kind = 'view'"), "entity_id", "at", pending=sets, seconds=seconds)
        assert {(r["entity_id"], r["seq"], r["due"]) for r in rows if r["status"] != "cancelled"} == {tuple(r) for r in wanted.collect()}
        assert {r["status"] for r in rows} >= {"fired", "cancelled"}
    polls = jobs.next_poll(facts.filter("kind = 'view'"), "entity_id", "at", minutes=360).collect()
    last = {}
    for r in rows:
        last[r["entity_id"]] = max(r["due"], last.get(r["entity_id"], r["due"]))
    assert last == {r["entity_id"]: r["due"] for r in polls}


def test_a_stream_of_nothing(spark, tmp_path):
    source = str(tmp_path / "facts")
    spark.createDataFrame([], FACT).write.parquet(source)
    assert jobs.lifecycle_stream(jobs.parquet_stream(spark, source), "id", lifecycle.MESSAGE, str(tmp_path / "a")).collect() == []
    assert jobs.timer_stream(jobs.parquet_stream(spark, source), "id", sets=("x",), seconds=1, folder=str(tmp_path / "b")).collect() == []


def test_projections_are_flushed_in_bounded_parts(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(k, 1, f"c{k}", 0, None, at(k), True) for k in range(180)]
    kind = "channel_id long, guild_id long, name string, channel_type int, parent_id long, updated_on timestamp, is_present boolean"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(source)
    stream = jobs.parquet_stream(spark, source)
    jobs.start_projection(stream, folder, kind="channels", every=None).awaitTermination()
    table = jobs.projected(spark, folder, stream, "channels")["channels"]
    sizes = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 180 and max(sizes) <= jobs.PROJECTIONS["channels"].rows
    assert {k: (p.rows, p.every) for k, p in jobs.PROJECTIONS.items()} == {"messages": (2000, "10 seconds"), "channels": (50, "2 seconds"), "guilds": (10, "2 seconds")}
