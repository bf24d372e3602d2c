"""Tables whose cost follows the batch: bucketed upserts, the stored rollup; and work that one key may not pile up in a task."""

from __future__ import annotations

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palaver.operators import graph, latest, rollups
from palaver.sources import rollup, shared, sinks


@pytest.fixture
def all_ranges(spark):
    """Small ranges are not joined into one."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def files(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in Path(folder).rglob("*.parquet")}


def test_upserts_write_the_buckets_that_they_touch(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda ids, v, seq: spark.createDataFrame([(i, f"{v}{i}", seq) for i in ids], "id long, v string, seq long")
    want = {i: f"a{i}" for i in range(2000)}
    sinks.write_upsert(rows(range(2000), "a", 0), path, ["id"], "seq", version=0, buckets=32)
    first = files(tmp_path / "t")
    assert len({f.split("bucket=")[1].split("/")[0] for f in first if "bucket=" in f}) == 32
    for version, ids in ((1, [5]), (2, [5, 6, 7, 2001]), (3, []), (4, [1])):
        out = sinks.write_upsert(rows(ids, f"b{version}-", 1), path, ["id"], "seq", version=version)
        want |= {i: f"b{version}-{i}" for i in ids}
        assert {r["id"]: r["v"] for r in out.collect()} == want == {r["id"]: r["v"] for r in sinks.read_version(spark, path).collect()}
        new = {f for f in files(tmp_path / "t") if f.startswith(f"version={version}/")}
        assert len({f.split("/")[1] for f in new}) <= len(ids)  # bytes in proportion to the buckets touched
    left = files(tmp_path / "t")
    assert sum(f in left and left[f] == first[f] for f in first if "bucket=" in f) >= 27  # and the others as they were
    assert not any(f.startswith("version=1/") for f in left)  # what no kept manifest holds is deleted
    again = sinks.write_upsert(rows([1], "b4-", 1), path, ["id"], "seq", version=4)
    assert {r["id"]: r["v"] for r in again.collect()} == want


def test_child_rows_of_touched_parents_give_way(spark, tmp_path):
    path = str(tmp_path / "t")
    kids = lambda *pairs: spark.createDataFrame(list(pairs), "parent long, k int")
    parents = lambda *ids: spark.createDataFrame([(i,) for i in ids], "parent long")
    every = [(p, k) for p in range(50) for k in range(3)]
    sinks.write_children(kids(*every), parents(*range(50)), path, "parent", version=0, buckets=16)
    out = sinks.write_children(kids((7, 9), (60, 1)), parents(7, 8), path, "parent", version=1)
    want = {x for x in every if x[0] not in (7, 8)} | {(7, 9), (60, 1)}
    assert {tuple(r) for r in out.collect()} == want
    gone = sinks.write_children(kids((7, 9)).filter("false"), parents(*range(61)), path, "parent", version=2)  # every bucket is emptied
    assert gone.collect() == [] and gone.columns == ["parent", "k"]
    assert {tuple(r) for r in sinks.read_version(spark, path, before=2).collect()} == want
    with pytest.raises(ValueError, match="bucket"):
        sinks.write_upsert(kids((1, 1)).withColumn("Bucket", F.lit(1)), path, ["parent"], "k", version=3)


def test_the_rollup_is_refreshed_where_it_was_touched(spark, tmp_path):
    path = str(tmp_path / "r")
    hour = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:30:00"
    frame = lambda hours: spark.createDataFrame([(h % 3, hour(h)) for h in hours], "channel_id long, t string").selectExpr("channel_id", "CAST(t AS TIMESTAMP) AS created_at")
    old = list(range(0, 24 * 9, 2))
    rollup.create(rollups.hourly_counts(frame(old)), path)
    before = files(tmp_path / "r" / "counts")
    late, open_, outside = [24 * 6 + 2, 24 * 6 + 2, 24 * 6 + 3], [24 * 8 + 12], [5]
    for k, hours in enumerate((late, open_, outside)):
        rollup.note(frame(hours), path, k)
    rollup.note(frame(outside), path, 2)  # noted again
    messages = frame(old + late + open_ + outside)
    got = rollup.refresh(messages, path, now="2024-01-09 12:50:00", days=7, open_hours=1)
    rows = lambda df: {(r["channel_id"], str(r["bucket"]), r["n"]) for r in df.collect()}
    assert rows(got) == rows(rollups.hourly_counts(frame(old + late)))
    after = files(tmp_path / "r" / "counts")
    assert {f for f in before if before[f] != after.get(f)} == {f for f in before if f.startswith("day=2024-01-07")}
    again = rollup.refresh(messages, path, now="2024-01-09 14:00:00", days=30, open_hours=1)  # the hours that waited
    assert rows(again) == rows(rollups.hourly_counts(messages))
    assert rows(rollup.refresh(messages, path, now="2024-01-09 14:00:00")) == rows(again)


def test_percentiles_are_nearest_ranks_and_no_task_holds_a_group(spark, monkeypatch, all_ranges):
    rnd = random.Random(1)
    values = {"one": [rnd.randrange(300) for _ in range(4000)], "few": [3, 1, 2], "none": [None], None: [5.0, None, 7.0], "same": [4] * 50}
    rows = [(g, None if v is None else float(v)) for g, vs in values.items() for v in vs]
    seen = []
    keep = shared.stored
    monkeypatch.setattr(rollups, "stored", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    ps = (0.0, 0.07, 0.5, 0.95, 0.99, 1.0)
    found = rollups.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", by="g", ps=ps).collect()
    for r in found:
        known = sorted(v for v in values[r["g"]] if v is not None)
        want = [next((v for k, v in enumerate(known, 1) if k / len(known) >= p), None) for p in ps]
        assert [r[f"p{p * 100:g}"] for p in ps] == want, r["g"]
    assert len(found) == len(values)
    parts = seen[0].filter("k = 'one'").groupBy("part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 250  # the group's distinct values are spread


def test_changes_of_a_key_that_has_all_rows(spark, monkeypatch, all_ranges):
    rnd = random.Random(2)
    rows = [(1, k, rnd.choice([None, "a", "b"]), None if rnd.random() < 0.5 else 1) for k in range(3000)]
    rows += [(k % 7 if k % 3 else None, k, "c", k % 2) for k in range(300)] + [(9, 5, "x", 1), (9, 5, "x", 1), (9, 5, "y", 1)]
    df = spark.createDataFrame(rows, "key long, at long, v string, u int").repartition(6)
    seen = []
    keep = shared.stored
    monkeypatch.setattr(latest, "stored", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    found = sorted(map(tuple, latest.snapshot_changes(df, "key", "at", ["v", "u"]).collect()), key=repr)
    want, last = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or 0)):
        if r[0] not in last or last[r[0]] != r[2:]:
            want.append(r)
        last[r[0]] = r[2:]
    assert found == sorted(want, key=repr)
    assert seen[0].filter("key = 1").select("__part").distinct().count() > 1


def test_a_level_of_a_walk_shuffles_its_frontier_only(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = spark.range(5000).selectExpr("id AS message_id", "CASE WHEN id % 5 > 0 THEN id - 1 END AS reply_to_id", "timestamp_seconds(id) AS created_at")
        with shared.bucketed(m, "reply_to_id") as adjacent:
            frontier = m.filter("message_id % 5 = 0").select(F.col("message_id").alias("at"))
            plan = frontier.join(adjacent, F.col("at") == F.col("reply_to_id"))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(at") == 1 and plan.count("Exchange") == 1, plan
        down = graph.thread_descendants(m, m.filter("message_id % 5 = 0"), max_depth=9)
        assert down.count() == 5000 and down.filter("depth = 4").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    folder = Path(down.stored_at.removeprefix("file:")).parent
    assert folder.exists() and spark.catalog.listTables() == []


def test_planned_buckets_follow_the_size(spark):
    assert shared.planned_buckets(spark.range(10)) == shared.FEWEST_BUCKETS
    assert shared.planned_buckets(spark.sparkContext.parallelize([(1,)]).toDF("k long")) == shared.BUCKETS_NOT_KNOWN
    big = shared.planned_buckets(spark.range(1 << 30))
    assert big == 1 << math.ceil(math.log2((8 << 30) / shared.BUCKET_BYTES + 1))


def test_a_busy_guild_and_a_busy_key_are_spread(spark, monkeypatch, all_ranges):
    """Running values are carried over ranges: the same as by hand, over facts in order."""
    from palaver.operators import lifecycle

    rnd = random.Random(3)
    hours = lambda h: None if h is None else f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    rows = []
    for k in range(1500):
        key = 1 if k % 10 else k % 7
        kind = rnd.choice(["sync_due", "changed", "heartbeat", "heartbeat", "else"]) if k > 20 else "changed"
        rows.append((key, k, kind, hours(k // 4), hours(rnd.randrange(600)) if rnd.random() < 0.7 else None, hours(rnd.randrange(600))))
    df = spark.createDataFrame(rows, "k long, seq long, kind string, a string, s string, c string").repartition(5)
    df = df.selectExpr("k", "seq", "kind", "CAST(a AS TIMESTAMP) AS at", "CAST(s AS TIMESTAMP) AS synced_at", "CAST(c AS TIMESTAMP) AS cutoff")
    seen = []
    keep = shared.stored
    monkeypatch.setattr(lifecycle, "stored", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    found = {r["seq"]: r["stale"] for r in lifecycle.guild_facts(df, "k").collect()}
    known, synced, want = set(), {}, {}
    for key, seq, kind, a, s, c in rows:
        want[seq] = (synced.get(key) is None or synced[key] < c) if kind == "heartbeat" else None
        if kind == "changed" and key in known:
            synced[key] = s or a
        if kind == "sync_due":
            known.add(key)
    assert found == want
    assert seen[0].filter("k = 1").select("_part").distinct().count() > 1
    late = {(r["k"], r["seq"]) for r in lifecycle.timeouts(df, "k", "at", pending=("sync_due", "changed"), seconds=3600).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    wanted = set()
    for key, own in by.items():
        for r, after in zip(own, [*own[1:], None], strict=True):
            gap = None if after is None else int(after[1]) // 4 - int(r[1]) // 4
            if r[2] in ("sync_due", "changed") and (gap is None or gap > 1):
                wanted.add((key, r[1]))
    assert late == wanted
