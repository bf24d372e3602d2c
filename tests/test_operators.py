"""Small exact cases, state transitions and properties."""

from __future__ import annotations

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from palaver.functions import scalars as S
from palaver.operators import dims, filters, ingest, latest, lifecycle, payloads, render, rollups, search, tokens
from palaver.operators import graph as G
from palaver.sources import capture, sinks
from palaver.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_uuid5_matches_the_standard(spark):
    assert one(spark, S.uuid5_key(F.lit(1).cast("long"))) == "c226d82f-a360-5ef4-ba7a-55a217168d4a"
    space = uuid.UUID(S.KEY_NAMESPACE)
    ids = [0, 7, 2**40 + 3, 2**62]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", S.uuid5_key(F.col("id")).alias("k")).collect()
    for r in got:
        digest = bytearray(hashlib.sha1(space.bytes + r["id"].to_bytes(8, "big")).digest()[:16])
        digest[6], digest[8] = digest[6] & 0x0F | 0x50, digest[8] & 0x3F | 0x80
        assert r["k"] == str(uuid.UUID(bytes=bytes(digest)))


@pytest.mark.parametrize(
    ("text", "substantive"),
    [("lol", False), ("LOL", False), ("  ok ", False), ("\U0001f600\U0001f600\U0001f600", False), ("12345", False), ("", False), (None, False),
     ("https://example.com/a", True), ("hello there", True), ("\\o", False), ("xD", False)],
)
def test_substantive(spark, text, substantive):
    assert one(spark, S.is_substantive(F.lit(text).cast("string"), F.lit(False))) is substantive
    assert one(spark, S.is_substantive(F.lit(text).cast("string"), F.lit(True))) is False


@pytest.mark.parametrize(
    ("content", "flat"),
    [("**important**", "important"), ("<@42>", "@42"), ("<#7777>", "#7777"), ("a `x*y*z` b", "a x*y*z b"), ("@everyone hi", "@everyone hi"),
     ("[site](https://a.example.com/x) !", "site (https://a.example.com/x) !"), ("[](https://a.example.com)", "https://a.example.com"),
     ("<a:wave_1:99>", ":wave_1:"), ("```py\nx = <@1>\n```", "x = <@1>"), (None, "")],
)
def test_flatten(spark, content, flat):
    assert one(spark, tokens.flatten(F.lit(content).cast("string"))) == flat


@pytest.mark.parametrize(
    ("content", "flat"),
    [("**hey <@1>**", "hey @1"), ("||<#5> spoiler||", "#5 spoiler"), ("**a `x*y` b**", "a x*y b"), ("~~[*s*](https://a.example.com/p_q)~~", "s (https://a.example.com/p_q)"),
     ("_❤️_ ***both <@&2>***", "❤️ both @2"), ("*a _b* c_", "a _b c_"), ("*a **b* c**", "a b c**"), ("**__~~||*in*||~~ out__**", "in out"), ("****", "**"), ("** open <@1> *", "* open @1"),
     ("> *a\nb*", "> *a\nb*"), ("*a\n> b*", "a\n> b"), ("> **q** x\n>>> a\n> *b*", "> q x\n> a\n> b"), ("*x*\ufdd0\ufdd1 *y*", "x\ufffd\ufffd y"), ("```\n*a*\n``` *b*", "*a*\n b")],
)
def test_flatten_pairs_markers_around_tokens(spark, content, flat):
    assert one(spark, tokens.flatten(F.lit(content))) == flat


def test_render_with_names_replies_and_trailer(spark):
    rows = [(1, "*hi* <@5> <@6> <@&5> <#9> <t:0:R> [a](https://x.example.com)", 7, 5), (2, "x", 7, None), (3, "y", None, None)]
    m = spark.createDataFrame(rows, "message_id long, content string, reply_to_id long, reply_author_id long")
    files = F.array(F.struct(F.lit("f").alias("filename"), F.lit("u<").alias("url")), F.struct(F.lit(None).cast("string").alias("filename"), F.lit("v").alias("url")))
    m = m.withColumn("attachments", F.when(F.col("message_id") == 1, files))
    m = m.withColumn("embeds", F.array(F.struct(F.lit("T").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("w").alias("url"))))
    named = lambda key, *rows: spark.createDataFrame(list(rows), f"{key} long, name string")
    names = {"users": named("user_id", (5, "ann"), (6, "")), "roles": named("role_id", (5, "mods"), (5, "mods"))}
    body = lambda fmt: {r["message_id"]: r["body"] for r in render.render(m, named("channel_id", (1, "c")), fmt=fmt, **names).collect()}
    assert body("plain") == {1: "hi @ann @6 @mods #<unknown channel> 1970-01-01 a (https://x.example.com)", 2: "x", 3: "y"}
    rest = "\n\n---\n**T**\nw\n"
    assert body("markdown") == {
        1: "> ↪ replying to @ann\n*hi* @ann @6 @mods #<unknown channel> 1970-01-01 [a](https://x.example.com)\n\n---\n[f](u<)\n[v](v)\n" + rest,
        2: "> ↪ replying to @unknown\nx" + rest, 3: "y" + rest,
    }
    assert '<a href="u&lt;">f</a>' in body("html")[1] and body("html")[3].startswith("y\n")


def test_flatten_with_names(spark):
    names = F.create_map(F.lit("user:42"), F.lit("bob"), F.lit("channel:7"), F.lit("announcements"))
    assert one(spark, tokens.flatten(F.lit("hey <@42> check <#7>"), names)) == "hey @bob check #announcements"


def test_payload_edges(spark):
    rows = [(1, ""), (2, "{not json"), (3, '{"author":{"id":5,"bot":"true"},"attachments":{}}'), (4, '{"author":{"id":"5","bot":true}}'), (5, None)]
    parsed = payloads.parse_payload(spark.createDataFrame(rows, "message_id long, payload string"))
    got = parsed.select("message_id", payloads.author_id(F.col("doc")).alias("a"), payloads.author_is_bot(F.col("doc")).alias("b")).orderBy("message_id").collect()
    assert [(r["a"], r["b"]) for r in got] == [(0, False), (0, False), (0, False), (5, True), (0, False)]
    assert payloads.attachment_rows(parsed).count() == 0
    assert payloads.embed_rows(parsed).count() == 0


def test_fingerprint_ignores_order(spark):
    rows = [("a", 2, "2024-01-01T00:00:00Z"), ("a", 1, None), ("b", 1, None), ("b", 2, "2024-01-01T02:00:00+02:00"), ("c", 1, None)]
    for data in (rows, rows[::-1]):
        df = spark.createDataFrame(data, "g string, id long, v string").withColumn("v", F.to_timestamp("v"))
        got = {r["g"]: r["fingerprint"] for r in latest.set_fingerprint(df, ["g"], "id", "v").collect()}
        assert got["a"] == got["b"] != got["c"]
        assert got["c"] == hashlib.sha256(b"1:").hexdigest()


def test_fingerprint_of_groups_longer_than_a_batch(spark):
    """A group's hash goes on over batches; null ids are left out, null groups are groups, and other columns may clash."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        ids = spark.range(5000, numPartitions=7).select(
            F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 50 == 1, F.col("id")).otherwise(-1).alias("g"),
            F.when(F.col("id") % 11 > 0, F.col("id")).alias("id"), F.lit(None).cast("timestamp").alias("v"), F.lit("x").alias("fingerprint"),
        )
        members: dict = {}
        for r in ids.collect():
            members.setdefault(r["g"], []).append(r["id"])
        wanted = {g: hashlib.sha256("|".join(f"{x}:" for x in sorted(x for x in xs if x is not None)).encode()).hexdigest() for g, xs in members.items()}
        got = latest.set_fingerprint(ids, ["g"], "id", "v").collect()
        assert len(got) == len(wanted) and {r["g"]: r["fingerprint"] for r in got} == wanted
        assert latest.set_fingerprint(ids.filter("false"), ["g"], "id", "v").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dedup_last(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "x", 1), (2, None, 1)], "k long, v string, seq long")
    assert {(r["k"], r["v"]) for r in latest.dedup_last(df, ["k"], "seq").collect()} == {(1, "b"), (2, "x")}
    assert latest.dedup_last(df.filter("false"), ["k"], "seq").count() == 0
    target = spark.createDataFrame([(1, "old"), (9, "kept")], "k long, v string")
    assert {(r["k"], r["v"]) for r in latest.upsert(target, df, ["k"], "seq").collect()} == {(1, "b"), (2, "x"), (9, "kept")}


def test_percentiles_are_nearest_rank(spark):
    df = spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    r = rollups.percentiles(df, "v", by="g", ps=(0, 0.5, 0.95, 0.99, 1)).first()
    assert [r[c] for c in ("p0", "p50", "p95", "p99", "p100")] == [1, 50, 95, 99, 100]
    with pytest.raises(ValueError, match="between"):
        rollups.percentiles(df, "v", by="g", ps=(1.5,))


def test_snippet_bounds():
    assert [S.snippet_words(n) for n in (0, 60, 240, 5000)] == [6, 6, 24, 100]


PATH = ["captured", "analyzed", "projected", "tagged", "classified"]


@pytest.mark.parametrize(
    ("kinds", "state", "pending", "enriched"),
    [
        ([], None, None, None),
        (["analyzed"], "", False, 0),
        (PATH[:1], "AnalyzePending", False, 0),
        (PATH[:2], "ProjectPending", False, 0),
        (["captured", "analyzed!"], "Excluded", False, 0),
        (["captured", "timeout"], "Faulted", False, 0),
        (["captured", "analyzed", "fault"], "Faulted", False, 0),
        (PATH[:3], "Tagging", False, 0),
        (PATH[:4], "Classifying", False, 0),
        (PATH, "Enriched", False, 1),
        ([*PATH[:2], "edit", "projected"], "ProjectPending", False, 0),
        ([*PATH[:3], "edit", "tagged"], "ProjectPending", False, 0),
        ([*PATH[:4], "edit", "classified"], "ProjectPending", False, 0),
        (["captured", "edit", "analyzed"], "ProjectPending", True, 0),
        ([*PATH, "edit"], "ProjectPending", False, 1),
        ([*PATH, "tags_invalidated"], "Tagging", False, 1),
        ([*PATH, "classify_invalidated"], "Classifying", False, 1),
        ([*PATH[:3], "fault", "replay"], "Tagging", False, 0),
        ([*PATH[:4], "fault", "replay"], "Classifying", False, 0),
        ([*PATH, "classify_invalidated", "fault", "replay"], "Faulted", False, 1),
        (["captured", "analyzed!", "edit"], "Excluded", False, 0),
        ([*PATH, "captured"], "Enriched", False, 1),
    ],
)
def test_message_lifecycle(spark, kinds, state, pending, enriched):
    rows = [(1, k, kind.rstrip("!"), not kind.endswith("!")) for k, kind in enumerate(kinds)]
    facts = spark.createDataFrame(rows, "id long, seq long, kind string, ok boolean").withColumn("at", F.timestamp_seconds("seq"))
    last = lifecycle.fold(facts, "id", lifecycle.MESSAGE).collect()
    if state is None:
        assert last == []
        return
    assert (last[0]["state"], last[0]["pending"], last[0]["n_enriched"]) == (state, pending, enriched)


def test_graph_depth_and_cycles(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (10, 11), (11, 10)]
    m = spark.createDataFrame(rows, "message_id long, reply_to_id long").withColumn("created_at", F.timestamp_seconds("message_id"))
    roots = m.filter("message_id = 1")
    assert {r["message_id"] for r in G.thread_descendants(m, roots, max_depth=2).collect()} == {1, 2, 3}
    assert G.thread_descendants(m, roots, max_depth=0).count() == 0
    assert G.thread_descendants(m, m.filter("message_id = 10"), max_depth=5).count() == 6
    assert [r["message_id"] for r in G.reply_ancestors(m, m.filter("message_id = 4"), max_depth=9).orderBy(F.desc("depth")).collect()] == [1, 2, 3, 4]
    assert G.conversation_context(m, m.select("message_id", F.lit(1).alias("channel_id"), F.lit(2).alias("author_id"), F.lit("t").alias("plain_text")).filter("false"), roots, radius=1).filter("author_id = 0 and plain_text = ''").count() == 2


def test_search_predicates(spark):
    docs = spark.createDataFrame([(1, "quick brown foxes"), (2, "brown bread quick"), (3, "slow brown fox"), (4, None)], "id long, text string")
    index = search.postings(docs, "id", "text").cache()
    ids = lambda **kw: {r["id"] for r in search.match(index, "id", **kw).collect()}
    assert ids(required=["quick", "brown"]) == {1, 2}
    assert ids(required=["brown"], excluded=["quick"]) == {3}
    assert ids(phrases=[["quick", "brown"]]) == {1}
    assert ids(any_of=["fox", "bread"]) == {1, 2, 3}
    assert ids(required=["Foxes", "the"]) == {1, 3} and ids(required=["QUICKLY brown"]) == {1} and ids(phrases=["brown, quick"]) == set()
    assert ids(any_of=[["fox", "breads"], ["slow", "quick"]]) == {1, 2, 3} and ids(required=["brown"], excluded=["brown fox"]) == {2}
    assert ids(required=["of the"]) == set()  # nothing but stop words
    with pytest.raises(ValueError, match="term"):
        search.match(index, "id")


def test_search_words_and_phrases_over_stop_words(spark):
    docs = spark.createDataFrame([(1, "Running channels quoted: the state of play"), (2, "a state play"), (3, "runs")], "id long, text string")
    index = search.postings(docs, "id", "text").cache()
    ids = lambda **kw: {r["id"] for r in search.match(index, "id", **kw).collect()}
    assert [ids(required=[w]) for w in ("running", "channels", "Channels", "RUN", "quote")] == [{1, 3}, {1}, {1}, {1, 3}, {1}]
    assert ids(phrases=["state of play"]) == ids(phrases=["States at plays"]) == {1} and ids(phrases=["state play"]) == {2}


#: A sample of the published vocabulary and its stems.
STEMS = dict(zip(
    """consign consigned consigning consignment consist consistency consistently consolations consolatory consoled consolidating consols conspicuously conspirator constables constancy
    knack knackeries knaves knavish kneading knee kneels knightly knits knitted knives knocker knots luxuriated hopping hoping hoped generously communities arsenal relational sensational skies dying
    gently news inning succeeded proceeding happily cries ties by say gas this kiwis agreed plastered bled motoring sing controlling rolls national rationally analogies analogously electricity
    hopefulness goodness formative adjustment adoption allowance replacement irritant probate rate cease controll bowdlerize youth boyish yellow eyed""".split(),
    """consign consign consign consign consist consist consist consol consolatori consol consolid consol conspicu conspir constabl constanc
    knack knackeri knave knavish knead knee kneel knight knit knit knive knocker knot luxuri hop hope hope generous communiti arsenal relat sensat sky die
    gentl news inning succeed proceed happili cri tie by say gas this kiwi agre plaster bled motor sing control roll nation ration analog analog electr
    hope good format adjust adopt allow replac irrit probat rate ceas control bowdler youth boyish yellow eye""".split(), strict=True,
))


def test_stems_of_the_published_vocabulary(spark):
    from palaver.operators import stem

    found = stem.stems(spark, [*STEMS, "naïve", "x1s", "ab", "as", "éing"])
    assert {w: s for w, s in found.items() if w in STEMS} == STEMS
    assert [found[w] for w in ("naïve", "x1s", "ab", "as", "éing")] == ["naïve", "x1s", "ab", "as", "éing"]


def test_index_upkeep_equals_a_fresh_index(spark, tmp_path, monkeypatch):
    from palaver.sources import textindex

    monkeypatch.setattr(textindex, "SEGMENTS", 2)
    monkeypatch.setattr(textindex, "BUCKET_WRITERS", 2)
    path = str(tmp_path / "ix")
    texts = {k: f"common words number{k} running" for k in range(60)}
    frame = lambda ids: spark.createDataFrame([(k, texts[k]) for k in ids], "id long, text string")
    rows = lambda df: {(r["term"], r["id"], tuple(r["positions"])) for r in df.collect()}
    textindex.create(frame(range(40)), path, "id", "text", buckets=4)
    base = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "ix" / "whole=0").rglob("*.parquet")}
    for step in range(4):
        changed = [k for k in texts if k % 7 == step % 7 or k == 40 + step]
        for k in changed:
            texts[k] = f"changed {step} common{k}"
        gone = [k for k in (3 * step, 3 * step + 1) if k not in changed]
        textindex.upsert(frame(changed), path, "id", "text", deleted=spark.createDataFrame([(k,) for k in gone], "id long"))
        held = {i for i in (set(range(40)) if step == 0 else held) | set(changed)} - set(gone)
        assert rows(textindex.read(spark, path, "id")) == rows(search.postings(frame(sorted(held)), "id", "text"))
        if step == 0:  # what was there is not written again, and a search reads its bucket of it
            assert base == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "ix" / "whole=0").rglob("*.parquet")}
            plan = search.match(textindex.read(spark, path, "id"), "id", required=["common"])._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters" in plan and "EqualTo(term,common)" in plan
    assert len([p for p in (tmp_path / "ix").iterdir() if p.name.startswith("segment=")]) <= textindex.SEGMENTS


def test_vector_errors_and_zero(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "message_id long, embedding array<float>")
    got = [(r["message_id"], round(r["score"], 4)) for r in search.vector_topk(v, [1.0, 0.0], k=3).collect()]
    assert got == [(1, 1.0), (3, 0.7071), (2, 0.0)]
    with pytest.raises(ValueError, match="query"):
        search.vector_topk(v, [], k=3)
    with pytest.raises(Exception, match="length"):
        search.vector_topk(v, [1.0], k=3).collect()


def test_hybrid_sides(spark):
    m = spark.createDataFrame([(1,), (2,), (3,)], "message_id long")
    lex = spark.createDataFrame([(1, 0.8), (9, 1.0)], "message_id long, score double")
    sem = spark.createDataFrame([(1, 0.4), (2, 0.6)], "message_id long, score double")
    scores = lambda df: [(r["message_id"], round(r["score"], 3)) for r in df.collect()]
    assert scores(search.hybrid(lex, sem, m)) == [(1, 0.6), (2, 0.3)]
    assert scores(search.hybrid(lex, None, m)) == [(1, 0.8)]
    assert scores(search.hybrid(lex, sem, m, w_lex=1.0, w_sem=0.0)) == [(1, 0.8), (2, 0.0)]
    assert scores(search.hybrid(None, None, m)) == []


def test_filters_push_down(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_suppkey", "guild_id").filter(filters.conjunctive(guild_id=3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,3)]" in plan


def test_names_fall_back(spark):
    refs = spark.createDataFrame([(1, 5, 5), (2, 6, 0), (3, 7, 0)], "message_id long, ref_id long, home_id long").withColumn("home_name", F.lit("home"))
    channels = spark.createDataFrame([(6, "six"), (7, "")], "channel_id long, name string")
    got = {r["message_id"]: r["name"] for r in dims.resolve_channels(refs, channels).collect()}
    assert got == {1: "home", 2: "six", 3: "<unknown channel>"}


def test_render_html(spark):
    m = spark.createDataFrame([(1, "a < b `x<y` https://e.example.com/?a=1&b=2 <#3>")], "message_id long, content string")
    c = spark.createDataFrame([(3, "general")], "channel_id long, name string")
    assert render.render(m, c, fmt="html").first()["body"] == (
        'a &lt; b <code>x&lt;y</code> <a href="https://e.example.com/?a=1&amp;b=2">https://e.example.com/?a=1&amp;b=2</a> #general'
    )


def test_capture_lines_in_any_letter_case_and_unreadable_ones(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    good = ingest.parse_lines(lines('{"Kind":"guildChanged","DATA":{"GuildId":5,"name":"g","Roles":[{"Id":1,"NAME":"r"}],"isPresent":true,"updatedOn":"2024-01-01T00:00:00Z"}}', " ", '{"data":null}'))
    assert sorted(r["kind"] for r in good.collect()) == ["", "guildChanged"]
    row = ingest.demux(good, "guildChanged").first().asDict(recursive=True)
    assert (row["guildId"], row["name"], row["roles"], row["isPresent"], str(row["updatedOn"])) == (5, "g", [{"id": 1, "name": "r"}], True, "2024-01-01 00:00:00")
    for bad in ("{oops", "7", '"text"', "[1]"):
        with pytest.raises(Exception, match="unreadable line"):
            ingest.parse_lines(lines('{"kind":"a","data":{}}', bad)).collect()
    for body in ("null", "3", "[]"):
        with pytest.raises(Exception, match="without a body"):
            ingest.demux(ingest.parse_lines(lines('{"kind":"guildChanged","data":' + body + "}")), "guildChanged").collect()


def test_capture_log_round_trip(spark, tmp_path):
    records = spark.createDataFrame([("messageCaptured", '{"messageSnowflake":5,"guildId":1}'), ("other", "{}")], "kind string, data string")
    capture.write_log(records, str(tmp_path / "log"), session="s1")
    back = capture.read_log(spark, str(tmp_path / "log"))
    assert {(r["kind"]) for r in back.collect()} == {"messageCaptured", "other"}
    assert ingest.demux(back, "messageCaptured").first()["messageSnowflake"] == 5
    late = spark.createDataFrame([('{"kind":"header","schemaVersion":2}',)], "value string")
    with pytest.raises(Exception, match="schema version"):
        capture.checked(ingest.parse_lines(late)).collect()
    with pytest.raises(Exception, match="without a body"):
        ingest.demux(spark.createDataFrame([("guildChanged", None)], "kind string, data string"), "guildChanged").collect()


def test_stream_equals_batch(spark, sf_dir):
    from palaver.plans.registry import Tables

    t = Tables(spark, sf_dir)
    streamed = {(r["channel_id"], r["bucket"]): r["n"] for r in jobs.hourly_stream(spark, f"{sf_dir}/events.parquet").collect()}
    batch = {(r["channel_id"], r["bucket"]): r["n"] for r in rollups.hourly_counts(t.facts.withColumnRenamed("entity_id", "channel_id"), at="ts").collect()}
    assert streamed and all(batch[k] == n for k, n in streamed.items())
    assert len(batch) - len(streamed) <= len({k for k in batch if k[1] >= max(b for _, b in batch) - __import__("datetime").timedelta(hours=2)})


def test_lifecycle_stream_equals_batch(spark, sf_dir, tmp_path):
    from palaver.plans import state_queries as Q
    from palaver.plans.registry import Tables

    facts = Q._message_facts(Tables(spark, sf_dir).facts)
    bounds = facts.agg(F.max("seq")).first()[0] // 3 + 1
    for k in range(3):  # three files, in order
        part = facts.filter((F.col("seq") / bounds).cast("int") == k)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "facts"))
    stream = jobs.parquet_stream(spark, str(tmp_path / "facts"), files=1)
    streamed = {tuple(r) for r in jobs.lifecycle_stream(stream, "entity_id", lifecycle.MESSAGE).collect()}
    assert streamed == {tuple(r) for r in lifecycle.fold(facts, "entity_id", lifecycle.MESSAGE).collect()}


def test_fingerprint_changes_of_all_events(spark, sf_dir):
    from palaver.plans.catalog import QUERIES
    from palaver.plans.registry import Tables

    days = {}
    for r in Tables(spark, sf_dir).facts.select("entity_id", "seq", F.date_trunc("day", "ts").alias("day")).collect():
        days.setdefault((r["entity_id"], r["day"]), []).append(r["seq"])
    wanted, before = set(), {}
    for (entity, day), seqs in sorted(days.items()):
        value = hashlib.sha256("|".join(f"{x}:" for x in sorted(seqs)).encode()).hexdigest()
        if before.get(entity) != value:
            wanted.add((entity, day, value))
        before[entity] = value
    got = QUERIES["fingerprint_changes_whole"](spark, sf_dir).collect()
    assert len(got) == len(wanted) and {(r["entity_id"], r["day"], r["fingerprint"]) for r in got} == wanted


def test_busy_keys_are_folded_in_bounded_runs(spark, monkeypatch):
    from palaver.operators import lifecycle as Y

    kinds = {
        "MESSAGE": "captured analyzed projected tagged classified edit fault replay tags_invalidated classify_invalidated timeout".split(),
        "CHANNEL": "sync_due completed changed pins poll seen".split(), "GUILD": "sync_due changed heartbeat seen".split(),
    }
    for name, known in kinds.items():
        some = ", ".join(f"'{x}'" for x in known)
        facts = spark.range(3000).selectExpr(
            "if(id % 3 = 0, id % 50, -1) AS k", "id AS seq", f"element_at(array({some}), cast(1 + pmod(hash(id), {len(known)}) AS int)) AS kind",
            "if(pmod(hash(id, 3), 20) = 0, null, pmod(hash(id, 1), 9) <> 0) AS ok", "pmod(hash(id, 2), 1000L) AS number", "timestamp_seconds(id * 60) AS at",
            "if(id % 7 = 0, null, id % 5) AS size", "concat('n', id % 11) AS name", "cast(id % 3 AS int) AS type", "if(id % 2 = 0, id, null) AS parent", "concat('d', id % 4) AS digest",
            "if(id % 4 = 0, null, timestamp_seconds(id * 60 - 50)) AS synced_at", "timestamp_seconds(id * 60 - 3000) AS cutoff", "array(named_struct('id', id, 'name', 'r')) AS roles",
        )
        rules = getattr(Y, name)

        def get(low, before=None, facts=facts, rules=rules, name=name):
            some = facts.filter(f"seq >= {low}")
            some = Y.guild_facts(some, "k", before) if name == "GUILD" else some
            return {r["k"]: r.asDict(recursive=True) for r in Y.fold(some, "k", rules, before).collect()}

        monkeypatch.setattr(Y, "CHUNK", 10**9)
        early = facts.filter("seq < 500")
        wanted, held = get(0), Y.fold(Y.guild_facts(early, "k") if name == "GUILD" else early, "k", rules).cache()
        assert len({r["state"] for r in wanted.values()}) > 1
        monkeypatch.setattr(Y, "CHUNK", 150)
        assert get(0) == wanted and get(500, held) == wanted
        runs = Y._fold_busy((Y.guild_facts(facts, "k") if name == "GUILD" else facts).filter("k = -1"), "k", rules, 2000).selectExpr("size(runs) AS n").first()["n"]
        assert runs == 14


CHANNEL_FACTS = "id long, seq long, kind string, ok boolean, number long, size long, name string, type int, parent long, digest string"


@pytest.mark.parametrize(
    ("facts", "wanted"),
    [
        ([("changed", False), ("completed", True, 9)], {"state": "", "is_present": True, "cursor": 0, "created_on": None}),
        ([("sync_due",), ("completed", True, 9, 3, "general", 11, 5)], {"state": "CaughtUp", "cursor": 9, "caught_up": True, "last_count": 3, "profile": {"name": "general", "type": 11, "parent_id": 5}}),
        ([("sync_due",), ("completed", True, 9), ("sync_due",), ("completed", False, 0, 0)], {"state": "CaughtUp", "cursor": 9, "caught_up": False, "last_count": 0}),
        ([("sync_due",), ("completed", True, 9), ("sync_due",)], {"state": "Syncing", "caught_up": False}),
        ([("sync_due",), ("sync_due",), ("changed", False), ("changed", True)], {"state": "Syncing", "is_present": False}),
        ([("sync_due",), ("pins", None, None, None, None, None, None, "early"), ("completed", True, 1)], {"state": "CaughtUp", "pins": None}),
        ([("sync_due",), ("completed", True, 1), ("pins", None, None, None, None, None, None, "d1"), ("poll",)], {"state": "CaughtUp", "pins": "d1"}),
    ],
)
def test_channel_lifecycle(spark, facts, wanted):
    rows = [(1, k, *f, *[None] * (8 - len(f))) for k, f in enumerate(facts)]
    df = spark.createDataFrame(rows, CHANNEL_FACTS).withColumn("at", F.timestamp_seconds("seq"))
    last = lifecycle.fold(df, "id", lifecycle.CHANNEL).first().asDict(recursive=True)
    assert {name: last[name] for name in wanted} == wanted


@pytest.mark.parametrize(
    ("facts", "state", "present", "roles"),
    [
        ([("heartbeat", None, 99)], "", True, None),
        ([("changed", True)], "", True, None),
        ([("sync_due",)], "Syncing", True, None),
        ([("sync_due",), ("changed", True)], "Synced", True, [1]),
        ([("sync_due",), ("changed", True), ("changed", True)], "Synced", True, [2]),
        ([("sync_due",), ("heartbeat", None, 99), ("changed", True)], "Synced", True, [2]),
        ([("sync_due",), ("changed", True), ("heartbeat", None, 1)], "Synced", True, [1]),
        ([("sync_due",), ("changed", True), ("heartbeat", None, 2)], "Syncing", True, [1]),
        ([("sync_due",), ("changed", False), ("heartbeat", None, 99)], "Synced", False, [1]),
        ([("sync_due",), ("changed", False), ("changed", True), ("sync_due",)], "Syncing", False, [2]),
    ],
)
def test_guild_lifecycle(spark, facts, state, present, roles):
    rows = [(1, k, *f, *[None] * (3 - len(f))) for k, f in enumerate(facts)]
    df = spark.createDataFrame(rows, "id long, seq long, kind string, ok boolean, late long").withColumns(
        {"at": F.timestamp_seconds("seq"), "cutoff": F.timestamp_seconds("late"), "synced_at": F.lit(None).cast("timestamp"), "name": F.lit("g"), "roles": F.expr("array(named_struct('id', seq, 'name', 'r'))")}
    )
    last = lifecycle.fold(lifecycle.guild_facts(df, "id"), "id", lifecycle.GUILD).first()
    got = last["profile"] and [r["id"] for r in last["profile"]["roles"]]
    assert (last["state"], last["is_present"], got) == (state, present, roles)


def test_lifecycle_stamps(spark):
    kinds = ["edit", "captured", "analyzed", "edit", "projected", "projected", "tagged", "classified", "seen", "replay"]
    rows = [(1, k, kind, True) for k, kind in enumerate(kinds)]
    facts = spark.createDataFrame(rows, "id long, seq long, kind string, ok boolean").withColumn("at", F.timestamp_seconds("seq"))
    last = lifecycle.fold(facts, "id", lifecycle.MESSAGE).select(*[F.unix_timestamp(c).alias(c) for c in ("created_on", "updated_on", "settled_on")]).first()
    assert tuple(last) == (1, 9, 7)


def test_versioned_sink_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "a long, b long, v string, seq long")
    sinks.write_upsert(rows((1, 1, "x", 0), (1, 2, "x", 0), (1, 1, "y", 1)), path, ["a", "b"], "seq", version=0)
    batch = rows((1, 2, "z", 5), (1, 2, "w", 4), (2, 1, "n", 1))
    got = [{tuple(r) for r in sinks.write_upsert(batch, path, ["a", "b"], "seq", version=1).collect()} for _ in range(2)]
    assert got[0] == got[1] == {(1, 1, "y"), (1, 2, "z"), (2, 1, "n")}
    # a version whose write did not end is not there
    (tmp_path / "t" / "version=2").mkdir()
    assert {tuple(r) for r in sinks.read_version(spark, path).collect()} == got[0]
    sinks.write_upsert(rows(), path, ["a", "b"], "seq", version=3)
    assert {tuple(r) for r in sinks.read_version(spark, path).collect()} == got[0]
    assert not (tmp_path / "t" / "manifest=0").exists() and (tmp_path / "t" / "manifest=1").exists()
    assert sinks.read_version(spark, str(tmp_path / "none")) is None


def test_weekly_table_replaces_touched_weeks_and_prunes(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = spark.range(200).selectExpr("id", "timestamp_seconds(id * 86400) AS at", "'old' AS v", "0 AS seq")
    sinks.write_weeks(rows, path, ["id"], "seq", "at")
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "w").glob("week=*/*.parquet")}
    batch = rows.filter("id between 30 and 32").withColumn("v", F.lit("new"))
    for _ in range(2):
        sinks.write_weeks(batch, path, ["id"], "seq", "at")
    got = {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {i: "new" if 30 <= i <= 32 else "old" for i in range(200)}
    after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "w").glob("week=*/*.parquet")}
    assert len(set(before.items()) - set(after.items())) == 1  # one week's file gave way
    some = sinks.between(spark, path, "at", "1970-01-20 00:00:00", "1970-01-25 00:00:00")
    assert sorted(r["id"] for r in some.collect()) == [19, 20, 21, 22, 23]
    assert "PartitionFilters: [isnotnull(week" in some._jdf.queryExecution().toString()
    assert {f.split("week=")[1].split("/")[0] for f in some.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} <= {"2", "3"}


def test_stored_index_reads_its_terms_buckets(spark, tmp_path):
    docs = spark.range(300).selectExpr("id", "concat('common term', id % 7, ' word', id) AS text")
    from palaver.sources import textindex

    index = search.postings(docs, "id", "text").cache()
    textindex.create(docs, str(tmp_path / "ix"), "id", "text", buckets=64)
    kept = textindex.read(spark, str(tmp_path / "ix"), "id")
    want = {tuple(r) for r in search.match(index, "id", required=["common", "term3"]).select("id", "score").collect()}
    found = search.match(kept, "id", required=["common", "term3"])
    assert {tuple(r) for r in found.select("id", "score").collect()} == want and len(want) == 43
    read = kept.filter(kept["bucket"].isin(*[search.bucket_of(F.lit(x), 64) for x in ("common", "term3")])).select(F.input_file_name().alias("f")).distinct().count()
    assert read <= 2 * textindex.BUCKET_WRITERS < len(kept.inputFiles())


def test_batched_vector_search_is_the_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "ROW_BLOCK", 70)
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    rnd = np.random.default_rng(4)
    data = rnd.normal(size=(500, 8)).astype("float32")
    data[100:140] = data[0]
    data[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(900, None)], "message_id long, embedding array<float>")
    asked = rows.filter("message_id % 20 = 0").select(F.col("message_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r["query_id"], r["rank"]): r["message_id"] for r in search.vector_topk_batch(rows, asked, k=6).collect()}
    unit = data.astype(float) / np.maximum(np.linalg.norm(data.astype(float), axis=1), 1e-300)[:, None]
    for q in range(0, 500, 20):
        order = np.lexsort((np.arange(500), -(unit * unit[q]).sum(axis=1)))[:6]
        assert [got[q, k + 1] for k in range(6)] == order.tolist()
    assert search.vector_topk_batch(rows, asked.filter("false"), k=3).count() == 0


def test_approximate_search_recall_and_odd_vectors(spark, tmp_path):
    import numpy as np
    from palaver.sources import vectorindex

    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 24))
    data = centers[rng.integers(0, 40, 3000)] + 0.25 * rng.normal(size=(3000, 24))
    rows = [(k, v, k % 5) for k, v in enumerate(data.tolist())]
    odd = [(5000, None, 1), (5001, [0.0] * 24, 1), (5002, [float("nan")] * 24, 1), (5003, [1.0] * 3, 1), (None, [1.0] * 24, 1), (5004, data[0].tolist(), 0), (5005, [None] + [1.0] * 23, 1)]
    df = spark.createDataFrame(rows + odd, "message_id long, embedding array<double>, guild int")
    path = str(tmp_path / "ix")
    vectorindex.build(df, path, filters=("guild",))
    book = vectorindex._open(spark, path)[0]
    assert book.probes < len(book.centroids) / 2 and book.again < 600  # where vectors lie in clusters few are looked at
    asked = df.filter("message_id < 3000 AND message_id % 50 = 0").select(F.col("message_id").alias("query_id"), F.col("embedding").alias("query"))
    unit = np.vstack([data, data[:1]])
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    ids, guilds = np.r_[np.arange(3000), 5004], np.r_[np.arange(3000) % 5, 0]
    for where, some in ((None, np.ones(3001, bool)), (F.col("guild") == 3, guilds == 3)):
        found = {}
        for r in vectorindex.search(spark, path, asked, k=10, where=where).collect():
            found.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
        hits = 0
        for q in range(0, 3000, 50):
            cosine = unit @ unit[q]
            true = ids[some][np.lexsort((ids[some], -np.round(cosine[some], 12)))][:10]
            assert sorted(found[q]) == list(range(1, 11))
            assert all(abs(s - cosine[np.flatnonzero(ids == i)[0]]) < 1e-9 for i, s in found[q].values())
            hits += len(set(true.tolist()) & {i for i, _ in found[q].values()})
        assert hits >= 0.95 * 600
        if where is None:
            assert [found[0][k][0] for k in (1, 2)] == [0, 5004]  # equal scores: the smaller id
    assert vectorindex.search(spark, path, asked, k=3, where=F.col("guild") == 77).collect() == []
    vectorindex.build(df.limit(0), str(tmp_path / "none"))
    assert vectorindex.search(spark, str(tmp_path / "none"), asked, k=3).collect() == []


def test_embedding_by_a_callable(spark):
    from palaver.operators import models

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "message_id long, text string")
    made = models.embed_batch(df, "text", lambda texts: [[float(len(x)), 1.0] for x in texts], model="sizes").collect()
    assert {r["message_id"]: (r["embedding"], r["model_version"]) for r in made} == {1: ([2.0, 1.0], "sizes"), 2: ([0.0, 1.0], "sizes"), 3: ([0.0, 1.0], "sizes")}


def test_walks_go_beyond_a_million_rows_and_a_hundred_levels(spark):
    wide = spark.range(1_200_000).selectExpr("id AS message_id", "if(id % 2 = 1, id - 1, null) AS reply_to_id", "timestamp_seconds(id) AS created_at")
    assert G.thread_descendants(wide, wide, max_depth=1).count() == 1_800_000
    chain = spark.range(104).selectExpr("id AS message_id", "if(id > 0, id - 1, null) AS reply_to_id", "timestamp_seconds(id) AS created_at").coalesce(1)
    assert G.reply_ancestors(chain, chain.filter("message_id = 103"), max_depth=102).count() == 103


def test_streams_go_on_after_they_stopped_and_take_empty_sources(spark, sf_dir, tmp_path):
    from palaver.plans import state_queries as Q
    from palaver.plans.registry import Tables

    facts = Q._message_facts(Tables(spark, sf_dir).facts)
    source, folder = str(tmp_path / "facts"), str(tmp_path / "job")
    facts.filter("false").write.parquet(source)
    run = lambda: jobs.lifecycle_stream(jobs.parquet_stream(spark, source, files=1), "entity_id", lifecycle.MESSAGE, folder)
    assert run().count() == 0
    bounds = facts.agg(F.max("seq")).first()[0] // 20 + 1
    for k in range(20):  # the job is started anew for each few files and passes a whole state
        facts.filter((F.col("seq") / bounds).cast("int") == k).coalesce(1).write.mode("append").parquet(source)
        if k in (2, 3, 19):
            last = run()
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in lifecycle.fold(facts, "entity_id", lifecycle.MESSAGE).collect()}
    empty = str(tmp_path / "conversations.parquet")
    spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("false").write.parquet(empty)
    assert [r["n"] for r in jobs.project_stream(spark, empty).collect()] == [0] * 5
