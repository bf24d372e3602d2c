"""Text, vector and hybrid search queries over documents, messages and embeddings."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import filters, search as S, stem
from ..sources import textindex, vectorindex
from ..sources.shared import children, finished, kept_at, scratch
from .registry import Tables, query

_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


def _index_sql(table: str, key: str, text: str, *asked: str) -> str:
    """Terms of a table (``ix``, ``p``) and of the words asked for (``stems``), in the oracle's SQL."""
    more = "".join(f" UNION SELECT '{w}'" for w in asked)
    return f"""w AS (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM {table}),
      e AS (SELECT {key}, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
      v AS MATERIALIZED (SELECT DISTINCT word FROM e WHERE word NOT IN ({_STOP}){more}), {stem.oracle_ctes("v")},
      p AS MATERIALIZED (SELECT {key}, pos, term FROM e JOIN stems ON stems.word = e.word),
      ix AS MATERIALIZED (SELECT term, {key}, count(*) AS tf FROM p GROUP BY 1, 2)"""


def _term(word: str) -> str:
    return f"(SELECT term FROM stems WHERE word = '{word}')"


_SCORE = "round(sum(list_sum(list_transform(range(1, tf + 1), lambda i: 1.0 / (i * i)))) / {n}, 6)"
_DOCS = "WITH " + _index_sql("documents", "doc_id", "text", "ering", "shou", "anea", "attion", "er", "thanedble", "whst", "stest", "ing")
_MESSAGES = ", " + _index_sql("messages", "message_id", "plain_text", "whst")


def _index(t: Tables, table: str, key: str, text: str):
    """The stored index of a table: a folder named by the table's files, written at the first search of them."""
    make = lambda at: textindex.create(getattr(t, table), at, key, text)
    path = kept_at(t.spark, f"index3-{table}-{_stamp(t, table, key, text)}", make, lambda at: bool(finished(t.spark, at, "whole")))
    return textindex.read(t.spark, path, key)


def _documents(t: Tables):
    return _index(t, "documents", "doc_id", "text")


@query("text_postings", (), _DOCS + " SELECT term, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences FROM ix GROUP BY 1")
def _(t: Tables):
    return _documents(t).groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@query(
    "text_match", (),
    _DOCS + f""" SELECT doc_id FROM ix GROUP BY 1 HAVING bool_or(term = {_term("whst")}) AND bool_or(term IN ({_term("er")}, {_term("shou")})) AND bool_or(term IN ({_term("attion")}, {_term("ing")}))
      AND NOT bool_or(term = {_term("anea")})""",
)
def _(t: Tables):
    return S.match(_documents(t), "doc_id", required=["WHST", "the"], any_of=[["Er", "shou"], ["attions", "Ing", "of"]], excluded=["aneas"]).select("doc_id")


@query(
    "text_phrase", (),
    _DOCS + f" SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = {_term('attion')} AND b.term = {_term('er')} "
    f"UNION SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 2 WHERE a.term = {_term('attion')} AND b.term = {_term('thanedble')}",
)
def _(t: Tables):
    # a phrase's stop words are not indexed, but they keep their places
    return S.match(_documents(t), "doc_id", any_of=["attion er", "Attions to thanedble"]).select("doc_id")


@query(
    "text_search", (),
    _DOCS + f" SELECT doc_id, {_SCORE.format(n=2)} AS score FROM ix WHERE term IN ({_term('ing')}, {_term('whst')}) GROUP BY 1 HAVING count(*) = 2 ORDER BY 2 DESC, 1 LIMIT 50",
)
def _(t: Tables):
    index = _documents(t)
    return S.top(S.match(index, "doc_id", required=["Ing", "whst"]).select("doc_id", F.round("score", 6).alias("score")), "doc_id", 50)


@query("search_total", (), _DOCS + f" SELECT count(*) AS total FROM (SELECT doc_id FROM ix WHERE term IN ({_term('ing')}, {_term('whst')}) GROUP BY 1 HAVING count(*) = 2)")
def _(t: Tables):
    return S.match(_documents(t), "doc_id", required=["Ing", "whst"]).agg(F.count("*").alias("total"))


@query("index_upkeep", (), _DOCS.replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'Whst changed ' || text ELSE text END AS text FROM documents WHERE doc_id % 5 <> 2))") + " SELECT term, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences FROM ix GROUP BY 1")
def _(t: Tables):
    """An index after two upserts and a deletion."""
    path = scratch(t.spark, "upkeep")
    docs = t.documents.select("doc_id", "text")
    changed = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Whst changed "), "text")).otherwise(F.col("text"))
    textindex.create(docs.filter("doc_id % 3 > 0"), path, "doc_id", "text")
    textindex.upsert(docs.filter("doc_id % 3 = 0 OR doc_id % 4 = 1").withColumn("text", F.lit("to be replaced")), path, "doc_id", "text")
    later = docs.filter("(doc_id % 3 = 0 OR doc_id % 4 = 1) AND doc_id % 5 <> 2").withColumn("text", changed)
    textindex.upsert(later, path, "doc_id", "text", deleted=docs.filter("doc_id % 5 = 2"))
    return textindex.read(t.spark, path, "doc_id").groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@query(
    "search_snippets", (),
    _DOCS + """, h AS (SELECT doc_id FROM ix WHERE term = (SELECT term FROM stems WHERE word = 'whst')), f AS (SELECT p.doc_id, min(pos) AS a FROM p JOIN h ON h.doc_id = p.doc_id WHERE term = (SELECT term FROM stems WHERE word = 'whst') GROUP BY 1),
      g AS (SELECT f.doc_id, a, min(CASE WHEN p.pos >= a + 24 THEN p.pos END) AS b FROM f JOIN p ON p.doc_id = f.doc_id AND p.term = (SELECT term FROM stems WHERE word = 'whst') GROUP BY 1, 2),
      t AS (SELECT doc_id, 1 AS part, greatest(a - 12, 0) AS s FROM g UNION ALL SELECT doc_id, 2, greatest(b - 12, 0) FROM g WHERE b IS NOT NULL),
      r AS (SELECT t.doc_id, part, string_agg(CASE WHEN q.pos IS NOT NULL THEN '<b>' || e.word || '</b>' ELSE e.word END, ' ' ORDER BY e.pos) AS x
            FROM t JOIN e ON e.doc_id = t.doc_id AND e.pos >= s AND e.pos < s + 24 LEFT JOIN p q ON q.doc_id = e.doc_id AND q.pos = e.pos AND q.term = (SELECT term FROM stems WHERE word = 'whst') GROUP BY 1, 2)
      SELECT doc_id, string_agg(x, ' ... ' ORDER BY part) AS snippet FROM r GROUP BY 1""",
)
def _(t: Tables):
    hits = S.match(_documents(t), "doc_id", required=["whst"])
    return S.snippets(hits, t.documents, "doc_id", "text", length=240)


def _query_vector(n: int = 64) -> list[float]:
    return [((i * 37) % 11 - 5) / 5 for i in range(n)]


_Q = "[" + ", ".join(map(str, _query_vector())) + "]"
_COSINE = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[]))"


@query("vector_topk", ("vectors",), f"SELECT message_id, round({_COSINE}, 6) AS score FROM vectors WHERE guild_id IN (1, 2) ORDER BY {_COSINE} DESC, message_id LIMIT 20")
def _(t: Tables):
    near = S.vector_topk(t.vectors, _query_vector(), k=20, where=F.col("guild_id").isin(1, 2))
    return near.select("message_id", F.round("score", 6).alias("score"))


@query(
    "vector_topk_batch", ("vectors",),
    """SELECT query_id, message_id, rank FROM (SELECT q.message_id AS query_id, v.message_id, CAST(row_number() OVER (PARTITION BY q.message_id
      ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, v.message_id) AS INT) AS rank
      FROM vectors v CROSS JOIN (SELECT * FROM vectors WHERE message_id % 50 = 0) q) WHERE rank <= 5""",
)
def _(t: Tables):
    queries = t.vectors.filter("message_id % 50 = 0").select(F.col("message_id").alias("query_id"), F.col("embedding").alias("query"))
    return S.vector_topk_batch(t.vectors, queries, k=5).select("query_id", "message_id", "rank")


def _stamp(t: Tables, table: str, *more: object) -> str:
    """A name for what is derived from a table's files: another one once they change."""
    files = [t.spark._jvm.org.apache.hadoop.fs.Path(f) for f in sorted(getattr(t, table).inputFiles())]
    status = [f.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(f) for f in files]
    return hashlib.sha256(repr([table, *more, *((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in status)]).encode()).hexdigest()[:32]


def _vector_index(t: Tables) -> str:
    make = lambda at: vectorindex.build(t.vectors, at, filters=("guild_id", "tag"))
    return kept_at(t.spark, f"vectors2-{_stamp(t, 'vectors')}", make, lambda at: bool(children(t.spark, f"{at}/book")))


@query("vector_ann", ("vectors",))
def _(t: Tables):
    asked = t.spark.createDataFrame([(0, _query_vector())], "query_id long, query array<double>")
    found = vectorindex.search(t.spark, _vector_index(t), asked, k=10)
    return found.select(F.col("id").alias("message_id"), F.round("score", 6).alias("score"))


@query("vector_ann_recall", ("vectors",), "SELECT unnest(['all', 'filtered']) AS searched, true AS enough, (SELECT count(*) FROM vectors WHERE message_id % 50 = 0) AS n_queries")
def _(t: Tables):
    """Whether nearly all true neighbours of every fiftieth vector are found, among all rows and among those of one guild."""
    asked = t.vectors.filter("message_id % 50 = 0").select(F.col("message_id").alias("query_id"), F.col("embedding").alias("query"))
    out = []
    for name, where in (("all", F.lit(True)), ("filtered", F.col("guild_id") == 2)):
        true = S.vector_topk_batch(t.vectors.filter(where), asked, k=10).select("query_id", F.col("message_id").alias("id"))
        found = vectorindex.search(t.spark, _vector_index(t), asked, k=10, where=None if name == "all" else where).select("query_id", "id", F.lit(1).alias("hit"))
        both = true.join(found, ["query_id", "id"], "left").agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.95).alias("enough"), F.count_distinct("query_id").alias("n_queries"))
        out.append(both.select(F.lit(name).alias("searched"), "enough", "n_queries"))
    return out[0].unionAll(out[1])


_LEX = _MESSAGES + f", lex AS (SELECT message_id, {_SCORE.format(n=1)} AS lex FROM ix WHERE term = (SELECT term FROM stems WHERE word = 'whst') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)"


@query(
    "hybrid_search", ("messages", "vectors"),
    _LEX + f""", sem AS (SELECT message_id * 1000 AS message_id, round({_COSINE}, 6) AS sem FROM vectors ORDER BY {_COSINE} DESC, vectors.message_id LIMIT 50)
    SELECT m.message_id, round(0.5 * coalesce(lex, 0) + 0.5 * coalesce(sem, 0), 6) AS score, m.author_id FROM lex FULL JOIN sem ON lex.message_id = sem.message_id
    JOIN messages m ON m.message_id = coalesce(lex.message_id, sem.message_id)""",
)
def _(t: Tables):
    index = _index(t, "messages", "message_id", "plain_text")
    hits = S.match(index, "message_id", required=["whst"]).select("message_id", F.round("score", 6).alias("score"))
    near = S.vector_topk(t.vectors, _query_vector(), k=50).select((F.col("message_id") * 1000).alias("message_id"), F.round("score", 6).alias("score"))
    both = S.hybrid(S.top(hits, "message_id", 50), near, t.messages.select("message_id", "author_id"))
    return both.select("message_id", F.round("score", 6).alias("score"), "author_id")


@query("filtered_search", ("messages",), _MESSAGES + " SELECT m.message_id FROM messages m JOIN ix ON ix.message_id = m.message_id WHERE term = (SELECT term FROM stems WHERE word = 'whst') AND guild_id = 1 AND author_id = 9")
def _(t: Tables):
    kept = t.messages.filter(filters.conjunctive(guild_id=1, author_id=9)).select("message_id")
    return S.match(_index(t, "messages", "message_id", "plain_text"), "message_id", required=["whst"]).select("message_id").join(kept, "message_id", "left_semi")
