"""Full-text, vector and hybrid search.

Text is indexed as postings: one row for each term of a message with its positions.  A term is a
lower-case run of letters and digits, without stop words, reduced by the English stemmer; words are
stemmed once each, as a table of distinct words, by SQL; Python gathers places by word, a batch of messages at a time.  What a search
asks for goes through the same rules.  The rank of a message sums, over the matched query terms, 1/(i+1)^2 for
the i-th occurrence, and divides by the number of query terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import snippet_words
from ..sources.shared import planned_bytes, stored
from .stem import stemmed

#: English words that are not indexed.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can "
    "will just don should now".split()
)
#: Bytes of a stored table of words up to which it is sent to all tasks; a larger one is joined by a shuffle.
SENT_BYTES = 16 << 20
#: Parts of the ids: a term that is everywhere is not gathered and written by one task.
WRITERS = 8
#: Vectors of a block: rows, and queries.
ROW_BLOCK, QUERY_BLOCK = 8_192, 1_024
#: Queries of a block whose scores a task holds at once: with all rows of a block, 4 MB.
QUERIES_AT_ONCE = 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def blocks(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Postings of words as they stand in the tables' batches: ``word``, ``_writer``, its ``ids``, how often each has it (``tfs``), and the ``pos`` of all.

    Words are cut and lowered natively; what a batch of messages holds of a word (and a part of the ids) is one row, so
    occurrences are never rows of their own.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(STOP_WORDS)
        for batch in batches:
            ids, writer, lists = batch.columns
            coded = lists.flatten().dictionary_encode()
            vocabulary, codes = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
            n = np.asarray(lists.value_lengths()).astype(np.int64)
            owner, pos = np.repeat(np.arange(len(n)), n), np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
            kept = ~np.asarray(pc.is_in(vocabulary, value_set=stop).to_numpy(zero_copy_only=False), bool)[codes]
            codes, owner, pos = codes[kept], owner[kept], pos[kept]
            if not len(codes):
                continue
            key = (codes * WRITERS + np.asarray(writer)[owner]) * len(n) + owner
            order = np.argsort(key, kind="stable")
            key, pos = key[order], pos[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            posting = key[first]
            word = posting // len(n)
            row = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            word = word[row]
            ends = np.r_[row, len(first)]
            yield pa.RecordBatch.from_arrays(
                [
                    vocabulary.take(pa.array(word // WRITERS)), pa.array(word % WRITERS, pa.int32()), _lists(ends, ids.take(pa.array(posting % len(n)))),
                    _lists(ends, pa.array(np.diff(np.r_[first, len(pos)]), pa.int32())), _lists(np.r_[first, len(pos)][ends], pa.array(pos, pa.int32())),
                ],
                names=["word", "_writer", "ids", "tfs", "pos"],
            )

    rows = messages.select(id_col, F.pmod(F.xxhash64(id_col), F.lit(WRITERS)).cast("int").alias("_writer"), words(F.col(text_col)).alias("ws"))
    return rows.mapInArrow(block, f"word string, _writer int, ids array<{messages.schema[id_col].dataType.simpleString()}>, tfs array<int>, pos array<int>")


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def termed(held: DataFrame) -> DataFrame:
    """Stored blocks with ``term`` in the place of ``word``; writes the table of distinct words (``stems_at``)."""
    known = stored(stemmed(held.select("word").distinct()), "stems")
    # which side may be sent is not left to the optimizer; a hash of the distinct words needs no sort of the blocks
    out = held.join(F.broadcast(known) if planned_bytes(known) <= SENT_BYTES else known.hint("shuffle_hash"), "word").drop("word")
    out.stems_at = known.stored_at
    return out


def gathered(rows: DataFrame, keys: str) -> DataFrame:
    """Blocks that stand in the order of ``keys`` in a task as one block a key, ``ids`` and their ``places``; words of one term meet here.

    A task holds the postings of one term of one of the ``WRITERS`` parts of ids.
    """
    names = [k.split()[0] for k in keys.split(", ")]

    def one(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, tfs, places = (table[c].combine_chunks() for c in ("ids", "tfs", "pos"))
        n = np.asarray(ids.value_lengths()).astype(np.int64)
        group = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, table.num_rows])), n)
        coded = ids.flatten().dictionary_encode(null_encoding="encode")
        who = np.asarray(coded.indices).astype(np.int64)
        key = np.repeat(group * len(coded.dictionary) + who, np.asarray(tfs.flatten()))
        pos = np.asarray(places.flatten())
        order = np.argsort(key, kind="stable")
        key, pos = key[order], pos[order]
        if ((key[1:] == key[:-1]) & (pos[1:] < pos[:-1])).any():
            pos = pos[np.lexsort((pos, key))]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        posting = key[first]
        row = np.searchsorted(posting // len(coded.dictionary), np.arange(len(starts)))
        ends = np.r_[row, len(first)]
        nested = _lists(ends, coded.dictionary.take(pa.array(posting % len(coded.dictionary)))), _lists(ends, _lists(np.r_[first, len(pos)], pa.array(pos, pa.int32())))
        return pa.RecordBatch.from_arrays([*(table[k].combine_chunks().take(pa.array(starts)) for k in names), *nested], names=[*names, "ids", "places"])

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in names:
            codes = np.asarray(table[k].combine_chunks().dictionary_encode().indices)
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of a key that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = begins(pa.Table.from_batches([batch]))
            if held and len(starts) == 1 and all(held[-1][k][0].as_py() == batch[k][0].as_py() for k in names):
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch])
            starts = begins(table)
            cut = int(starts[-1])
            if cut:
                yield one(table.slice(0, cut), starts[:-1])
            held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield one(table, begins(table))

    return rows.select(*names, "ids", "tfs", "pos").mapInArrow(merge, f"{keys}, ids {rows.schema['ids'].dataType.simpleString()}, places array<array<int>>")


def listed(rows: DataFrame, id_col: str) -> DataFrame:
    """Blocks as postings: a row for each term and id, with ``tf`` and ``positions``."""
    others = [c for c in rows.columns if c not in ("ids", "places")]
    each = rows.select(*others, F.inline(F.arrays_zip("ids", "places")).alias(id_col, "positions"))
    return each.select("term", id_col, F.size("positions").cast("long").alias("tf"), "positions", *(c for c in others if c != "term"))


def postings(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``term``, the id, ``tf`` and the sorted ``positions``."""
    dealt = termed(stored(blocks(messages, id_col, text_col), "blocks")).repartition("term", "_writer").sortWithinPartitions("term", "_writer")
    return listed(gathered(dealt, "term string, _writer int"), id_col).drop("_writer")


#: An asked text's terms, each with its place among the text's words.
Asked = list[tuple[str, int]]


def analysed(spark: SparkSession, texts: Sequence[str]) -> list[Asked]:
    """Asked texts by the index's own rules; one of stop words alone has no terms."""
    if not texts:
        return []
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    each = rows.select("k", F.posexplode(words(F.col("text"))).alias("pos", "word")).filter(~F.col("word").isin(*STOP_WORDS))
    found = stemmed(each).select("k", "term", "pos").collect()
    out: list[Asked] = [[] for _ in texts]
    for k, term, pos in sorted(found, key=lambda r: r["pos"]):
        out[k].append((term, pos))
    return out


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _there(asked: Asked) -> Column:
    """Whether a message has an asked text: its term, or its terms at the same distances."""
    (term, first), *rest = asked
    if not rest:
        return F.array_contains("terms", term)
    starts = F.element_at("places", term)
    for other, pos in rest:
        starts = F.array_intersect(starts, _moved(F.element_at("places", other), pos - first))
    return F.coalesce(F.size(starts) > 0, F.lit(False))


def match(
    index: DataFrame, id_col: str, *, required: Sequence[str] = (), any_of: Sequence[str | Sequence[str]] = (), excluded: Sequence[str] = (),
    phrases: Sequence[str | Sequence[str]] = (),
) -> DataFrame:
    """Messages with all required texts and phrases, one of each group of ``any_of`` and no excluded text, with ``score``.

    Texts are as users type them: a word in any case and form; several words are a phrase, whose stop words keep their
    places.  ``any_of`` is one group of texts, or a list of groups.  Texts of stop words alone are left out; if nothing is left to find,
    nothing is found.  One pass over the few terms asked for: of a stored index only their buckets are read.
    """
    groups = [list(any_of)] if any(isinstance(x, str) for x in any_of) else [list(g) for g in any_of]
    if not required and not phrases and not any(groups):
        raise ValueError("a search needs a term to find")
    texts = [*required, *(p if isinstance(p, str) else " ".join(p) for p in phrases)]
    flat = [*texts, *(x for g in groups for x in g), *excluded]
    known = iter(analysed(index.sparkSession, flat))
    must = [a for a in (next(known) for _ in texts) if a]
    some = [[a for a in (next(known) for _ in g) if a] for g in groups]
    without = [a for a in (next(known) for _ in excluded) if a]
    some = [g for g in some if g]
    wanted = [*dict.fromkeys(t for a in (*must, *(a for g in some for a in g)) for t, _ in a)]
    terms = [*dict.fromkeys([*wanted, *(t for a in without for t, _ in a)])]
    hits = index.filter(F.col("term").isin(*terms)) if wanted else index.filter(F.lit(False))
    if "bucket" in index.columns:
        hits = hits.filter(F.col("bucket").isin(*[bucket_of(F.lit(t), index.buckets) for t in terms]))
    per_term = F.aggregate(F.sequence(F.lit(1), F.col("tf").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / (i * i))
    found = hits.groupBy(id_col).agg(
        F.collect_set("term").alias("terms"),
        F.sum(F.when(F.col("term").isin(*wanted), per_term)).alias("total"),
        F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"),
    )
    keep = F.lit(True)
    for asked in must:
        keep &= _there(asked)
    for group in some:
        one = F.lit(False)
        for asked in group:
            one |= _there(asked)
        keep &= one
    for asked in without:
        keep &= ~_there(asked)
    return found.filter(keep).select(id_col, (F.col("total") / max(len(wanted), 1)).alias("score"), "places")


def bucket_of(term: Column, buckets: int) -> Column:
    """The bucket of a stored index that holds a term."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def top(hits: DataFrame, id_col: str, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), id_col).limit(k)


def snippets(hits: DataFrame, messages: DataFrame, id_col: str, text_col: str, *, length: int = 240) -> DataFrame:
    """Up to two fragments around a hit's first places, with the hit words marked."""
    span = snippet_words(length)
    places = F.array_sort(F.array_distinct(F.flatten(F.map_values("places"))))
    begin = lambda at: F.greatest(at - span // 2, F.lit(0))
    first, second = F.get("places", F.lit(0)), F.get(F.filter("places", lambda p: p >= F.get("places", F.lit(0)) + span), F.lit(0))
    near = hits.select(id_col, places.alias("places")).select(id_col, "places", begin(first).alias("_first"), begin(second).alias("_second"))
    shown = F.filter("places", lambda p: (p < F.col("_first") + span) | ((p >= F.col("_second")) & (p < F.col("_second") + span)))
    # the hits' few places are hashed; texts meet them as they are, unsorted, and are cut into words afterwards
    near = near.select(id_col, shown.alias("places"), "_first", F.when(second.isNotNull(), F.col("_second")).alias("_second"))
    rows = messages.select(id_col, F.col(text_col).alias("_text")).join(near.hint("shuffle_hash"), id_col).withColumn("ws", words(F.col("_text")))

    def fragment(at: Column) -> Column:
        marked = F.transform(
            F.slice("ws", at + 1, F.lit(span)),
            lambda w, i: F.when(F.array_contains("places", at + i), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w),
        )
        return F.array_join(marked, " ")

    first, second = F.col("_first"), F.col("_second")
    return rows.select(id_col, F.concat_ws(" ... ", fragment(first), F.when(second.isNotNull(), fragment(second))).alias("snippet"))


def with_norm(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.withColumn("norm", F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(vectors: DataFrame, query: Sequence[float], *, k: int, where: Column | None = None) -> DataFrame:
    """Exact cosine scores, best first; a zero vector scores 0; ties by id.

    A top-k plan: every task keeps its k best, and only those reach the last merge.
    """
    if not query or k < 0:
        raise ValueError("a query vector and k >= 0 are needed")
    own = sum(x * x for x in query) ** 0.5
    rows = with_norm(vectors if where is None else vectors.filter(where))
    size = F.when(F.size("embedding") == len(query), F.lit(True)).otherwise(F.raise_error(F.lit("vector length differs from the query's")).cast("boolean"))
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.when((F.col("norm") == 0) | F.lit(own == 0), 0.0).otherwise(dot(F.col("embedding"), q) / (F.col("norm") * F.lit(own or 1.0)))
    return rows.filter(size).withColumn("score", score).orderBy(F.desc("score"), "message_id").limit(k)


def packed(rows: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """Vectors in blocks: ``ids``, the unit vectors as one array of doubles, and ``n`` of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                data = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                size = np.sqrt(np.einsum("ij,ij->i", data, data))[:, None]
                unit = np.divide(data, size, out=np.zeros_like(data), where=size > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([np.asarray(part.column(0)).tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary()), pa.array([part.num_rows])], names=["ids", "unit", "n"]
                )

    typed = rows.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).filter(F.col(vector).isNotNull() & F.col(key).isNotNull())
    return typed.mapInArrow(pack, "ids binary, unit binary, n long")


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, *, k: int) -> DataFrame:
    """The k best rows of many queries (``query_id``, ``query``), exactly: ``query_id``, ``message_id``, ``score``, ``rank``.

    Rows and queries are packed into blocks, and each pair of blocks is one matrix product of which the k best a
    query are kept, so what is shuffled is k rows for each query and block of rows.  All vectors must be of one
    length; a zero vector scores 0; null vectors take no part; ties go to the smaller id.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, asked = (np.frombuffer(batch[c][i].as_buffer(), np.int64) for c in ("ids", "query_ids"))
                left, right = np.frombuffer(batch["query_unit"][i].as_buffer()).reshape(len(asked), -1), np.frombuffer(batch["unit"][i].as_buffer()).reshape(len(ids), -1)
                parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for start in range(0, len(asked), QUERIES_AT_ONCE):
                    score = left[start : start + QUERIES_AT_ONCE] @ right.T
                    least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None] - 1e-9 if len(ids) > k else np.full((len(score), 1), -np.inf)
                    near = score >= least  # with all that may tie at the bound
                    for q in range(len(score)):
                        at = np.flatnonzero(near[q])
                        # a product's last bits depend on its place in a matrix: equal rows must score alike
                        exact = (right[at] * left[start + q]).sum(axis=1)
                        first = np.lexsort((ids[at], -exact))[:k]
                        parts.append((np.full(len(first), asked[start + q]), ids[at[first]], exact[first]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["query_id", "message_id", "score"])

    if k <= 0:
        raise ValueError("k > 0 is needed")
    asked = packed(queries, "query_id", "query", QUERY_BLOCK).select(F.col("ids").alias("query_ids"), F.col("unit").alias("query_unit"))
    pairs = packed(vectors, "message_id", "embedding", ROW_BLOCK).select("ids", "unit").crossJoin(asked)
    found = pairs.mapInArrow(best, "query_id long, message_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "message_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hybrid(lexical: DataFrame | None, semantic: DataFrame | None, messages: DataFrame, *, w_lex: float = 0.5, w_sem: float = 0.5) -> DataFrame:
    """Both hit lists on their messages, scored by their weighted sum (a missing side counts 0); with one list
    its own score stands, and with none nothing is found.  Hits without a message drop out; there is no limit."""
    if lexical is None and semantic is None:
        both = messages.filter(F.lit(False)).select("message_id", F.lit(0.0).alias("score"))
    elif semantic is None:
        both = lexical.select("message_id", F.col("score").alias("score"))
    elif lexical is None:
        both = semantic.select("message_id", F.col("score").alias("score"))
    else:
        joined = lexical.select("message_id", F.col("score").alias("lex")).join(semantic.select("message_id", F.col("score").alias("sem")), "message_id", "full")
        both = joined.select("message_id", (w_lex * F.coalesce("lex", F.lit(0.0)) + w_sem * F.coalesce("sem", F.lit(0.0))).alias("score"))
    return both.join(messages, "message_id").orderBy(F.desc("score"), "message_id")
