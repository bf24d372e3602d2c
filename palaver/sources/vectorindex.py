"""A stored approximate index of vectors by cosine: coarse lists with product-quantised codes.

Unit vectors are assigned to the nearest of the coarse centroids (a list), and what is left of them is cut into
parts, each replaced by the number of its nearest codeword.  The table is written by parts, in the order of lists, and holds id,
codes, the vector and the columns that searches filter by, each read only where it is needed.  A search

1. ranks the lists for each query and probes the first ones,
2. scores what the probed lists' codes stand for, filters first,
3. scores the best ones again, exactly, on their vectors, which are read of those lists only.

How many lists are probed and how many codes scored again is calibrated against exact search until the wanted
recall is reached.  A filter that keeps a share of the rows widens the probes by as much.

Scale: centroids and codewords are learned from a bounded sample and are all that is sent to tasks.  Codes and queries
meet as blocks of bounded size, of which a query's best codes are kept; neither are repeated by list.

Edge cases: null and zero vectors, those with null or non-finite components or of another length than most, and rows
without an id are not indexed; equal scores go to the smaller id; an empty table gives an index in which nothing is found.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.search import QUERIES_AT_ONCE, QUERY_BLOCK, WRITERS, packed, vector_topk_batch
from .shared import stored

#: Vectors that centroids and codewords are learned from; the most lists; parts of a vector; codewords of a part.
SAMPLE, MOST_LISTS, PARTS, WORDS = 16_384, 4_096, 16, 256
#: Calibration queries, and the recall that they have to reach.
CALIBRATION, RECALL = 64, 0.97
#: Codes of a block that one task scores at once, and the most parts that lists are written in.
BLOCK, MOST_PARTS = 65_536, 64


@dataclass
class Codebook:
    """Coarse centroids, codewords by part, and how a search goes about it."""

    centroids: np.ndarray
    words: np.ndarray
    dim: int
    probes: int = 1
    again: int = 64
    parts: int = 1

    def _cut(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as parts of equal length, filled up with zeros."""
        width = self.words.shape[2]
        out = np.zeros((len(vectors), len(self.words) * width), vectors.dtype)
        out[:, : vectors.shape[1]] = vectors
        return out.reshape(len(vectors), len(self.words), width)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(unit, self.centroids)
        parts = self._cut(unit - self.centroids[own])
        codes = np.stack([nearest(parts[:, j], self.words[j]) for j in range(len(self.words))], axis=1)
        return own, codes.astype(np.uint8)

    def visits(self, queries: np.ndarray, n: int) -> np.ndarray:
        """For each query which lists are among the ``n`` whose centroids are nearest to it."""
        if n >= len(self.centroids):
            return np.ones((len(queries), len(self.centroids)), bool)
        out = np.zeros((len(queries), len(self.centroids)), bool)
        far = (self.centroids * self.centroids).sum(axis=1) / 2 - queries @ self.centroids.T
        np.put_along_axis(out, np.argsort(far, axis=1, kind="stable")[:, :n], True, axis=1)
        return out

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes of lists stand for."""
        cut = np.concatenate([self.words[j][codes[:, j]] for j in range(len(self.words))], axis=1)
        return self.centroids[own] + cut[:, : self.dim]


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    half = (centers * centers).sum(axis=1) / 2
    for start in range(0, len(points), 4096):
        out[start : start + 4096] = (points[start : start + 4096] @ centers.T - half).argmax(axis=1)
    return out


def k_means(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centers of ``points``; where there are no more different ones than asked for, those."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= k:
        return distinct
    centers = distinct[np.random.default_rng(3).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = nearest(points, centers)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, column, k) for column in points.T], axis=1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def usable(vector: Column) -> Column:
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fits & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def build(vectors: DataFrame, path: str, *, id_col: str = "message_id", vector_col: str = "embedding", filters: tuple[str, ...] = ()) -> None:
    """Learns, writes and calibrates an index in a new folder; ``filters`` are the columns that searches may filter by."""
    spark = vectors.sparkSession
    good = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = good.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *filters)
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n = (sizes["dim"], sizes["n"]) if sizes else (1, 0)
    rows = rows.filter(F.size("vector") == dim)
    draw = F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 40))
    taken = rows.filter(draw < math.ceil((1 << 40) * min(1.0, SAMPLE / max(n, 1)))).select("id", "vector").orderBy(draw, "id").limit(2 * SAMPLE).toArrow().combine_chunks()
    sample = _unit(_matrix(taken["vector"].combine_chunks())) if taken.num_rows else np.zeros((1, dim)) + 1.0
    book = Codebook(k_means(sample, min(MOST_LISTS, max(1, round(math.sqrt(n))), max(1, len(sample) // 8))), np.zeros((min(PARTS, dim), 1, -(-dim // min(PARTS, dim)))), dim)
    left = book._cut(sample - book.centroids[nearest(sample, book.centroids)])
    learned = [k_means(left[:, j], WORDS) for j in range(left.shape[1])]
    book.words = np.stack([np.concatenate([w, np.repeat(w[-1:], WORDS - len(w), axis=0)]) for w in learned])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, codes = book.encode(_unit(_matrix(batch.column(1))))
                width = codes.shape[1]
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), packed, *batch.columns], names=["list", "codes", *batch.schema.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    # few files, whatever the number of lists: a list is some row groups of its part's files
    book.parts = min(MOST_PARTS, len(book.centroids), max(1, n // BLOCK))
    coded = rows.mapInArrow(encode, f"list long, codes binary, {kinds}").withColumn("part", F.pmod("list", F.lit(book.parts)).cast("int"))
    dealt = coded.repartition("part", F.pmod(F.xxhash64("id"), F.lit(WRITERS))).sortWithinPartitions("part", "list")
    dealt.write.partitionBy("part").parquet(f"{path}/rows")
    _save(spark, path, book, coded.schema.json(), overwrite=False)
    if n:
        _calibrate(spark, path, book, taken, coded.schema.json(), n)


def _save(spark: SparkSession, path: str, book: Codebook, schema: str, overwrite: bool) -> None:
    row = spark.createDataFrame([(bytearray(pickle.dumps(book)), schema)], "book binary, schema string")
    row.coalesce(1).write.mode("overwrite" if overwrite else "error").parquet(f"{path}/book")


def _open(spark: SparkSession, path: str) -> tuple[Codebook, DataFrame]:
    saved = spark.read.parquet(f"{path}/book").first()
    return pickle.loads(saved["book"]), spark.read.schema(StructType.fromJson(json.loads(saved["schema"]))).parquet(f"{path}/rows")


def _calibrate(spark: SparkSession, path: str, book: Codebook, sample: pa.Table, schema: str, n: int, k: int = 10) -> None:
    """Widens the probes, and the codes scored again, until the sample's first vectors find their true neighbours."""
    queries = spark.createDataFrame(sample.slice(0, CALIBRATION).rename_columns(["query_id", "query"]).to_pylist(), "query_id long, query array<double>")
    rows = _open(spark, path)[1].select(F.col("id").alias("message_id"), F.col("vector").alias("embedding"))
    true = stored(vector_topk_batch(rows, queries, k=k).select("query_id", F.col("message_id").alias("id")), "true_neighbours")
    total, lists = true.count(), len(book.centroids)
    book.probes, book.again = max(1, lists // 16), 8 * k
    while True:
        found = search(spark, path, queries, k=k, book=book)
        share = found.join(true, ["query_id", "id"], "left_semi").count() / max(total, 1)
        if share >= RECALL or (book.probes == lists and book.again >= n):
            break
        wide = search(spark, path, queries, k=k, book=replace(book, again=8 * book.again))
        more = wide.join(true, ["query_id", "id"], "left_semi").count() / max(total, 1)
        # where more codes scored again would help more than half of what is missing, that; else more lists
        if book.probes == lists or more - share > (1 - share) / 2:
            book.again = min(2 * book.again, max(n, 1))
        else:
            book.probes = min(2 * book.probes, lists)
    _save(spark, path, book, schema, overwrite=True)


def search(spark: SparkSession, path: str, queries: DataFrame, *, k: int, where: Column | None = None, book: Codebook | None = None) -> DataFrame:
    """Each query's (``query_id``, ``query``) approximate ``k`` nearest rows: ``query_id``, ``id``, ``score``, ``rank``.

    ``where`` is on the index's filter columns and applies before codes are scored.
    """
    known, rows = _open(spark, path)
    book = book or known
    share = 1.0 if where is None else rows.agg(F.avg(F.when(where, 1.0).otherwise(0.0))).first()[0] or 0.0
    probes = min(len(book.centroids), math.ceil(book.probes / share)) if share else 0
    depth = max(k, book.again)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    asked = asked.filter(F.col("query_id").isNotNull() & usable(F.col("query")) & (F.size("query") == book.dim))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                seen = book.visits(_unit(_matrix(batch.column(1))), probes).any(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], names=["list"])

    if probes == len(book.centroids):
        held = rows
    else:
        probed = sorted(r["list"] for r in asked.mapInArrow(visited, "list long").distinct().collect())  # as many as there are lists, at most
        held = rows.filter(F.col("part").isin(sorted({x % book.parts for x in probed})) & F.col("list").isin(probed)) if probed else rows.filter(F.lit(False))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting)
            own = np.asarray(table["list"])
            order = np.argsort(own, kind="stable")
            codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(own), -1)
            data = [own[order].tobytes(), np.asarray(table["id"])[order].tobytes(), codes[order].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], names=["lists", "ids", "codes"])

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                if sum(x.num_rows for x in waiting) + part.num_rows > BLOCK:
                    yield block()
                    waiting = []
                waiting.append(part)
        if waiting:
            yield block()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, ids, query_ids = (np.frombuffer(batch[c][i].as_buffer(), np.int64) for c in ("lists", "ids", "query_ids"))
                codes = np.frombuffer(batch["codes"][i].as_buffer(), np.uint8).reshape(len(ids), -1)
                queries = np.frombuffer(batch["query_unit"][i].as_buffer()).reshape(len(query_ids), -1)
                meant, starts = book.decode(own, codes), np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                ends = np.r_[starts[1:], len(own)]
                for at in range(0, len(queries), QUERIES_AT_ONCE):
                    some = queries[at : at + QUERIES_AT_ONCE]
                    near = np.full((len(some), len(ids)), -np.inf)
                    visits = book.visits(some, probes)[:, own[starts]]
                    for j in np.flatnonzero(visits.any(axis=0)).tolist():
                        who = np.flatnonzero(visits[:, j])
                        # a product's last bits depend on its place in a matrix: equal codes must score alike
                        near[who, starts[j] : ends[j]] = np.round(some[who] @ meant[starts[j] : ends[j]].T, 9)
                    least = np.partition(near, len(ids) - depth, axis=1)[:, len(ids) - depth] if len(ids) > depth else np.full(len(some), -np.inf)
                    out = []
                    for q in range(len(some)):
                        there = np.flatnonzero((near[q] >= least[q]) & (near[q] > -np.inf))
                        there = there[np.lexsort((ids[there], -near[q, there]))[:depth]]
                        out.append((np.full(len(there), query_ids[at + q]), own[there], ids[there], near[q, there]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "list", "id", "near"])

    blocks = (held if where is None else held.filter(where)).select("list", "id", "codes").mapInArrow(pack, "lists binary, ids binary, codes binary")
    many = packed(asked, "query_id", "query", QUERY_BLOCK).select(F.col("ids").alias("query_ids"), F.col("unit").alias("query_unit"))
    scored = blocks.crossJoin(many).mapInArrow(score, "query_id long, list long, id long, near double")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))
    some = scored.withColumn("place", first).filter(F.col("place") <= depth).select("query_id", "list", "id")
    # the vectors are read of the probed lists only
    both = some.join(held.select("list", "id", "vector"), ["list", "id"]).join(asked, "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot(F.col("vector"), F.col("query")) / (F.sqrt(dot(F.col("vector"), F.col("vector"))) * F.sqrt(dot(F.col("query"), F.col("query"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    exact = both.select("query_id", "id", cosine.alias("score"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k)
