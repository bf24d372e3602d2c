"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted by spherical k-means, level by level, on a bounded sample; every row is then
indexed under a leaf.  A query walks the tree with a priority queue, best centroid first, and so
gets the leaves in the order of their promise.  How many leaves to visit is calibrated: the true
neighbours, among all rows, of a fixed number of calibration vectors are found by brute force in
blocks, and the visits are widened until the wanted share of them lies in visited leaves.
Candidates are scored exactly, in double precision, on the original vectors.

Scale: the tree and the calibration are bounded by parameters.  Vectors are dealt out by leaf and,
within a leaf, by blocks of bounded size, so that a leaf (or a vector that a third of the rows
share) is spread over many tasks; a query goes to each block of the leaves that it visits, and
where queries are many they are cut into parts of bounded size that meet the blocks one by one.
As the tree's size is bounded, the share of the rows that a query is held against depends on the
data and not on their number: few leaves where vectors lie in clusters, most of them where they do not.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do rows without an id or with another length than most vectors have; ties go to the smaller id;
a query row is no candidate of itself, nor is a row that repeats its id; repeated candidate rows
count as rows; a query id that repeats is searched once, with its smallest vector; with no more
rows than asked for, all are returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import store

#: Numbers in the sample that the tree is fitted on (vectors times their length).
SAMPLE_NUMBERS = 1 << 20
#: Children of a node, and the sample's vectors below which a node is a leaf.
BRANCHES, LEAF_SAMPLE = 8, 48
#: Calibration vectors, and the share of their true neighbours that the visited leaves must hold.
CALIBRATION, RECALL = 256, 0.96
#: Vectors of a leaf that one task scores at once, and the queries that it scores them for.
BLOCK, QUERY_BLOCK = 8192, 32_768


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Tree:
    """Nodes from the root (0) on: unit centroids, children, and leaf numbers (-1: none)."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    visits: int = 1
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the nearest centroids."""
        out = np.zeros(len(vectors), np.int64)
        pending = [(0, np.arange(len(vectors)))]
        while pending:
            node, rows = pending.pop()
            if not len(rows):
                continue
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            best = (vectors[rows] @ self.centroids[kids].T).argmax(axis=1)
            pending += [(kid, rows[best == k]) for k, kid in enumerate(kids)]
        return out

    def leaves_by_promise(self, query: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield int(self.leaf[node])
                continue
            for kid, near in zip(kids, self.centroids[kids] @ query, strict=True):
                heapq.heappush(queue, (-float(near), kid))

    def visit(self, query: np.ndarray, k: int) -> list[int]:
        """The leaves a query visits: the calibrated number, and more until they hold over k rows."""
        out, rows = [], 0
        for leaf in self.leaves_by_promise(query):
            if len(out) >= self.visits and rows > k:
                break
            out.append(leaf)
            rows += self.sizes[leaf]
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def fit_tree(sample: np.ndarray, *, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE, rounds: int = 8) -> Tree:
    """Hierarchical spherical k-means over unit vectors."""
    rng = np.random.default_rng(7)
    centroids, children = [sample.mean(axis=0)], [[]]
    pending = [(0, np.arange(len(sample)))]
    while pending:
        node, rows = pending.pop()
        points = np.unique(sample[rows], axis=0)  # copies make no branches
        if len(rows) <= leaf_sample or len(points) < 2 * branches:
            continue
        centers = points[rng.choice(len(points), branches, replace=False)]
        for _ in range(rounds):
            own = (sample[rows] @ centers.T).argmax(axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, sample[rows])
            norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centers = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centers)
        own = (sample[rows] @ centers.T).argmax(axis=1)
        kept = [k for k in range(branches) if (own == k).any()]
        if len(kept) < 2:
            continue
        for k in kept:
            children[node].append(len(children))
            centroids.append(centers[k])
            children.append([])
            pending.append((len(children) - 1, rows[own == k]))
    leaf = np.full(len(children), -1)
    ends = [i for i, kids in enumerate(children) if not kids]
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centroids), children, leaf)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows, alike for like rows wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """For each query its k best of a block, ties to the smaller id: (query row, vector row, score)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    units = unit(vectors)
    for start in range(0, len(queries), 256):
        near = unit(queries[start : start + 256]) @ units.T
        near[query_ids[start : start + 256, None] == ids[None, :]] = -np.inf
        kth = np.partition(near, max(near.shape[1] - k, 0), axis=1)[:, max(near.shape[1] - k, 0)]
        for i in range(len(near)):
            rows = np.flatnonzero((near[i] >= kth[i] - 1e-9) & (near[i] > -np.inf))
            score = exact_cosine(np.broadcast_to(queries[start + i], (len(rows), queries.shape[1])), vectors[rows])
            order = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(order), start + i), rows[order], score[order]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def build_index(vectors: DataFrame, *, k: int = 5) -> tuple[Tree, int] | None:
    """Fits and calibrates a tree for the columns ``vec_id``, ``embedding`` of usable rows.

    Returns it with the vectors' length, or None for an empty table.
    """
    lengths = vectors.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return None
    dim, count = lengths[0]["dim"], lengths[0]["count"]
    rows = vectors.filter(F.size("embedding") == dim)
    draw = F.pmod(F.xxhash64("vec_id", F.lit("tree")), F.lit(1 << 40))
    size = max(SAMPLE_NUMBERS // dim, 4 * CALIBRATION)
    taken = rows.filter(draw < math.ceil((1 << 40) * min(1.0, size / count))).toArrow()
    if not taken.num_rows:
        taken = rows.orderBy(draw, "vec_id", "embedding").limit(size).toArrow()
    sample, ids = _matrix(taken["embedding"], dim), np.asarray(taken["vec_id"], np.int64)
    # the sample comes in no set order: in that of a hash, tree and calibration are always the same
    order = np.lexsort((*sample.T[::-1], ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    sample, ids = sample[order], ids[order]
    # the calibration vectors take no part in the fit, unless there are hardly any others
    held = CALIBRATION if len(sample) >= 2 * CALIBRATION else 0
    tree = fit_tree(unit(sample[held:]))
    probes, probe_ids = sample[:CALIBRATION], ids[:CALIBRATION]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaf sizes, and each probe's best of this task, with their leaves."""
        sizes = np.zeros(tree.n_leaves, np.int64)
        best = [np.zeros((0, 4))]
        for batch in batches:
            if not batch.num_rows:
                continue
            block, own = _matrix(batch.column("embedding"), dim), np.asarray(batch.column("vec_id"), np.int64)
            leaves = tree.assign(unit(block))
            sizes += np.bincount(leaves, minlength=tree.n_leaves)
            q, v, score = best_of_block(probes, probe_ids, block, own, k)
            rows = np.vstack([best[0], np.column_stack([q, leaves[v], score, own[v]])])
            order = np.lexsort((rows[:, 3], -rows[:, 2], rows[:, 0]))
            rows = rows[order]
            place = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
            best = [rows[place < k]]
        found = best[0]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[np.full(tree.n_leaves, -1), found[:, 0]].astype(np.int64)),
                pa.array(np.r_[np.arange(tree.n_leaves), found[:, 1]].astype(np.int64)),
                pa.array(np.r_[sizes, found[:, 2]].astype(np.float64)),
                pa.array(np.r_[np.zeros(tree.n_leaves), found[:, 3]].astype(np.int64)),
            ],
            names=["probe", "leaf", "value", "vec_id"],
        )

    measured = rows.select("vec_id", "embedding").mapInArrow(measure, "probe long, leaf long, value double, vec_id long")
    sizes = measured.filter("probe < 0").groupBy("leaf").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("value"), "vec_id"))
    true = measured.filter("probe >= 0").withColumn("place", place).filter(F.col("place") <= k)
    told = true.select("probe", "leaf", "value").unionByName(sizes.select(F.lit(-1).cast("long").alias("probe"), "leaf", "value")).collect()
    tree.sizes = np.zeros(tree.n_leaves, np.int64)
    wanted: dict[int, list[int]] = {}
    for r in told:
        if r["probe"] < 0:
            tree.sizes[r["leaf"]] = int(r["value"])
        else:
            wanted.setdefault(r["probe"], []).append(r["leaf"])
    ranks: list[int] = []
    for probe, leaves in wanted.items():
        rank = {leaf: n for n, leaf in enumerate(tree.leaves_by_promise(unit(probes[probe : probe + 1])[0]))}
        ranks += [rank[leaf] for leaf in leaves]
    tree.visits = 1 + (int(np.quantile(ranks, RECALL, method="higher")) if ranks else 0)
    return tree, dim


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest rows: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    stored_as = f"array<{kind if kind in ('float', 'double') else 'double'}>"

    def pick(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(stored_as).alias("embedding"))
        return own.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))

    vectors, queries = pick(vectors), pick(queries)
    built = build_index(vectors, k=k)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree, dim = built
    blocks = np.maximum(1, -(-tree.sizes // BLOCK))
    same = F.size("embedding") == dim
    distinct = store(queries.filter(same).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    parts = max(1, -(-distinct.count() // QUERY_BLOCK))

    def part_of(ids: np.ndarray) -> np.ndarray:
        return ((ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % parts

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = tree.assign(unit(_matrix(batch.column("embedding"), dim)))
                own = np.asarray(batch.column("vec_id"), np.int64).astype(np.uint64)
                block = ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks[leaves]
                for part in range(parts):
                    yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(block * parts + part), *batch.columns], names=["leaf", "block", "vec_id", "embedding"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit(_matrix(batch.column("embedding"), dim))
            own = part_of(np.asarray(batch.column("vec_id"), np.int64)).tolist()
            rows, leaves, places = [], [], []
            for i, query in enumerate(units):
                for leaf in tree.visit(query, k):
                    for block in range(blocks[leaf]):
                        rows.append(i)
                        leaves.append(leaf)
                        places.append(block * parts + own[i])
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(places, pa.int64()), *taken.columns], names=["leaf", "block", "vec_id", "embedding"])

    schema = f"leaf long, block long, vec_id long, embedding {stored_as}"
    indexed = vectors.filter(same).mapInArrow(index, schema)
    # the walk is the queries' work: dealt over all cores, however small their table
    visiting = distinct.repartition(vectors.sparkSession.sparkContext.defaultParallelism, "vec_id").mapInArrow(walk, schema)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = _matrix(right["embedding"], dim), _matrix(left["embedding"], dim)
        if not len(q) or not len(v):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        query_ids, ids = np.asarray(right["vec_id"], np.int64), np.asarray(left["vec_id"], np.int64)
        at, row, near = best_of_block(q, query_ids, v, ids, k)
        return pa.table({"query_id": query_ids[at], "vec_id": ids[row], "score": near})

    scored = indexed.groupBy("leaf", "block").cogroup(visiting.groupBy("leaf", "block")).applyInArrow(score, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_five(embeddings: DataFrame) -> DataFrame:
    """Queries: the rows whose id is divisible by 50; candidates: all rows."""
    return search(embeddings, embeddings.filter(F.col("vec_id") % 50 == 0), k=5)
