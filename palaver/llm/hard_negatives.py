"""Hard-negative mining by inner product over an STR-packed R-tree.

Vectors are made integers (``floor(scale * x)``), so that every score is exact.  The tree is packed
by sort-tile-recursive: rows are cut by ranges of label, leading coordinate and id into slabs of
bounded size, each slab is tiled along its widest coordinates into pages, and pages are gathered
``FANOUT`` at a time, in their order, under the nodes above.  A node's minimum bounding box gives, for
every coordinate, the interval of its product with an anchor's, and so the interval of the
score; the label is one more side of the box.  An anchor's search takes nodes from a priority
queue, highest possible score first.  Nodes that hold no wanted label or lie outside the score's
window are never put in it, and the search ends where the best node left is strictly below the
k-th score found (one that could tie is still opened: ties go to the smaller id).

Two searches are made: for an anchor's positives, among the slabs that hold its label, and then for
each positive's negatives inside the window that the positive's score sets.  Each gives the ``k``
best of every slab, of which the best are kept.

Scale: the index is a stored table of pages.  Its slabs are cut by ranges that end in the id, so a
label or a vector that a third of the rows share is spread like any other.  A task holds one slab and
the anchors stream past it; a slab is repeated only for each ``ANCHOR_PART`` anchors.  Nothing is
collected or broadcast but two numbers for each coordinate.

Edge cases: rows without id or label, and vectors that are null or hold null or non-finite
components, take no part, nor do vectors with a component so large that a score may leave the 53 bits in which
sums are exact; empty vectors score 0, and shorter vectors count as if zeros followed; an anchor is no
candidate of itself, nor is a row that repeats its id; an anchor's id that repeats is searched once, by its
smallest label and vector; other repeated rows count as rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import discard, store
from .words import settle

#: Rows of a page (a leaf), children of a node above, and rows of a slab.
PAGE, FANOUT, SLAB = 256, 8, 8_192
#: Anchors that one copy of a slab is held against.
ANCHOR_PART = 1 << 18
#: Anchors whose intervals a task works out at once.
ANCHOR_BLOCK = 128


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, as longs; null where a component is null, not finite or too large."""
    bound = F.floor(F.sqrt(F.lit(float(1 << 53)) / F.greatest(F.size(vector), F.lit(1)))) / F.lit(float(scale)) - 1
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) <= bound, F.lit(False)))
    return F.when(fits, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers; shorter ones are filled up with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def str_pages(vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, page: int = PAGE) -> list[np.ndarray]:
    """Sort-tile-recursive: the rows of each page, in the pages' order.

    Labels come first: one with over a page of rows has pages of its own.  Rows of a label are sorted by their
    widest coordinate and cut into tiles, each of which is sorted by the next one, and so on.
    """

    def tiles(rows: np.ndarray, coordinates: list[int]) -> Iterator[np.ndarray]:
        pages = -(-len(rows) // page)
        if pages <= 1:
            yield rows
            return
        if coordinates:
            rows = rows[np.lexsort((ids[rows], vectors[rows, coordinates[0]]))]
        cuts = math.ceil(pages ** (1 / len(coordinates))) if coordinates else pages
        step = -(-pages // cuts) * page
        for start in range(0, len(rows), step):
            yield from tiles(rows[start : start + step], coordinates[1:])

    order = np.lexsort((ids, labels))
    runs = np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(order) else []
    out: list[np.ndarray] = []
    small: list[np.ndarray] = []
    for run in [*runs, None]:
        if small and (run is None or len(run) > page or sum(map(len, small)) + len(run) > page):
            out.append(np.concatenate(small))
            small = []
        if run is not None and len(run) > page:
            wide = np.argsort(-vectors[run].var(axis=0), kind="stable")
            out += tiles(run, wide[: math.ceil(math.log2(-(-len(run) // page)))].tolist())
        elif run is not None:
            small.append(run)
    return out


class RTree:
    """Pages and the nodes above them: boxes, label ranges and children, the root last."""

    def __init__(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lows: np.ndarray, highs: np.ndarray):
        self.pages = pages  # ids, labels, vectors
        boxes = [(lows, highs, np.array([p[1].min() for p in pages]), np.array([p[1].max() for p in pages]))]
        self.children: list[range] = [range(0)] * len(pages)
        first = 0
        while len(boxes[-1][0]) > 1:
            lo, hi, least, most = boxes[-1]
            starts = np.arange(0, len(lo), FANOUT)
            self.children += [range(first + s, first + min(s + FANOUT, len(lo))) for s in starts.tolist()]
            first += len(lo)
            boxes.append((np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)))
        self.lo, self.hi = (np.concatenate([b[k] for b in boxes]) for k in (0, 1))
        self.least, self.most = (np.concatenate([b[k] for b in boxes]).tolist() for k in (2, 3))

    def intervals(self, anchors: np.ndarray) -> tuple[list[list[float]], list[list[float]]]:
        """The lowest and highest score that each box allows, by anchor: sums of the coordinates' intervals."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return (up @ self.lo.T + down @ self.hi.T).tolist(), (up @ self.hi.T + down @ self.lo.T).tolist()

    def search(self, anchor: np.ndarray, own: int, label: int, same: bool, k: int, lower: list[float], upper: list[float], low: float, high: float, seen: dict) -> list[tuple[int, int]]:
        """The ``k`` best (score, id) between ``low`` and ``high`` of the anchor's label (or of the others), best first.

        ``lower`` and ``upper`` are the anchor's intervals; ``seen`` keeps the pages' scores between its searches.
        """
        root = len(self.children) - 1
        queue = [(-min(upper[root], high), root)] if upper[root] >= low and lower[root] <= high else []
        found: list[tuple[int, int]] = []  # (-score, id)
        while queue:
            bound, node = heapq.heappop(queue)
            if len(found) == k and bound > found[-1][0]:
                break
            if self.children[node]:
                for child in self.children[node]:
                    there = self.least[child] <= label <= self.most[child] if same else not self.least[child] == label == self.most[child]
                    if there and upper[child] >= low and lower[child] <= high:
                        heapq.heappush(queue, (-min(upper[child], high), child))
                continue
            ids, labels, vectors = self.pages[node]
            scores = seen.get(node)
            if scores is None:
                scores = seen[node] = vectors @ anchor
            least = max(low, -found[-1][0]) if len(found) == k else low
            rows = np.flatnonzero((scores >= least) & (scores <= high))
            if len(rows):
                rows = rows[((labels[rows] == label) == same) & (ids[rows] != own)]
                if len(rows) > k:
                    rows = rows[np.lexsort((ids[rows], -scores[rows]))[:k]]
                found = sorted([*found, *zip((-scores[rows]).astype(np.int64).tolist(), ids[rows].tolist(), strict=True)])[:k]
        return [(-s, i) for s, i in found]


def build_index(rows: DataFrame) -> DataFrame:
    """The stored pages of the columns ``id``, ``label``, ``vector`` (longs): ``slab``, ``page``, ``own_labels`` and the
    page's ``ids``, ``labels``, ``vectors``, ``lo`` and ``hi`` as bytes of longs."""
    rows = store(rows, "vectors")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over a task's rows, and squares', by coordinate."""
        total = np.zeros((2, 0))
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            dim = max(total.shape[1], int(np.diff(np.asarray(batch.column(0).offsets)).max()))
            total = np.pad(total, ((0, 0), (0, dim - total.shape[1])))
            own = _matrix(batch.column(0), dim)
            total += [own.sum(axis=0), (own * own).sum(axis=0)]
            n += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(total.shape[1])]), pa.array(np.r_[float(n), total[0]]), pa.array(np.r_[0.0, total[1]])], names=["c", "s", "ss"])

    sums = rows.select("vector").mapInArrow(spread, "c long, s double, ss double").groupBy("c").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()
    by = {r["c"]: r for r in sums}
    n = int(by[-1]["s"]) if -1 in by else 0
    dim = max(by, default=-1) + 1
    lead = max(range(dim), key=lambda c: (by[c]["ss"] - by[c]["s"] ** 2 / n, -c), default=0)
    dealt = rows.repartitionByRange(max(1, -(-n // SLAB)), "label", F.coalesce(F.get("vector", F.lit(lead)), F.lit(0)), "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        slab = TaskContext.get().partitionId()
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, labels, vectors = np.asarray(table.column(0)), np.asarray(table.column(1), np.int64), _matrix(table.column(2), dim)
        for k, page in enumerate(str_pages(vectors, labels, ids)):
            own = vectors[page].astype(np.int64)
            cells = [ids[page], labels[page], own, own.min(axis=0), own.max(axis=0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([slab]), pa.array([k]), pa.array([np.unique(labels[page]).tolist()], pa.list_(pa.int64())), *(pa.array([c.tobytes()], pa.binary()) for c in cells)],
                names=["slab", "page", "own_labels", "ids", "labels", "vectors", "lo", "hi"],
            )
        settle()

    schema = "slab long, page long, own_labels array<long>, ids binary, labels binary, vectors binary, lo binary, hi binary"
    index = store(dealt.select("id", "label", "vector").mapInArrow(pack, schema), "pages")
    discard(rows)
    index.dim = dim
    return index


_TASK = "ids", "labels", "vectors", "lo", "hi"


def _held_against(index: DataFrame, asked: DataFrame, parts: int, find, schema: str) -> DataFrame:
    """Runs ``find(tree, anchors)`` for each slab and the anchors (``slab``, ``anchor_id``, ``label``, ``vector``, ``targets``) sent
    to it: a slab's pages come first, then its anchors, which stream by."""
    dim = index.dim
    no = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    pages = index.select("slab", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "page", *_TASK, *no("long", "anchor_id", "label"), *no("array<long>", "vector", "targets"))
    part = F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int").alias("part")
    sent = asked.select("slab", part, F.lit(1 << 62).alias("page"), *no("binary", *_TASK), "anchor_id", "label", "vector", "targets")
    rows = pages.unionAll(sent).repartition("slab", "part").sortWithinPartitions("slab", "part", "page", "anchor_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, None
        pages: list[tuple] = []
        for batch in batches:
            slabs, own_parts, kinds = (np.asarray(batch.column(k)) for k in (0, 1, 2))
            is_page = kinds < 1 << 62
            cuts = np.flatnonzero((np.diff(slabs) != 0) | (np.diff(own_parts) != 0) | (np.diff(is_page.astype(int)) != 0)) + 1
            for start, stop in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(slabs)].tolist(), strict=True):
                if start == stop:
                    continue
                if key != (here := (slabs[start], own_parts[start])):
                    key, tree, pages = here, None, []
                if is_page[start]:
                    for row in batch.slice(start, stop - start).select(_TASK).to_pylist():
                        pages.append(tuple(np.frombuffer(row[c], np.int64) for c in _TASK))
                    continue
                if not pages:
                    continue
                if tree is None:
                    leaves = [(ids, labels, v.reshape(-1, dim).astype(np.float64)) for ids, labels, v, _, _ in pages]
                    tree = RTree(leaves, *(np.array([p[k] for p in pages], np.float64).reshape(-1, dim) for k in (3, 4)))
                for first in range(start, stop, ANCHOR_BLOCK):
                    part = batch.slice(first, min(ANCHOR_BLOCK, stop - first))
                    vectors = _matrix(part.column("vector"), dim)
                    lower, upper = tree.intervals(vectors)
                    asked = zip(np.asarray(part.column("anchor_id")).tolist(), np.asarray(part.column("label")).tolist(), vectors, part.column("targets").to_pylist(), lower, upper, strict=True)
                    found = [row for anchor in asked for row in find(tree, *anchor)]
                    columns = list(zip(*found, strict=True)) or [()] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
        settle()

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def _first(df: DataFrame, keys: list[str], score: str, identity: str, k: int, name: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), identity))
    return df.withColumn(name, place).filter(F.col(name) <= k)


def mine(
    rows: DataFrame, anchors: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other
    labels whose score is from ``low`` to ``high`` percent of the positive's.

    Returns ``anchor_id``, ``positive_id``, ``positive_rank``, ``rank`` (of the negative), ``negative_id``, ``positive_score``, ``negative_score``.
    """

    def pick(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("vector"))
        return own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())

    index = build_index(pick(rows))
    once = pick(anchors).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("own"))
    once = store(once.select(F.col("id").alias("anchor_id"), "own.label", "own.vector"), "anchors")
    parts = max(1, -(-once.count() // ANCHOR_PART))
    slabs = index.agg(F.max("slab")).first()[0]
    if slabs is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long")

    def same_label(tree: RTree, own: int, label: int, vector: np.ndarray, targets: None, lower: list, upper: list) -> Iterator[tuple]:
        for score, i in tree.search(vector, own, label, True, positives, lower, upper, -math.inf, math.inf, {}):
            yield own, i, score

    def in_windows(tree: RTree, own: int, label: int, vector: np.ndarray, targets: list[int], lower: list, upper: list) -> Iterator[tuple]:
        seen: dict = {}
        for place, score in enumerate(targets):
            least, most = -(-low * score // 100), high * score // 100
            for negative, i in tree.search(vector, own, label, False, negatives, lower, upper, least, most, seen) if least <= most else ():
                yield own, place, i, negative

    holding = index.select("slab", F.explode("own_labels").alias("label")).distinct()
    asked = once.join(holding, "label").withColumn("targets", F.lit(None).cast("array<long>"))
    near = _held_against(index, asked, parts, same_label, "anchor_id long, positive_id long, positive_score long")
    near = store(_first(near, ["anchor_id"], "positive_score", "positive_id", positives, "positive_rank"), "positives")
    targets = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_score")))["positive_score"].alias("targets"))
    asked = once.join(targets, "anchor_id").withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs).cast("long"))))
    found = _held_against(index, asked, parts, in_windows, "anchor_id long, place long, negative_id long, negative_score long")
    found = _first(found, ["anchor_id", "place"], "negative_score", "negative_id", negatives, "rank")
    found = found.withColumn("positive_rank", (F.col("place") + 1).cast("int")).join(near, ["anchor_id", "positive_rank"])
    return found.select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Anchors: the rows whose id is divisible by 100; labels of ids divisible by 7 are moved on by one, modulo 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select("vec_id", label.alias("label"), "embedding")
    return mine(rows, rows.filter(F.col("vec_id") % 100 == 0)).drop("positive_rank")
