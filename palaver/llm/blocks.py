"""Work on the members of large groups, block against block, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .tables import discard, store
from .words import settle


def in_block_pairs(members: DataFrame, keys: list[str], member: str, size: Column, block: int) -> DataFrame:
    """Cuts each group into blocks of about ``block`` members and gives every member a row for each
    pair of blocks that its own is part of (columns ``low``, ``high``, ``own``).

    ``size`` is the group's number of members.  A group of one block gets one row for each member.
    """
    n = F.ceil(size / F.lit(float(block))).cast("int")
    own = F.pmod(F.xxhash64(member), n).cast("int")
    marked = members.withColumns({"__n": n, "own": own})
    spread = marked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return spread.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("__n", "other")


def dealt(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of a key in one partition, one after another."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or []))


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int, rows: int = 20_000, size: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Cuts batches that are in the order of their first ``n_keys`` columns into chunks of whole
    groups, of about ``rows`` rows or ``size`` bytes or one group: each chunk, and the bounds of its groups."""
    held: list[pa.RecordBatch] = []
    n_held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n_held += batch.num_rows
        if n_held < rows and sum(b.nbytes for b in held) < size:
            continue
        chunk, bounds = _cut(held, n_keys)
        if len(bounds) > 2:
            yield chunk.slice(0, bounds[-2]), bounds[:-1]
            chunk = chunk.slice(bounds[-2])
        held, n_held = [chunk], chunk.num_rows
        rows = max(rows, 2 * n_held) if len(bounds) == 2 else rows
    if held:
        yield _cut(held, n_keys)
    settle()


def _cut(held: list[pa.RecordBatch], n_keys: int) -> tuple[pa.RecordBatch, np.ndarray]:
    chunk = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    change = np.zeros(chunk.num_rows - 1, bool)
    for k in range(n_keys):
        c = np.asarray(chunk.column(k))
        change |= c[1:] != c[:-1]
    return chunk, np.r_[0, np.flatnonzero(change) + 1, chunk.num_rows]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows 0 .. n-1 as stars: every linked row but the first of its component, and that first."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def star_edges(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links between rows as edges ``a``, ``b`` from each id of a component to its smallest id.

    Groups of the same members give the same edges, whatever the order of their rows.
    """
    row, root = stars(len(ids), a, b)
    least = ids.copy()
    np.minimum.at(least, root, ids[row])
    linked = np.r_[row, np.unique(root)]
    to = least[np.r_[root, np.unique(root)]]
    some = ids[linked] != to
    return pa.RecordBatch.from_arrays([pa.array(ids[linked][some], pa.int64()), pa.array(to[some], pa.int64())], names=["a", "b"])


def spanning_forest(n: int, linked) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the rows 0 .. n-1.

    ``linked(i, rows)`` tells which of ``rows`` link to row i.  Every row is held against all rows
    not yet reached, so the forest spans what all pairs would.
    """
    edges: list[tuple[int, int]] = []
    rest = np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hits = rest[linked(i, rest)]
            if len(hits):
                found = hits.tolist()
                edges += [(i, j) for j in found]
                queue += found
                rest = rest[~np.isin(rest, hits, assume_unique=True)]
    return edges


def links_across(label: np.ndarray, asking: np.ndarray, linked) -> list[tuple[int, int]]:
    """Links that join different labels: the rows ``asking`` are held against all rows of other labels."""
    label, edges = label.copy(), []
    for i in asking.tolist():
        others = np.flatnonzero(label != label[i])
        if not len(others):
            break
        hits = others[linked(i, others)]
        _, first = np.unique(label[hits], return_index=True)
        if len(first):
            edges += [(i, j) for j in hits[first].tolist()]
            label[np.isin(label, label[hits])] = label[i]
    return edges


#: Members of a large group that every block of it is held against.
PIVOTS = 4

#: What a group's task is given beside the members' own columns.
_PLACED = "group", "block", "asks", "label", "id"


def linked_components(members: DataFrame, block: int, attach: Callable[[DataFrame], DataFrame], columns: list[str], linker: Callable, chunk: dict, pairs: Callable | None = None) -> DataFrame:
    """Components (``id``, ``component``) of the links between members of the same group.

    ``members`` is a stored table of ``group``, ``id`` and ``members`` (the group's size); ``attach`` joins to rows with
    an ``id`` the ``columns`` that ``linker`` needs: given those of one group's rows as Arrow arrays, it returns the
    function ``linked(i, rows)``.  ``pairs`` tells the same of many groups of two at once: given the columns of all rows
    and the places of the firsts and of the seconds, which pairs link.  An id may be in several groups.

    Groups of more than ``block`` members are cut into blocks, each held against itself and against
    a few pivots, so that a group of near copies comes together with work in proportion to its size.
    Then only members that are still apart from the greater part of their group meet all its blocks: no
    link is left out, and where most is linked few rows are sent twice.

    Members are dealt to blocks by their ids alone; the columns are joined once, and a row is
    repeated for its blocks only after that.
    """
    n = F.ceil(F.col("members") / F.lit(float(block))).cast("long")
    own = F.pmod(F.xxhash64("id"), n)
    no_label = F.lit(None).cast("long").alias("label")
    large = members.filter(F.col("members") > block)
    some_large = not large.isEmpty()
    placed = members.select("group", F.array(own).alias("blocks"), F.lit(True).alias("asks"), no_label, "id")
    if some_large:
        by_hash = Window.partitionBy("group").orderBy(F.xxhash64("id"), "id")
        pivots = large.withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= PIVOTS)
        placed = placed.unionAll(pivots.select("group", F.sequence(F.lit(0).cast("long"), n - 1), F.lit(True), no_label, "id"))
    found = components(_linked(attach(placed), columns, linker, chunk, pairs))
    if not some_large:
        return found
    label = F.coalesce("component", large["id"])
    apart = large.join(found, "id", "left").select("group", large["id"], "members", label.alias("label"))
    sizes = apart.groupBy("group", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = store(main.filter("most < all"), "split_groups")
    if main.isEmpty():
        discard(main)
        return found
    split = apart.join(main, "group").withColumn("asks", F.col("label") != F.col("main"))
    asking = F.ceil((F.col("all") - F.col("most")) / F.lit(float(block))).cast("long")
    asked_by = F.pmod(F.xxhash64("id", F.lit(1)), asking)
    every = lambda k, at: F.transform(F.sequence(F.lit(0).cast("long"), k - 1), at).alias("blocks")
    told = split.select("group", every(asking, lambda other: other * n + own), F.lit(False).alias("asks"), "label", "id")
    asks = split.filter("asks").select("group", every(n, lambda other: asked_by * n + other), F.lit(True).alias("asks"), "label", "id")
    across = _linked(attach(told.unionAll(asks)), columns, linker, chunk)
    out = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(across))
    discard(found)
    discard(main)
    return out


def _linked(placed: DataFrame, columns: list[str], linker: Callable, chunk: dict, pairs: Callable | None = None) -> DataFrame:
    rows = dealt(placed.select("group", F.explode("blocks").alias("block"), "asks", "label", "id", *columns), ["group", "block"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in whole_groups(batches, 2, **chunk):
            ids = np.asarray(part.column(4))
            found: list[tuple[int, int]] = []
            least = 2
            if pairs is not None:
                two = bounds[:-1][np.diff(bounds) == 2]
                two = two[pairs(*part.columns[len(_PLACED) :], two, two + 1)]
                found, least = [(i, i + 1) for i in two.tolist()], 3
            for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if stop - start < least:
                    continue
                own = part.slice(start, stop - start)
                linked = linker(*own.columns[len(_PLACED) :])
                if own.column(3).null_count:
                    edges = spanning_forest(stop - start, linked)
                else:
                    edges = links_across(np.asarray(own.column(3)), np.flatnonzero(np.asarray(own.column(2))), linked)
                found += [(start + i, start + j) for i, j in edges]
            links = np.array(found, np.int64).reshape(-1, 2)
            yield star_edges(ids, links[:, 0], links[:, 1])

    return rows.mapInArrow(link, "a long, b long")
