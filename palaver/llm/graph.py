"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, store


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (its smallest reachable id) for every id of the edges ``a``, ``b``.

    A node whose one neighbour is smaller is a leaf: it is set aside and takes that neighbour's component in the
    end, so that only what is not yet a star goes on.  Then alternating large-star and small-star rounds:
    in each, every node links its neighbours to the smallest id that it knows, until the edges are
    stars.  Each round works on grouped minima and joins, never on a node's neighbours in one
    place, and is written to the shared folder, so that no lineage builds up.
    """
    pairs = store(_pairs(edges), "edges")
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("least"), F.lit(0).alias("below")).unionAll(
        pairs.select("b", F.lit(None).cast("long"), F.lit(1))
    )
    nodes = ends.groupBy("id").agg(F.count("least").alias("above"), F.sum("below").alias("below"), F.min("least").alias("least"))
    nodes = store(nodes.filter("above > 0"), "nodes")
    leaf = (F.col("above") == 1) & (F.col("below") == 0)
    leaves = nodes.filter(leaf).select(F.col("id").alias("a"), F.col("least").alias("b"))
    inner = nodes.filter(~leaf).select(F.col("id").alias("a"))
    current = store(pairs.join(inner, "a", "left_semi"), "edges")
    discard(pairs)
    while not _settled(current):
        # large-star: larger neighbours go to the smallest of the neighbourhood
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        # small-star: smaller neighbours, and the node itself, go to the smallest of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        linked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(lowest.select("a", F.col("m").alias("b")))
        before, current = current, store(linked.filter("a != b").distinct(), "edges")
        discard(before)
    known = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    outer = leaves.join(known, leaves["b"] == known["id"], "left").select(leaves["a"].alias("id"), F.coalesce("component", "b").alias("component"))
    told = known.unionAll(outer)
    roots = told.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    out = store(told.unionAll(roots), "components")
    discard(current)
    discard(nodes)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node links to one root, and no root links on."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return edges.isEmpty() or nodes.filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def _pairs(edges: DataFrame) -> DataFrame:
    """Each pair once, the larger id first."""
    pairs = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pairs.distinct()
