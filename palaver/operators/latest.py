"""Last-writer-wins, change detection and incremental cursors.

Every operator that depends on arrival order takes it as a column (``seq``); where it ties, the
row that sorts last by all its columns stands, so results do not depend on the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored


def dedup_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key.  One partial aggregation: a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(F.col(seq), *[F.col(c) for c in rest if c != seq]))
    return df.groupBy(*keys).agg(last.alias("row")).select(*keys, *[F.col("row")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The table after the batch: its last rows by key, and the target's rows of other keys."""
    fresh = dedup_last(batch, keys, seq).drop(seq)
    return target.join(fresh.select(*keys), keys, "left_anti").select(*fresh.columns).unionByName(fresh)


def replace_children(target: DataFrame, batch: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Child rows after the batch: all rows of a touched parent give way to the batch's."""
    kept = target.join(parents.select(parent).distinct(), parent, "left_anti")
    return kept.select(*batch.columns).unionByName(batch)


def incremental_scan(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows past their channel's cursor (exclusive; without one, past 0)."""
    joined = messages.join(cursors, "channel_id", "left")
    return joined.filter(F.col("message_id") > F.coalesce("cursor", F.lit(0))).drop("cursor")


def advance_cursors(cursors: DataFrame, seen: DataFrame, page: int = 100) -> DataFrame:
    """Each channel's cursor after a pass: it never regresses; ``short_pass``: less than a page was new."""
    new = seen.groupBy("channel_id").agg(F.max("message_id").alias("newest"), F.count("*").alias("n_new"))
    both = cursors.join(new, "channel_id", "full")
    return both.select(
        "channel_id",
        F.greatest(F.coalesce("cursor", F.lit(0)), F.coalesce("newest", F.lit(0))).alias("cursor"),
        F.coalesce("n_new", F.lit(0)).alias("n_new"),
        (F.coalesce("n_new", F.lit(0)) < page).alias("short_pass"),
    )


def snapshot_changes(df: DataFrame, key: str, order: str, watched: list[str]) -> DataFrame:
    """Rows whose watched columns differ from the key's row before; a first sighting always counts.

    Rows are dealt out by ranges of key and order and compared inside them; a range's first row of a key is compared with the
    last one of the key in the ranges before, which is carried over.  So a key may have any number of rows.  Rows of one
    ``order`` stand in the order of all their columns.
    """
    seen = F.struct(F.struct(*watched).alias("w"))
    rest = [c for c in df.columns if c not in (key, order)]
    ranged = stored(df.repartitionByRange(key, order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("__part", key).orderBy(order, *rest)
    marked = ranged.withColumns({"__before": F.lag(seen).over(inside), "__first": F.row_number().over(inside) == 1})
    last = ranged.groupBy("__part", key).agg(F.max_by(seen, F.struct(order, *rest)).alias("__last"))
    carried = last.select("__part", key, F.lag("__last").over(Window.partitionBy(key).orderBy("__part")).alias("__carried"))
    carried = carried.filter("__carried is not null").select(F.col("__part").alias("__p"), F.col(key).alias("__k"), "__carried", F.lit(True).alias("__f"))
    both = marked.join(carried, (F.col("__part") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__k")) & (F.col("__first") == F.col("__f")), "left")
    before = F.coalesce("__before", "__carried")
    return both.filter(before.isNull() | ~F.struct(*watched).eqNullSafe(before["w"])).select(*df.columns)


def _digests(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes sorted rows (``width`` group columns, pair, whether the group begins) group after group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, begun = None, hashlib.sha256(), False

        def closed(keys: list[pa.RecordBatch], values: list[str]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(keys).combine_chunks()
            return rows.append_column("fingerprint", pa.array(values, pa.string())).to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            group, pairs = batch.select(list(range(width))), batch.column(width).to_pylist()
            starts = np.flatnonzero(batch.column(width + 1).to_numpy(zero_copy_only=False)).tolist()
            keys, values = [], []
            ends = [*starts, batch.num_rows]
            for at, end, fresh in zip([0, *starts], ends, [False, *[True] * len(starts)], strict=True):
                if fresh:
                    if key is not None:
                        keys.append(key)
                        values.append(digest.hexdigest())
                    key, digest, begun = group.slice(at, 1), hashlib.sha256(), False
                told = [p for p in pairs[at:end] if p is not None]
                if told:
                    digest.update(("|" * begun + "|".join(told)).encode())
                    begun = True
            if keys:
                yield closed(keys, values)
        if key is not None:
            yield closed([key], [digest.hexdigest()])

    return run


def set_fingerprint(df: DataFrame, group: list[str], member: str, version: str) -> DataFrame:
    """SHA-256 of a group's sorted ``id:version`` pairs; it does not depend on their order.

    ``version`` is a timestamp (null: empty); it is written in UTC with 100 ns digits.  Null ids are left out.
    The hash of a sequence asks for one task a group: its rows are sorted (with spilling) and hashed as they
    pass, so memory does not grow with the group.
    """
    stamp = F.coalesce(F.date_format(version, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0+00:00'"), F.lit(""))
    w = Window.partitionBy(*group).orderBy("__id", "__stamp")
    rows = df.select(*group, F.col(member).alias("__id"), stamp.alias("__stamp"))
    marked = rows.select(
        *group,
        F.concat(F.col("__id").cast("string"), F.lit(":"), F.col("__stamp")).alias("__pair"),
        F.lag(F.lit(True)).over(w).isNull().alias("__first"),
    )
    fields = [T.StructField(f.name, f.dataType) for f in marked.schema.fields[: len(group)]]
    return marked.mapInArrow(_digests(len(group)), T.StructType([*fields, T.StructField("fingerprint", T.StringType())]))


def fingerprint_changes(df: DataFrame, key: str, at: str, value: str = "fingerprint") -> DataFrame:
    """Observations whose value differs from the one before, the first included."""
    return snapshot_changes(df, key, at, [value])
