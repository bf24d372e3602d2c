"""Counts over time, state counts, percentiles and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def hourly_counts(messages: DataFrame, at: str = "created_at") -> DataFrame:
    return messages.groupBy("channel_id", F.date_trunc("hour", at).alias("bucket")).agg(F.count("*").alias("n"))


def active_channels(hourly: DataFrame, channels: DataFrame, *, guild_id: int | None = None, since_hours: int = 24, now: str) -> DataFrame:
    """Channels by messages since then: ``channel_id``, ``name``, ``total``, ``last_active``."""
    since = F.lit(now).cast("timestamp") - F.expr(f"interval {since_hours} hour")
    dim = channels if guild_id is None else channels.filter(F.col("guild_id") == guild_id)
    totals = hourly.filter(F.col("bucket") >= since).groupBy("channel_id").agg(
        F.sum("n").alias("total"), (F.max("bucket") + F.expr("interval 1 hour")).alias("last_active")
    )
    # totals first: the join then meets one row for each channel
    return totals.join(dim.select("channel_id", "name"), "channel_id").orderBy(F.desc("total"), "channel_id")


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("entity", "state").agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, value: str, *, by: str, ps: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles of each group, as ``p50``, ``p95``, ...; each p lies in [0, 1].

    Distinct values are counted and dealt out by ranges of group and value.  A range's counts tell how many rows of a group
    lie before the next one, so each rank is found inside one range, and no task holds a group's values.
    """
    if any(not 0 <= p <= 1 for p in ps):
        raise ValueError("percentiles lie between 0 and 1")
    counts = df.groupBy(F.col(by).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()), "ranges")
    valued = ranged.filter("v is not null")
    order = Window.partitionBy("k").orderBy("part")
    parts = valued.groupBy("k", "part").agg(F.sum("n").alias("own"))
    before = F.coalesce(F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("k").alias("pk"), F.col("part").alias("pp"), before.alias("before"), F.sum("own").over(Window.partitionBy("k")).alias("total"))
    within = valued.withColumn("upto", F.sum("n").over(Window.partitionBy("k", "part").orderBy("v")))
    placed = within.join(parts, (F.col("part") == F.col("pp")) & F.col("k").eqNullSafe(F.col("pk"))).select("k", "v", ((F.col("before") + F.col("upto")) / F.col("total")).alias("share"))
    found = placed.groupBy("k").agg(*[F.min(F.when(F.col("share") >= p, F.col("v"))).alias(f"p{p * 100:g}") for p in ps])
    groups = ranged.select(F.col("k").alias("g")).distinct()
    return groups.join(found, F.col("g").eqNullSafe(F.col("k")), "left").drop("k").withColumnRenamed("g", by)


def gap_violations(df: DataFrame, gap: str, threshold: float, *, by: str) -> DataFrame:
    return df.filter(F.col(gap) > threshold).groupBy(by).agg(F.count("*").alias("n"), F.max(gap).alias("largest"))


def transport_latency(log: DataFrame) -> DataFrame:
    """``gap`` (received less published) and ``dwell`` (received less enqueued; null without an enqueue
    time) in seconds; unset stamps take the time of receipt."""
    received = F.unix_seconds("received")
    return log.withColumns(
        {
            "gap": received - F.unix_seconds(F.coalesce("published", "received")),
            "dwell": F.when(F.col("enqueued").isNotNull(), received - F.unix_seconds("enqueued")),
        }
    )


def store_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each table: its name and its number of rows."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def entity_snapshots(states: DataFrame, *, guild_id: int | None = None) -> DataFrame:
    """Latest state rows, with the number of roles (none: 0)."""
    rows = states if guild_id is None else states.filter(F.col("guild_id") == guild_id)
    return rows.withColumn("n_roles", F.coalesce(F.size("roles"), F.lit(0)))


def channel_snapshots(states: DataFrame, *, guild_id: int | None = None) -> DataFrame:
    """Latest states of channels, of one guild's if given: the state, the cursor, and what the last sync found."""
    rows = states if guild_id is None else states.filter(F.col("guild_id") == guild_id)
    return rows.select("channel_id", "guild_id", "name", "type", "state", "cursor", "last_synced", "caught_up", "last_count", "pins")


def message_state(states: DataFrame, key: str, message_id: int) -> DataFrame:
    """One message's state, or nothing."""
    return states.filter(F.col(key) == message_id).limit(1)
