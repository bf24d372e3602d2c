"""Sharding by jump consistent hashing, in native column expressions.

Jump consistent hashing walks the jumps of a key's bucket as the number of buckets grows: from
bucket ``b`` the next jump goes to ``floor((b + 1) * 2**31 / (r + 1))`` where ``r`` is the next
31-bit number of a 64-bit linear congruential generator seeded with the key.  The last jump below
``n_shards`` is the shard.  There is no ring table, and a further shard takes rows only into
itself: about ``1 / (n + 1)`` of them.

Scale: the shard is a pure function of the key, so there is no shuffle of texts.  A walk takes about
``ln(n_shards)`` jumps; the few keys that need more than the usual bound walk on.  Slots within a
shard are numbered in fine sub-buckets of the row (key and order columns: rows that share a key are
spread), a narrow shuffle of the kept columns, and the offsets of the ``n_shards * SUB_BUCKETS`` sub-buckets are
joined to them where they are.  A shard is never sorted in one task.

Edge cases: a null key hashes as 0; a null text counts as empty; repeated rows get the same shard
and slots of their own; an empty table gives an empty result; columns of the input with the names
of the results are replaced by them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import fresh_name

#: The multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
#: Sub-buckets of a shard in which slots are numbered in parallel.
SUB_BUCKETS = 256

_LIMB = 1 << 22
_M0, _M1, _M2 = MULTIPLIER % _LIMB, (MULTIPLIER >> 22) % _LIMB, MULTIPLIER >> 44


def _next_state(s: Column) -> Column:
    """``s * MULTIPLIER + 1`` modulo 2**64 for a signed 64-bit ``s``, without overflow.

    The factors are cut into limbs of 22 bits, so no partial sum leaves 63 bits; only the last
    shift drops bits, as the modulus asks.
    """
    mask = F.lit(_LIMB - 1).cast("long")
    a0, a1, a2 = s.bitwiseAND(mask), F.shiftright(s, 22).bitwiseAND(mask), F.shiftrightunsigned(s, 44)
    low = a0 * F.lit(_M0) + F.lit(1).cast("long")
    mid = a1 * F.lit(_M0) + a0 * F.lit(_M1) + F.shiftright(low, 22)
    high = a2 * F.lit(_M0) + a1 * F.lit(_M1) + a0 * F.lit(_M2) + F.shiftright(mid, 22)
    return F.shiftleft(high, 44).bitwiseOR(F.shiftleft(mid.bitwiseAND(mask), 22)).bitwiseOR(low.bitwiseAND(mask))


def jump_hash(key: Column, n_shards: int) -> Column:
    """The shard, from 0 to ``n_shards`` - 1, of an integer key; null as 0."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    start = F.struct(
        F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("s"),
        F.lit(0).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def step(acc: Column, _: Column) -> Column:
        s = _next_state(acc["s"])
        draw = (F.shiftrightunsigned(s, 33) + F.lit(1)).cast("double")
        j = F.floor((acc["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long")
        moved = F.struct(s.alias("s"), acc["j"].alias("b"), j.alias("j"))
        return F.when(acc["j"] < n_shards, moved).otherwise(acc)

    # jump k has a mean of ln(n_shards) predecessors: far fewer than this bound, but for one key in very many
    bound = min(n_shards, 20 + math.ceil(4 * math.log(n_shards + 1)))
    near = F.aggregate(F.sequence(F.lit(1), F.lit(bound)), start, step)
    if bound == n_shards:  # each live step raises j by one at least: none is below n_shards now
        return near["b"].cast("int")
    # evaluated for the walks that are not at their end
    rest = F.when(near["j"] < n_shards, F.sequence(F.lit(1), F.lit(n_shards))).otherwise(F.array(F.lit(0)))
    return F.aggregate(rest, near, step, lambda acc: acc["b"]).cast("int")


def assign_shards(df: DataFrame, key: str, n_shards: int, *, order: list[str] | None = None) -> DataFrame:
    """All columns of ``df`` plus ``shard``, ``slot`` (gapless from 0 in each shard) and
    ``grown_shard`` (the shard were there one more)."""
    sub, start, rank = (fresh_name(df, x) for x in ("sub", "start", "rank"))
    buckets = F.pmod(F.xxhash64(key, *(order or [])), F.lit(SUB_BUCKETS)).cast("int")
    shard = jump_hash(F.col(key), n_shards)
    keyed = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot", "grown_shard") and c != key])
    marked = keyed.withColumns({"shard": shard, "grown_shard": jump_hash(F.col(key), n_shards + 1), sub: buckets})
    # reads the key and order columns alone: one row for each sub-bucket of a shard
    sizes = keyed.select(shard.alias("shard"), buckets.alias(sub)).groupBy("shard", sub).agg(F.count("*").alias(rank))
    before = Window.partitionBy("shard").orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", sub, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy("shard", sub).orderBy(key, *(order or []))
    numbered = marked.withColumn(rank, F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, ["shard", sub])
        .withColumn("slot", (F.col(rank) + F.col(start)).cast("long"))
        .select(*keyed.columns, "shard", "slot", "grown_shard")
    )


def write_shards(df: DataFrame, path: str) -> None:
    """Writes the rows of ``assign_shards`` as one Parquet folder for each shard."""
    df.write.partitionBy("shard").parquet(path)


def sharded_sizes(documents: DataFrame, n_shards: int = 16) -> DataFrame:
    """Digest of every document's place under the ``key`` law."""
    narrow = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign_shards(narrow, "doc_id", n_shards, order=["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
