"""Near-duplicate documents by MinHash bands and odd sketches.

A document is the set of its distinct word shingles.  Documents with equal sets are one class.
Each class has a MinHash signature, whose samples give band keys and are folded into an odd
sketch: a bitmap in which every sample toggles one bit, so that the population count of two
sketches' XOR estimates the number of samples that differ, most precisely at high similarity.

1. Classes that share a band key are candidates.  Within a band bucket, sketches that are near enough
   (the threshold less six deviations) are linked.
2. The components of these links are clumps: no link can run between two of them.
3. Within a clump, full shingle sets are held against each other; the components of the links that hold
   exactly are the groups.

With 32 bands of 4 samples a pair at similarity 0.8 misses all bands with probability 5e-8, and six
deviations of the sketch cost another 1e-9.  No pair within a clump is left out, so nothing else is lost.

Scale: texts are read twice and shuffled once, by document, to bring those in clumps together.  Copies
are collapsed by partial aggregation before anything is shuffled.  Large buckets and clumps are cut into
blocks that first meet a few pivots; only members that stay apart from their group's greater part
meet all of it (``linked_components``), so that a large group of near copies is worked through in proportion to its size.

Edge cases: null and empty texts have an empty set and link with nothing; a text of fewer words
than a shingle is one shingle as a whole; a null id links nothing and keeps itself; rows that repeat an id
are documents of their own, by their texts, and a group's id is the smallest id of any; equal rows are
copies (each gives a row of the result, and one of them stays where rows are dropped).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import linked_components
from .tables import discard, fresh_name, store
from .words import as_fraction, hashed_words, mix, shingles, slices

#: Samples of a signature, in bands.
BANDS, ROWS = 32, 4
#: Bits of an odd sketch.
SKETCH_BITS = 256
#: Members of a block: sketches in a bucket, full sets in a clump.
SKETCH_BLOCK, SET_BLOCK = 1024, 256

_rng = np.random.default_rng(41)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def largest_distance(threshold: float, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """The XOR population count that a pair at the threshold exceeds by chance of six deviations."""
    differing = 2 * samples * (1 - threshold)
    left = math.exp(-2 * differing / bits)
    mean = bits / 2 * (1 - left)
    by_samples = left * 2 * math.sqrt(samples * threshold * (1 - threshold))
    by_bits = math.sqrt(bits / 4 * (1 - left * left))
    return math.ceil(mean + 6 * math.hypot(by_samples, by_bits))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds."""
    words, at = hashed_words(texts)
    sets = [np.unique(shingles(words[at[i] : at[i + 1]], width)) for i in range(len(texts))]
    bounds = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), bounds


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash samples, one row for each non-empty set."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), BANDS * ROWS), np.uint64)
    if len(starts):
        buffer = np.empty_like(values)
        for k in range(BANDS * ROWS):
            np.bitwise_xor(values, _XOR[k], out=buffer)
            np.multiply(buffer, _MULTIPLY[k], out=buffer)
            out[:, k] = np.minimum.reduceat(buffer, starts)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as 64-bit words."""
    bit = (mix(samples + np.arange(samples.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    at = np.arange(len(samples))[:, None] * SKETCH_BITS + bit
    odd = (np.bincount(at.reshape(-1), minlength=len(samples) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(samples), SKETCH_BITS), axis=1).view(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(samples), BANDS)).copy()
    parts = samples.reshape(len(samples), BANDS, ROWS)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9DDFEA08EB382D69) + parts[:, :, k])
    return key


def _lists(rows: np.ndarray, has: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    offsets = np.r_[0, np.cumsum(has * width)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1).view(np.int64)))


def sketch_documents(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text), ``n_shingles``, the set's fingerprint ``set_a``, ``set_b``,
    ``bands`` and ``sketch``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                values, bounds = shingle_sets(batch.column("text").slice(start, stop - start), width)
                sizes = np.diff(bounds)
                has = sizes > 0
                prints = np.zeros((2, len(sizes)), np.uint64)
                if has.any():
                    for k, salt in enumerate((np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93))):
                        prints[k, has] = np.add.reduceat(mix(values ^ salt), bounds[:-1][has])
                samples = signatures(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start),
                        batch.column("text_key").slice(start, stop - start),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        _lists(band_keys(samples), has),
                        _lists(odd_sketches(samples), has),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    schema = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(sketch, schema)


def sketch_clumps(classes: DataFrame, threshold: float) -> DataFrame:
    """Components of the near sketches that share a band bucket; needs ``id``, ``n``, ``bands``, ``sketch``."""
    most, words = largest_distance(threshold), SKETCH_BITS // 64
    part, whole = as_fraction(threshold)
    exploded = classes.select(F.explode("bands").alias("group"), "id")
    shared = exploded.groupBy("group").agg(F.count("*").alias("members")).filter("members > 1")
    members = store(exploded.join(shared, "group"), "bucket_members")

    def pairs(sizes: pa.Array, sketches: pa.Array, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        n = np.asarray(sizes).astype(np.int64)
        bits = np.asarray(sketches.flatten()).view(np.uint64).reshape(-1, words)
        fits = whole * np.minimum(n[a], n[b]) >= part * np.maximum(n[a], n[b])
        return fits & (np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= most)

    def linker(sizes: pa.Array, sketches: pa.Array) -> Callable:
        return lambda i, rows: pairs(sizes, sketches, i, rows)

    attach = lambda rows: rows.join(classes.select("id", "n", "sketch"), "id")
    found = linked_components(members, SKETCH_BLOCK, attach, ["n", "sketch"], linker, {}, pairs)
    discard(members)
    return found


def exact_groups(docs: DataFrame, classes: DataFrame, clumps: DataFrame, width: int, threshold: float) -> DataFrame:
    """Components, within each clump, of the links that hold on full shingle sets.

    ``classes``: ``id`` and its first document's ``doc_id``, ``text_key``; ``clumps``: ``id``, ``component``.
    """
    sizes = clumps.groupBy("component").agg(F.count("*").alias("members"))
    members = store(clumps.join(sizes, "component").select(F.col("component").alias("group"), "id", "members"), "clump_members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    firsts = classes.select("id", F.col("doc_id").alias("first_doc"), F.col("text_key").alias("first_key"))

    def attach(rows: DataFrame) -> DataFrame:
        # equal rows of a document become members twice: the pair of equal ids links nothing
        named = rows.join(firsts, "id")
        return texts.join(named, (texts["doc_id"] == named["first_doc"]) & (texts["text_key"] == named["first_key"]))

    part, whole = as_fraction(threshold)

    def linker(texts: pa.Array) -> Callable:
        values, at = shingle_sets(texts, width)
        codes = np.unique(values, return_inverse=True)[1].reshape(-1)
        mark, n = np.zeros(codes.max() + 1 if len(codes) else 1, np.int32), np.diff(at)

        def linked(i: int, rows: np.ndarray) -> np.ndarray:
            mark[codes[at[i] : at[i + 1]]] = 1
            if len(rows) * 4 < len(n):
                both = np.array([mark[codes[at[r] : at[r + 1]]].sum() for r in rows])
            else:
                both = np.add.reduceat(mark[codes], at[:-1])[rows].astype(np.int64)
            mark[codes[at[i] : at[i + 1]]] = 0
            return whole * both >= part * (n[rows] + n[i] - both)

        return linked

    found = linked_components(members, SET_BLOCK, attach, ["text"], linker, {"rows": 2000, "size": 2 << 20})
    discard(members)
    return found


_SET = ["set_a", "set_b", "n_shingles"]


def _grouped(docs: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The sketched rows of ``docs``, and for each distinct set its ``group`` (null: alone)."""
    sketched = store(sketch_documents(docs, width), "sketches")
    classes = store(
        sketched.filter("n_shingles > 0 and doc_id is not null")
        .groupBy(*_SET)
        .agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .select(*_SET, "first.doc_id", "first.text_key", F.col("n_shingles").alias("n"), "bands", "sketch", F.monotonically_increasing_id().alias("id")),
        "classes",
    )
    clumps = sketch_clumps(classes, threshold)
    groups = exact_groups(docs, classes, clumps, width, threshold)
    discard(clumps)
    return sketched, classes.select(*_SET, "doc_id", "text_key", "id").join(groups, "id", "left").withColumnRenamed("component", "group")


def near_duplicates(docs: DataFrame, *, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``."""
    sketched, sets = _grouped(docs, width, threshold)
    first = sets.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("first"))
    named = sets.join(first, "group", "left").select(*_SET, F.coalesce("first", "doc_id").alias("component_id"))
    every = sketched.select("doc_id", *_SET).join(named, _SET, "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id"))
    return every.select("doc_id", "n_shingles", F.coalesce(own, F.col("doc_id")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, *, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each group, with all its columns: the smallest id's (of an id's texts that of the smallest hash).

    Rows that are in no group stay, but for further rows of the same id and text.
    """
    sketched, sets = _grouped(docs, width, threshold)
    place = F.struct("doc_id", "text_key")
    first = sets.filter("group is not null").groupBy("group").agg(F.min(place).alias("first"))
    named = sets.join(first, "group", "left").select(*_SET, F.coalesce("first", place).alias("stays"))
    rows = sketched.groupBy("doc_id", "text_key", *_SET).agg(F.count("*").alias("n_rows")).join(named, _SET, "left")
    goes = F.col("stays").isNotNull() & F.col("doc_id").isNotNull() & (F.col("stays") != place)
    id_, key, all_go = (fresh_name(docs, x) for x in ("id", "key", "all_go"))
    told = store(rows.filter(goes | (F.col("n_rows") > 1)).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), goes.alias(all_go)), "gone")
    same = docs["doc_id"].cast("long").eqNullSafe(told[id_]) & (F.xxhash64(docs["text"]) == told[key])
    kept = docs.join(told, same, "left_anti")
    several = told.filter(~F.col(all_go))
    if several.isEmpty():
        return kept
    return kept.unionByName(docs.join(several, same).dropDuplicates([id_, key]).select(*docs.columns))
