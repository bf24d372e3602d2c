"""Collocations: phrases of two and three words that stand together more often than their parts do apart.

Counting is by direct-address tiling.  Words get ids in the order of their frequency in their language,
so that most pairs of neighbours fall near the origin of the pair matrix.  Its tiles there are counted
densely, a pair's ids being its address (``numpy.bincount``); all other tiles are sparse and kept as
sorted coordinates with their counts.  Frequent pairs are then ranked anew and take the first word's place:
a triple is a pair of a frequent pair and a word, and is counted by the same tiles.  What tasks have counted
is summed by Spark.

1. Texts are read once: each task cuts them into pieces and words, and writes chunks of one language
   with their distinct words and the running text as places in that list.
2. Distinct words are summed, those below the least count are left out, the others ranked.
3. Each chunk's distinct words are joined with their ranks (a shuffle of distinct words, not of
   occurrences), and its text is written again as runs of ids.
4. Pairs, then triples are counted; a triple counts only where both its pairs are frequent.

Scale: every step works on chunks of bounded size and sums by key with partial sums before the shuffle.  No
vocabulary is broadcast: sent to tasks are a bit table of fixed size, which says of most infrequent pairs that they
are, and a fixed number of the most frequent pairs with their ranks.  Both only save work; the counts are exact without them.

Edge cases: null texts count as empty, a null language as ``und``; a text never shares a piece with another;
repeated rows count again; of phrases with the same score and count the first in byte order comes first; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import batches_of, discard, store
from .words import LOWER, mix, settle, string_buffers, word_bounds

#: Bytes of text of a chunk, and of all chunks that a task gathers at once.
CHUNK_BYTES, GATHERED_BYTES = 8 << 20, 32 << 20
#: Chunks that a task is given at once.
CHUNK_ROWS = 4
#: Occurrences that a task counts at once.
BUFFER = 1 << 20
#: Side of a tile; tiles (i, j) with (i + 1) * (j + 1) up to ``DENSE`` are counted densely.
TILE, DENSE = 256, 16
#: Bits (as a power of two) of the table of frequent pairs, and pairs that are ranked anew for dense tiles.
BITS, RANKED_PAIRS = 24, 16_384

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False

_NUMBER = np.full((DENSE, DENSE), -1, np.int64)  # of the dense tiles
_NUMBER[tuple(np.array([(i, j) for i in range(DENSE) for j in range(DENSE // (i + 1))]).T)] = np.arange(sum(DENSE // (i + 1) for i in range(DENSE)))
_TILES = [(i, j) for i in range(DENSE) for j in range(DENSE // (i + 1))]


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of some texts, and all words as places among them (inverted where a word begins a piece)."""
    raw, bounds = string_buffers(texts)
    starts, ends = word_bounds(raw, bounds, _WORD)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int32)
    cuts = np.cumsum(_BREAK[raw], dtype=np.int32)[starts] + np.searchsorted(bounds, starts, "right")
    offsets = np.r_[0, np.cumsum(ends - starts)]
    letters = LOWER[raw[_WORD[raw]]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    places = np.asarray(words.indices).astype(np.int32)
    first = np.r_[True, cuts[1:] != cuts[:-1]]
    return words.dictionary, np.where(first, ~places, places)


def _chunks(documents: DataFrame) -> DataFrame:
    """``chunk``, ``lang``, ``words``, ``counts``, ``n`` and ``codes`` (as ``coded`` gives them)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)
        number = TaskContext.get().partitionId() << 32

        def out(lang: str) -> pa.RecordBatch:
            nonlocal number
            words, codes = coded(pa.concat_arrays(held.pop(lang)))
            sizes.pop(lang)
            number += 1
            counts = np.bincount(np.where(codes < 0, ~codes, codes), minlength=len(words))
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
            cells = [pa.array([number]), pa.array([lang]), one(words, pa.string()), one(pa.array(counts), pa.int64()), pa.array([len(codes)]), pa.array([codes.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, names=["chunk", "lang", "words", "counts", "n", "codes"])

        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                part = batch.column(1).filter(pc.equal(batch.column(0), lang))
                held[lang].append(part)
                sizes[lang] += part.nbytes
                if sizes[lang] >= CHUNK_BYTES:
                    yield out(lang)
            while sum(sizes.values()) > GATHERED_BYTES:
                yield out(max(sizes, key=sizes.get))
        for lang in list(held):
            yield out(lang)
        settle()

    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "chunk long, lang string, words array<string>, counts array<long>, n long, codes binary")


def _ranked(words: DataFrame) -> DataFrame:
    """Adds ``id``: the place of a word among its language's, by ``f`` and then the word; no language is sorted in one task."""
    order = ["lang", F.desc("f"), "word"]
    at = store(words.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "frequent_words")
    part = F.shiftright("at", 33).alias("part")
    runs = at.groupBy("lang", part).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("lang", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start")).alias("move"))
    own = at.withColumn("part", F.shiftright("at", 33)).join(runs, ["lang", "part"])
    return own.select("lang", "word", "f", (F.col("at") + F.col("move")).cast("int").alias("id"))


def runs_of_ids(codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The text as ids, with -1 where a piece or a run of ranked words ends; words without a ranked neighbour are left out."""
    first = codes < 0
    out = np.full(len(codes) + 2 + first.sum(), -1, np.int32)
    out[np.arange(1, len(codes) + 1) + np.cumsum(first)] = ids[np.where(first, ~codes, codes)]
    some = out >= 0
    linked = some.copy()
    linked[1:-1] &= some[:-2] | some[2:]
    keep = linked.copy()
    keep[1:] |= ~some[1:] & linked[:-1]
    return out[keep]


def _sequences(chunks: DataFrame, ranked: DataFrame) -> DataFrame:
    """``lang``, ``seed`` (a hash of it) and ``ids`` of each chunk."""
    distinct = chunks.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
    known = distinct.join(ranked.select("lang", "word", "id"), ["lang", "word"])
    known = known.groupBy("chunk").agg(F.collect_list(F.struct("place", "id")).alias("known"))
    joined = chunks.select("chunk", "lang", F.size("words").alias("size"), "codes").join(known, "chunk")

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pairs = batch.column(4).slice(k, 1).flatten()
                ids = np.full(batch.column(2)[k].as_py(), -1, np.int32)
                ids[np.asarray(pairs.field("place"))] = np.asarray(pairs.field("id"))
                runs = runs_of_ids(np.frombuffer(batch.column(3)[k].as_buffer(), np.int32), ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([runs.tobytes()], pa.binary())], names=["lang", "seed", "ids"])
            settle()

    rows = joined.select("lang", F.xxhash64("lang").alias("seed"), "size", "codes", "known")
    return rows.mapInArrow(recode, "lang string, seed long, ids binary")


def tiled(rows: np.ndarray, columns: np.ndarray, keys: np.ndarray | None = None, keys_at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts the pairs of ``rows`` and ``columns``: distinct pairs and how often each is there.

    Dense tiles by address, the others by sorted coordinates.  Where ``keys`` are given, rows stand for them: dense
    tiles hold rows from 0 on (-1: not ranked), whose keys are ``keys_at``, and keys are returned in the rows' place.
    """
    near = np.flatnonzero((rows >= 0) & ((rows // TILE + 1) * (columns // TILE + 1) <= DENSE))
    a, b = rows[near], columns[near]
    address = (_NUMBER[a // TILE, b // TILE] * TILE + a % TILE) * TILE + b % TILE
    counts = np.bincount(address, minlength=1)
    found = np.flatnonzero(counts)
    tile = np.array(_TILES)[found // (TILE * TILE)]
    cell = found % (TILE * TILE)
    dense_a, dense_b = tile[:, 0] * TILE + cell // TILE, tile[:, 1] * TILE + cell % TILE
    if keys is not None:
        dense_a = keys_at[dense_a]
    far = np.ones(len(rows), bool)
    far[near] = False
    own = rows if keys is None else keys
    distinct, place = (None, own[far]) if keys is None else np.unique(own[far], return_inverse=True)
    code = np.sort(place.astype(np.int64) << 32 | columns[far])
    edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    sparse_a, sparse_b = code[edges] >> 32, code[edges] & 0xFFFFFFFF
    if keys is not None:
        sparse_a = distinct[sparse_a]
    return np.r_[dense_a, sparse_a], np.r_[dense_b, sparse_b], np.r_[counts[found], np.diff(np.r_[edges, len(code)])]


def _counted(sequences: DataFrame, width: int, count: Callable[[str, int, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], least: int) -> DataFrame:
    """Sums what ``count(lang, seed, ids)`` gives for phrases of ``width`` words (keys, columns, counts); those below ``least`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[np.ndarray]] = defaultdict(list)
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, seed), parts in held.items():
                a, b, n = count(lang, seed, np.concatenate(parts).astype(np.int64))
                for start in range(0, len(a), 1 << 18):
                    part = slice(start, start + (1 << 18))
                    names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(a[part]), np.int32)), pa.array([lang])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(a[part]), pa.array(b[part].astype(np.int32)), pa.array(n[part])], names=["lang", "key", "next", "n"])
            held.clear()
            settle()

        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[k].as_buffer(), np.int32)
                for start in range(0, len(ids), BUFFER):  # a part goes on to the end of the last phrase that begins in it
                    part = np.r_[ids[start : start + BUFFER + width - 1], np.int32(-1)]
                    held[batch.column(0)[k].as_py(), batch.column(1)[k].as_py()].append(part)
                    size += min(BUFFER, len(ids) - start)
                    if size >= BUFFER:
                        yield from out()
                        size = 0
        yield from out()

    counted = sequences.mapInArrow(run, "lang string, key long, next int, n long")
    return counted.groupBy("lang", "key", "next").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _bit_of(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.uint64) ^ mix(np.atleast_1d(np.asarray(seed, np.int64)).astype(np.uint64))) >> np.uint64(64 - BITS)


def _bit_table(pairs: DataFrame) -> np.ndarray:
    """A bit for the hash of every frequent pair; of fixed size, whatever their number."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit_of(np.asarray(batch.column(1)), np.asarray(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    found = pairs.select(F.xxhash64("lang"), "pair").mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[np.asarray(found["at"])] = np.asarray(found["bits"])
    return out.view(np.uint64)


def _pairs(sequences: DataFrame, least: int) -> DataFrame:
    def count(lang: str, seed: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        return tiled(ids[at], ids[at + 1])

    counted = _counted(sequences, 2, count, least)
    return counted.select("lang", (F.shiftleft("key", 32) + F.col("next")).alias("pair"), "n")


def _triples(sequences: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    spark = sequences.sparkSession
    ranked: dict[str, list[int]] = defaultdict(list)
    for lang, pair in pairs.orderBy(F.desc("n"), "lang", "pair").limit(RANKED_PAIRS).select("lang", "pair").collect():
        ranked[lang].append(pair)
    table = spark.sparkContext.broadcast((_bit_table(pairs), {lang: np.array(keys, np.int64) for lang, keys in ranked.items()}))

    def count(lang: str, seed: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits, ranks = table.value
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        key = ids[at] << 32 | ids[at + 1]
        bit = _bit_of(key, seed)
        some = (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
        at, key = at[some], key[some]
        both = np.flatnonzero(at[1:] == at[:-1] + 1)
        key, following = key[both], ids[at[both] + 2]
        keys_at = ranks.get(lang, np.zeros(0, np.int64))
        if not len(keys_at):
            return tiled(np.full(len(key), -1), following, key, keys_at)
        order = np.argsort(keys_at)
        spot = order[np.minimum(np.searchsorted(keys_at, key, sorter=order), len(order) - 1)]
        return tiled(np.where(keys_at[spot] == key, spot, -1), following, key, keys_at)

    counted = _counted(sequences, 3, count, least)
    return counted.select("lang", F.col("key").alias("pair"), "next", "n")


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))``, exactly, for counts of up to 16 digits."""
    a, left, right = (x.cast("decimal(16,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a).cast("decimal(31,0)"), left * right)


def collocations(documents: DataFrame, *, least: int = 10, limit: int = 2_000, share: int = 50) -> DataFrame:
    """Each language's ``limit`` best phrases of two or three words that occur at least ``least`` times.

    A phrase's score is that of its weakest cut in two, ``1000000 * a * a / (l * r)``; a phrase inside a longer one that
    has at least ``share`` percent of its occurrences is left out.  Needs ``lang`` and ``text``; returns ``lang``, ``rank``, ``phrase``,
    ``a`` (occurrences), ``l``, ``r`` (those of the parts), ``n`` (the language's words) and ``score``.
    """
    chunks = store(_chunks(documents), "chunks", "zstd")
    each = chunks.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("f"))))
    frequent = each.groupBy("lang", "word").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    ranked = store(_ranked(frequent), "ranked_words")
    totals = store(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    with batches_of(documents.sparkSession, CHUNK_ROWS):
        sequences = store(_sequences(chunks, ranked), "sequences", "zstd")
        discard(chunks)
        pairs = store(_pairs(sequences, least), "pairs")
        triples = store(_triples(sequences, pairs, least), "triples")
    discard(sequences)

    word = lambda name, at: ranked.select("lang", F.col("id").cast("long").alias(at), F.col("word").alias(f"w{name}"), F.col("f").alias(f"f{name}"))
    first, second = F.shiftright("pair", 32), F.col("pair").bitwiseAND(0xFFFFFFFF)
    two = pairs.select("lang", "pair", first.alias("i"), second.alias("j"), F.col("n").alias("a"))
    inside = triples.select("lang", "pair", "n").unionAll(triples.select("lang", F.shiftleft(second, 32) + F.col("next"), "n"))
    inside = inside.groupBy("lang", "pair").agg(F.max("n").alias("longer"))
    two = two.join(inside, ["lang", "pair"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    two = two.join(word(1, "i"), ["lang", "i"]).join(word(2, "j"), ["lang", "j"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))

    three = triples.select("lang", "pair", (F.shiftleft(second, 32) + F.col("next")).alias("last"), first.alias("i"), second.alias("j"), F.col("next").cast("long").alias("k"), F.col("n").alias("a"))
    three = three.join(pairs.select("lang", "pair", F.col("n").alias("f12")), ["lang", "pair"]).join(pairs.select("lang", F.col("pair").alias("last"), F.col("n").alias("f23")), ["lang", "last"])
    three = three.join(word(1, "i"), ["lang", "i"]).join(word(2, "j"), ["lang", "j"]).join(word(3, "k"), ["lang", "k"])
    one, other = _score(F.col("a"), F.col("f1"), F.col("f23")), _score(F.col("a"), F.col("f12"), F.col("f3"))
    cut = F.when(one <= other, F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), one.alias("score"))).otherwise(F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"), other.alias("score")))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = two.unionByName(three).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
