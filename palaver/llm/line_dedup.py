"""Line dedup by an exact set-similarity join.

A line is the set of its distinct words.  Lines with equal sets are one class, led by its first line
in the order of document and line number.  Classes are joined where the Jaccard similarity of
their sets reaches the threshold; a line is removed if it is not its class's first, or if its
class has a similar class that begins earlier.

The join is exact.  A line's tokens are ordered by rarity, and only a prefix of them is indexed:
similar sets share a token within their prefixes.  Pairs that meet at a token pass the length
filter, the positional filter (the tokens left after the shared one must suffice) and a parity
filter (each differing token flips at most one bit of a parity map whose size grows with the set, so
the bits that differ cannot outnumber the differing tokens that the threshold allows).  Forests of what passes make
clumps; within a clump every pair of classes is verified on its full sets and counted.

Rarity is a token's count over all lines, by a grouping on the token itself.  What every task needs
of it is held in a table of fixed size: for each value of a token's upper bits the largest count of
any token there, coarsened to a byte.  So a frequent token is never taken for a rare one, however
large the table, and any one order of tokens is right.

Scale: one pass over the texts counts, a second describes each line once for all later steps.
Copies are collapsed by partial aggregation.  The prefix's tokens are counted themselves, and those of
very many lines, like clumps of very many classes, are cut into blocks that meet in pairs; no
task emits more links than it has members.  Texts are shuffled once, by document, to verify what lies in
clumps (and once more to cut lines out).  What reaches the driver is the table of fixed size.

Edge cases: lines end at a line feed; lines without words are kept and match nothing; null and
empty texts have no lines with words; lines of equal sets at the same place of rows that repeat a
document id are one line, and a null id is an id like any other (it sorts first); a document that loses all its
words to earlier lines is dropped by ``drop_repeated_lines``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import dealt, in_block_pairs, star_edges, whole_groups
from .graph import components
from .tables import discard, fresh_name, store
from .words import as_fraction, hash_spans, mix, slices, string_buffers, word_bounds

#: Entries of the table of rarities: the upper bits of a token's hash.
RARITY_BITS = 20
#: Steps of a rarity for each doubling of the count.
RARITY_STEPS = 8
#: Tokens that a task counts before it hands the counts on.
COUNTED_TOKENS = 2_000_000
#: Pairs of postings that are laid out at once.
PAIRS_AT_ONCE = 400_000
#: Clumps up to which pairs are laid out side by side; in larger ones each row meets the whole block.
SMALL_CLUMP = 12
#: Members of a block: postings of a token, full sets of a clump.
POSTING_BLOCK, SET_BLOCK = 65_536, 512
#: Distinct tokens for each 64 bits of a parity map, and the most such words of a map.
TOKENS_PER_WORD, MOST_WORDS = 80, 64
#: Lines of a slice of texts up to which a line's number fits the sort key.
_KEY_LINES = 1 << 24


def line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the number of each word's line among all lines of the batch, and each
    text's first line number there (one more at the end)."""
    raw, bounds = string_buffers(texts)
    starts, ends = word_bounds(raw, bounds)
    feeds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=feeds[1:])
    at = np.searchsorted(starts, bounds)
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    # a text without words may stand between: every text begins a line of its own
    first = feeds[bounds] + np.arange(len(bounds))
    return hash_spans(raw, starts, ends), feeds[starts] + text_of, first


def distinct_tokens(words: np.ndarray, lines: np.ndarray, rarity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each line's distinct tokens, rarest first and then by their hashes: tokens and their lines."""
    if not len(words):
        return words, lines
    high = words >> np.uint64(32)
    if rarity is not None:
        high |= rarity[_slot(words)].astype(np.uint64) << np.uint64(32)
    order = None
    if lines[-1] - lines[0] < _KEY_LINES:
        key = (lines - lines[0]).astype(np.uint64) << np.uint64(40) | high
        order = np.argsort(key)
        key, sorted_words = key[order], words[order]
        same = key[1:] == key[:-1]
        if (sorted_words[1:] != sorted_words[:-1])[same].any():
            order = None  # two tokens of a line agree in the upper half of their hashes
    if order is None:
        order = np.lexsort((words, high, lines))
        sorted_words = words[order]
        same = (sorted_words[1:] == sorted_words[:-1]) & (lines[order][1:] == lines[order][:-1])
    keep = np.ones(len(words), bool)
    keep[1:] = ~same
    return sorted_words[keep], lines[order][keep]


def _slot(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def token_rarities(docs: DataFrame) -> np.ndarray:
    """For each slot of tokens the logarithm of its most frequent token's count over all lines."""

    def summed(tokens: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, n = np.concatenate(tokens), np.concatenate(counts)
        order = np.argsort(every)
        every, n = every[order], n[order]
        starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        return every[starts], np.add.reduceat(n, starts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, held, merged = [], [], 0, 0
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                words, _, _ = line_words(batch.column("text").slice(start, stop - start))
                own, n = np.unique(words, return_counts=True)
                tokens.append(own)
                counts.append(n)
                held += len(own)
                if held > COUNTED_TOKENS + 2 * merged and held:
                    own, n = summed(tokens, counts)
                    merged = len(own)
                    if merged > COUNTED_TOKENS:
                        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["token", "n"])
                        tokens, counts, held, merged = [], [], 0, 0
                    else:
                        tokens, counts, held = [own], [n], merged
        if held:
            own, n = summed(tokens, counts)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["token", "n"])

    counted = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    slot = F.shiftrightunsigned("token", 64 - RARITY_BITS).cast("int").alias("slot")
    found = counted.select(slot, "n").groupBy("slot").agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(1 << RARITY_BITS, np.uint8)
    out[np.asarray(found["slot"])] = np.minimum(np.log2(np.asarray(found["n"]).astype(float)) * RARITY_STEPS, 255)
    return out


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens that must be indexed: similar sets share at least ceil(threshold * n) tokens."""
    return n - np.ceil(np.round(threshold * n, 9)).astype(np.int64) + 1


def map_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of a parity map: a power of two that grows with the set."""
    return np.minimum(1 << np.ceil(np.log2(np.maximum(n / TOKENS_PER_WORD, 1))).astype(np.int64), MOST_WORDS)


def _folded(words: np.ndarray, starts: np.ndarray, wide: np.ndarray, rows: np.ndarray, to: int) -> np.ndarray:
    """The maps of the rows, folded to ``to`` words: bit b of a wide map is bit b modulo the narrow width."""
    out = np.zeros((len(rows), to), np.uint64)
    span = np.arange(to)
    for k in range(int((wide[rows] // to).max(initial=0))):
        some = np.flatnonzero(wide[rows] // to > k)
        out[some] ^= words[starts[rows[some], None] + k * to + span]
    return out


def _prints(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    salts = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93))
    a, b = (np.add.reduceat(mix(words ^ s), starts).view(np.int64) for s in salts)
    return a, b


def smallest_set(threshold: float) -> int:
    """Tokens below which a set is similar to no other set."""
    return math.ceil(round(threshold / (1 - threshold), 9)) if threshold < 1 else 2**31 - 1


def line_sets(docs: DataFrame, rarity: np.ndarray, threshold: float) -> DataFrame:
    """One row for each line with words: ``doc_id``, ``text_key`` (a hash of the document's text),
    ``line_no``, ``n`` distinct tokens, the set's fingerprint ``set_a``, ``set_b``, and, where it can be
    similar to another set, its parity map folded to 64 bits (``parity``) and whole (``map``, if
    it is wider) and the upper halves of its ``prefix``'s tokens."""
    smallest = smallest_set(threshold)

    def lists(lengths: np.ndarray) -> pa.Buffer:
        return pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int32))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                words, lines, first = line_words(batch.column("text").slice(start, stop - start))
                if not len(words):
                    continue
                words, lines = distinct_tokens(words, lines, rarity)
                starts = np.flatnonzero(np.r_[True, lines[1:] != lines[:-1]])
                n = np.diff(np.r_[starts, len(lines)])
                own = np.repeat(np.arange(len(starts)), n)
                doc = np.searchsorted(first, lines[starts], "right") - 1
                wide = map_words(n)
                at = np.cumsum(wide) - wide
                spot = at[own] * 64 + (words & (wide[own] * 64 - 1).astype(np.uint64)).astype(np.int64)
                odd = np.bincount(spot, minlength=int(wide.sum()) * 64) & 1
                maps = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
                whole = np.where((wide > 1) & (n >= smallest), wide, 0)
                held = maps[np.repeat(whole > 0, wide)]
                length = np.where(n >= smallest, prefix_length(n, threshold), 0)
                inside = np.arange(len(words)) - starts[own] < length[own]
                prefix = (words[inside] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                a, b = _prints(words, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start).take(pa.array(doc)),
                        batch.column("text_key").slice(start, stop - start).take(pa.array(doc)),
                        pa.array((lines[starts] - first[doc]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(a),
                        pa.array(b),
                        pa.array(np.bitwise_xor.reduceat(maps, at)),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, lists(whole * 8), pa.py_buffer(held)]),
                        pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(n) + 1, [None, lists(length)]), pa.array(prefix)),
                    ],
                    names=["doc_id", "text_key", "line_no", "n", "set_a", "set_b", "parity", "map", "prefix"],
                )

    schema = "doc_id long, text_key long, line_no int, n int, set_a long, set_b long, parity long, map binary, prefix array<int>"
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(describe, schema)


#: A posting's group (32 bits; a clash only makes a pair to verify), set size and position, in one number.  A
#: size or position beyond its bits is cut, which loosens the filters and loses nothing.
_POS_BITS = 12
_POS_MAX, _N_MAX = (1 << _POS_BITS) - 1, (1 << (32 - _POS_BITS)) - 1


def _postings(classes: DataFrame, rarity: np.ndarray) -> DataFrame:
    """The prefixes' tokens with what the filters need: ``place``, ``id``, ``parity``, ``map``, ``pair``.

    A token's postings are a group.  Where they are more than ``POSTING_BLOCK``, which is counted, they are
    cut into blocks, and each pair of blocks is a group (``pair``: the blocks, and which is the row's own).
    """
    spark = classes.sparkSession
    tokens = classes.select("id", "n", "parity", "map", F.posexplode("prefix").alias("pos", "token"))
    # only tokens that occur often enough over all lines can be in so many prefixes: at most one for each slot
    often = np.flatnonzero(rarity >= int(math.log2(POSTING_BLOCK) * RARITY_STEPS)).astype(np.int32)
    slots = F.broadcast(spark.createDataFrame(pa.table({"slot": pa.array(often)})))
    slot = F.shiftrightunsigned("token", 32 - RARITY_BITS)
    counted = tokens.select("token", slot.alias("slot")).join(slots, "slot", "left_semi").groupBy("token").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / F.lit(float(POSTING_BLOCK))).cast("int").alias("blocks")
    split = store(counted.filter(F.col("members") > POSTING_BLOCK).select("token", blocks), "split_tokens")
    joined = tokens.join(split, "token", "left")
    own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    every = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = joined.withColumn("own", own).withColumn("other", F.explode(every))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    pair = F.shiftleft(low.cast("long"), 32).bitwiseOR(F.shiftleft(high.cast("long"), 1)).bitwiseOR((F.col("own") == high).cast("long"))
    group = F.when(F.col("blocks").isNull(), F.col("token")).otherwise(F.hash("token", low, high)).cast("long")
    size, pos = F.least("n", F.lit(_N_MAX)).cast("long"), F.least("pos", F.lit(_POS_MAX)).cast("long")
    place = F.shiftleft(group, 32).bitwiseOR(F.shiftleft(size, _POS_BITS)).bitwiseOR(pos)
    return spread.select(place.alias("place"), "id", "parity", "map", F.when(F.col("blocks").isNotNull(), pair).alias("pair"))


def clump_edges(classes: DataFrame, rarity: np.ndarray, threshold: float) -> DataFrame:
    """Components, as stars, of the pairs that pass the filters within the postings of each token."""
    # in the order of place, a group's postings stand together in the order of their set sizes
    rows = _postings(classes, rarity).repartition(F.shiftright("place", 32)).sortWithinPartitions("place")
    share = threshold / (1 + threshold)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = pa.array(np.asarray(b.column(0)) >> 32)
            yield pa.RecordBatch.from_arrays([group, *b.columns], names=["group", *b.schema.names])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, bounds in whole_groups(grouped(batches), 1, rows=50_000):
            place, ids = np.asarray(chunk.column(1)), np.asarray(chunk.column(2))
            parity = np.asarray(chunk.column(3)).view(np.uint64)
            raw, at = string_buffers(chunk.column(4))
            words, starts, wide = raw.copy().view(np.uint64), at[:-1] // 8, np.maximum(np.diff(at) // 8, 1)
            pairs = np.asarray(chunk.column(5).fill_null(-1))
            across = (pairs >> 32) != (pairs >> 1 & 0x7FFFFFFF)
            across &= pairs >= 0
            n = (place >> _POS_BITS) & _N_MAX
            pos = place & _POS_MAX
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            # rows of a group stand in the order of n: those that the length filter allows follow each other
            key = group * (1 << 32) + n
            stop = np.searchsorted(key, group * (1 << 32) + np.floor(np.round(n / threshold, 9)).astype(np.int64), "right")
            count = stop - np.arange(len(n)) - 1
            found_a, found_b = [], []
            ends = np.cumsum(count)
            start = 0
            while start < len(n):  # a bounded number of pairs at a time
                end = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")), start + 1)
                c = count[start:end]
                i = np.repeat(np.arange(start, end), c)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
                both = n[i] + n[j]
                need = np.ceil(np.round(share * both, 9))
                good = np.bitwise_count(parity[i] ^ parity[j]) <= both - 2 * need
                good &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
                good &= pairs[i] >> 1 == pairs[j] >> 1
                good &= ~across[i] | (pairs[i] != pairs[j])
                i, j, most = i[good], j[good], (both - 2 * need)[good]
                width = np.minimum(wide[i], wide[j])
                fits = width == 1  # these have been held against each other in full
                for w in np.unique(width[width > 1]).tolist():
                    some = np.flatnonzero(width == w)
                    apart = _folded(words, starts, wide, i[some], w) ^ _folded(words, starts, wide, j[some], w)
                    fits[some] = np.bitwise_count(apart).sum(axis=1) <= most[some]
                found_a.append(i[fits])
                found_b.append(j[fits])
                start = end
            yield star_edges(ids, np.concatenate(found_a), np.concatenate(found_b))

    return rows.mapInArrow(link, "a long, b long").filter("a != b").distinct()


def _small_pairs(edges: np.ndarray, sizes: np.ndarray, across: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the small groups, some thousands at a time (their sets are laid out)."""
    count = np.repeat(edges[1:], sizes) - np.arange(sizes.sum()) - 1
    count[np.repeat(sizes > SMALL_CLUMP, sizes)] = 0
    ends = np.cumsum(count)
    start = 0
    while start < len(count):
        end = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE // 40, "right")), start + 1)
        c = count[start:end]
        i = np.repeat(np.arange(start, end), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        apart = ~across[i] | (own[i] != own[j])
        yield i[apart], j[apart]
        start = end


def _similar(i: np.ndarray, j: np.ndarray, n: np.ndarray, firsts: np.ndarray, codes: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose sets are similar; each row's codes are sorted."""
    if not len(i):
        return i, j
    fits = whole * np.minimum(n[i], n[j]) >= part * np.maximum(n[i], n[j])
    i, j = i[fits], j[fits]
    width = np.int64(codes.max()) + 1 if len(codes) else np.int64(1)
    keys = np.repeat(np.arange(len(n)), n) * width + codes
    pair = np.repeat(np.arange(len(i)), n[i])
    token = np.arange(len(pair)) - np.repeat(np.cumsum(n[i]) - n[i], n[i]) + firsts[i][pair]
    wanted = j[pair] * width + codes[token]
    spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    both = np.bincount(pair, keys[spot] == wanted, len(i)) if len(i) else np.zeros(0)
    good = whole * both >= part * (n[i] + n[j] - both)
    return i[good], j[good]


def verified_links(docs: DataFrame, classes: DataFrame, clumps: DataFrame, threshold: float) -> DataFrame:
    """``id``, ``n_links`` (similar classes) and ``has_earlier`` for the classes that have links."""
    sizes = clumps.groupBy("component").agg(F.count("*").alias("members"))
    members = clumps.join(sizes, "component").join(classes.drop("prefix", "map", "parity", "n"), "id")
    wanted = members.groupBy(F.col("doc_id").alias("first_doc"), F.col("text_key").alias("first_key")).agg(
        F.collect_list(F.struct("component", "members", "id", "set_a", "set_b", "line_no")).alias("wanted")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    same = texts["doc_id"].eqNullSafe(wanted["first_doc"]) & (texts["text_key"] == wanted["first_key"])
    # a text is split once, however many of its lines are wanted
    split = texts.join(wanted, same).select("first_doc", F.split("text", "\n").alias("parts"), "wanted")
    lines = split.select("first_doc", "parts", F.explode("wanted").alias("own")).select("first_doc", "own.*", F.get("parts", "own.line_no").alias("line"))
    placed = in_block_pairs(lines.filter("line is not null"), ["component"], "id", F.col("members"), SET_BLOCK)
    names = ["component", "low", "high", "own", "id", "set_a", "set_b", "first_doc", "line_no", "line"]
    rows = dealt(placed.select(*names), ["component", "low", "high"], ["id"])
    part, whole = as_fraction(threshold)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, bounds in whole_groups(batches, 3, rows=10_000, size=4 << 20):
            low, high, own, ids, set_a, set_b = (np.asarray(chunk.column(k)) for k in range(1, 7))
            docs_of = np.asarray(chunk.column(7).fill_null(np.iinfo(np.int64).min))
            line_of = np.asarray(chunk.column(8))
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            raw, at = string_buffers(chunk.column(9))
            begin, end = word_bounds(raw, at)
            words = hash_spans(raw, begin, end)
            words, owner = distinct_tokens(words, np.searchsorted(at, begin, "right") - 1)
            n = np.bincount(owner, minlength=len(ids))
            good = np.flatnonzero(n > 0)
            # rows that repeat a document id with another text are not the class's line; and once is enough
            a, b = _prints(words, (np.cumsum(n) - n)[good])
            good = good[(a == set_a[good]) & (b == set_b[good])]
            good = good[np.r_[True, (ids[good][1:] != ids[good][:-1]) | (group[good][1:] != group[good][:-1])]] if len(good) else good
            mark = np.zeros(len(ids), bool)
            mark[good] = True
            codes = np.unique(words[mark[owner]], return_inverse=True)[1].reshape(-1)
            low, high, own, ids, docs_of, line_of, group, n = (x[good] for x in (low, high, own, ids, docs_of, line_of, group, n))
            firsts = np.cumsum(n) - n
            links, earlier = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)

            def note(i: np.ndarray, j: np.ndarray) -> None:
                """Counts the links of paired rows, and marks the later of each pair."""
                np.add.at(links, i, 1)
                np.add.at(links, j, 1)
                i_first = (docs_of[i] < docs_of[j]) | ((docs_of[i] == docs_of[j]) & (line_of[i] < line_of[j]))
                earlier[np.where(i_first, j, i)] = True

            edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, np.int64)
            sizes = np.diff(edges)
            for i, j in _small_pairs(edges, sizes, low != high, own):
                note(*_similar(i, j, n, firsts, codes, part, whole))
            for g in np.flatnonzero(sizes > SMALL_CLUMP):
                s, e = edges[g], edges[g + 1]
                block = codes[firsts[s] : firsts[e - 1] + n[e - 1]]
                seen = np.zeros(int(block.max()) + 1, np.int32)
                starts = firsts[s:e] - firsts[s]
                for i in range(e - s - 1):
                    mine = block[starts[i] : starts[i] + n[s + i]]
                    seen[mine] = 1
                    both = np.add.reduceat(seen[block[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1]).astype(np.int64)
                    seen[mine] = 0
                    rest = n[s + i + 1 : e]
                    hit = whole * both >= part * (rest + n[s + i] - both)
                    if low[s] != high[s]:
                        hit &= own[s + i + 1 : e] != own[s + i]
                    j = s + i + 1 + np.flatnonzero(hit)
                    if len(j):
                        note(np.full(len(j), s + i), j)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(earlier[some])], names=["id", "n_links", "has_earlier"])

    counted = rows.mapInArrow(verify, "id long, n_links long, has_earlier boolean")
    # written, so that the texts' shuffle files go before the lines are joined
    return store(counted.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.max("has_earlier").alias("has_earlier")), "line_links")


def similar_lines(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """One row for each line with words: ``doc_id``, ``line_no`` (from 0), ``n_tokens``, its class by
    that one's first line (``class_doc``, ``class_line``), ``n_links`` (similar classes) and ``kept``."""
    return _judged_lines(docs, threshold)[0].drop("text_key")


def _judged_lines(docs: DataFrame, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """The judged lines, and the stored tables that they are read from."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    rarity = token_rarities(docs)
    lines = store(line_sets(docs, rarity, threshold), "lines")
    keys = ["set_a", "set_b", "n"]
    grouped = lines.groupBy(*keys).agg(
        F.min(F.struct("doc_id", "line_no", "text_key")).alias("first"),
        F.first("parity").alias("parity"),
        F.first("map").alias("map"),
        F.first("prefix").alias("prefix"),
    )
    classes = store(
        grouped.select(*keys, "first.doc_id", "first.line_no", "first.text_key", "parity", "map", "prefix", F.monotonically_increasing_id().alias("id")),
        "line_classes",
    )
    clumps = components(clump_edges(classes, rarity, threshold))
    links = verified_links(docs, classes, clumps, threshold)
    discard(clumps)
    told = classes.select(*keys, F.col("doc_id").alias("class_doc"), F.col("line_no").alias("class_line"), "id").join(links, "id", "left")
    told = told.select(*keys, "class_doc", "class_line", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("has_earlier", F.lit(False)).alias("has_earlier"))
    own = lines.select("doc_id", "text_key", "line_no", *keys).join(told, keys)
    first = F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("line_no") == F.col("class_line"))
    whole = [F.col(c).cast("long").alias(x) for c, x in (("line_no", "line_no"), ("n", "n_tokens"))]
    judged = own.select("doc_id", "text_key", *whole, "class_doc", F.col("class_line").cast("long"), "n_links", (first & ~F.col("has_earlier")).alias("kept"))
    return judged, [lines, classes, links]


def _marks(cut: Column) -> Column:
    """For sorted line numbers, an array that is true at these places, up to the last of them."""
    gap = lambda c, k: c - F.when(k == 0, F.lit(-1)).otherwise(F.get(cut, k - 1)) - 1
    return F.flatten(F.transform(cut, lambda c, k: F.concat(F.array_repeat(F.lit(False), gap(c, k).cast("int")), F.array(F.lit(True)))))


def drop_repeated_lines(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the removed lines, with all columns; ``n_chars``, if there, is counted anew.

    Documents whose words all go are dropped.
    """
    lines, read = _judged_lines(docs, threshold)
    cuts = lines.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.when(~F.col("kept"), F.col("line_no")))).alias("cut"), F.max("kept").alias("left")
    )
    own, key, gone, left = (fresh_name(docs, x) for x in ("own", "key", "gone", "left"))
    cuts = store(cuts.filter(F.size("cut") > 0).select(F.col("doc_id").alias(own), F.col("text_key").alias(key), _marks(F.col("cut")).alias(gone), F.col("left").alias(left)), "cuts")
    for table in read:
        discard(table)
    same = docs["doc_id"].cast("long").eqNullSafe(cuts[own]) & (F.xxhash64(docs["text"]) == cuts[key])
    joined = docs.join(cuts, same, "left").filter(F.coalesce(left, F.lit(True)))
    stays = F.filter(F.split("text", "\n"), lambda x, k: ~F.coalesce(F.get(F.col(gone), k), F.lit(False)))
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
