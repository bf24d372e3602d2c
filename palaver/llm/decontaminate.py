"""Benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

Each test item's word trigrams are its seeds, all of them: a seed that is left out for being
frequent may be the only one that an often copied edit still holds.  A document's trigrams that
are seeds mark where an item may lie in it; hits of one item that are no further apart than an
item's length make one window, and a word-level Smith-Waterman alignment of the item with that
window scores exact, edited and paraphrased copies alike.  The score is the alignment's share of
a perfect one; at ``MIN_SCORE`` or more the document holds the item.

Common phrases start windows too, so a bound is taken first: no alignment scores more than the best
run of the window's words with each word that the item has anywhere as a match and each other
word as the least loss.  Only a window whose bound reaches the score is aligned; none that would is lost.

Words are runs of letters and digits in lower case; each character of a script that is written without
spaces is a word.

Scale: one pass over the documents, no shuffle.  The test items are sent to the executors in slices
of at most ``SLICE_BYTES`` of text, one pass for each slice, so a benchmark of any size is held
against the documents in bounded memory.  Work grows with the items that share a trigram with a document.

Edge cases: null and empty texts match nothing, nor do null items or items without words; an item of fewer
than ``MIN_WORDS`` words has to be there exactly, one of one or two words as the whole document; an item id that repeats with several texts counts by its best; an
item found several times in a document gives one row, the best (ties: the first place);
repeated documents are aligned again; very long texts are cut into words as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import hash_spans, shingles, slices, string_buffers

#: Words of a seed, the fewest words of an item that may be edited, and the score from which an item is found.
SEED_WORDS, MIN_WORDS, MIN_SCORE = 3, 5, 0.5
#: Bytes of item texts that are held at once.
SLICE_BYTES = 16 << 20
#: Alignment: a matching word, a differing word, a word left out or put in.
MATCH, DIFFER, GAP = 2, -1, -1

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: First bytes of the characters among which are signs other than letters and digits, or scripts without spaces.
_MIXED_BYTE = np.zeros(256, bool)
_MIXED_BYTE[[0xC2, 0xCB, 0xCD, 0xCE, *range(0xD5, 0xF5)]] = True
_NO_WORD = r"[^\p{L}\p{M}\p{N}]+"
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's bounds among them."""
    if texts.null_count:
        texts = texts.fill_null("")
    lower = pc.utf8_lower(texts)
    raw, bounds = string_buffers(lower)
    mixed = np.flatnonzero(_MIXED_BYTE[raw])
    if len(mixed):
        some = np.zeros(len(texts), bool)
        some[np.searchsorted(bounds, mixed, "right") - 1] = True
        plain = pc.replace_substring_regex(pc.replace_substring_regex(lower.filter(pa.array(some)), _NO_WORD, " "), _UNSPACED, r" \1 ")
        raw, bounds = string_buffers(pc.replace_with_mask(lower, pa.array(some), plain))
    inside = _WORD_BYTE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return hash_spans(raw, starts, ends), np.searchsorted(starts, bounds)


def _best_end(item: np.ndarray, window: np.ndarray, anchored: bool) -> tuple[int, int, int]:
    """The best score of an alignment, and how many words of the item and of the window lie before its end.

    Row by row, so that memory is that of the window.  ``anchored``: it begins at both beginnings.
    """
    n = len(window)
    steps = np.arange(n + 1, dtype=np.int64) * -GAP
    above = -steps if anchored else np.zeros(n + 1, np.int64)
    best, end = 0, (0, 0)
    for i in range(len(item)):
        row = np.empty(n + 1, np.int64)
        row[0] = (i + 1) * GAP if anchored else 0
        np.maximum(above[:-1] + np.where(window == item[i], MATCH, DIFFER), above[1:] + GAP, out=row[1:])
        if not anchored:
            np.maximum(row, 0, out=row)
        # a run of words put in: the best of all places to the left, less their distance
        above = np.maximum.accumulate(row + steps) - steps
        k = int(above.argmax())
        if above[k] > best or (above[k] == best and k < end[1]):
            best, end = int(above[k]), (i + 1, k)
    return best, *end


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman of words: the share of a perfect score, and the aligned span of the window.

    The end is found forwards and the beginning backwards from there, so no table is kept.
    """
    best, i, j = _best_end(item, window, False)
    if not best:
        return 0.0, 0, 0
    _, _, length = _best_end(item[:i][::-1], window[:j][::-1], True)
    return best / (MATCH * len(item)), j - length, j


def reachable(item: np.ndarray, window: np.ndarray) -> float:
    """A share of a perfect score that no alignment passes; ``item``: its words, sorted."""
    spot = np.minimum(np.searchsorted(item, window), len(item) - 1)
    sums = np.r_[0, np.cumsum(np.where(item[spot] == window, MATCH, max(DIFFER, GAP)))]
    return min(1.0, int((sums - np.minimum.accumulate(sums)).max()) / (MATCH * len(item)))


@dataclass
class Items:
    """Test items as word hashes, and their seeds in one sorted array."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    item_of: np.ndarray
    place: np.ndarray
    sorted: list[np.ndarray]
    sizes: np.ndarray

    def search(self, words: np.ndarray, min_score: float) -> list[dict]:
        """The items a document's words hold."""
        if not len(words) or not len(self.seeds):
            return []
        grams = shingles(words, SEED_WORDS)
        low = np.searchsorted(self.seeds, grams, "left")
        hit = np.flatnonzero(self.seeds[np.minimum(low, len(self.seeds) - 1)] == grams)
        if not len(hit):
            return []
        high = np.searchsorted(self.seeds, grams[hit], "right")
        count = high - low[hit]
        at = np.repeat(hit, count)
        seed = np.repeat(low[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, begin = self.item_of[seed], at - self.place[seed]
        best: dict = {}
        order = np.lexsort((at, item))
        item, at, begin = item[order], at[order], begin[order]
        sizes = self.sizes
        apart = (item[1:] != item[:-1]) | (at[1:] - at[:-1] > sizes[item[1:]])
        for part in np.split(np.arange(len(item)), np.flatnonzero(apart) + 1):
            k = int(item[part[0]])
            slack = sizes[k] // 2 + 2
            # from where the item would begin at the first hit to where it would end at the last
            start = max(0, int(begin[part].min()) - slack)
            stop = min(len(words), int(begin[part].max()) + int(sizes[k]) + slack)
            least = min_score if sizes[k] >= MIN_WORDS else 1.0
            if reachable(self.sorted[k], words[start:stop]) < least:
                continue
            score, j, end = align(self.words[k], words[start:stop])
            found = {"item_id": self.ids[k], "score": score, "start_word": start + j, "end_word": start + end}
            if score >= least and (found["item_id"] not in best or score > best[found["item_id"]]["score"]):
                best[found["item_id"]] = found
        return list(best.values())


def _all_seeds(ids: list, words: list[np.ndarray]) -> Items:
    grams = [shingles(w, SEED_WORDS) for w in words]
    seeds = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    item_of = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64)
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(seeds, kind="stable")
    return Items(ids, words, seeds[order], item_of[order], place[order], [np.sort(w) for w in words], np.array([len(w) for w in words], np.int64))


def item_slices(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's usable items, in slices of bounded size."""
    usable = benchmark.filter("text is not null").select("item_id", "text")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // SLICE_BYTES)
    for k in range(n):
        taken = usable if n == 1 else usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        table = taken.orderBy("item_id", "text").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        texts = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
        words, at = words_of(texts)
        each = [words[at[i] : at[i + 1]] for i in range(table.num_rows)]
        ids = table["item_id"].to_pylist()
        some = [i for i, w in enumerate(each) if len(w)]
        yield _all_seeds([ids[i] for i in some], [each[i] for i in some])


def found_items(text: Column, items: Items, min_score: float = MIN_SCORE) -> Column:
    """An array of structs ``item_id``, ``score``, ``start_word``, ``end_word`` for a text column."""

    @F.pandas_udf("array<struct<item_id:long,score:double,start_word:long,end_word:long>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            column = pa.array(texts, pa.large_string())
            out: list[list[dict]] = []
            for start, stop in slices(column):
                words, at = words_of(column.slice(start, stop - start))
                out += [items.search(words[at[i] : at[i + 1]], min_score) for i in range(stop - start)]
            yield pd.Series(out, dtype=object)

    return find(F.coalesce(text, F.lit("")))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_score: float = MIN_SCORE) -> DataFrame:
    """One row for each document and item that it holds: ``doc_id``, ``item_id``, ``score``,
    ``start_word``, ``end_word`` (a span of the document's words)."""
    out = None
    for items in item_slices(benchmark):
        found = found_items(F.col("text"), items, min_score)
        rows = docs.select("doc_id", F.explode(found).alias("hit")).select("doc_id", "hit.*")
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        empty = F.lit(None).cast("array<struct<item_id:long,score:double,start_word:long,end_word:long>>")
        return docs.select("doc_id", F.explode(empty).alias("hit")).select("doc_id", "hit.*")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns."""
    out = docs
    for items in item_slices(benchmark):
        found = found_items(F.col("text"), items, min_score)
        out = out.filter(F.size(found) == 0)
    return out
