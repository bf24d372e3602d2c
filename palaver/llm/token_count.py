"""Token counts by rank-synchronous array merging.

A batch's texts are cut into pre-tokens; those not met before are laid out as one ragged numpy
array of symbol ids.  In each round every pre-token merges all occurrences of *its own*
lowest-rank pair, all pre-tokens at once, until none has a pair left; the surviving symbols are
counted.  A merge's product first exists after that merge, so its own pairs rank higher: merging
all occurrences of the lowest pair together, left to right, gives what the one-by-one procedure gives.

Scale: no shuffle.  Texts stream through Arrow batches; memory holds one slice of texts and a
bounded store of counted pre-tokens.

Edge cases: null and empty texts have no tokens; special strings inside texts are one token each,
as the library's default is; a very long pre-token is merged like any other, by array operations
over its length; repeated rows are counted again.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pre-tokens whose counts a Python worker keeps.
KEPT_WORDS = 400_000
#: Symbols that are merged at once.
MERGE_SYMBOLS = 2_000_000

# Code points that the library's version of Unicode does not know as letters or digits, though the
# version of the pattern engine here does; and letters whose lower case the library knows and Python does not.
LATER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
#: Texts without such a code point have none of the above.
_HIGH = regex.compile("[\u0558-\U0010ffff]")
_LATER = regex.compile(f"[{LATER}]")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


class PairMerger:
    """A tokenizer file's normalizer, pre-tokenizer and merges, for counting."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pieces = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(p["pattern"]["Regex"] for p in pieces if p["type"] == "Split")
        kinds = [n["type"] for n in (spec["normalizer"] or {"normalizers": []})["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model.get("byte_fallback"):
            raise ValueError("this file's normalizer or model is not one that is counted here")
        self.words = regex.compile(pattern)
        known = "[[{}]--[" + LATER + "]]"
        self.later_words = regex.compile(pattern.replace(r"\p{L}", known.format(r"\p{L}")).replace(r"\p{N}", known.format(r"\p{N}")), regex.V1)
        marks = [a["content"] for a in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        letters, vocab, suffix = _byte_letters(), model["vocab"], model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.n = 1 + max(vocab.values())
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.kept: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; one past the last for a pair that does not merge."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols each non-empty word ends with."""
        none = len(self.keys)
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.first[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        out = np.zeros(len(words), np.int64)
        rank = np.full(len(symbols), none)
        if len(symbols) > 1:
            same = np.flatnonzero(owner[:-1] == owner[1:])
            rank[same] = self._rank(symbols[same], symbols[same + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            best = np.minimum.reduceat(rank, starts)
            done = best == none
            if done.any():  # finished words leave the arrays
                out[owner[starts[done]]] = lengths[done]
                live = np.repeat(~done, lengths)
                symbols, owner, rank = symbols[live], owner[live], rank[live]
                best, lengths = best[~done], lengths[~done]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, lengths)
            # overlapping occurrences: in each run of hits every second one, from its left end
            at = np.flatnonzero(hit)
            run = np.cumsum(np.r_[0, np.diff(at) != 1])
            first = np.r_[0, np.flatnonzero(np.diff(run)) + 1]
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            symbols, owner, changed = symbols[~gone], owner[~gone], changed[~gone]
            rank = rank[~gone]
            # ranks change at a merged symbol and just before it
            redo = changed.copy()
            redo[:-1] |= changed[1:]
            spots = np.flatnonzero(redo)
            rank[spots] = none
            spots = spots[spots + 1 < len(symbols)]
            spots = spots[owner[spots] == owner[spots + 1]]
            rank[spots] = self._rank(symbols[spots], symbols[spots + 1])
        return out

    def _learn(self, words: set[str]) -> None:
        batch, size = [], 0
        for w in words:
            batch.append(w)
            size += len(w)
            if size >= MERGE_SYMBOLS:
                self.kept.update(zip(batch, self.survivors([w.encode() for w in batch]).tolist(), strict=True))
                batch, size = [], 0
        if batch:
            self.kept.update(zip(batch, self.survivors([w.encode() for w in batch]).tolist(), strict=True))

    def _words(self, text: str) -> list[str]:
        """The pre-tokens of a text as the library normalizes and cuts it."""
        if text.isascii():
            return self.words.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        high = _HIGH.search(text) is not None
        if high:
            text = text.translate(LOWER)
        # one character at a time, as the library lowers: no context-dependent final sigma
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return (self.later_words if high and _LATER.search(text) else self.words).findall(text)

    def counts(self, texts: list[str]) -> list[int]:
        cut: list[list[str]] = []
        extra: list[int] = []
        for text in texts:
            parts = [text]
            if self.special is not None and "<" in text:
                parts = self.special.split(text)
            extra.append(len(parts) - 1)
            found: list[str] = []
            for part in parts:
                found += self._words(part)
            cut.append(found)
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        new = set().union(*cut) - self.kept.keys() if cut else set()
        if new:
            self._learn(new)
        kept = self.kept
        return [n + sum([kept[w] for w in found]) for n, found in zip(extra, cut, strict=True)]


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def token_counter(path: str):
    """A column function: the number of tokens of a text under the vocabulary file at ``path``."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counting = merger(path)
        for texts in batches:
            out: list[int] = []
            part: list[str] = []
            size = 0
            for text in texts:
                part.append(text or "")
                size += len(part[-1])
                if size > 2_000_000:
                    out += counting.counts(part)
                    part, size = [], 0
            yield pd.Series(out + counting.counts(part), dtype="int64")

    return count


def count_tokens(text: Column, path: str) -> Column:
    return token_counter(path)(F.coalesce(text, F.lit("")))


def document_tokens(documents, path: str, limit: int = 2048):
    counted = documents.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        count_tokens(F.col("text"), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
