"""Language identification by interpolated Kneser-Ney character models.

For each language an interpolated Kneser-Ney model of characters (lower-cased letters; all else is
one space) is learned from a bounded sample of labelled documents.  The models lie side by side in
sorted hash arrays, one for each order: a found n-gram gives its interpolated log-probability under
every language of its group at once, and a missing one backs off through the arrays of context
weights.  Groups are of at most ``GROUP`` languages, so the arrays grow in proportion to the languages.  The
language with the lowest cross-entropy per character wins.

Rejection is calibrated on labelled documents that were kept out of the counts: the limit lies
midway between their mean cross-entropy and that of their own letters in random order (and never
within eight deviations of the mean), with more room for short texts.  A language of too few documents to keep
any out takes the widest limit of the others; where none has one, all are accepted.  A text whose best
cross-entropy is above it is not ``accepted``; nor is a text without letters.

Scale: learning collects n-grams of a sample of about ``SAMPLE_DOCS`` documents for each language,
whatever the table's size.  Prediction is one pass without a shuffle; the
model that is sent to the executors is bounded by the sample.

Edge cases: null, empty and letterless texts are ``und`` with score 0 and not accepted; if nothing is
labelled, every text is ``und`` and those with letters are accepted; ties go to the language that
sorts first; whole texts are scored, however long; repeated rows are scored again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import store
from .words import mix, settle

#: Length of the longest n-gram.
ORDER = 4
#: Labelled documents of a language that are learned from (the bound of the sample), counts and calibration.
SAMPLE_DOCS = 400
#: Languages whose models share arrays.
GROUP = 8
#: Characters that are scored, or counted, at once.
SLICE_CHARS = 250_000
#: One in so many sampled documents is kept for calibration.
CALIBRATION = 5
#: Characters beyond which a text's confidence grows no more.
CONFIDENT_CHARS = 20
UNKNOWN = "und"

_SPACE = 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 spaces; bounds; whether a text has a letter."""
    joined = "\0".join(t.lower().replace("\0", " ") for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letter = _letter_table()[points]
    ends = points == 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    owner = np.cumsum(ends) - ends
    has = np.bincount(owner, letter, len(texts)) > 0
    keep &= ~ends | np.r_[False, letter[:-1]]
    kept, owner = np.where(letter, points, _SPACE)[keep], owner[keep]
    sizes = np.bincount(owner, minlength=len(texts))
    pad = ORDER - 1
    bounds = np.r_[0, np.cumsum(sizes + pad)]
    out = np.full(bounds[-1], _SPACE, np.uint32)
    out[np.arange(len(kept)) + (owner + 1) * pad] = kept
    return out, bounds, has


def _keys(points: np.ndarray, at: np.ndarray, order: int, context: bool = False) -> np.ndarray:
    """Hashes of the last ``order`` code points of the n-grams that start at ``at``, without the
    very last one for a context."""
    key = np.full(len(at), np.uint64(order + 100 * context))
    for k in range(ORDER - order, ORDER - context):
        key = key * _PRIME + points[at + k].astype(np.uint64)
    return mix(key)


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return spot, keys[spot] == wanted


@dataclass
class Group:
    """Kneser-Ney models of some languages in sorted hash arrays."""

    #: for each order: sorted n-gram keys, and log-probabilities by language
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    #: for each order: sorted context keys, and log back-off weights by language
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    #: log-probability of a character that no language has, by language
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def position_scores(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probabilities, by language, of the last characters of the n-grams that start at ``at``."""
        out = np.empty((len(at), len(self.floor)))
        left: np.ndarray | None = None
        for order in range(ORDER, 0, -1):
            keys, logs = self.grams[order - 1]
            spot, found = _look_up(keys, _keys(points, at, order))
            if left is None:
                np.take(logs, spot, axis=0, out=out)
                left = np.flatnonzero(~found)
                out[left] = 0
            else:
                out[left[found]] += logs[spot[found]]
                left = left[~found]
            if not len(left):
                return out
            at = at[~found]
            if order > 1:  # the context's weight, for those that back off
                keys, weights = self.contexts[order - 1]
                spot, found = _look_up(keys, _keys(points, at, order, context=True))
                out[left[found]] += weights[spot[found]]
        out[left] += self.floor
        return out


@dataclass
class Model:
    """The models of all languages, which stand in the order of their names, group after group."""

    languages: list[str] = field(default_factory=list)
    groups: list[Group] = field(default_factory=list)
    #: the largest accepted cross-entropy of a long text, by language
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character by text and language; characters; whether there is a letter."""
        points, bounds, has = fold(texts)
        sizes = np.diff(bounds) - (ORDER - 1)
        total = np.zeros((len(texts), len(self.languages)))
        some = sizes > 0
        if some.any() and self.languages:
            # the first of an n-gram's positions, for each character of a text
            starts = np.cumsum(sizes) - sizes
            at = np.arange(sizes.sum()) + np.repeat(bounds[:-1] - starts, sizes)
            own = np.repeat(np.arange(len(texts)), sizes)
            for k, group in enumerate(self.groups):
                columns = slice(k * GROUP, k * GROUP + len(group.floor))
                for first in range(0, len(at), 2 * SLICE_CHARS):  # a long text is scored piece by piece
                    part = slice(first, first + 2 * SLICE_CHARS)
                    scores, owner = group.position_scores(points, at[part]), own[part]
                    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    total[owner[edges], columns] += np.add.reduceat(scores, edges, axis=0)
        return -total / np.maximum(sizes, 1)[:, None], sizes, has

    def identify(self, texts: list[str]) -> pd.DataFrame:
        entropy, sizes, has = self.entropies(texts)
        if not self.languages:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "cross_entropy": 0.0, "accepted": has})
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        reach = np.minimum(np.maximum(sizes, 1), CONFIDENT_CHARS)
        score = 1 / np.exp(-(entropy - lowest[:, None]) * reach[:, None]).sum(axis=1)
        room = 2.0 / np.sqrt(np.maximum(sizes, 1))
        names = np.array([*self.languages, UNKNOWN], object)
        return pd.DataFrame(
            {
                "lang_pred": names[np.where(has, best, len(self.languages))],
                "score": np.where(has, np.clip(score, 0, 1), 0.0),
                "cross_entropy": np.where(has, lowest, 0.0),
                "accepted": has & (lowest <= self.limit[best] + room),
            }
        )


def _kneser_ney(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """``grams``: for each language the distinct ORDER-grams (rows of code points) and their counts."""
    languages = sorted(grams)
    n_chars = len(np.unique(np.concatenate([np.unique(g) for g, _ in grams.values()]))) + 1
    groups = [_group([grams[x] for x in languages[k : k + GROUP]], n_chars) for k in range(0, len(languages), GROUP)]
    return Model(languages, groups, np.full(len(languages), np.inf))


def _group(grams: list[tuple[np.ndarray, np.ndarray]], n_chars: int) -> Group:
    model = Group()
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by order, by language: n-grams and counts
    for order in range(ORDER, 0, -1):
        level = []
        for i in range(len(grams)):
            if order == ORDER:
                level.append(grams[i])
            else:  # continuation counts: distinct characters before the n-gram
                suffixes, counts = np.unique(tables[0][i][0][:, 1:], axis=0, return_counts=True)
                level.append((suffixes, counts))
        tables.insert(0, level)
    lower: np.ndarray | None = None  # probabilities of the union's n-grams one order down
    lower_grams: np.ndarray | None = None
    for order in range(1, ORDER + 1):
        level = tables[order - 1]
        union = np.unique(np.concatenate([g for g, _ in level]), axis=0)
        index = {g.tobytes(): k for k, g in enumerate(union)}
        contexts, context_of = np.unique(union[:, :-1], axis=0, return_inverse=True) if order > 1 else (union[:1, :0], np.zeros(len(union), int))
        context_of = context_of.reshape(-1)
        probs = np.zeros((len(union), len(grams)))
        weights = np.zeros((len(contexts), len(grams)))
        for i, (g, c) in enumerate(level):
            c = c.astype(float)
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95)
            at = np.fromiter((index[x.tobytes()] for x in g), int, len(g))
            total = np.bincount(context_of[at], c, len(contexts))
            kinds = np.bincount(context_of[at], minlength=len(contexts))
            seen = total > 0
            back = np.where(seen, discount * kinds / np.maximum(total, 1), 1.0)
            held = np.zeros(len(union))
            held[at] = (c - discount) / total[context_of[at]]
            if order == 1:
                below = np.full(len(union), 1 / n_chars)
            else:
                where = {x.tobytes(): k for k, x in enumerate(lower_grams)} if i == 0 else where
                tail = np.fromiter((where[np.ascontiguousarray(x).tobytes()] for x in union[:, 1:]), int, len(union)) if i == 0 else tail
                below = lower[tail, i]
            probs[:, i] = held + back[context_of] * below
            weights[:, i] = back
        if order == 1:
            model.floor = np.log(weights[0] / n_chars)
        for rows, values, table, context in ((union, probs, model.grams, False), (contexts, weights, model.contexts, True)):
            padded = np.full((len(rows), ORDER), _SPACE, np.uint32)
            padded[:, ORDER - order : ORDER - context] = rows
            keys = _keys(padded.reshape(-1), np.arange(len(rows)) * ORDER, order, context)
            sort = np.argsort(keys)
            table.append((keys[sort], np.log(values)[sort]))
        lower, lower_grams = probs, union
    return model


def _parts(texts: pd.Series) -> Iterator[list[str]]:
    """The texts (nulls: empty) in lists of about ``SLICE_CHARS`` characters; one list at least."""
    part, size, n = [], 0, 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size > SLICE_CHARS:
            yield part
            part, size, n = [], 0, n + 1
    if part or not n:
        yield part


def learn(labelled: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from the columns ``doc_id``, ``text`` and ``lang`` of a bounded sample of rows."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = store(usable.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000))
    share = F.ceil(F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("docs")) * 1e6)
    # a language of few documents is learned from all of them
    aside = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibrate")), F.lit(CALIBRATION)) == 0) & (F.col("docs") >= 2 * CALIBRATION)
    sample = store(usable.join(sizes, "lang").filter(draw < share).select("text", "lang", aside.alias("aside")), "sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for texts in _parts(part["text"]):
                    points, bounds, has = fold(texts)
                    rows = np.lib.stride_tricks.sliding_window_view(points, ORDER) if len(points) >= ORDER else np.zeros((0, ORDER), np.uint32)
                    own = np.ones(len(rows), bool)
                    for b in bounds[1:-1]:
                        own[max(b - ORDER + 1, 0) : b] = False  # windows over two texts
                    grams, counts = np.unique(rows[own], axis=0, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": [g.astype("<u4").tobytes() for g in grams], "n": counts})

    counted = (
        sample.filter(~F.col("aside")).select("text", "lang").mapInPandas(count, "lang string, gram binary, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    found = counted.toPandas()
    if not len(found):
        return Model()
    grams = {
        lang: (np.frombuffer(b"".join(part["gram"]), "<u4").reshape(-1, ORDER).astype(np.uint32), part["n"].to_numpy())
        for lang, part in found.groupby("lang")
    }
    model = _kneser_ney(grams)
    told = sample.filter("aside").select("lang", _calibration(F.col("text"), model).alias("own"))
    stats = (
        told.filter(F.col("own.lang_pred") == F.col("lang"))
        .groupBy("lang")
        .agg(F.avg("own.entropy").alias("mean"), F.stddev_pop("own.entropy").alias("sd"), F.avg("own.noise").alias("noise"))
    ).collect()
    for r in stats:
        limit = max(r["mean"] + 8 * r["sd"], (r["mean"] + r["noise"]) / 2)
        model.limit[model.languages.index(r["lang"])] = limit
    known = np.isfinite(model.limit)
    if known.any():  # a language without a limit of its own takes the widest of the others
        model.limit[~known] = model.limit[known].max()
    return model


def _calibration(text: Column, model: Model) -> Column:
    """The language of a text, its cross-entropy, and that of its letters in random order (drawn anew
    for each text, but alike for the same text); one function, so that a task needs one worker."""

    @F.pandas_udf("lang_pred string, entropy double, noise double")
    def calibrate(texts: pd.Series) -> pd.DataFrame:
        own, noise = [], []
        for text in texts:
            letters = np.array(list(text))
            np.random.default_rng(zlib.crc32(text.encode())).shuffle(letters)
            own.append(model.identify([text]))
            noise.append(model.identify(["".join(letters)])["cross_entropy"])
        settle()
        if not own:
            return pd.DataFrame({"lang_pred": [], "entropy": [], "noise": []})
        told = pd.concat(own, ignore_index=True)
        return pd.DataFrame({"lang_pred": told["lang_pred"], "entropy": told["cross_entropy"], "noise": pd.concat(noise, ignore_index=True)})

    return calibrate(text)


def identify_text(text: Column, model: Model) -> Column:
    """A struct ``lang_pred``, ``score``, ``cross_entropy``, ``accepted`` for a text column."""

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, accepted boolean")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.concat([model.identify(part) for part in _parts(texts)], ignore_index=True)
            settle()

    return identify(F.coalesce(text, F.lit("")))


def held_out() -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_documents(documents: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out, and predicts for all."""
    model = learn(documents.filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    own = documents.select("doc_id", held_out().alias("held_out"), identify_text(F.col("text"), model).alias("own"))
    return own.select("doc_id", "held_out", "own.lang_pred", "own.score", "own.cross_entropy", "own.accepted")
