"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is read as words (runs of ASCII letters and digits and of all other characters, A-Z as a-z), in overlapping
windows of ``WINDOW`` words.  A word's input has a word part (a trained vector for words that the sample
often has, and the word's log-odds) and a character part (the mean of trained vectors of its trigrams, and the
highest, lowest and mean log-odds of its n-grams of 3 to 6 bytes, with marks for its start and end), so that a word
never seen is judged by its spelling.  A gated recurrent unit reads the window in each direction, attention weighs the
states, and their weighted sum gives the window's logit.  A text scores as its highest window.

Learning: a label says that a text has a toxic window, not which.  So a toxic document teaches by
its highest window, a clean one by several of its highest ones, and after each epoch all windows of the sample are
scored anew.  Log-odds are lower confidence bounds; those that the network is trained on come from the half of the sample
that a document is not in, so that words of one document do not look telling.  Scores are calibrated by a
logistic fit on documents that took no part, weighted back to the classes' true shares.

Scale: the sample is bounded by ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` documents of at most ``SAMPLE_CHARS`` characters, and the
model by the sample.  Scoring is one pass over all texts without a shuffle: the inputs of distinct words are
worked out once for about a megabyte of text, and windows run through the network in batches of fixed size.

Edge cases: null and empty texts, and those without a word, score as a window without words does; whole texts are scored, however
long; labels other than 0 and 1 are left out, as are those of unknown documents; a document with both labels counts with each, an id that
repeats by its smallest text; without labels of both kinds every score is the known labels' mean (0 without any); repeated rows are scored again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import LOWER, hash_spans, mix, settle, slices, string_buffers, word_bounds

#: The bound of the sample: labelled documents of each kind, and the longest that is taken.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1_500, 3_000, 20_000
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 16
#: Sizes: states in each direction, word vectors, trigram vectors.
STATE, WORD_DIM, CHAR_DIM = 8, 8, 8
#: Documents of the sample that a word with a vector of its own is in.
KNOWN = 5
#: Powers of two: buckets of n-gram log-odds and of trigram vectors.
ODDS_BITS, CHAR_BITS = 20, 13
BATCH, CLEAN_WINDOWS = 128, 3
#: Passes over the sample, and updates that are made at least (a small sample is passed over more often).
EPOCHS, UPDATES = 6, 300
#: One in so many documents of the sample is kept for calibration.
CALIBRATION = 5
#: Windows that run through the network at once.
RUN = 2_048

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Masks of the first n bytes of a little-endian word, and what tells n-grams of different lengths apart.
_GRAM = np.array([(1 << 8 * n) - 1 for n in range(7)], np.uint64)
_OWN = np.array([n * 0x9E3779B97F4A7C15 % (1 << 64) for n in range(7)], np.uint64)


@dataclass
class Words:
    """The distinct words of some texts, and the texts as places among them."""

    keys: np.ndarray
    #: bytes of the words, each between a mark for its start and one for its end, and their bounds
    letters: np.ndarray
    bounds: np.ndarray
    places: np.ndarray
    #: text i has ``places[texts[i]:texts[i + 1]]``
    texts: np.ndarray


def read_words(texts: pa.Array) -> Words:
    raw, bounds = string_buffers(texts)
    starts, ends = word_bounds(raw, bounds, _TOKEN)
    keys, first, places = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
    size = ends[first] - starts[first]
    own = np.r_[0, np.cumsum(size + 2)]
    letters = np.full(own[-1], ord("<"), np.uint8)
    letters[own[1:] - 1] = ord(">")
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    letters[np.repeat(own[:-1] + 1, size) + inner] = LOWER[raw[np.repeat(starts[first], size) + inner]]
    return Words(keys, letters, own, places.astype(np.int32), np.searchsorted(starts, bounds))


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the words' letters: a hash of the n-gram that starts there, and whether the word goes on so far."""
    padded = np.zeros(len(words.letters) + 8, np.uint8)
    padded[: len(words.letters)] = words.letters
    eight = np.ndarray(len(words.letters), "<u8", padded, strides=(1,))
    left = np.repeat(words.bounds[1:], np.diff(words.bounds)) - np.arange(len(words.letters))
    return mix((eight & _GRAM[n]) + _OWN[n]), left >= n


@dataclass
class Odds:
    """Log-odds of words (sorted keys) and of n-grams (by bucket)."""

    keys: np.ndarray
    words: np.ndarray
    grams: np.ndarray

    def features(self, words: Words) -> np.ndarray:
        """Of each word: its own log-odds; the highest, lowest and mean of its n-grams."""
        out = np.zeros((len(words.keys), 4), np.float32)
        if not len(words.keys):
            return out
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, words.keys), len(self.keys) - 1)
            out[:, 0] = np.where(self.keys[spot] == words.keys, self.words[spot], 0)
        high, low, total, n_grams = (np.zeros(len(words.letters), np.float32) for _ in range(4))
        for n in range(3, 7):
            key, there = grams(words, n)
            value = np.where(there, self.grams[key >> np.uint64(64 - ODDS_BITS)], 0)
            np.maximum(high, value, out=high)
            np.minimum(low, value, out=low)
            total += value
            n_grams += there
        at = words.bounds[:-1]
        out[:, 1] = np.maximum.reduceat(high, at)
        out[:, 2] = np.minimum.reduceat(low, at)
        out[:, 3] = np.add.reduceat(total, at) / np.maximum(np.add.reduceat(n_grams, at), 1)
        return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How much likelier toxic documents have something than clean ones: one deviation below (above) the estimate, never past 0."""
    share = n_toxic / max(n_toxic + n_clean, 1)
    a, b = toxic + 2 * share, clean + 2 * (1 - share)
    value = np.log(a / max(n_toxic, 1)) - np.log(b / max(n_clean, 1))
    return (np.sign(value) * np.clip(np.abs(value) - np.sqrt(1 / a + 1 / b), 0, 4)).astype(np.float32)


def learn_odds(words: Words, label: np.ndarray, rows: np.ndarray) -> Odds:
    """From the texts ``rows``; a text counts once for each word and n-gram that it has."""
    found = np.zeros((2, len(words.keys)))
    buckets = np.zeros((2, 1 << ODDS_BITS))
    spans = [grams(words, n) for n in range(3, 7)]
    spans = [((key >> np.uint64(64 - ODDS_BITS)).astype(np.int32), there) for key, there in spans]
    for i in rows.tolist():
        own = np.unique(words.places[words.texts[i] : words.texts[i + 1]])
        found[label[i], own] += 1
        size = np.diff(words.bounds)[own] if len(own) else np.zeros(0, int)
        at = np.repeat(words.bounds[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        seen = np.concatenate([key[at][there[at]] for key, there in spans])
        buckets[label[i], np.unique(seen)] += 1
    n = np.bincount(label[rows], minlength=2)
    some = found.sum(axis=0) > 0
    return Odds(words.keys[some], log_odds(found[1, some], found[0, some], n[1], n[0]), log_odds(buckets[1], buckets[0], n[1], n[0]))


def windows(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (places of words) and texts of all windows; a text without words has none."""
    size = np.diff(texts)
    n = np.where(size > 0, 1 + np.maximum(-(-(size - WINDOW) // STRIDE), 0), 0)
    own = np.repeat(np.arange(len(size)), n)
    starts = texts[:-1][own] + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return starts, np.minimum(starts + WINDOW, texts[1:][own]), own


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Parameters ``p`` by name; inputs are the odds' features, a word vector and the mean of trigram vectors."""

    known: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, known: np.ndarray, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        size = 4 + WORD_DIM + CHAR_DIM
        p = {"words": rng.normal(0, 0.02, (len(known) + 1, WORD_DIM)), "chars": rng.normal(0, 0.02, (1 << CHAR_BITS, CHAR_DIM))}
        for way in "fb":  # columns: update gate, reset gate, candidate
            p["w" + way] = rng.normal(0, 0.4 / np.sqrt(size), (size, 3 * STATE))
            p["u" + way] = rng.normal(0, 0.6 / np.sqrt(STATE), (STATE, 3 * STATE))
            p["b" + way] = np.zeros(3 * STATE)
        p |= {"attend": rng.normal(0, 0.3, 2 * STATE), "out": rng.normal(0, 0.3, 2 * STATE), "bias": np.full(1, -1.0)}
        return cls(known, {k: v.astype(np.float32) for k, v in p.items()})

    def spots(self, words: Words) -> np.ndarray:
        """Rows of the word vectors; words without one share the last row."""
        if not len(self.known):
            return np.zeros(len(words.keys), np.int64)
        spot = np.minimum(np.searchsorted(self.known, words.keys), len(self.known) - 1)
        return np.where(self.known[spot] == words.keys, spot, len(self.known))

    def inputs(self, words: Words, odds: np.ndarray) -> np.ndarray:
        chars = np.zeros((len(words.keys), CHAR_DIM), np.float32)
        if len(words.keys):
            key, there = grams(words, 3)
            own = np.where(there[:, None], self.p["chars"][key >> np.uint64(64 - CHAR_BITS)], 0)
            at = words.bounds[:-1]
            chars = np.add.reduceat(own, at) / np.maximum(np.add.reduceat(there, at), 1, dtype=np.float32)[:, None]
        vectors = self.p["words"][self.spots(words)] * (self.spots(words) < len(self.known))[:, None]
        return np.hstack([odds, vectors, chars]).astype(np.float32)

    def gates(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates; the last row, for places after a window's end, keeps the state as it is."""
        out = {}
        for way in "fb":
            pad = np.zeros((1, 3 * STATE), np.float32)
            pad[0, :STATE] = 50
            out[way] = np.vstack([inputs @ self.p["w" + way] + self.p["b" + way], pad])
        return out

    def forward(self, gates: dict[str, np.ndarray], index: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows, given as rows of words' places (-1: none); ``keep`` takes what the way back needs."""
        n, length = index.shape
        states = np.empty((length, n, 2 * STATE), np.float32)
        for way, cut, steps in (("f", slice(0, STATE), range(length)), ("b", slice(STATE, 2 * STATE), range(length - 1, -1, -1))):
            u, table = self.p["u" + way], gates[way]
            h = np.zeros((n, STATE), np.float32)
            trace = []
            for t in steps:
                x = table[index[:, t]]
                zr = _sigmoid(x[:, : 2 * STATE] + h @ u[:, : 2 * STATE])
                z, r = zr[:, :STATE], zr[:, STATE:]
                c = np.tanh(x[:, 2 * STATE :] + (r * h) @ u[:, 2 * STATE :])
                if keep is not None:
                    trace.append((t, h, z, r, c))
                h = z * h + (1 - z) * c
                states[t, :, cut] = h
            if keep is not None:
                keep[way] = trace
        weight = states @ self.p["attend"]
        weight[(index < 0).T] = -np.inf
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep |= {"states": states, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def backward(self, index: np.ndarray, keep: dict, d_logit: np.ndarray, n_words: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the parameters above the inputs, and of each word's gates."""
        g = {"out": keep["pooled"].T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = np.outer(d_logit, self.p["out"])
        weight, states = keep["weight"], keep["states"]
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * self.p["attend"]
        d_gates = {}
        for way, cut in (("f", slice(0, STATE)), ("b", slice(STATE, 2 * STATE))):
            u = self.p["u" + way]
            d_u, d_h = np.zeros_like(u), np.zeros((len(index), STATE), np.float32)
            d_x = np.zeros((n_words + 1, 3 * STATE), np.float32)
            for t, h, z, r, c in reversed(keep[way]):
                d_h = d_h + d_states[t, :, cut]
                d_c = d_h * (1 - z) * (1 - c * c)
                d_rh = d_c @ u[:, 2 * STATE :].T
                d_zr = np.hstack([d_h * (h - c) * z * (1 - z), d_rh * h * r * (1 - r)])
                d_u[:, : 2 * STATE] += h.T @ d_zr
                d_u[:, 2 * STATE :] += (r * h).T @ d_c
                np.add.at(d_x, index[:, t], np.hstack([d_zr, d_c]))
                d_h = d_h * z + d_rh * r + d_zr @ u[:, : 2 * STATE].T
            g["u" + way], d_gates[way] = d_u, d_x[:-1]
        return g, d_gates


def _index(places: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < ends[:, None], places[np.minimum(at, len(places) - 1)], -1)


def _logits(network: Network, gates: dict[str, np.ndarray], places: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    parts = [network.forward(gates, _index(places, starts[k : k + RUN], ends[k : k + RUN])) for k in range(0, len(starts), RUN)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def _highest(logits: np.ndarray, own: np.ndarray, n: int, empty: float) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, own, logits)
    return np.where(np.isinf(out), empty, out)


@dataclass
class Model:
    """A network with its log-odds and calibration; without a network every score is ``mean``."""

    mean: float = 0.0
    network: Network | None = None
    odds: Odds | None = None
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.mean)
        words = read_words(texts)
        gates = self.network.gates(self.network.inputs(words, self.odds.features(words)))
        starts, ends, own = windows(words.texts)
        high = _highest(_logits(self.network, gates, words.places, starts, ends), own, len(texts), float(self.network.p["bias"][0]))
        return 1 / (1 + np.exp(-np.clip(self.slope * high + self.shift, -60, 60)))


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.step = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def update(self, g: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)


def loss_gradients(network: Network, words: Words, odds: np.ndarray, index: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted mean cross-entropy of some windows and its gradients; ``index`` holds places among ``words``."""
    inputs = network.inputs(words, odds)
    keep: dict = {}
    logit = network.forward(network.gates(inputs), index, keep)
    p = _sigmoid(logit)
    loss = float((weight * (np.logaddexp(0, logit) - target * logit)).sum() / weight.sum())
    g, d_gates = network.backward(index, keep, (weight * (p - target) / weight.sum()).astype(np.float32), len(words.keys))
    d_inputs = np.zeros_like(inputs)
    for way in "fb":
        g["w" + way], g["b" + way] = inputs.T @ d_gates[way], d_gates[way].sum(axis=0)
        d_inputs += d_gates[way] @ network.p["w" + way].T
    spot = network.spots(words)
    g["words"] = np.zeros_like(network.p["words"])
    np.add.at(g["words"], spot, d_inputs[:, 4 : 4 + WORD_DIM])
    g["words"][-1] = 0
    key, there = grams(words, 3)
    n = np.maximum(np.add.reduceat(there, words.bounds[:-1]), 1, dtype=np.float32) if len(words.keys) else np.ones(0, np.float32)
    each = np.repeat(d_inputs[:, 4 + WORD_DIM :] / n[:, None], np.diff(words.bounds), axis=0)
    g["chars"] = np.zeros_like(network.p["chars"])
    np.add.at(g["chars"], (key >> np.uint64(64 - CHAR_BITS))[there].astype(np.int64), each[there])
    return loss, g


def _subset(words: Words, chosen: np.ndarray) -> Words:
    size = np.diff(words.bounds)[chosen]
    at = np.repeat(words.bounds[chosen], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return Words(words.keys[chosen], words.letters[at], np.r_[0, np.cumsum(size)], np.zeros(0, np.int32), np.zeros(1, np.int64))


def train(texts: list[str], label: np.ndarray, shares: np.ndarray) -> Model:
    """Learns from texts and labels 0 and 1 (both there); ``shares``: for each label, how many rows one of the sample stands for."""
    words = read_words(pa.array(texts, pa.large_string()))
    rng = np.random.default_rng(5)
    fold = np.zeros(len(texts), int)
    aside = np.zeros(len(texts), bool)
    for k in (0, 1):  # both kinds are dealt alike
        own = rng.permutation(np.flatnonzero(label == k))
        fold[own] = np.arange(len(own)) % 2
        aside[own[CALIBRATION - 1 :: CALIBRATION]] = True
    learned = np.flatnonzero(~aside)
    halves = [learn_odds(words, label, learned[fold[learned] != k]).features(words) for k in (0, 1)]
    seen = np.zeros(len(words.keys), int)
    for i in learned.tolist():
        seen[np.unique(words.places[words.texts[i] : words.texts[i + 1]])] += 1
    network = Network.fresh(words.keys[seen >= KNOWN])
    adam = _Adam(network.p, 0.01)
    starts, ends, own = windows(words.texts)
    weight = np.where(label == 1, np.sqrt((label == 0).sum() / max((label == 1).sum(), 1)), 1.0).astype(np.float32)
    # at first a window's place is judged by the log-odds alone
    logits = np.zeros(len(starts))
    for k in (0, 1):
        sums = np.r_[0, np.cumsum(np.maximum(halves[k][:, :2].max(axis=1), 0)[words.places])]
        mine = fold[own] == k
        logits[mine] = (sums[ends] - sums[starts])[mine]
    epoch, epochs = 0, EPOCHS
    while epoch < epochs:
        order = np.lexsort((-logits, own))
        rank = np.arange(len(order)) - np.searchsorted(own[order], own[order])
        taken = order[(rank < np.where(label[own[order]] == 1, 1, CLEAN_WINDOWS)) & ~aside[own[order]]]
        taken = rng.permutation(taken)
        epochs = max(EPOCHS, -(-UPDATES * BATCH // max(len(taken), 1)))
        for k in (0, 1):
            part = taken[fold[own[taken]] == k]
            for at in range(0, len(part), BATCH):
                some = part[at : at + BATCH]
                index = _index(words.places, starts[some], ends[some])
                chosen, local = np.unique(index, return_inverse=True)
                local = local.reshape(index.shape)
                if chosen[0] < 0:
                    chosen, local = chosen[1:], local - 1
                _, g = loss_gradients(network, _subset(words, chosen), halves[k][chosen], local, label[own[some]], weight[own[some]])
                adam.rate = 0.01 * (1 - epoch / (epochs + 1))
                adam.update(g)
        epoch += 1
        for k in (0, 1):
            mine = np.flatnonzero(fold[own] == k)
            gates = network.gates(network.inputs(words, halves[k]))
            logits[mine] = _logits(network, gates, words.places, starts[mine], ends[mine])
    odds = learn_odds(words, label, learned)
    gates = network.gates(network.inputs(words, odds.features(words)))
    kept = aside[own]
    high = _highest(_logits(network, gates, words.places, starts[kept], ends[kept]), own[kept], len(texts), float(network.p["bias"][0]))
    rows = np.flatnonzero(aside) if len(np.unique(label[aside])) == 2 else np.arange(len(texts))
    if len(rows) == len(texts):
        high = _highest(_logits(network, gates, words.places, starts, ends), own, len(texts), float(network.p["bias"][0]))
    slope, shift = calibrate(high[rows], label[rows], shares[label[rows]])
    return Model(float(label.mean()), network, odds, slope, shift)


def calibrate(logit: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """A weighted logistic fit of labels to logits by Newton's method, with targets drawn in by one row on each side."""
    n = np.array([weight[label == k].sum() for k in (0, 1)])
    target = np.where(label == 1, (n[1] + weight.mean()) / (n[1] + 2 * weight.mean()), weight.mean() / (n[0] + 2 * weight.mean()))
    theta = np.array([1.0, np.log(n[1] / n[0])])
    x = np.column_stack([logit, np.ones(len(logit))]).astype(float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -60, 60)))
        slope = x.T @ (weight * (p - target)) + [1e-3 * (theta[0] - 1), 0]
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta -= step / max(1.0, float(np.abs(step).max()))
    return max(float(theta[0]), 1e-3), float(theta[1])


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """Learns from the columns ``doc_id``, ``text`` and ``toxic`` (0 or 1) of a bounded sample of labels, drawn by a hash of their ids.

    Only the sample's ids meet the texts, and are few enough to be sent to them.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(float(max(counts, default=0)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30))
    share = [min(1.0, bound / counts[k]) for k, bound in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC))]
    taken = usable.filter(draw < F.when(F.col("toxic") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30))))
    texts = documents.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(taken), "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("at", F.xxhash64("doc_id")).toArrow()
    rows = rows.sort_by([("at", "ascending"), ("toxic", "ascending")])
    label = np.asarray(rows["toxic"], np.int64)
    if len(np.unique(label)) < 2:
        return Model(counts[1] / (counts[0] + counts[1]))
    return train(rows["text"].to_pylist(), label, 1 / np.array(share))


def score(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row, in one pass over the whole texts."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.scores(part.column(1)))], names=["doc_id", "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def held_out() -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labelled documents that are not held out, and scores all; toxic from 0.3 on."""
    scored = score(documents, learn(documents, labels.filter(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
