"""Quality classifier: supervised subword embeddings.

Words and character 3- and 4-grams inside words (the neighbouring white space marks the word's ends) and the mark of a word that repeats the one before are hashed
into ``buckets`` learned vectors; a document is the average of its vectors over all occurrences, and a softmax
layer gives the class. Fitted by stochastic gradient descent in numpy on a bounded sample. Scoring uses whole
texts: the softmax of an average is a function of the average of one number per bucket, which is broadcast.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .labelled import sample, score

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_AGAIN = np.uint64(0xD6E8FEB86659FD93)
_POWER = np.cumprod(np.full(64, _B, np.uint64))
# Texts are read in pieces of about this many bytes, cut at white space, so memory does not grow with a text.
_PIECE = 1 << 20


@dataclass(frozen=True)
class Model:
    """``weight``: per bucket the difference of the two classes' scores; ``bias``: that of the output layer."""

    weight: np.ndarray
    bias: float
    bits: int

    def score(self, data: bytes) -> float:
        total, n = 0.0, 0
        for piece in _pieces(data):
            at = features(piece, self.bits)
            total, n = total + float(self.weight[at].sum(dtype=np.float64)), n + len(at)
        return float(1.0 / (1.0 + np.exp(-np.clip(total / max(n, 1) + self.bias, -60, 60))))


def _pieces(data: bytes):
    start = 0
    while start < len(data):
        stop = min(len(data), start + _PIECE)
        while stop < len(data) and data[stop] not in b" \t\n\r\x0b\x0c" and stop < start + 2 * _PIECE:
            stop += 1
        yield data[start:stop]
        start = stop


def features(data: bytes, bits: int) -> np.ndarray:
    """Bucket of every word and every 3- and 4-gram of UTF-8 bytes, repeats included."""
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    gap = _SPACE[raw]
    shift = np.uint64(64 - bits)
    v = raw.astype(np.uint64) + np.uint64(1)
    v[gap] = np.uint64(33)
    two = v[:-1] * np.uint64(257) + v[1:]
    three = two[:-1] * np.uint64(257) + v[2:]
    four = three[:-1] * np.uint64(257) + v[3:]
    inner = ~gap
    ok3 = inner[1:-1]
    ok4 = inner[1:-2] & inner[2:-1]
    out = [((three[ok3] + np.uint64(3 << 40)) * _A) >> shift, ((four[ok4] + np.uint64(4 << 40)) * _A) >> shift]
    edge = np.flatnonzero(inner[1:] & gap[:-1]) + 1
    if len(edge):
        place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], edge]), np.diff(np.concatenate([[0], edge, [len(raw)]])))
        term = np.where(inner, v * _POWER[place & 63], np.uint64(0))
        words = np.add.reduceat(term, edge)
        words = (words ^ (words >> np.uint64(31))) * _A
        again = np.flatnonzero(words[1:] == words[:-1])
        out.append(words >> shift)
        # A word right after itself is one more feature, the same for all words.
        out.append(np.full(len(again), _AGAIN >> shift))
    return np.concatenate(out).astype(np.int64)


def fit(texts: list[bytes], labels: list[int], bits: int = 16, dim: int = 10, epochs: int = 5, rate: float = 0.3, seed: int = 7) -> Model:
    """Numpy stochastic gradient descent, one document a step, classes weighted alike.

    Without documents of both classes the score is the same for all: the smoothed share of label 1.
    """
    y = np.array(labels, np.int64)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), bits)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / dim, 1.0 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    # All documents in two flat arrays, which go back to the system as a whole, unlike thousands of small ones.
    buckets, shares, ends = array("i"), array("f"), [0]
    for text in texts:
        at, n = np.unique(features(text, bits), return_counts=True)
        buckets.frombytes(at.astype(np.int32).tobytes())
        shares.frombytes((n / max(n.sum(), 1)).astype(np.float32).tobytes())
        ends.append(len(buckets))
    flat = np.frombuffer(buckets, np.int32), np.frombuffer(shares, np.float32)
    docs = [tuple(x[a:b] for x in flat) for a, b in zip(ends, ends[1:])]
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            at, n = docs[k]
            step = np.float32(rate * (1.0 - done / steps) * weight[y[k]])
            done += 1
            mean = n @ vectors[at]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1.0
            back = p @ layer
            layer -= step * np.outer(p, mean)
            bias -= step * 0.1 * p
            # Rare buckets move as far as their share of the text; the factor keeps long texts learning.
            vectors[at] -= (step * 20.0) * n[:, None] * back[None, :]
    weight_of = (vectors @ (layer[1] - layer[0])).astype(np.float32)
    return Model(weight_of, float(bias[1] - bias[0]), bits)


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = 2000, max_chars: int = 50_000) -> Model:
    return fit(*sample(docs, labels, "quality", may_learn, per_class, max_chars))


def keep_good(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The documents with a score of ``least`` or more, columns unchanged."""
    (name,) = fresh(docs, "_quality")
    return score(docs, model, name).where(F.col(name) >= least).drop(name)
