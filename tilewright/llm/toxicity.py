"""Toxicity: class-conditional Kneser-Ney models.

Each class has interpolated bigrams over continuation unigrams over word beginnings (the first four characters).
Expressions that both classes together have ``rare`` times or less keep no mass of their own: it goes to the backoff
counts that both classes share, so that they count for neither. The mean log-likelihood ratio per token, toxic over ordinary,
is mapped to a probability by a logistic curve fitted on texts that were kept out of the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from .labelled import sample

DISCOUNT = 0.75
# A log ratio of two counts within so many standard errors of 0 is taken for chance and counts as 0.
ERRORS = 3.0
START = b"\x00"
_TO_SPACE = bytes.maketrans(bytes(range(33)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x7f", b" " * (33 + 33))
_PIECE = 1 << 20


def tokens(data: bytes) -> list[bytes]:
    """Lower-case words; ASCII punctuation and white space part them."""
    return data.decode("utf-8", "replace").lower().encode().translate(_TO_SPACE).split()


def beginning(word: bytes) -> bytes:
    return word.decode("utf-8", "replace")[:4].encode()


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios: per word, per word beginning, per kept bigram and per context's backoff."""

    words: dict[bytes, int]
    starts: dict[bytes, float]
    unseen: float
    word_ratio: np.ndarray
    context: np.ndarray
    pair_keys: np.ndarray
    pair_ratio: np.ndarray
    slope: float
    offset: float

    def ratio(self, data: bytes) -> float:
        """Mean log-likelihood ratio per token; 0 for a text without words."""
        total, n, last = 0.0, 0, 0
        for piece in _pieces(data):
            found = tokens(piece)
            if found:
                part, last = self._sum(found, last)
                total, n = total + part, n + len(found)
        return total / n if n else 0.0

    def _sum(self, found: list[bytes], last: int) -> tuple[float, int]:
        ids = np.array([self.words.get(w, -1) for w in found], np.int64)
        single = self.word_ratio[ids]
        for k in np.flatnonzero(ids < 0):
            single[k] = self.starts.get(beginning(found[k]), self.unseen)
        before = np.concatenate([[last], ids[:-1]])
        value = single + np.where(before >= 0, self.context[before], 0.0)
        if len(self.pair_keys):
            key = before * len(self.word_ratio) + ids
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = (self.pair_keys[at] == key) & (before >= 0) & (ids >= 0)
            value = np.where(hit, self.pair_ratio[at], value)
        return float(value.sum()), int(ids[-1])

    def score(self, data: bytes) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.ratio(data) + self.offset, -60, 60))))


def _pieces(data: bytes):
    start = 0
    while start < len(data):
        stop = min(len(data), start + _PIECE)
        while stop < len(data) and data[stop] not in b" \t\n\r" and stop < start + 2 * _PIECE:
            stop += 1
        yield data[start:stop]
        start = stop


def _own(counts: np.ndarray, total: np.ndarray | float, kept: np.ndarray) -> np.ndarray:
    """Discounted share per item; items that are not kept have none."""
    return np.where(kept, np.maximum(counts - DISCOUNT, 0.0), 0.0) / np.maximum(total, 1)


def _texts_with(streams: list[np.ndarray], size: int) -> np.ndarray:
    """In how many texts each number stands."""
    return np.bincount(np.concatenate([np.unique(x) for x in streams] or [np.zeros(0, np.int64)]), minlength=size)


def _sure(ratio: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Log ratios as they are where they exceed ``ERRORS`` standard errors of their counts, else 0."""
    error = np.sqrt(1.0 / (one + 0.5) + 1.0 / (other + 0.5))
    return np.where(np.abs(ratio) > ERRORS * error, ratio, 0.0)


def count_models(texts: list[bytes], labels: list[int], rare: int = 5, rare_pairs: int = 30) -> Model:
    """Models of both classes from token counts; the logistic curve is left at slope 1 and offset 0."""
    words: dict[bytes, int] = {START: 0}
    streams: list[list[np.ndarray]] = [[], []]
    for text, y in zip(texts, labels):
        ids = [0] + [words.setdefault(w, len(words)) for w in tokens(text)]
        streams[y].append(np.array(ids, np.int64))
    size = len(words)
    start_no: dict[bytes, int] = {}
    start_of = np.array([start_no.setdefault(beginning(w), len(start_no)) for w in words], np.int64)
    pairs = [np.unique(np.concatenate([s[:-1] * size + s[1:] for s in side]), return_counts=True) for side in streams]
    # Continuation counts: in how many different contexts a word, or a word with such a beginning, stands.
    spread = [np.bincount(k % size, minlength=size).astype(np.float64) for k, _ in pairs]
    begun = [np.bincount(start_of, weights=x, minlength=len(start_no)) for x in spread]
    both, both_begun = spread[0] + spread[1], begun[0] + begun[1]
    share = 0.5 / (both_begun.sum() + 0.5 * (len(start_no) + 1))
    shared_start = both_begun / both_begun.sum() * (1 - share * (len(start_no) + 1)) + share
    in_start = both / np.maximum(both_begun[start_of], 1)
    single, at_start, unseen = [], [], []
    for y in (0, 1):
        own0 = _own(begun[y], begun[y].sum(), both_begun > rare)
        rest0 = 1.0 - own0.sum()
        level0 = own0 + rest0 * shared_start
        own1 = _own(spread[y], spread[y].sum(), both > rare)
        rest1 = 1.0 - own1.sum()
        single.append(own1 + rest1 * level0[start_of] * in_start)
        at_start.append(rest1 * level0)
        unseen.append(rest1 * rest0 * share)
    # Chance is judged by the number of texts, as a text may say the same word again and again.
    seen = [_texts_with(side, size) for side in streams]
    begun_in = [_texts_with([start_of[x] for x in side], len(start_no)) for side in streams]
    word_ratio = _sure(np.log(np.maximum(single[1], 1e-300)) - np.log(np.maximum(single[0], 1e-300)), seen[1], seen[0])
    start_ratio = _sure(np.log(at_start[1]) - np.log(at_start[0]), begun_in[1], begun_in[0])
    every = np.unique(np.concatenate([k for k, _ in pairs]))
    counts = np.zeros((2, len(every)))
    for y, (k, c) in enumerate(pairs):
        counts[y, np.searchsorted(every, k)] = c
    chosen = counts.sum(axis=0) > rare_pairs
    context = []
    at_pair = []
    for y in (0, 1):
        total = np.bincount(every // size, weights=counts[y], minlength=size)
        own2 = _own(counts[y], total[every // size], chosen)
        back = 1.0 - np.bincount(every // size, weights=own2, minlength=size)
        context.append(np.maximum(back, 1e-9))
        at_pair.append(own2[chosen])
    keys = every[chosen]
    h, w = keys // size, keys % size
    pair_ratio = np.log(at_pair[1] + context[1][h] * single[1][w]) - np.log(at_pair[0] + context[0][h] * single[0][w])
    in_texts = [_texts_with([np.searchsorted(every, np.unique(x[:-1] * size + x[1:])) for x in side], len(every))[chosen] for side in streams]
    pair_ratio = _sure(pair_ratio, in_texts[1], in_texts[0])
    back_ratio = np.log(context[1]) - np.log(context[0])
    back_ratio = _sure(back_ratio, seen[1], seen[0])
    # Words that are rare say what their beginnings say; leaving them out keeps the table small.
    held = both > rare
    held[0] = True
    held[h] = held[w] = True
    new, n = np.cumsum(held) - 1, int(held.sum())
    remade = new[h] * n + new[w]
    order = np.argsort(remade)
    return Model(
        {x: int(new[i]) for x, i in words.items() if held[i]}, {x: float(start_ratio[i]) for x, i in start_no.items()},
        float(np.log(unseen[1]) - np.log(unseen[0])), word_ratio[held], back_ratio[held], remade[order], pair_ratio[order], 1.0, 0.0,
    )


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton steps for one slope and one offset."""
    scale = max(float(np.std(x)), 1e-9)
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ b, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        b += np.clip(np.linalg.solve(hessian, z.T @ (y - p) - ridge * b), -2, 2)
    return float(b[0] / scale), float(b[1])


def fit(texts: list[bytes], labels: list[int], rare: int = 5) -> Model:
    """Counts from three of four texts, the curve from the fourth. With one class only, or none, all scores are alike."""
    y = np.array(labels, np.int64)
    aside = np.arange(len(y)) % 4 == 3
    inner = ~aside
    if len(set(y[aside])) < 2 or len(set(y[inner])) < 2:
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        empty = np.zeros(0)
        return Model({START: 0}, {}, 0.0, np.zeros(1), np.zeros(1), empty.astype(np.int64), empty, 0.0, float(np.log(share / (1 - share))))
    model = count_models([texts[k] for k in np.flatnonzero(inner)], [labels[k] for k in np.flatnonzero(inner)], rare)
    x = np.array([model.ratio(texts[k]) for k in np.flatnonzero(aside)])
    slope, offset = _logistic(x, y[aside])
    return Model(**{**model.__dict__, "slope": slope, "offset": offset})


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = 4000, max_chars: int = 50_000) -> Model:
    """A model of at most ``per_class`` texts of either label; the sample's rows of a class are spread evenly over both uses."""
    texts, found = sample(docs, labels, "toxic", may_learn, per_class, max_chars)
    return fit(texts, found)
