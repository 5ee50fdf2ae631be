"""Hidden Markov language model: exact log-likelihoods of whole texts.

Tokens are words (ASCII lower case) and one end per text. The ``FREQUENT`` most frequent training words, seen
``OFTEN`` times or more, are symbols of their own; a rarer word is the symbol of its last three bytes times its share of that symbol, known
words discounted (Good-Turing) in favour of one unknown word per symbol. So the forward recursion needs only a
table of bounded size, and the counts of rare words, which grow with the corpus, meet the texts in one join whose
keys cannot be hot: all frequent words have left it.

Training: Baum-Welch. A sample of bounded size gives the start; then rounds over all training texts until they settle,
expected counts are summed per partition and then by Spark, and the driver divides them. In training a text is
taken in pieces of ``SEGMENT`` tokens, later pieces starting from the stationary mix; scoring never cuts a text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, text_of, written

FREQUENT, SUFFIXES = 32_000, 1_024
# A word of its own occurs so often at least.
OFTEN = 5
SYMBOLS = 1 + FREQUENT + SUFFIXES
SEGMENT = 256
# Tokens of a text that the start sees, and the rounds over all texts.
START_TOKENS, MOST_ROUNDS, GAIN = 2_000, 100, 1e-3
_WORDS_HELD = 400_000
_CELLS = 200_000


def suffix_symbol(word: bytes) -> int:
    return 1 + FREQUENT + zlib.crc32(word[-3:]) % SUFFIXES


def _words(rows: DataFrame) -> DataFrame:
    """``word, n`` of ``rows(text)``: counts of words, summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = iter(counts.items())
            while part := list(islice(items, 50_000)):
                words, numbers = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(numbers, pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for text in byte_values(batch.column(0)):
                counts.update(text.lower().split())
                if len(counts) > _WORDS_HELD:
                    yield from out()
        yield from out()

    return rows.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Counts:
    """Corpus counts: ``table`` (word, n) of all words; totals; the frequent words; per suffix symbol tokens and types."""

    table: DataFrame
    texts: int
    tokens: int
    types: int
    frequent: dict[bytes, int]
    frequent_n: np.ndarray
    suffix_tokens: np.ndarray
    suffix_types: np.ndarray
    discount: float

    def base(self, n):
        """log10 of the smoothed share of a token with count ``n``."""
        return np.log10((n + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def count_corpus(rows: DataFrame) -> Counts:
    """Counts over all of ``rows(text)``."""
    table = written(_words(rows), "word-counts")
    texts = rows.count()
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # At most FREQUENT words come to the driver.
    top = table.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    words, numbers = top.column(0).to_pylist(), top.column(1).to_numpy()
    suffix = F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(SUFFIXES)).cast("int")
    own = F.broadcast(table.sparkSession.createDataFrame(top.select(["word"]))) if words else table.select("word")
    rare = table.join(own, "word", "left_anti").groupBy(suffix.alias("s")).agg(
        F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")
    )
    tokens, types, once, twice = np.zeros(SUFFIXES), np.zeros(SUFFIXES), 0, 0
    for r in rare.collect():
        tokens[r.s], types[r.s] = r.n, r.v
        once, twice = once + r.once, twice + r.twice
    discount = float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once else 0.5
    return Counts(table, texts, total.n + texts, total.v + (texts > 0), {w: k + 1 for k, w in enumerate(words)}, numbers, tokens, types, discount)


def encode(rows: DataFrame, counts: Counts) -> DataFrame:
    """``row, doc_id, held_out, n_tokens, n_known, base, ids, words, times`` of ``rows(doc_id, held_out, text)``.

    ``ids``: symbols as 16-bit numbers, the end last. ``base`` and ``n_known`` cover frequent words and the end;
    ``words`` and ``times`` list the other words.
    """
    share = np.zeros(SYMBOLS)
    share[0] = counts.base(counts.texts)
    share[1:1 + len(counts.frequent_n)] = counts.base(counts.frequent_n)
    held = rows.sparkSession.sparkContext.broadcast((counts.frequent, share, counts.texts > 0))
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, ids binary, words array<binary>, times array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, shares, ended = held.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in byte_values(batch.column(2)):
                found = text.lower().split()
                ids = list(map(frequent.get, found))
                rare = Counter([w for w, k in zip(found, ids) if k is None])
                if rare:
                    own = {w: suffix_symbol(w) for w in rare}
                    ids = [own[w] if k is None else k for w, k in zip(found, ids)]
                ids.append(0)
                symbols = np.array(ids, "<u2")
                known = len(found) - rare.total() + ended
                for column, value in zip(out, (len(ids), known, float(shares[symbols].sum()), symbols.tobytes(), list(rare), list(rare.values()))):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x, t) for x, t in zip(out, types)]],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "ids", "words", "times"],
            )

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @property
    def stationary(self) -> np.ndarray:
        mix = np.full(len(self.start), 1.0 / len(self.start))
        for _ in range(200):
            mix = mix @ self.step
        return mix / mix.sum()


def first_guess(totals: np.ndarray, states: int, seed: int) -> Hmm:
    """Sticky states whose symbol shares are the corpus's, disturbed."""
    rng = np.random.default_rng(seed)
    emit = (totals + 0.1)[:, None] * rng.gamma(4.0, 0.25, (len(totals), states))
    step = np.full((states, states), 0.02 / max(states - 1, 1))
    np.fill_diagonal(step, 0.98)
    return Hmm(np.full(states, 1.0 / states), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def segments(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (symbols by time and row, lengths, whether the row begins a text), rows by falling length."""
    parts = [(len(s) - a, k, a) for k, s in enumerate(sequences) for a in range(0, len(s), SEGMENT)]
    parts = sorted(((min(n, SEGMENT), k, a) for n, k, a in parts), reverse=True)
    at = 0
    while at < len(parts):
        rows = parts[at:at + max(1, _CELLS // parts[at][0])]
        at += len(rows)
        lengths = np.array([n for n, _, _ in rows])
        block = np.zeros((lengths[0], len(rows)), np.int64)
        for j, (n, k, a) in enumerate(rows):
            block[:n, j] = sequences[k][a:a + n]
        yield block, lengths, np.array([a == 0 for _, _, a in rows])


def expected_counts(sequences: list[np.ndarray], model: Hmm, total: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """One expectation step: adds to ``total`` = (starts, transitions, emissions). Returns the log-likelihood of the pieces."""
    starts, moves, emitted = total
    likelihood = 0.0
    states, later = len(model.start), model.stationary
    shares, step = model.emit.astype(np.float32), model.step.astype(np.float32)
    # A product with ones is the sum of all states, once per state.
    back_step, ones = np.ascontiguousarray(step.T), np.ones((states, states), np.float32)
    met = np.zeros((states, states))
    for block, lengths, first in segments(sequences):
        steps, width = block.shape
        active = np.searchsorted(-lengths, -np.arange(steps), "left").tolist()
        seen = shares[block]
        forward = np.empty((steps, width, states), np.float32)
        scales = np.ones((steps, width), np.float32)
        now = np.where(first[:, None], model.start, later).astype(np.float32)
        for t in range(steps):
            n = active[t]
            if t:
                now = forward[t - 1, :n] @ step
            now *= seen[t, :n]
            scale = now @ ones
            np.maximum(scale, 1e-30, out=scale)
            np.divide(now, scale, out=forward[t, :n])
            seen[t, :n] /= scale
            scales[t, :n] = scale[:, 0]
        likelihood += float(np.log(scales).sum(dtype=np.float64))
        back = np.ones((width, states), np.float32)
        # At the end of a piece the forward values are the shares of the states already.
        for t in range(steps - 2, -1, -1):
            m = active[t + 1]
            weighted = back[:m] * seen[t + 1, :m]
            met += forward[t, :m].T @ weighted
            np.matmul(weighted, back_step, out=back[:m])
            # In place: the forward values of this time are no more needed.
            forward[t, :m] *= back[:m]
        starts += forward[0][first].sum(axis=0)
        inside = np.arange(steps)[:, None] < lengths[None, :]
        symbols, values = block[inside], forward[inside]
        for s in range(states):
            emitted[:, s] += np.bincount(symbols, weights=values[:, s], minlength=len(emitted))
    moves += met * step
    return likelihood


def maximise(total: tuple[np.ndarray, np.ndarray, np.ndarray], totals: np.ndarray) -> Hmm:
    """Shares from expected counts; symbols rare in a state lean on the corpus's shares."""
    starts, moves, emitted = total
    states = len(starts)
    prior = (totals + 0.1) / (totals + 0.1).sum()
    strength = 2000.0
    emit = (emitted + strength * prior[:, None]) / (emitted.sum(axis=0) + strength)
    return Hmm((starts + 1.0) / (starts.sum() + states), (moves + 1.0) / (moves.sum(axis=1, keepdims=True) + states), emit)


def _zeros(states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(states), np.zeros((states, states)), np.zeros((SYMBOLS, states))


def baum_welch(encoded: DataFrame, totals: np.ndarray, states: int = 8, rounds: int = 3, sample_texts: int = 1500, sample_rounds: int = 15, seed: int = 3) -> Hmm:
    """Fits on all of ``encoded(doc_id, n_tokens, ids)``.

    The start is fitted on at most ``sample_texts`` texts of any length, of each the first ``START_TOKENS``, chosen by
    a hash of the id. Then at least ``rounds`` rounds sum expected counts over every text, until a round gains less
    than ``GAIN`` of log-likelihood (natural) a token; without that after ``MOST_ROUNDS`` it raises. What comes to the
    driver has ``SYMBOLS`` rows.
    """
    model = first_guess(totals, states, seed)
    short = encoded.select("doc_id", F.substring("ids", 1, 2 * START_TOKENS).alias("ids"))
    chosen = short.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_texts).select("ids").toArrow()
    sequences = [np.frombuffer(x, "<u2") for x in chosen.column(0).to_pylist()]
    if not sequences:
        return model
    for _ in range(sample_rounds):
        total = _zeros(states)
        expected_counts(sequences, model, total)
        model = maximise(total, totals)
    names = [f"c{s}" for s in range(states)]
    schema = "place bigint, " + ", ".join(f"{n} float" for n in names)
    context = encoded.sparkSession.sparkContext
    tokens, last = totals.sum(), -np.inf
    for done in range(1, MOST_ROUNDS + 1):
        held = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total, likelihood = _zeros(states), 0.0
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    likelihood += expected_counts([np.frombuffer(x, "<u2") for x in batch.column(0).slice(k, 1000).to_pylist()], held.value, total)
            every = np.concatenate([total[2], total[1], total[0][None, :], np.full((1, states), likelihood)])
            at = np.flatnonzero(every.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(every[at, s].astype(np.float32)) for s in range(states)]], names=["place", *names])

        # A task's sums come in 32 bits and are added up in 64.
        summed = encoded.select("ids").mapInArrow(run, schema).groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        every = np.zeros((SYMBOLS + states + 2, states))
        every[summed.column(0).to_numpy()] = np.stack([summed.column(1 + s).to_numpy() for s in range(states)], axis=1)
        model = maximise((every[-2], every[SYMBOLS:SYMBOLS + states], every[:SYMBOLS]), totals)
        now = every[-1, 0] / tokens
        if done >= rounds and now - last < GAIN:
            return model
        last = now
    raise RuntimeError("training did not settle")


def log_likelihoods(sequences: list[np.ndarray], model: Hmm) -> np.ndarray:
    """log10 likelihood of each whole sequence by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    ones = np.ones((len(model.start), len(model.start)))
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        rows = order[at:at + max(1, min(512, 4 * _CELLS // max(longest, 1)))]
        at += len(rows)
        lengths = np.array([len(sequences[k]) for k in rows])
        block = np.zeros((longest, len(rows)), np.uint16)
        for j, k in enumerate(rows):
            block[:lengths[j], j] = sequences[k]
        active = np.searchsorted(-lengths, -np.arange(longest), "left").tolist()
        now, scales = np.tile(model.start, (len(rows), 1)), np.ones((longest, len(rows)))
        for t in range(longest):
            n = active[t]
            now = (now[:n] if t == 0 else now[:n] @ model.step) * model.emit[block[t, :n]]
            scale = now @ ones
            now /= scale
            scales[t, :n] = scale[:, 0]
        found = np.log10(scales).sum(axis=0)
        out[rows] = found
    return out


def score(docs: DataFrame, held_out: Column, states: int = 8, rounds: int = 3) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of ``docs(doc_id, text)``.

    Learns from rows that are not held out. A null text counts as empty and has one token, the end; a null
    ``held_out`` counts as false. Without training texts all symbols are alike.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of("text").alias("text"))
    counts = count_corpus(rows.where("not held_out").select("text"))
    encoded = written(encode(rows, counts), "symbols")
    totals = np.zeros(SYMBOLS)
    totals[0] = counts.texts
    totals[1:1 + len(counts.frequent_n)] = counts.frequent_n
    totals[1 + FREQUENT:] = counts.suffix_tokens
    model = baum_welch(encoded.where("not held_out").select("doc_id", "n_tokens", "ids"), totals, states, rounds)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [log_likelihoods([np.frombuffer(x, "<u2") for x in batch.column(1).slice(k, 2000).to_pylist()], held.value) for k in range(0, batch.num_rows, 2000)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found or [np.zeros(0)]))], names=["row", "hidden"])

    hidden = encoded.select("row", "ids").mapInArrow(run, "row bigint, hidden double")
    # Share of a rare word in its suffix symbol.
    spark = docs.sparkSession
    suffixes = F.broadcast(spark.createDataFrame(
        pa.table({"suffix": np.arange(SUFFIXES), "all_n": counts.suffix_tokens, "all_v": counts.suffix_types})
    ))
    used = encoded.select("row", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("times"))))
    suffix = F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(SUFFIXES)).cast("bigint")
    used = used.join(counts.table, "word", "left").withColumns({"suffix": suffix, "n": F.coalesce("n", F.lit(0))}).join(suffixes, "suffix")
    bottom = float(counts.tokens + 0.1 * (counts.types + 1))
    own = F.when(F.col("n") > 0, (F.col("n") - counts.discount) / F.col("all_n")).when(
        F.col("all_v") > 0, F.col("all_v") * counts.discount / F.col("all_n")
    ).otherwise(1.0)
    rare = used.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("n") + 0.1) / bottom)).alias("rare_base"),
        F.sum(F.col("times") * F.log10(own)).alias("rare_score"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    return (
        encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base").join(hidden, "row").join(rare, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
            (F.col("hidden") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
        )
    )
