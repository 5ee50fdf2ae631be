"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A document leaks an item if ``WINDOW`` neighbouring tokens of both agree in all but ``ERRORS`` places. The window
is cut into ``ERRORS + 2`` blocks; so many errors leave two blocks untouched, and one mask per pair of blocks,
ignoring all other places, finds every such window. Hashes of masked test and training windows are joined, and
each hit is verified token by token in the join condition. An item shorter than the window is one window of its own
size, with masks of that size and the errors that ``errors_of`` allows it. Items of fewer than ``LEAST`` tokens, which
stand in ordinary sentences by chance, are found where they make up a whole line. An item without tokens is never found.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of

WINDOW, ERRORS, LEAST = 12, 2, 5
# Windows of at least so many tokens may have one substitution; shorter ones none.
ONE_ERROR = 8
# Test windows that are broadcast at most: 1 KB each at the outside.
BROADCAST_WINDOWS = 200_000
TOKEN = r"[\p{L}\p{N}]+"


def masks(window: int = WINDOW, errors: int = ERRORS) -> list[tuple[int, ...]]:
    """Places that each mask keeps: every two of ``errors + 2`` blocks."""
    edges = [round(window * k / (errors + 2)) for k in range(errors + 3)]
    blocks = [range(a, b) for a, b in zip(edges, edges[1:])]
    return [(*a, *b) for a, b in combinations(blocks, 2)]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _seeds(words: Column, at: Column, window: int, kept: list[tuple[int, ...]]) -> Column:
    """One hash per mask of the window that begins at ``at`` (from 0)."""
    return F.array(*[
        F.xxhash64(F.lit(window), F.lit(k), *[F.get(words, at + j) for j in places]) for k, places in enumerate(kept)
    ])


def errors_of(size: int, window: int = WINDOW, errors: int = ERRORS) -> int:
    """Substitutions that a window of ``size`` tokens may have."""
    return errors if size >= window else min(errors, 1 if size >= ONE_ERROR else 0)


def _differ(size: int, left, right) -> Column:
    """In how many of ``size`` places two windows differ."""
    return sum((F.when(left(j) == right(j), 0).otherwise(1) for j in range(size)), F.lit(0))


def _near(shapes: list[tuple[int, int]], left) -> Column:
    """Whether the window of ``part`` agrees with the tokens ``left(place)`` but for the errors of its size."""
    part = lambda j: F.get("part", F.lit(j))
    (first, most), *rest = shapes
    if not rest:
        return _differ(first, left, part) <= most
    near = F.when(F.col("size") == first, _differ(first, left, part) <= most)
    for size, most in rest:
        near = near.when(F.col("size") == size, _differ(size, left, part) <= most)
    return near


def _spans(seen: DataFrame, test: DataFrame, window: int, errors: int) -> DataFrame:
    """``doc_id, item_id, q, at``: windows of ``test(item_id, words)`` in ``seen(doc_id, words)``.

    One pass over the documents probes all sizes of window that occur.
    """
    sizes = [r.n for r in test.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()]
    shapes = [(n, errors_of(n, window, errors)) for n in sorted(sizes, reverse=True)] or [(window, errors)]
    kept = {n: masks(n, most) if most else [tuple(range(n))] for n, most in shapes}
    asked = None
    for n, _ in shapes:
        mine = test.where(F.least(F.size("words"), F.lit(window)) == n)
        mine = mine.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("q")).select(
            "item_id", "q", F.lit(n).alias("size"), F.slice("words", F.col("q") + 1, n).alias("part"),
            F.explode(_seeds(F.col("words"), F.col("q"), n, kept[n])).alias("seed"),
        )
        asked = mine if asked is None else asked.union(mine)
    least = shapes[-1][0]
    places = seen.where(F.size("words") >= least).select("doc_id", "words", F.posexplode("words").alias("at", "_w"))
    places = places.where(F.col("at") <= F.size("words") - least)
    seeds = _seeds(F.col("words"), F.col("at"), least, kept[least])
    if len(shapes) > 1:
        none = F.array().cast("array<bigint>")
        fits = lambda n: F.col("at") <= F.size("words") - n
        seeds = F.concat(*[F.when(fits(n), _seeds(F.col("words"), F.col("at"), n, kept[n])).otherwise(none) for n, _ in shapes])
    hits = places.select("doc_id", "words", "at", F.explode(seeds).alias("seed"))
    if asked.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        met = hits.join(F.broadcast(asked), (hits.seed == asked.seed) & _near(shapes, lambda j: F.get("words", F.col("at") + j)))
    else:
        # Only the few windows whose seed occurs in the test set go on to be joined with their tokens.
        own = hits.select("doc_id", "at", F.slice("words", F.col("at") + 1, shapes[0][0]).alias("words"), "seed")
        met = own.join(asked.select("seed").distinct().hint("shuffle_hash"), "seed", "left_semi").alias("l")
        met = met.join(asked.alias("r"), (F.col("l.seed") == F.col("r.seed")) & _near(shapes, lambda j: F.get("words", F.lit(j))))
    return met.select("doc_id", "item_id", "q", "at")


def _whole_lines(docs: DataFrame, test: DataFrame, least: int) -> DataFrame:
    """``doc_id, item_id, q, at``: the first and the last line of a document that is an item of ``test(item_id, words)``.

    ``at`` counts tokens. Each distinct short line of a document is looked up once.
    """
    n_of = lambda key: F.when(key == "", 0).otherwise(F.size(F.split(key, " ")))
    asked = test.select("item_id", F.array_join("words", " ").alias("key"))
    if asked.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        asked = F.broadcast(asked)
    lined = docs.select("doc_id", F.transform(F.split(text_of("text"), "\n", -1), lambda x: F.array_join(tokens(x), " ")).alias("lines"))
    short = F.array_distinct(F.filter("lines", lambda k: (k != "") & (n_of(k) < least)))
    met = lined.select("doc_id", "lines", F.explode(short).alias("key")).join(asked, "key")
    first = F.array_position("lines", F.col("key")).cast("int")
    last = F.size("lines") + 1 - F.array_position(F.reverse("lines"), F.col("key")).cast("int")
    before = lambda line: F.aggregate(F.slice("lines", F.lit(1), line - 1), F.lit(0), lambda n, k: n + n_of(k))
    return met.select("doc_id", "item_id", F.lit(0).alias("q"), F.explode(F.array(before(first), before(last))).alias("at"))


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, errors: int = ERRORS) -> DataFrame:
    """``doc_id, item_id, n_windows, first_at, last_at`` for each leak: windows of the item that the document has, and
    where the first and last of them begin in it, counted in tokens.

    Null texts have no tokens; a null id is a value like others. Equal windows of one document and one item
    count once. Rows that repeat an id are taken together.
    """
    test = items.select("item_id", tokens(text_of("text")).alias("words")).where(F.size("words") > 0)
    least = min(LEAST, window)
    seen = docs.select("doc_id", tokens(text_of("text")).alias("words"))
    found = _spans(seen, test.where(F.size("words") >= least), window, errors)
    short = test.where(F.size("words") < least)
    if not short.isEmpty():
        found = found.union(_whole_lines(docs, short, least))
    spans = found.groupBy("doc_id", "item_id", "q").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    return spans.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_windows"), F.min("low").alias("first_at"), F.max("high").alias("last_at")
    )


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item, columns unchanged. A document with a null doc_id goes if one such leaks."""
    (leak,) = fresh(docs, "_leak")
    leaks = find_leaks(docs, items).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti").select(*docs.columns)
