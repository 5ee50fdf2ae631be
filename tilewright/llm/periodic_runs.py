"""Periodic runs of the words of a text, by longest common extensions on suffix trees.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal), at least ``max(least, 2 * q)``
words long, that no neighbouring word extends. Every run holds, for the order of words or for the inverse order, a
longest Lyndon word that begins inside it and has the length of its period. So the candidates are the longest Lyndon
words at every position in both orders. They follow from the order of the suffixes, which the leaves of the suffix tree
give. Each candidate is extended to the right on the tree of the words and to the left on the tree of the
reversed words; both extensions are lowest common ancestors, read off the tour of the tree in constant time.

Only stretches that can hold a run go into the trees. With ``least >= 12``, each six words of a run, or all but the
few at its middle, come again inside the run, and those that do cover it. So a stretch is a maximal range of
words covered by groups of six words that come again in it. The check drops no run, whatever the text.

Everything happens inside a row: there is no shuffle, and the work of a text is linear, but for sorting, in its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import flat_texts, fresh, text_of, text_slices, words_of

# Words that must come again. Any number up to six is safe for runs of 12 words or more.
GRAM = 6
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

MADE = StructType([
    StructField("n_words", LongType()),
    StructField("runs", ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))),
    StructField("collapsed", StringType()),
])


class SuffixTree:
    """Ukkonen's tree of a list of symbols whose last one is unique.

    An inner node stands for ``symbols[pos:pos + depth]``. A leaf is the complement of where its suffix begins.
    ``child`` maps ``node * width + symbol`` to a node, so the tree is two lists and one dictionary.
    """

    def __init__(self, symbols: list[int], width: int) -> None:
        pos, depth, link, child = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, symbol in enumerate(symbols):
            fresh_node = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                key = node * width + symbols[edge]
                below = child.get(key)
                if below is None:
                    child[key] = ~(i - waiting + 1)
                    if fresh_node:
                        link[fresh_node] = node
                        fresh_node = 0
                else:
                    at = depth[node]
                    if below >= 0:
                        span = depth[below] - at
                        if length >= span:
                            edge += span
                            length -= span
                            node = below
                            continue
                        first = pos[below] + at
                    else:
                        first = ~below + at
                    if symbols[first + length] == symbol:
                        length += 1
                        if fresh_node:
                            link[fresh_node] = node
                        break
                    inner = len(pos)
                    pos.append(first - at)
                    depth.append(at + length)
                    link.append(0)
                    child[key] = inner
                    child[inner * width + symbols[first + length]] = below
                    child[inner * width + symbol] = ~(i - waiting + 1)
                    if fresh_node:
                        link[fresh_node] = inner
                    fresh_node = inner
                waiting -= 1
                if not node and length:
                    length -= 1
                    edge = i - waiting + 1
                elif node:
                    node = link[node]
        self.size, self.width, self.depth = len(symbols), width, depth
        self.keys = np.fromiter(child.keys(), np.int64, len(child))
        self.ends = np.fromiter(child.values(), np.int64, len(child))

    def tour(self, inverse_above: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in the order of the leaves, depth of the lowest node between each leaf and the one before).

        With ``inverse_above``, symbols from there on are taken in inverse order; smaller ones stay in front.
        The depths are what an Euler tour shows at its lowest between two neighbouring leaves.
        """
        keys = self.keys
        if inverse_above is not None:
            parent, symbol = keys // self.width, keys % self.width
            keys = parent * self.width + np.where(symbol < inverse_above, symbol, inverse_above + self.width - 1 - symbol)
        order = np.argsort(keys)
        parents = keys[order] // self.width
        starts = np.searchsorted(parents, np.arange(len(self.depth) + 1)).tolist()
        below, depth = self.ends[order].tolist(), self.depth
        leaves, lows = [], []
        stack, marks = [0], [0]
        while stack:
            node, low = stack.pop(), marks.pop()
            if node < 0:
                leaves.append(~node)
                lows.append(low)
                continue
            a, b = starts[node], starts[node + 1]
            if b - a > 1:
                stack.extend(below[b - 1:a:-1])
                marks.extend([depth[node]] * (b - a - 1))
            stack.append(below[a])
            marks.append(low)
        return np.array(leaves, np.int64), np.array(lows, np.int32)


class Extension:
    """Longest common extensions to the right of pairs of positions, in constant time each, from a tree's tour."""

    def __init__(self, leaves: np.ndarray, lows: np.ndarray) -> None:
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        levels = [lows]
        step = 1
        while 2 * step <= len(lows):
            last = levels[-1]
            # Padded at the end, where no range of this length begins.
            levels.append(np.concatenate([np.minimum(last[:-step], last[step:]), last[-step:]]))
            step *= 2
        self.levels = np.stack(levels)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols from positions ``a`` and ``b`` on; the positions of a pair differ."""
        low, high = self.rank[a], self.rank[b]
        low, high = np.minimum(low, high) + 1, np.maximum(low, high)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.levels[level, low], self.levels[level, high - (1 << level) + 1]).astype(np.int64)


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each position the next one with a smaller rank; the length of the list where there is none."""
    found = [len(rank)] * len(rank)
    stack: list[int] = []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            found[stack.pop()] = i
        stack.append(i)
    return np.array(found, np.int64)


def runs_of(stretches: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, length, period) of all runs of several stretches of word numbers, ordered and distinct.

    The stretches stand in one pair of trees, each between symbols that occur once, which nothing extends across.
    """
    marks = len(stretches) + 1
    sizes = np.array([len(x) for x in stretches], np.int64)
    _, dense = np.unique(np.concatenate(stretches), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.empty(int(sizes.sum()) + marks, np.int64)
    is_mark = np.zeros(len(symbols), bool)
    is_mark[first] = True
    symbols[is_mark] = np.arange(marks)
    symbols[~is_mark] = dense + marks
    n, width = len(symbols), marks + int(dense.max()) + 1
    tree = SuffixTree(symbols[::-1].tolist(), width)
    left = Extension(*tree.tour())
    tree = SuffixTree(symbols.tolist(), width)
    leaves, lows = tree.tour()
    right = Extension(leaves, lows)
    inverse = np.empty(n, np.int64)
    inverse[tree.tour(inverse_above=marks)[0]] = np.arange(n)
    del tree
    at = np.flatnonzero(~is_mark)
    begins, ends = [], []
    for rank in (right.rank, inverse):
        i, j = at, _next_smaller(rank.tolist())[at]
        ahead = right(i, j)
        behind = left(n - i, n - j)
        period = j - i
        keep = ahead + behind >= period
        begins.append(np.stack([(i - behind)[keep], (j + ahead)[keep], period[keep]], axis=1))
    found = np.unique(np.concatenate(begins), axis=0)
    found = found[found[:, 1] - found[:, 0] >= np.maximum(least, 2 * found[:, 2])]
    stretch = np.searchsorted(first, found[:, 0], "right") - 1
    return stretch, found[:, 0] - first[stretch] - 1, found[:, 1] - found[:, 0], found[:, 2]


def _gram_hashes(codes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """One number per group of ``GRAM`` words; equal groups of words of one group of positions have equal numbers."""
    count = len(codes) - GRAM + 1
    mixed = group[:count].astype(np.uint64) * _MIX
    for k in range(GRAM):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _ODD + codes[k:k + count].astype(np.uint64)
    return mixed


def stretches_of(codes: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the ranges of words that can hold a run. ``owner`` numbers the texts, never falling."""
    low, high = np.flatnonzero(np.diff(owner, prepend=-1)), None
    high = np.append(low[1:], len(owner))
    gram = GRAM if least >= 2 * GRAM else 1
    total = -1
    while len(low) and total != (total := int((high - low).sum())):
        sizes = high - low
        # Only words of open stretches are looked at again.
        at = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)
        group = np.repeat(np.arange(len(low)), sizes)
        if total < gram:
            return low[:0], high[:0]
        part = codes[at]
        if gram == 1:
            hashes = group.astype(np.uint64) * _MIX ^ (part.astype(np.uint64) * _ODD)
        else:
            hashes = _gram_hashes(part, group)
        inside = group[:len(hashes)] == group[gram - 1:]
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        again = np.zeros(len(hashes), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        again &= inside
        cover = np.zeros(total + 1, np.int32)
        cover[:len(hashes)] += again
        cover[gram:gram + len(hashes)] -= again
        covered = np.cumsum(cover)[:-1] > 0
        begins = covered & ~(np.concatenate([[False], covered[:-1]]) & (group == np.concatenate([[-1], group[:-1]])))
        stops = covered & ~(np.concatenate([covered[1:], [False]]) & (group == np.concatenate([group[1:], [-1]])))
        low, high = at[begins], at[stops] + 1
        long = high - low >= least
        low, high = low[long], high[long]
    return low, high


def _solve(words: pa.Array, first: np.ndarray, least: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """(runs, words that stay, joined by a blank) of each text."""
    coded = words.dictionary_encode()
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    texts = len(first) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(texts)]
    gone = np.zeros(len(codes) + 1, np.int32)
    if len(codes):
        low, high = stretches_of(codes, owner, least)
        if len(low):
            which, start, length, period = runs_of([codes[a:b] for a, b in zip(low, high)], least)
            start = start + low[which]
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            text = owner[start]
            order = np.lexsort((period, start))
            rows = zip(text[order].tolist(), (start - first[text])[order].tolist(), length[order].tolist(), period[order].tolist())
            for t, *run in rows:
                runs[t].append(tuple(run))
    kept = np.cumsum(gone)[:-1] == 0
    stay = words.filter(pa.array(kept)) if not kept.all() else words
    count = np.concatenate([[0], np.cumsum(kept)])
    lengths = np.diff(np.frombuffer(stay.buffers()[1], np.int64, len(stay) + 1, stay.offset * 8))
    solid = np.frombuffer(stay.buffers()[2], np.uint8) if len(stay) else np.empty(0, np.uint8)
    begin = int(np.frombuffer(stay.buffers()[1], np.int64, 1, stay.offset * 8)[0]) if len(stay) else 0
    # Every word is followed by a blank; the last one of a text is cut off again.
    ends = np.cumsum(lengths + 1)
    spread = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    is_blank = np.zeros(len(spread), bool)
    is_blank[ends - 1] = True
    spread[~is_blank] = solid[begin:begin + int(lengths.sum())]
    ends = np.concatenate([[0], ends])
    whole = spread.tobytes()
    joined = [whole[ends[a]:max(ends[a], ends[b] - 1)] for a, b in zip(count[first[:-1]], count[first[1:]])]
    return runs, joined


def find_runs(docs: DataFrame, text: str | Column = "text", least: int = 12, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` and, of the whole text, ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` holds start (word number from 0), length and period of every run, by start, then period. ``collapsed``
    is the words joined by one blank, without those that any run holds after its first period. A null text has
    no words. Columns of ``docs`` with these names that are kept are replaced. Rows keep nothing of each other, so
    repeated rows and ids give repeated results. A text takes about 1 kB of memory per word of its stretches.
    """
    made = MADE.names
    fields = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = docs.select(*fields, text_of(text).alias(fresh(docs, "_whole")[0]))
    names = [*fields, *made]
    schema = StructType([*docs.select(*fields).schema.fields, *MADE.fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_texts(batch.column(len(fields)))
            for start, stop in text_slices(offsets):
                words, first = words_of(data, offsets[start:stop + 1])
                runs, joined = _solve(words, first, least)
                sizes = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])
                made = [pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), values).cast(kind), pa.array(joined, pa.binary()).cast(pa.string())]
                kept = [c.slice(start, stop - start) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    return rows.mapInArrow(run, schema)


def with_planted_run(doc_id: str, text: str) -> Column:
    """The text in which every tenth document, by crc32 of its id, repeats a part of itself to its end.

    With ``h = crc32(id)``, ``g = h // 10``, n words, ``a = g % n`` and ``p = 1 + (n - a) // (3 + g % 8)``: where
    ``h % 10 = 0``, each word i from a on becomes word ``a + (i - a) % p``. Others, texts without words and rows
    without an id stay.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.filter(F.split(text_of(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def edited(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        repeated = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int"))))
        return F.when(n > 0, F.array_join(repeated, " ")).otherwise(text_of(text))

    # The words are bound once, so that they are not cut again for every word.
    once = F.transform(F.array(words), edited)[0]
    return F.when(F.pmod(h, F.lit(10)) == 0, once).otherwise(text_of(text))
