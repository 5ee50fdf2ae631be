"""The trie of all prefixes of conversations, from double arrays per prefix shard.

1. Turns become 128-bit digests of role and text. A conversation is a row per pack of up to ``PACK`` neighbouring
   turn numbers, so a conversation of any length is spread. A prefix is named by two 64-bit sums (exclusive or) of the
   hashes of its digests with their depths; packs only pass on their sums.
2. Equal conversations become one sequence with a number of copies and the smallest conv_id. Their ids meet as
   ready strings of ranges of ids, so the digest of a large group streams through a task.
3. Prefixes are counted in sequences. Three kinds of nodes follow. *Hot* ones hold more than a fair share of sequences.
   Others whose parent is in two sequences or more are *branches*. The rest, where one sequence goes on alone, is its
   *tail*, as in the classical double array: its nodes follow from running totals and need no trie.
4. Sequences are dealt out by their first branch node. Each shard numbers its turns densely, packs BASE and CHECK, walks its
   sequences down the arrays, and adds up from the leaves.
5. Hot nodes, the root among them, are shared by shards. Their numbers are partial sums, merged over all shards; the few
   merged nodes (at most sequences / share per depth) are packed into one more double array, which adds up what lies below.

Edge cases: rows without a conv_id belong to no conversation; an empty table has no nodes, not even a root. Turns of equal
number are ordered by digest, and repeated rows are turns of their own. Role and text that are null are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast
from .common import written

# Turn numbers that stay together.
PACK = 64
# Ids of equal conversations that become one string.
RANGE = 4096
# Sequences that one double array takes, once it has all of its last first-branch node.
ARRAY_SEQUENCES = 50_000
NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, up1 bigint, up2 bigint, fp1 bigint, fp2 bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, end_rep bigint"
)


def packs_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, pack, before, turns``: turns in order as ``struct<key, n>``, and how many turns the packs before hold."""
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.floor(F.col("turn") / PACK), F.lit(-(2**62))).cast("bigint").alias("pack"),
        F.struct(F.col("turn"), F.substring(F.unhex(F.sha2(content, 256)), 1, 16).alias("key"), F.length(text).cast("bigint").alias("n")).alias("t"),
    )
    # Nulls come first in ascending order.
    packs = rows.groupBy("conv_id", "pack").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["n"].alias("n"))).alias("turns"))
    before = F.expr("coalesce(sum(size(turns)) over (partition by conv_id order by pack rows between unbounded preceding and 1 preceding), 0)")
    return packs.withColumn("before", before.cast("bigint"))


def with_borrowed_heads(packs: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation ``c - c % group`` (all if fewer, none if it is absent) instead
    of its own first h; ``h = crc32(decimal c) % (most + 1)``. The remainder has the sign of c. Columns as of ``packs_of``."""
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = packs.where((F.col("conv_id") % group == 0) & (F.col("before") < most)).groupBy(F.col("conv_id").alias("base")).agg(
        F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("before", "turns"))), lambda p: p["turns"])), 1, most).alias("head")
    )
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    rows = packs.withColumns({"base": base, "h": h}).join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h").cast("int")))
    own = F.filter("turns", lambda t, i: F.col("before") + i >= F.col("h"))
    return rows.select(
        "conv_id", "pack",
        F.when(F.col("before") == 0, F.lit(0)).otherwise(F.size("head") + F.greatest(F.col("before") - F.col("h"), F.lit(0))).cast("bigint").alias("before"),
        F.when(F.col("before") == 0, F.concat("head", own)).otherwise(own).alias("turns"), (F.col("before") == 0).alias("is_first"),
    )


def _hashes(key: Column, depth: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, depth), F.xxhash64(depth, key)


def _with_prefixes(packs: DataFrame) -> DataFrame:
    """Packs with the prefix in front (``p1, p2``, characters ``c``) and the whole sequence (``s1, s2``, length ``size``, characters ``chars``)."""
    folded = [F.aggregate(F.transform("turns", lambda t, i: _hashes(t["key"], F.col("before") + i + 1)[k]), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x)) for k in (0, 1)]
    rows = packs.withColumns({"x1": folded[0], "x2": folded[1], "xn": F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + t["n"]), "xs": F.size("turns").cast("bigint")})
    up, all_ = "over (partition by conv_id order by pack rows between unbounded preceding and 1 preceding)", "over (partition by conv_id)"
    return rows.select(
        "conv_id", "before", "turns", "is_first",
        F.expr(f"coalesce(bit_xor(x1) {up}, 0L)").alias("p1"), F.expr(f"coalesce(bit_xor(x2) {up}, 0L)").alias("p2"), F.expr(f"coalesce(sum(xn) {up}, 0L)").alias("c"),
        F.expr(f"bit_xor(x1) {all_}").alias("s1"), F.expr(f"bit_xor(x2) {all_}").alias("s2"), F.expr(f"sum(xs) {all_}").alias("size"), F.expr(f"sum(xn) {all_}").alias("chars"),
    )


def _sequences(packs: DataFrame) -> DataFrame:
    """``rep, copies, ends_sha256``: the smallest id of equal conversations, their number, and the digest of their ids in order."""
    chunks = packs.where("is_first").groupBy("s1", "s2", "size", F.floor(F.col("conv_id") / RANGE).alias("chunk")).agg(
        F.min("conv_id").alias("low"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    )
    rows = chunks.repartition("s1", "s2", "size").sortWithinPartitions("s1", "s2", "size", "chunk").select("s1", "s2", "size", "low", "n", "ids")
    names = ["rep", "copies", "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rep, copies, digest = None, None, 0, None
        for batch in batches:
            done = []
            for *name, low, n, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if name != now:
                    if now is not None:
                        done.append((rep, copies, digest.hexdigest()))
                    now, rep, copies, digest = name, low, 0, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
                copies += n
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (rep, copies, digest.hexdigest())], names=names)

    return rows.mapInArrow(run, "rep bigint, copies bigint, ends_sha256 string")


def _prefixes(packs: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row per prefix of a sequence: ``rep, copies, size, chars, d, key, n, c`` (characters up to d), ``f1, f2`` (it) and ``p1, p2`` (its parent)."""
    rows = packs.join(sequences.select(F.col("rep").alias("conv_id"), "copies"), "conv_id")
    zero = F.struct(F.col("p1").alias("f1"), F.col("p2").alias("f2"), F.col("c").alias("c"), F.expr(
        "cast(array() as array<struct<d: bigint, key: binary, n: bigint, c: bigint, f1: bigint, f2: bigint, p1: bigint, p2: bigint>>)"
    ).alias("out"))
    numbered = F.transform("turns", lambda t, i: F.struct(t["key"].alias("key"), t["n"].alias("n"), (F.col("before") + i + 1).alias("d")))

    def step(a: Column, t: Column) -> Column:
        h1, h2 = _hashes(t["key"], t["d"])
        f1, f2, c = a["f1"].bitwiseXOR(h1), a["f2"].bitwiseXOR(h2), a["c"] + t["n"]
        row = F.struct(t["d"].alias("d"), t["key"].alias("key"), t["n"].alias("n"), c.alias("c"), f1.alias("f1"), f2.alias("f2"), a["f1"].alias("p1"), a["f2"].alias("p2"))
        return F.struct(f1.alias("f1"), f2.alias("f2"), c.alias("c"), F.concat(a["out"], F.array(row)).alias("out"))

    return rows.select(F.col("conv_id").alias("rep"), "copies", "size", "chars", F.inline(F.aggregate(numbered, zero, step)["out"]))


class DoubleArray:
    """BASE and CHECK of a set of sequences of dense symbols from 1 on; the child of slot s by symbol c is ``BASE[s] + c`` if its CHECK is s.

    ``paths[k]`` is the slot of each sequence after k symbols, -1 beyond its end.
    """

    TRIES = 32

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray) -> None:
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -2, np.int64)
        self.end, self.holes = 1, []
        width = int(symbols.max()) + 1 if len(symbols) else 1
        begins = np.cumsum(sizes) - sizes
        now = np.zeros(len(sizes), np.int64)
        for level in range(int(sizes.max()) if len(sizes) else 0):
            on = np.flatnonzero(sizes > level)
            edges, which = np.unique(now[on] * width + symbols[begins[on] + level], return_inverse=True)
            now[on] = self._place(edges // width, edges % width)[which]
        self.base, self.check = self.base[:self.end], self.check[:self.end]

    def _room(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
        self.end = max(self.end, size)

    def _place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Slots of new children; ``parents`` ascend, and so do the symbols of each."""
        low = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(np.append(low, len(parents)))
        slots = np.empty(len(parents), np.int64)
        # Large families first; single children fill the holes that are left.
        for k in np.argsort(-sizes, kind="stable")[:int((sizes > 1).sum())].tolist():
            own = symbols[low[k]:low[k] + sizes[k]] - symbols[low[k]]
            start = next((h for h in self.holes[-self.TRIES:] if self._fits(h, own)), self.end)
            taken = start + own
            end = self.end
            self._room(int(taken[-1]) + 1)
            used = set(taken.tolist())
            self.holes = [h for h in self.holes if h not in used] if start < end else self.holes
            self.holes += [s for s in range(end, int(taken[-1])) if s not in used]
            slots[low[k]:low[k] + sizes[k]] = taken
            self.base[parents[low[k]]] = start - symbols[low[k]]
            self.check[taken] = parents[low[k]]
        single = low[sizes == 1]
        count = len(single)
        old = [self.holes.pop() for _ in range(min(count, len(self.holes)))]
        free = np.concatenate([np.array(old, np.int64), np.arange(self.end, self.end + count - len(old))])
        self._room(self.end + count - len(old))
        slots[single] = free
        self.base[parents[single]] = free - symbols[single]
        self.check[free] = parents[single]
        return slots

    def _fits(self, start: int, own: np.ndarray) -> bool:
        taken = start + own
        inside = taken[taken < self.end]
        return bool((self.check[inside] == -1).all())

    def walk(self, symbols: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per depth from 1 on: (sequences that go so far, their slots), found through BASE and CHECK alone."""
        begins = np.cumsum(sizes) - sizes
        now = np.zeros(len(sizes), np.int64)
        for level in range(int(sizes.max()) if len(sizes) else 0):
            on = np.flatnonzero(sizes > level)
            slots = self.base[now[on]] + symbols[begins[on] + level]
            if not np.array_equal(self.check[slots], now[on]):
                raise ValueError("a sequence is not in its double array")
            now[on] = slots
            yield on, slots


def _ragged(batch: pa.Table, column: str) -> tuple[pa.StructArray, np.ndarray]:
    lists = batch.column(column).combine_chunks()
    return lists.flatten(), np.asarray(lists.value_lengths())


def _shard_nodes(rows: pa.Table) -> pa.RecordBatch:
    """Nodes below the hot ones of sequences that share no further node with others.

    ``rows``: ``rep, copies, size, chars, f1, f2, p1, p2`` (the first branch node and its parent), ``d`` (its depth) and ``path``.
    """
    items, sizes = _ragged(rows, "path")
    value = lambda name: rows.column(name).combine_chunks().to_numpy()
    rep, copies, chars, p1, p2, d = [value(n) for n in ("rep", "copies", "chars", "p1", "p2", "d")]
    first = np.cumsum(sizes) - sizes
    # Dense numbers of turns; a first symbol is its whole prefix, since shards hold many of them.
    turns = items.field("key").dictionary_encode()
    symbols = turns.indices.to_numpy().astype(np.int64) + 1
    _, heads = np.unique(np.stack([value("f1"), value("f2")]), axis=1, return_inverse=True)
    symbols[first] = len(turns.dictionary) + 1 + heads.ravel()
    trie = DoubleArray(symbols, sizes)
    count = len(trie.base)
    n_convs, low, depth, n = np.zeros(count, np.int64), np.full(count, np.iinfo(np.int64).max), np.zeros(count, np.int64), np.zeros(count, np.int64)
    children, leaves, saved, top = [np.zeros(count, np.int64) for _ in range(4)]
    end_rep = np.full(count, -1, np.int64)
    length, total = items.field("n").to_numpy(), items.field("c").to_numpy()
    last = np.zeros(len(sizes), np.int64)
    for level, (on, slots) in enumerate(trie.walk(symbols, sizes)):
        np.add.at(n_convs, slots, copies[on])
        np.minimum.at(low, slots, rep[on])
        depth[slots], n[slots] = d[on] + level, length[first[on] + level]
        last[on] = slots
        if not level:
            top[slots] = on
    ended = value("size") == depth[last]
    end_rep[last[ended]] = np.flatnonzero(ended)
    # A tail: one more child, one leaf, and what copies save on it.
    tail = np.flatnonzero(~ended)
    children[last[tail]] += 1
    leaves[last[tail]] += 1
    saved[last[tail]] += (copies[tail] - 1) * (chars[tail] - total[first[tail] + sizes[tail] - 1])
    used = np.flatnonzero(trie.check >= 0)
    saved[used] += (n_convs[used] - 1) * n[used]
    inner = used[trie.check[used] > 0]
    np.add.at(children, trie.check[inner], 1)
    leaves[used[children[used] == 0]] = 1
    order = used[np.argsort(-depth[used], kind="stable")]
    for slots in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []:
        below = slots[trie.check[slots] > 0]
        np.add.at(leaves, trie.check[below], leaves[below])
        np.add.at(saved, trie.check[below], saved[below])
    is_top = trie.check[used] == 0
    parent = np.where(is_top, 0, low[trie.check[used]])
    up = lambda values: pa.array(values[top[used]], mask=~is_top)
    has_end = end_rep[used] >= 0
    none = pa.nulls(len(used), pa.int64())
    columns = [
        pa.array(low[used]), pa.array(depth[used]), pa.array(parent, mask=is_top), up(p1), up(p2), none, none, pa.array(n_convs[used]), pa.array(children[used]),
        pa.array(leaves[used]), pa.array(saved[used]), pa.array(rep[np.maximum(end_rep[used], 0)], mask=~has_end),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_names(NODE))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their first branch node; an array is closed only where that changes."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= ARRAY_SEQUENCES:
            table = pa.Table.from_batches(held)
            f1, f2 = [table.column(c).to_numpy() for c in ("f1", "f2")]
            changes = np.flatnonzero((np.diff(f1) != 0) | (np.diff(f2) != 0))
            if len(changes):
                cut = int(changes[-1]) + 1
                yield _shard_nodes(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                count -= cut
    if count:
        yield _shard_nodes(pa.Table.from_batches(held))


def _merged_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final numbers of the hot nodes: ``fp1, fp2, up1, up2, depth, n, n_convs, conv_id, end_rep, n_children, n_leaves, saved_tokens`` (the last three of what shards found below)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    value = lambda name: rows.column(name).combine_chunks().fill_null(0).to_numpy().copy()
    depth, n, n_convs, low = [value(c) for c in ("depth", "n", "n_convs", "conv_id")]
    children, leaves, saved = [value(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    name = {k: i for i, k in enumerate(zip(value("fp1").tolist(), value("fp2").tolist(), depth.tolist()))}
    above = np.array([name.get(k, -1) for k in zip(value("up1").tolist(), value("up2").tolist(), (depth - 1).tolist())], np.int64)
    order = np.argsort(depth, kind="stable")
    paths: dict[int, list[int]] = {}
    for i in order.tolist():
        paths[i] = [*paths[above[i]], i] if depth[i] else []
    # Sequences of dense numbers, packed and walked like those of a shard; node numbers stand for the turns.
    sizes = np.array([len(paths[i]) for i in range(len(depth))], np.int64)
    symbols = np.array([s + 1 for i in range(len(depth)) for s in paths[i]], np.int64)
    trie = DoubleArray(symbols, sizes)
    slot = np.zeros(len(depth), np.int64)
    for on, slots in trie.walk(symbols, sizes):
        slot[on] = slots
    node_at = np.full(len(trie.base), -1, np.int64)
    node_at[slot] = np.arange(len(depth))
    up = np.where(depth > 0, node_at[np.maximum(trie.check[slot], 0)], -1)
    np.add.at(children, up[up >= 0], 1)
    leaves[children == 0] = 1
    saved += (n_convs - 1) * np.where(depth > 0, n, 0)
    for i in order[::-1].tolist():
        if up[i] >= 0:
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    keep = lambda c: rows.column(c).combine_chunks()
    columns = [
        pa.array(low), pa.array(depth), pa.array(np.where(up >= 0, low[up], 0), mask=up < 0), keep("up1"), keep("up2"), keep("fp1"), keep("fp2"),
        pa.array(n_convs), pa.array(children), pa.array(leaves), pa.array(saved), keep("end_rep"),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=_names(NODE))


def trie_nodes(packs: DataFrame) -> DataFrame:
    """All nodes of the trie of the conversations in ``packs`` (``packs_of``, ``with_borrowed_heads``).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``. A node's members are the
    conversations that begin with it, its leaves the childless nodes in its subtree; ``saved_tokens`` adds up, over its subtree, the
    characters of each node's last text times its members but one; ``ends_sha256`` is the digest of the ids that end at it, in order, with commas.
    Tables are written to the shared folder, and sequences counted, when this is called.
    """
    spark = packs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = written(_with_prefixes(packs), "packs")
    sequences = written(_sequences(packs), "sequences")
    rows = written(_prefixes(packs, sequences), "prefixes")
    # A fair share of sequences: it spreads the work and changes no result.
    share = max(50, sequences.count() // (4 * parts))
    counts = written(rows.groupBy("f1", "f2", "d").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    hot = checked_broadcast(counts.where(F.col("k") > share).select("f1", "f2", "d", F.lit(True).alias("is_hot")))
    is_parent = hot.select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), (F.col("d") + 1).alias("d"), F.col("is_hot").alias("under_hot"))
    rows = rows.join(hot, ["f1", "f2", "d"], "left").join(checked_broadcast(is_parent), ["p1", "p2", "d"], "left")
    below_hot = (F.col("d") == 1) | F.coalesce("under_hot", F.lit(False))
    cool = rows.where("is_hot is null").withColumn("below_hot", below_hot).drop("is_hot", "under_hot")
    # No key of this join has more rows than the share.
    shared = counts.where(F.col("k") <= share).select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), (F.col("d") + 1).alias("d"), F.lit(True).alias("is_shared"))
    rest = cool.where("not below_hot").join(shared, ["p1", "p2", "d"], "left")
    columns = ["rep", "copies", "size", "chars", "d", "key", "n", "c", "f1", "f2", "p1", "p2"]
    branches = cool.where("below_hot").select(*columns).unionByName(rest.where("is_shared").select(*columns))
    tails = rest.where("is_shared is null")

    found = branches.groupBy("rep").agg(
        *[F.min(c).alias(c) for c in ("copies", "size", "chars")], F.min_by(F.struct("d", "f1", "f2", "p1", "p2"), "d").alias("first"),
        F.sort_array(F.collect_list(F.struct("d", "key", "n", "c"))).alias("path"),
    ).select("rep", "copies", "size", "chars", "first.*", "path")
    found = found.repartition(2 * parts, "f1", "f2").sortWithinPartitions("f1", "f2")
    own = written(found.mapInArrow(_shards, NODE), "nodes")

    # Hot nodes: partial sums over all sequences, and over the tops of the shards.
    ends = F.max(F.when(F.col("d") == F.col("size"), F.col("rep")))
    upper = rows.where("is_hot").groupBy("f1", "f2", "d").agg(
        F.min("p1").alias("up1"), F.min("p2").alias("up2"), F.min("n").alias("n"), F.sum("copies").alias("n_convs"), F.min("rep").alias("conv_id"), ends.alias("end_rep")
    )
    root = packs.where("is_first").join(sequences, F.col("conv_id") == F.col("rep")).agg(
        F.sum("copies").alias("n_convs"), F.min("rep").alias("conv_id"), F.max(F.when(F.col("size") == 0, F.col("rep"))).alias("end_rep")
    ).where("conv_id is not null")
    zero = F.lit(0).cast("bigint")
    upper = upper.unionByName(root.select(zero.alias("f1"), zero.alias("f2"), zero.alias("d"), zero.alias("n"), "n_convs", "conv_id", "end_rep"), allowMissingColumns=True)
    tops = own.where("parent_conv_id is null").groupBy(F.col("up1").alias("f1"), F.col("up2").alias("f2"), (F.col("depth") - 1).alias("d")).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    merged = upper.join(tops, ["f1", "f2", "d"], "left").select(
        F.col("f1").alias("fp1"), F.col("f2").alias("fp2"), "up1", "up2", F.col("d").alias("depth"), "n", "n_convs", "conv_id", "end_rep", "n_children", "n_leaves", "saved_tokens"
    )
    merged = written(merged.coalesce(1).mapInArrow(_merged_nodes, NODE), "merged")

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep"]
    above = checked_broadcast(merged.select(F.col("fp1").alias("up1"), F.col("fp2").alias("up2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above")))
    placed = own.join(above, ["up1", "up2", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    alone = tails.select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("copies").alias("n_convs"),
        (F.col("d") < F.col("size")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("copies") - 1) * (F.col("chars") - F.col("c") + F.col("n"))).alias("saved_tokens"), F.when(F.col("d") == F.col("size"), F.col("rep")).alias("end_rep"),
    )
    nodes = merged.select(*names).unionByName(placed.select(*names)).unionByName(alone)
    nodes = nodes.join(sequences.select(F.col("rep").alias("end_rep"), "ends_sha256"), "end_rep", "left")
    return nodes.select(*names[:-1], F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
