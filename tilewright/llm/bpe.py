"""Byte-level BPE: encoding by ranked merges in higher-order functions, decoding by concatenating pieces.

A text is cut by the tokenizer's pattern. Words of the text that are in a stored cache of bounded size take
their ids from there. All other distinct words of a group of texts go through ``merge_words``: a fold that
merges the neighbours with the lowest rank until none is left, as Spark higher-order functions with the ranks
as a joined row of arrays. The cache is filled by the same fold; its content changes speed only, never ids.

Texts are not shuffled: groups are made and folded in one stage, written as references to words, and put together
in the next one, so memory is bounded by the cache and a task's groups.
"""

from __future__ import annotations

import base64
import io
import json
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_folder, open_store, text_of, written

# Bits of an id, and where the rank begins in the number of a piece; between them is the place of its first byte.
BITS = 17
RANK_AT = 45
GROUPS = 1 << 16
SPREAD = 40_503_337
# Texts that share their words, so that each rare one is folded once: characters and number.
GROUP_BYTES = 16 << 20
GROUP_DOCS = 20_000
# Longer words are not cached, so the bytes of the cache are bounded. References that are looked up at once.
CACHED_LENGTH = 64
REFS_AT_ONCE = 200_000
# Tasks that fold the words of the cache, and lists of words in each.
FOLDS = 48
LISTS = 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Ranks(NamedTuple):
    """The rank map as columns of arrays: hashed ``slots``, the ``shifts`` of its hash, ``first``, the id of each byte, and the ``mark``."""

    slots: Column
    shifts: Column
    first: Column
    size: int
    mark: int


def hash_pairs(numbers: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, used, shifts): a pair has the number ``h = (left << BITS | right) * SPREAD``; its rank is at slot
    ``((h >> 16) + shifts[(h >> 34) % GROUPS]) % len(slots)`` as ``h ^ rank``. Slots that are not ``used`` hold no pair.

    Numbers are multiples of ``SPREAD``, which is above all ranks, so only the pair's own number leaves a rank. The
    groups of pairs, largest first, are shifted until none of their slots is taken.
    """
    size = 1 << (2 * len(numbers) + 1).bit_length()
    group = (numbers >> 34) % GROUPS
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=GROUPS)
    ends = np.cumsum(counts)
    slots, taken, shifts = np.zeros(size, np.int64), bytearray(size), np.zeros(GROUPS, np.int64)
    for g in np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)].tolist():
        rows = order[ends[g] - counts[g]:ends[g]]
        home = (numbers[rows] >> 16).tolist()
        for shift in range(size):
            at = [(x + shift) % size for x in home]
            if len(set(at)) == len(at) and not any(map(taken.__getitem__, at)):
                break
        else:
            raise ValueError("the pairs do not fit")
        shifts[g] = shift
        for i in at:
            taken[i] = 1
        slots[at] = numbers[rows] ^ ranks[rows]
    return slots, np.frombuffer(taken, bool), shifts


def _literal(values: np.ndarray, used: np.ndarray | None = None) -> Column:
    """An array of numbers as a literal, null where not ``used``; written piece by piece, so that few objects live at once."""
    text = io.StringIO()
    for start in range(0, len(values), 4096):
        own = values[start:start + 4096].tolist()
        known = [True] * len(own) if used is None else used[start:start + 4096].tolist()
        text.write("," if start else "[")
        text.write(",".join(str(v) if u else "null" for v, u in zip(own, known)))
    text.write("]")
    return F.from_json(F.lit(text.getvalue()), "array<bigint>")


def rank_arrays(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots, used, shifts, first) of a vocabulary whose ids are its ranks.

    A piece is held as its id. Each way to part a piece into two pieces is an entry: (left id, right id) to the
    rank of their concatenation. Spark searches a map from end to end, so this map is a hash table in an array.
    """
    numbers, merged = array("q"), array("q")
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
            if left is not None and right is not None:
                numbers.append((left << BITS | right) * SPREAD)
                merged.append(rank)
    slots, used, shifts = hash_pairs(np.frombuffer(numbers, np.int64), np.frombuffer(merged, np.int64))
    return slots, used, shifts, np.array([ranks[bytes([k])] for k in range(256)], np.int64)


def rank_map(ranks: dict[bytes, int]) -> Ranks:
    """The rank map as literals, for expressions that stand alone; every description of their plan holds it in full."""
    slots, used, shifts, first = rank_arrays(ranks)
    return Ranks(_literal(slots, used), _literal(shifts), _literal(first), len(slots), max(ranks.values()) + 1)


def rank_row(spark: SparkSession, ranks: dict[bytes, int]) -> tuple[DataFrame, Ranks]:
    """The rank map as a stored table of one row to be joined, and its columns. Plans name these columns and hold no values."""
    slots, used, shifts, first = rank_arrays(ranks)
    columns = {"slots": pa.array(slots, mask=~used), "shifts": pa.array(shifts), "first": pa.array(first)}
    row = pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for name, x in columns.items()})
    stored = written(spark.createDataFrame(row), "ranks")
    return F.broadcast(stored), Ranks(*map(F.col, columns), len(slots), max(ranks.values()) + 1)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _held_once(table: Ranks, use) -> Column:
    """``use(table)`` with every array of the table computed once."""
    return _let(table.slots, lambda a: _let(table.shifts, lambda b: _let(table.first, lambda c: use(Ranks(a, b, c, table.size, table.mark)))))


def merge_words(word: Column, table: Ranks) -> Column:
    """Ids of one word, a text column, as an array of integers: the bytes, merged as the ranks say."""
    return _held_once(table, lambda held: _merged_word(word, held))


def merge_lists(words: Column, table: Ranks) -> Column:
    """Ids of each word of an array of words."""
    return _held_once(table, lambda held: F.transform(words, lambda word: _merged_word(word, held)))


def _merged_word(word: Column, table: Ranks) -> Column:
    """Ids of one word.

    State: one number per piece, between two marks that merge with nothing. From its high bits: the rank of the piece's
    concatenation with the next one or a number above all ranks, the place of its first byte, its id. So the least
    number is the leftmost pair of lowest rank, which is merged first. An empty word has no ids.
    """
    def big(value: int) -> Column:
        return F.lit(value).cast("bigint")

    def fold(raw: Column) -> Column:
        none = big(1 << BITS)

        def number(left: Column, right: Column) -> Column:
            return left * big(SPREAD << BITS) + right * big(SPREAD)

        def own(piece: Column) -> Column:
            return piece.bitwiseAND(big((1 << BITS) - 1))

        def ranked(h: Column, low: Column) -> Column:
            shift = F.get(table.shifts, F.shiftright(h, 34).bitwiseAND(big(GROUPS - 1)).cast("int"))
            slot = F.get(table.slots, (F.shiftright(h, 16) + shift).bitwiseAND(big(table.size - 1)).cast("int"))
            # An empty slot is null, which least() passes over.
            return F.shiftleft(F.least(slot.bitwiseXOR(h), none), RANK_AT).bitwiseOR(low)

        def start(p: Column) -> Column:
            pairs = F.transform(p, lambda x, i: number(x, F.coalesce(F.get(p, i + 1), big(table.mark))))
            return F.transform(pairs, lambda h, i: ranked(h, F.shiftleft(i.cast("bigint"), BITS).bitwiseOR(F.get(p, i))))

        def merged(q: Column, at: Column, low: Column) -> Column:
            rank = F.shiftright(low, RANK_AT)
            beside = F.array(number(own(F.get(q, at - 2)), rank), number(rank, own(F.get(q, at + 1))))
            # The piece before keeps its place and id, the merged one has the place of its left part.
            kept = big((1 << RANK_AT) - 1)
            place = big((1 << RANK_AT) - (1 << BITS))
            two = F.transform(beside, lambda h, i: ranked(h, F.when(i == 0, F.get(q, at - 2).bitwiseAND(kept)).otherwise(low.bitwiseAND(place).bitwiseOR(rank))))
            return F.concat(F.slice(q, 1, at - 2), two, F.slice(q, at + 2, F.lit(1 << 30)))

        def step(q: Column, _: Column) -> Column:
            return _let(F.array_min(q), lambda low: F.when(low >= big(1 << (BITS + RANK_AT)), q).otherwise(
                _let(F.array_position(q, low).cast("int"), lambda at: merged(q, at, low))
            ))

        mark = F.array(big(table.mark))
        pieces = F.concat(mark, F.transform(F.split(raw, ""), lambda c: F.get(table.first, F.ascii(c))), mark)
        # One merge fewer than bytes at most; a word of one byte merges with nothing, however often.
        rounds = F.sequence(F.lit(2), F.length(raw))
        return _let(pieces, lambda p: F.aggregate(rounds, start(p), step, lambda q: F.transform(F.slice(q, 2, F.size(q) - 2), own)))

    # One character per byte.
    raw = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")

    return _let(raw, lambda x: F.when(F.length(x) == 0, F.array().cast("array<int>")).otherwise(fold(x).cast("array<int>")))


def frequent_words(docs: DataFrame, pattern: str, cache_words: int, sample_docs: int) -> DataFrame:
    """``word``: the most frequent words, at most ``cache_words``, of about ``sample_docs`` documents chosen by a hash of their id.

    All words of a count are taken or none, but for those of more than ``CACHED_LENGTH`` characters.
    """
    import regex

    n = docs.count()
    part = min(1.0, sample_docs / max(n, 1))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(part * 1_000_000) + 1).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(find(text))
            for word in [w for w in counts if len(w) > CACHED_LENGTH]:
                del counts[word]
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counted = written(chosen.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    # The least count that leaves no more words than asked for, from how many words have each count: no task sorts them.
    having = counted.groupBy("n").agg(F.count("*").alias("words"))
    upto = having.select("n", F.sum("words").over(W.orderBy(F.desc("n"))).alias("upto")).where(F.col("upto") <= cache_words)
    least = upto.agg(F.min("n").alias("least")).first().least
    return counted.where(F.col("n") >= (least or 2**62)).select("word")


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


class Numbers(dict):
    """Numbers words from 0 as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _hashes(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))


class KnownWords:
    """Which words have cached ids, and their place in the cache: sorted hashes, and the words themselves to make sure."""

    def __init__(self, own: list[str], table: pa.Array):
        self.words = pa.concat_arrays([pa.array(own, pa.large_string()), table.cast(pa.large_string())])
        hashes = np.concatenate([_hashes(own), *[_hashes(table.slice(k, 50_000).to_pylist()) for k in range(0, len(table), 50_000)]])
        # Of two places of a word the lower one is found.
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]

    def places(self, words: list[str]) -> np.ndarray:
        """Place of each word, -1 for those that are not cached."""
        if not len(words) or not len(self.order):
            return np.full(len(words), -1, np.int32)
        at = np.searchsorted(self.hashes, _hashes(words), "left")
        at = self.order[np.minimum(at, len(self.order) - 1)]
        same = pc.equal(self.words.take(pa.array(at)), pa.array(words, pa.large_string())).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1).astype(np.int32)


class Lists(NamedTuple):
    """Lists of numbers one after the other, and where each begins and the last one ends."""

    values: np.ndarray
    ends: np.ndarray

    def __add__(self, other: Lists) -> Lists:
        return Lists(np.concatenate([self.values, other.values]), np.concatenate([self.ends, other.ends[1:] + self.ends[-1]]))

    def joined(self, refs: np.ndarray) -> bytes:
        """The lists at ``refs``, one after the other."""
        out = []
        for k in range(0, len(refs), REFS_AT_ONCE):
            part = refs[k:k + REFS_AT_ONCE]
            low, sizes = self.ends[part], self.ends[part + 1] - self.ends[part]
            before = np.cumsum(sizes) - sizes
            out.append(self.values[np.repeat(low - before, sizes) + np.arange(sizes.sum())].tobytes())
        return b"".join(out)


def _lists(ids: pa.ListArray) -> Lists:
    # Without lists the offsets may be missing.
    ends = ids.offsets.to_numpy().astype(np.int64) if len(ids) else np.zeros(1, np.int64)
    return Lists(ids.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).astype("<u4"), ends - ends[0])


# What a Python worker holds: the words of the last cache that it has read, or their ids.
_held: dict[tuple[str, str], KnownWords | Lists] = {}


def _cache(folder: str, pieces, column: str) -> KnownWords | Lists:
    """The column ``word`` or ``ids`` of the cache: words that have a rank of their own, then the table of folded words in ``folder``."""
    if (folder, column) not in _held:
        _held.clear()
        store, place = open_store(folder)
        # Files and rows have the same order whichever column is read.
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet"))
        parts = [pq.ParquetFile(f, filesystem=store).read([column]).column(0) for f in files]
        chunks = [c for part in parts for c in part.chunks]
        own = [(piece.decode(), rank) for rank, piece in sorted(pieces.value.items()) if _is_text(piece)]
        if column == "word":
            found = KnownWords([w for w, _ in own], pa.concat_arrays(chunks) if chunks else pa.array([], pa.string()))
        else:
            # A word that has a rank of its own is that one id.
            every = [Lists(np.array([r for _, r in own], "<u4"), np.arange(len(own) + 1)), *map(_lists, chunks)]
            values, sizes = np.concatenate([x.values for x in every]), np.concatenate([np.diff(x.ends) for x in every])
            found = Lists(values, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32 if len(values) < 1 << 31 else np.int64))
        _held[folder, column] = found
        pa.default_memory_pool().release_unused()
    return _held[folder, column]


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, decode: bool = False, keep: list[str] | None = None,
    cache_words: int = 1_500_000, sample_docs: int = 40_000,
) -> DataFrame:
    """The columns ``keep`` (all but text) of ``docs`` with ``ids`` (little-endian unsigned 32-bit numbers as binary).

    With ``decode`` also ``decoded``: the pieces of the ids, concatenated. A null text counts as empty; it has no ids.
    Columns named ``ids`` or ``decoded`` are replaced.
    """
    ranks = load_ranks(ranks_path)
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of("text").alias("text"))
    row, table = rank_row(spark, ranks)
    # The folded words are a table in the shared folder, which every Python worker reads for itself; none come to the driver.
    folder = new_folder(spark, "folded-words")
    words = frequent_words(rows, pattern, cache_words, sample_docs)
    # The rank map is joined to lists of words, so that it is copied once for many.
    lists = words.withColumn("list", F.pmod(F.xxhash64("word"), F.lit(FOLDS * LISTS))).repartition(FOLDS, "list").groupBy("list").agg(F.collect_list("word").alias("words"))
    ids = lists.crossJoin(row).select(F.arrays_zip("words", merge_lists(F.col("words"), table).alias("ids")).alias("folded"))
    ids.select(F.inline("folded").alias("word", "ids")).write.parquet(folder)
    pieces = spark.sparkContext.broadcast({rank: piece for piece, rank in ranks.items()})

    names = [c for c in (docs.columns if keep is None else keep) if c not in ("text", "ids", "decoded")]
    fields = docs.select(*names).schema
    carried = docs.select(F.struct(*names).alias("row"), text_of("text").alias("text"))
    row_type = carried.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        known = _cache(folder, pieces, "word")
        for batch in batches:
            texts = batch.column(1)
            start = 0
            while start < batch.num_rows:
                number = Numbers()
                found, size, stop = [], 0, start
                while stop < batch.num_rows and (stop == start or size < GROUP_BYTES) and stop - start < GROUP_DOCS:
                    text = texts[stop].as_py()
                    size += len(text)
                    cuts = find(text)
                    found.append(np.fromiter(map(number.__getitem__, cuts), np.int32, len(cuts)))
                    stop += 1
                words = list(number)
                places = known.places(words)
                # The rare words of the group follow on the cached ones.
                rare = np.flatnonzero(places < 0)
                places[rare] = len(known.words) + np.arange(len(rare))
                refs = [places[x].astype("<i4").tobytes() for x in found]
                one = pa.array([0, stop - start], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(one, batch.column(0).slice(start, stop - start)),
                        pa.ListArray.from_arrays(one, pa.array(refs, pa.binary())),
                        pa.array([[words[k] for k in rare.tolist()]], pa.list_(pa.string())),
                    ],
                    names=["rows", "refs", "rare"],
                )
                start = stop

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached, piece = _cache(folder, pieces, "ids"), pieces.value
        for batch in batches:
            for k in range(batch.num_rows):
                every = cached + _lists(batch.column(2).slice(k, 1).flatten())
                got = [every.joined(np.frombuffer(refs, "<i4")) for refs in batch.column(1)[k].as_py()]
                own = batch.column(0)[k].values
                columns = [*own.flatten(), pa.array(got, pa.binary())]
                if decode:
                    columns.append(pa.array([b"".join(map(piece.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in got], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", *["decoded"] * decode])

    groups = carried.mapInArrow(cut, f"rows array<{row_type}>, refs array<binary>, rare array<string>")
    folded = groups.crossJoin(row).select("rows", "refs", merge_lists(F.col("rare"), table).alias("ids"))
    # Written in between, so that a task runs one Python worker at a time, which holds the words of the cache or their ids.
    place = new_folder(spark, "references")
    folded.write.option("compression", "zstd").parquet(place)
    folded = spark.read.schema(folded.schema).parquet(place)
    schema = fields.add("ids", "binary")
    return folded.mapInArrow(put_together, schema.add("decoded", "binary") if decode else schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the bytes that an array of ids stands for: the binary pieces, concatenated."""
    by_id = {rank: piece for piece, rank in load_ranks(ranks_path).items()}
    table = [base64.b64encode(by_id.get(k, b"")).decode() for k in range(max(by_id) + 1)]
    pieces = F.from_json(F.lit(json.dumps(table)), "array<string>")
    parts = F.transform(F.coalesce(F.col(ids), F.array()), lambda i: F.decode(F.unbase64(F.get(pieces, i)), "ISO-8859-1"))
    return df.withColumn(name, F.encode(F.array_join(parts, ""), "ISO-8859-1"))
