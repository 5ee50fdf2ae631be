"""Document fingerprints: weighted SimHash, and search by permuted block tables.

Terms are pairs of neighbouring words (the word itself when there is only one), lower-cased, split at white
space. A term that occurs f times weighs 1 + ln f. Its 64-bit hash votes with its weight on the signs of the
64 bits; a bit is set if its votes are positive.

Search: the bits are cut into ``blocks`` blocks. Fingerprints within ``radius`` bits agree on at least
``blocks - radius`` blocks, so one table per choice of that many blocks, keyed by their bits, finds every one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import byte_values, map_batches, text_of

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_WORDS_KEPT = 50_000
_TERMS_AT_ONCE = 1 << 15


def term_hashes(data: bytes, cache: dict[bytes, int]) -> np.ndarray:
    """One 64-bit hash per term of a UTF-8 text, in order."""
    words = data.decode("utf-8", "replace").lower().encode().split()
    if len(cache) > _WORDS_KEPT:
        cache.clear()
    for word in set(words).difference(cache):
        cache[word] = xxhash.xxh64_intdigest(word)
    hashes = np.array([cache[w] for w in words], np.uint64)
    if len(hashes) < 2:
        return hashes
    mixed = hashes[:-1] * _ODD + (hashes[1:] ^ (hashes[1:] >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX
    return mixed ^ (mixed >> np.uint64(31))


def weighted_simhash(data: bytes, cache: dict[bytes, int] | None = None) -> int:
    """Signed 64-bit fingerprint; a text without words gives zero."""
    terms, counts = np.unique(term_hashes(data, {} if cache is None else cache), return_counts=True)
    votes = np.zeros(64)
    for k in range(0, len(terms), _TERMS_AT_ONCE):
        part = np.ascontiguousarray(terms[k:k + _TERMS_AT_ONCE]).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        weights = 1.0 + np.log(counts[k:k + _TERMS_AT_ONCE])
        # Rounded to whole millionths, so that the order of summing cannot flip a sign.
        weights = np.rint(weights * 1e6)
        votes += 2.0 * (weights @ bits) - weights.sum()
    return int(np.packbits(votes > 0, bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``df`` with the fingerprint of a text column as a signed 64-bit column ``name``; null counts as empty."""
    fields = [f for f in df.schema.fields if f.name != name]
    schema = df.select(*[f.name for f in fields]).schema.add(name, LongType())
    place = [f.name for f in fields].index(text)

    def run(batches):
        cache: dict[bytes, int] = {}
        for batch in batches:
            found = [weighted_simhash(x, cache) for x in byte_values(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, name])

    return df.select(*[f.name for f in fields]).mapInArrow(run, schema)


def likeness(a: Column, b: Column) -> Column:
    """Cosine that the differing bits stand for, cut at 0: 1 for equal fingerprints, about 0 for unrelated texts."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * (np.pi / 64.0)))


def range_starts(docs: DataFrame, buckets: int) -> list[int]:
    """At most ``buckets`` ids of ``docs(doc_id)``, the smallest included, that cut it into ranges of like size."""
    shares = [k / buckets for k in range(buckets)]
    key = _order_key()
    found = docs.agg(F.min(key).alias("low"), F.percentile_approx(key, shares, 100 * buckets).alias("cuts")).first()
    return [0] if found.low is None else sorted({found.low, *found.cuts})


def _order_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)).cast("bigint"))


def edited_texts(docs: DataFrame, starts: list[int]) -> DataFrame:
    """``doc_id, text, fp, n_chars, edited, next_fp`` of ``docs(doc_id, text, fp)``.

    ``edited`` is the text with its last floor(n/4) code points replaced by the first as many (or all) of the
    next document in order of doc_id; after the last comes the first. Rows are dealt out by ranges of doc_id
    that begin at ``starts`` (see ``range_starts``). The first row of a range is also sent to the range before
    it, so no range needs another and no window spans the table. Null ids come first; repeated ids are ordered
    by text.
    """
    rows = docs.select(_order_key().alias("_k"), "doc_id", "text", "fp")
    cuts = F.array(*[F.lit(s).cast("bigint") for s in starts])
    own = F.size(F.filter(cuts, lambda s: s <= F.col("_k"))) - 1
    before = F.pmod(own - 1, F.lit(len(starts)))
    sent = F.when(F.array_contains(cuts, F.col("_k")), F.array(
        F.struct(own.alias("bucket"), F.lit(False).alias("guest")), F.struct(before.alias("bucket"), F.lit(True).alias("guest"))
    )).otherwise(F.array(F.struct(own.alias("bucket"), F.lit(False).alias("guest"))))
    rows = rows.select("*", F.inline(sent))
    order = W.partitionBy("bucket").orderBy("guest", "_k", "text")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    return (
        rows.select("doc_id", "text", "fp", "guest", F.lead("text").over(order).alias("_next"), F.lead("fp").over(order).alias("next_fp"))
        .where("not guest")
        .select(
            "doc_id", "text", "fp", n.cast("bigint").alias("n_chars"),
            F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_next", F.lit(1), cut)).alias("edited"), "next_fp",
        )
    )


def block_masks(blocks: int) -> list[int]:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def tables(df: DataFrame, fp: str = "fp", blocks: int = 5, radius: int = 3) -> DataFrame:
    """``df`` once per table: ``table_no`` and ``key``, the bits of the table's blocks in front."""
    masks = block_masks(blocks)
    kept = [sum(c) for c in combinations(masks, blocks - radius)]
    signed = [m - 2**64 if m >= 2**63 else m for m in kept]
    return df.select("*", F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m).cast("bigint")) for m in signed])).alias("table_no", "key"))


def search(queries: DataFrame, marks: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """All fingerprints of ``marks(fp, copies)`` within ``radius`` of ``queries(fp)``: ``query_fp, fp, copies, distance``.

    Both sides hold each fingerprint once, so copies do not multiply. The distance is part of the join
    condition. A pair found by several tables is kept by the lowest table that finds it.
    """
    left = tables(queries.select(F.col("fp").alias("query_fp")), "query_fp", blocks, radius)
    right = tables(marks.select("fp", "copies"), "fp", blocks, radius)
    differ = F.col("query_fp").bitwiseXOR(F.col("fp"))
    masks = block_masks(blocks)
    signed = [sum(c) - 2**64 if sum(c) >= 2**63 else sum(c) for c in combinations(masks, blocks - radius)]
    first = F.lit(len(signed))
    for k in range(len(signed) - 1, -1, -1):
        first = F.when(differ.bitwiseAND(F.lit(signed[k]).cast("bigint")) == 0, k).otherwise(first)
    met = (left.table_no == right.table_no) & (left.key == right.key) & (F.bit_count(differ) <= radius) & (first == left.table_no)
    return left.join(right, met).select("query_fp", "fp", "copies", F.bit_count(differ).alias("distance"))


def documents(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("text"))


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
