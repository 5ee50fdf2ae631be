"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

Layout of a file: records one after another, each a frame of

    length    unsigned 64 bits: bytes of the payload
    check     unsigned 32 bits: masked CRC-32C of the eight bytes of the length
    payload   12 bytes of header, then the ids
    check     unsigned 32 bits: masked CRC-32C of the payload

all little-endian. Header: unsigned 32 bits (lowest byte: 2 or 4, the bytes of an id; 256 is added for a null doc_id), then doc_id
as signed 64 bits. The index is a Parquet table beside the files with one row per record. It names the
files that count: an attempt of a task that was lost leaves a file that no row names, and its repetition
writes another. So records come back once, whatever happened.
"""

from __future__ import annotations

import os
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import running_total
from .common import flat_texts, open_store, text_of, text_slices, words_of

# Fixed values of the checksum and of its mask.
CRC32C_POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

HEADER = 12
FILE_BYTES = 256 << 20
BLOCK_BYTES = 1 << 20
# Known words of a worker; more are forgotten and encoded again. Longer words are always encoded again.
WORDS_KEPT, WORD_BYTES = 500_000, 100
# Texts that are encoded together, in bytes: the more there are, the more often a word comes again.
ENCODED_BYTES = 8_000_000
# 1: ASCII letter, 2: digit, 3: other printable ASCII but the apostrophe; 0: never cut beside it.
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] = 3
_KINDS[48:58] = 2
_KINDS[[*range(65, 91), *range(97, 123)]] = 1
_KINDS[39] = 0
INDEX = "shard int, part int, file string, record bigint, doc_id bigint, offset bigint, n_bytes bigint, n_tokens bigint, block int"


class Crc32c:
    """CRC-32C of many byte ranges at once.

    A range is cut into pieces of ``PIECE`` bytes from its end, the first one filled up with zeros in front, which
    change nothing in a register of zero. Pieces are summed up side by side, and each moved by the zeros that follow
    it: moving is linear, so it is a table look-up per power of two of pieces.
    """

    PIECE = 64

    def __init__(self) -> None:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(CRC32C_POLYNOMIAL), table >> np.uint32(1))
        # One, two, three and four bytes of zeros after a byte.
        self.ahead = [table]
        for _ in range(3):
            self.ahead.append(table[self.ahead[-1] & np.uint32(255)] ^ (self.ahead[-1] >> np.uint32(8)))
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(self.PIECE):
            bits = table[bits & np.uint32(255)] ^ (bits >> np.uint32(8))
        self.moves = [self._spread(bits)]

    @staticmethod
    def _spread(bits: np.ndarray) -> list[np.ndarray]:
        """Tables per byte of a linear map that is given by its images of single bits."""
        value = np.arange(256, dtype=np.uint32)
        out = []
        for byte in range(4):
            table = np.zeros(256, np.uint32)
            for k in range(8):
                table ^= np.where(value >> np.uint32(k) & 1, bits[8 * byte + k], np.uint32(0)).astype(np.uint32)
            out.append(table)
        return out

    def _move(self, power: int, crc: np.ndarray) -> np.ndarray:
        """Registers after ``2 ** power`` pieces of zeros."""
        while len(self.moves) <= power:
            bits = self._apply(self.moves[-1], self._apply(self.moves[-1], np.uint32(1) << np.arange(32, dtype=np.uint32)))
            self.moves.append(self._spread(bits))
        return self._apply(self.moves[power], crc)

    @staticmethod
    def _apply(tables: list[np.ndarray], crc: np.ndarray) -> np.ndarray:
        low = np.uint32(255)
        return tables[0][crc & low] ^ tables[1][(crc >> np.uint32(8)) & low] ^ tables[2][(crc >> np.uint32(16)) & low] ^ tables[3][crc >> np.uint32(24)]

    def __call__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Checksums of ``data[start:start + size]``; every size is at least four."""
        pieces = -(-sizes // self.PIECE)
        ends = np.cumsum(pieces)
        room = np.zeros(int(ends[-1]) * self.PIECE if len(ends) else 0, np.uint8)
        for start, size, end in zip(starts.tolist(), sizes.tolist(), (ends * self.PIECE).tolist()):
            room[end - size:end] = data[start:start + size]
            # A register that begins with ones is one that begins with zeros and meets the first four bytes inverted.
            room[end - size:end - size + 4] ^= 255
        words = np.ascontiguousarray(room.view("<u4").reshape(-1, self.PIECE // 4).T)
        crc = np.zeros(words.shape[1], np.uint32)
        flipped = self.ahead[::-1]
        for word in words:
            crc = self._apply(flipped, crc ^ word)
        after = np.repeat(ends, pieces) - np.arange(len(crc)) - 1
        power = 0
        while len(after) and after.max() >> power:
            moved = np.flatnonzero(after >> power & 1)
            crc[moved] = self._move(power, crc[moved])
            power += 1
        if not len(sizes):
            return np.zeros(0, np.uint32)
        return np.bitwise_xor.reduceat(crc, ends - pieces) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


class WordEncoder:
    """Ids of texts by a lower-casing tokenizer of the ``tokenizers`` library that cuts words like ``word_bpe_49k.json``.

    Its rules look across neither white space nor a change between ASCII letters, digits and other printable ASCII (apostrophes
    excepted, which begin contractions), and it takes every digit by itself. So the ids of a text are those of its pieces between such places,
    one after another, and every distinct piece of a slice of texts is encoded once by the library. ASCII letters are lower-cased
    before, but for those in front of a character that is not ASCII, which may be a mark that joins the letter.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings of special tokens are ordinary text inside a document.
        self.tokenizer.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        base, end = int(offsets[0]), int(offsets[-1])
        text = data[base:end].copy()
        ahead = np.append(text[1:], 0)
        text[(text >= 65) & (text <= 90) & (ahead < 128)] += 32
        kind = _KINDS[text]
        cuts = np.zeros(len(text), bool)
        cuts[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        return words_of(text, offsets - base, cuts)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text and at the end)."""
        words, first = self._pieces(data, offsets)
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        parts = list(map(self.known.get, names))
        new = [k for k, ids in enumerate(parts) if ids is None]
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
        for k, ids in zip(new, self._encode([names[k] for k in new])):
            parts[k] = ids
            if len(names[k]) <= WORD_BYTES:
                self.known[names[k]] = ids
        flat = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        codes = coded.indices.to_numpy()
        count = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(begins[codes] - ends[:-1], count) + np.arange(int(ends[-1]))
        return flat[place], ends[first]


@lru_cache(maxsize=4)
def _encoder(path: str) -> WordEncoder:
    """One encoder per tokenizer and Python worker: reading the file takes longer than many a task."""
    return WordEncoder(path)


@lru_cache(maxsize=1)
def _crc() -> Crc32c:
    return Crc32c()


def encode(docs: DataFrame, tokenizer: str, end_id: int, cuts: list[int], id_bytes: int = 2) -> DataFrame:
    """``shard, doc_id, ids`` of the whole texts (null: empty) of ``docs(doc_id, text)``.

    ``ids`` are little-endian numbers of ``id_bytes`` bytes, ``end_id`` the last of them. ``cuts`` are ascending ids at which
    a shard begins (``fingerprints.range_starts``); null ids are in the first one. An id that does not fit raises.
    """
    kind, most = {2: "<u2", 4: "<u4"}[id_bytes], 256**id_bytes
    edges = np.array(cuts[1:], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokenizer)
        for batch in batches:
            data, offsets = flat_texts(batch.column(1))
            shards = np.searchsorted(edges, batch.column(0).fill_null(-(2**63)).to_numpy(), "right").astype(np.int32)
            for start, stop in text_slices(offsets, ENCODED_BYTES):
                ids, before = coder(data, offsets[start:stop + 1])
                if len(ids) and ids.max() >= most:
                    raise ValueError(f"id {ids.max()} does not fit into {id_bytes} bytes")
                # One more id at the end of each text.
                ends = before[1:] + np.arange(1, stop - start + 1)
                out = np.empty(len(ids) + stop - start, kind)
                is_end = np.zeros(len(out), bool)
                is_end[ends - 1] = True
                out[is_end] = end_id
                out[~is_end] = ids
                places = np.concatenate([[0], ends]) * id_bytes
                made = pa.Array.from_buffers(pa.large_binary(), stop - start, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards[start:stop]), batch.column(0).slice(start, stop - start), made.cast(pa.binary())], names=["shard", "doc_id", "ids"]
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(run, "shard int, doc_id bigint, ids binary")


def frames(ids: list[bytes], doc_ids: list[int | None], id_bytes: int, crc: Crc32c) -> tuple[bytes, np.ndarray]:
    """(records one after another, their offsets and the end)."""
    sizes = np.array([HEADER + len(x) for x in ids], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes + 16)])
    room = bytearray(int(ends[-1]))
    for start, size, x, doc_id in zip(ends.tolist(), sizes.tolist(), ids, doc_ids):
        struct.pack_into("<Q", room, start, size)
        struct.pack_into("<Iq", room, start + 12, id_bytes | (256 if doc_id is None else 0), doc_id or 0)
        room[start + 24:start + 12 + size] = x
    data = np.frombuffer(room, np.uint8)
    starts = ends[:-1]
    checks = [masked(crc(data, starts, np.full(len(starts), 8))), masked(crc(data, starts + 12, sizes))]
    for start, size, a, b in zip(starts.tolist(), sizes.tolist(), checks[0].tolist(), checks[1].tolist()):
        struct.pack_into("<I", room, start + 8, a)
        struct.pack_into("<I", room, start + 12 + size, b)
    return bytes(room), ends


def parse(data: bytes, crc: Crc32c) -> tuple[list[int | None], list[np.ndarray]]:
    """(doc_ids, ids) of records one after another. Broken lengths or checksums raise."""
    flat = np.frombuffer(data, np.uint8)
    starts, sizes, at = [], [], 0
    while at < len(data):
        size = struct.unpack_from("<Q", data, at)[0] if at + 8 <= len(data) else len(data)
        if size < HEADER or at + 16 + size > len(data):
            raise ValueError("a record ends beyond its block")
        starts.append(at)
        sizes.append(size)
        at += size + 16
    begin, size = np.array(starts, np.int64), np.array(sizes, np.int64)
    if len(begin):
        found = [masked(crc(flat, begin, np.full(len(begin), 8))), masked(crc(flat, begin + 12, size))]
        for at, values in zip((begin + 8, begin + 12 + size), found):
            kept = flat[at[:, None] + np.arange(4)].copy().view("<u4").ravel()
            if not np.array_equal(kept, values):
                raise ValueError("a checksum does not agree")
    doc_ids, ids = [], []
    for start, size in zip(starts, sizes):
        flags, doc_id = struct.unpack_from("<Iq", data, start + 12)
        doc_ids.append(None if flags & 256 else doc_id)
        width = flags & 255
        ids.append(np.frombuffer(data, f"<u{width}", (size - HEADER) // width, start + 12 + HEADER))
    return doc_ids, ids


def write_records(rows: DataFrame, path: str, shards: int, id_bytes: int = 2, file_bytes: int = FILE_BYTES, block_bytes: int = BLOCK_BYTES) -> None:
    """Writes ``rows(shard, doc_id, ids)`` below ``path``: files per shard, in order of doc_id (null first), and the index.

    Equal ids are ordered by their ids of tokens. A file that has reached ``file_bytes`` is followed by another one. The index
    counts blocks of ``block_bytes`` by where records begin, so that a block is read with one request.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = _crc()
        store, folder = open_store(path)
        store.create_dir(f"{folder}/records", recursive=True)
        shard, part, record, at, file, out = None, 0, 0, 0, "", None
        try:
            for batch in batches:
                column = batch.column(2)
                _, bytes_before = flat_texts(column)
                numbers = batch.column(0).to_numpy()
                for low, high in text_slices(bytes_before):
                    # A slice ends with its shard.
                    cuts = [low, *(np.flatnonzero(np.diff(numbers[low:high])) + low + 1).tolist(), high]
                    for start, stop in zip(cuts, cuts[1:]):
                        if numbers[start] != shard:
                            shard, part, record = int(numbers[start]), -1, 0
                        if part < 0 or at >= file_bytes:
                            if out is not None:
                                out.close()
                            part, at = part + 1, 0
                            file = f"records/shard-{shard:06d}-{part:04d}-{uuid.uuid4().hex}.rec"
                            out = store.open_output_stream(f"{folder}/{file}")
                        doc_ids = batch.column(1).slice(start, stop - start)
                        data, ends = frames(column.slice(start, stop - start).to_pylist(), doc_ids.to_pylist(), id_bytes, crc)
                        out.write(data)
                        n, sizes, offsets = stop - start, np.diff(ends), ends[:-1] + at
                        same = lambda value, kind: pa.array([value] * n, kind)
                        yield pa.RecordBatch.from_arrays([
                            same(shard, pa.int32()), same(part, pa.int32()), same(file, pa.string()), pa.array(np.arange(record, record + n)),
                            doc_ids, pa.array(offsets), pa.array(sizes), pa.array((sizes - 16 - HEADER) // id_bytes), pa.array((offsets // block_bytes).astype(np.int32)),
                        ], names=[f.split()[0] for f in INDEX.split(", ")])
                        record, at = record + n, at + int(ends[-1])
        finally:
            if out is not None:
                out.close()

    placed = rows.select("shard", "doc_id", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    placed.mapInArrow(run, INDEX).write.parquet(f"{path}/index")


def _fetched(requests: DataFrame, path: str, schema: str, names: list[str]) -> DataFrame:
    """Records of ``requests(file, offset, n_bytes, start)``, one read of neighbouring records each, as ``schema``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = _crc()
        store, folder = open_store(path)
        opened, source = None, None
        for batch in batches:
            for file, offset, n_bytes, start in zip(*[c.to_pylist() for c in batch.columns]):
                if file != opened:
                    if source is not None:
                        source.close()
                    opened, source = file, store.open_input_file(f"{folder}/{file}")
                data = source.read_at(n_bytes, offset)
                if len(data) != n_bytes:
                    raise ValueError(f"{file} ends inside a record")
                doc_ids, ids = parse(data, crc)
                counts = np.array([len(x) for x in ids], np.int64)
                columns = {
                    "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(np.cumsum(counts) - counts + (start or 0)),
                    "n_tokens": pa.array(counts), "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
        if source is not None:
            source.close()

    return requests.select("file", "offset", "n_bytes", "start").mapInArrow(run, schema)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index: one row per record, in columns as in ``INDEX``."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every record; checksums are verified.

    ``start`` counts the ids of all records before, in order of shard and record; ``ids`` are little-endian unsigned 32-bit numbers. The
    files are read in blocks, dealt out over ``tasks`` (default: twice the shuffle partitions).
    """
    blocks = read_index(spark, path).groupBy("shard", "part", "file", "block").agg(
        F.min("offset").alias("offset"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")
    )
    # Sums per shard are one row per shard; that is all that any one task orders.
    blocks = running_total(blocks, F.col("n_tokens"), "shard", ["part", "block"], "upto").withColumn("start", F.col("upto") - F.col("n_tokens"))
    blocks = blocks.repartition(tasks or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _fetched(blocks, path, "doc_id bigint, start bigint, n_tokens bigint, ids binary", ["doc_id", "start", "n_tokens", "ids"])


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """``doc_id, ids`` of every record in a seeded random order, one read per record by its offset."""
    order = F.xxhash64(F.lit(seed), "shard", "record")
    rows = read_index(spark, path).select("file", "offset", "n_bytes", F.lit(0).cast("bigint").alias("start"), order.alias("_order"), "shard", "record")
    rows = rows.repartitionByRange("_order").sortWithinPartitions("_order", "shard", "record")
    return _fetched(rows, path, "doc_id bigint, ids binary", ["doc_id", "ids"])
