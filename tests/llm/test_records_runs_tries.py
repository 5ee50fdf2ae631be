"""Token records, periodic runs and prefix tries against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tilewright.llm import periodic_runs, prefix_trie, token_records
from tilewright.llm.common import flat_texts, words_of
from tilewright.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SPACES = re.compile("[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


# Token records


def crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    crc = token_records.Crc32c()
    # The published check value of the polynomial.
    assert crc(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9])).tolist() == [0xE3069283]
    data = np.random.default_rng(1).integers(0, 256, 4000).astype(np.uint8)
    starts, sizes = np.array([0, 1, 5, 63, 64, 100, 3]), np.array([4, 63, 64, 65, 129, 3000, 12])
    assert crc(data, starts, sizes).tolist() == [crc32c(data[a:a + n].tobytes()) for a, n in zip(starts, sizes)]


def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found.encode_special_tokens = True
    return found


def test_ids_of_words_are_the_ids_of_the_text():
    rng, coder, own = random.Random(5), tokenizer(), token_records.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = "aBH'st.,9<\u0338\u0331 \t\n\x0b\x0c\r\x1c\x85\u2003\u0308\u0301\u0130\u03a3\uac00\u1100\u1161\u65e5\U0001F600\x00<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["x <|endoftext|> y", "", "w" * 5000]
    ids, ends = own(*flat_texts(pa.array(texts)))
    for k, text in enumerate(texts):
        assert ids[ends[k]:ends[k + 1]].tolist() == coder.encode(text, add_special_tokens=False).ids


def check_records(rows, texts):
    coder, start = tokenizer(), 0
    got = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in texts]
    for row, (_, text) in zip(got, texts):
        ids = coder.encode(text or "", add_special_tokens=False).ids + [1]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op11(spark):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    check_records([r.asDict() for r in QUERIES["op11_token_records"](spark, SMALL).collect()], texts)


def test_op11_odd_rows(folder, rows_of):
    texts = [(None, "no id"), (-3, "below"), (0, None), (1, ""), (2**62, "far"), (7, "same"), (7, "same")]
    path = folder(True, documents=texts)
    check_records(rows_of("op11_token_records", path), sorted(texts, key=lambda t: (t[0] is not None, t[0] or 0)))


@pytest.mark.parametrize("id_bytes,file_bytes,block_bytes", [(2, 1 << 30, 1 << 20), (4, 300, 100), (2, 1, 1)])
def test_files(spark, tmp_path, id_bytes, file_bytes, block_bytes):
    """Sizes of files, blocks and ids change no row, in order or shuffled; a changed byte is found."""
    texts = [(k, "word " * (k % 7) + str(k)) for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    path = f"{tmp_path}/r"
    rows = token_records.encode(docs, public_tokenizers.path("word_bpe_49k.json"), 1, [0, 20, 40], id_bytes)
    token_records.write_records(rows, path, 3, id_bytes, file_bytes, block_bytes)
    coder = tokenizer()
    want = {i: np.array(coder.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t in texts}
    got = token_records.read_records(spark, path, 3).collect()
    assert {r.doc_id: bytes(r.ids) for r in got} == want
    starts = np.cumsum([0] + [len(want[i]) // 4 for i in range(60)])
    assert {r.doc_id: r.start for r in got} == dict(enumerate(starts[:-1]))
    orders = []
    for seed in (1, 2):
        mixed = token_records.read_shuffled(spark, path, seed).collect()
        assert {r.doc_id: bytes(r.ids) for r in mixed} == want and len(mixed) == 60
        orders.append([r.doc_id for r in mixed])
    assert orders[0] != orders[1] != list(range(60))
    # A file that the index does not name, as a lost attempt leaves it, is not read.
    (tmp_path / "r" / "records" / "shard-000000-0000-lost.rec").write_bytes(b"half a rec")
    assert token_records.read_records(spark, path, 3).count() == 60
    some = sorted(p for p in (tmp_path / "r" / "records").iterdir() if "lost" not in p.name)[0]
    data = bytearray(some.read_bytes())
    data[30] ^= 1
    some.write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        token_records.read_records(spark, path, 3).collect()


# Periodic runs


def runs_by_hand(w, least):
    found, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                if not any(all(w[k] == w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                    found.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs(least):
    rng = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            w = [rng.choice("abcde"[:rng.choice([1, 2, 3, 5])]) for _ in range(rng.randrange(50))]
            if len(w) > 3 and rng.random() < 0.5:
                a, p = rng.randrange(len(w)), rng.randrange(1, 9)
                w = [x if i < a else w[a + (i - a) % p] if a + p <= len(w) else x for i, x in enumerate(w)]
            texts.append(" " * rng.randrange(2) + rng.choice([" ", "\n\t"]).join(w))
        data, offsets = flat_texts(pa.array(texts))
        runs, left = periodic_runs._solve(*words_of(data, offsets), least)
        for text, found, kept in zip(texts, runs, left):
            want = runs_by_hand(words(text), least)
            assert found == want
            gone = {k for s, n, q in want for k in range(s + q, s + n)}
            assert kept.decode() == " ".join(w for k, w in enumerate(words(text)) if k not in gone)


def check_runs(row, doc_id, text):
    w, h = words(text), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(w)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    want = runs_by_hand(w, 12)
    best = min(want, key=lambda r: (-r[1], r[0], r[2])) if want else (None, None, None)
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(want), *best)
    assert row["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
    assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
    gone = {k for s, n, q in want for k in range(s + q, s + n)}
    assert row["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    return len(want)


def test_op12(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    # Brute force takes the square of the words.
    assert sum(check_runs(r.asDict(), r.doc_id, texts[r.doc_id]) for r in rows if len(texts[r.doc_id]) < 4000) > 20


def test_op12_odd_rows(folder, rows_of):
    texts = [(None, "a b " * 9), (0, None), (1, ""), (2, " \n"), (3, "a " * 11), (4, "a " * 12), (5, "\u00e9\u00a0x " * 30), (5, "\u00e9\u00a0x " * 30), (6, ("p q r s t u v " * 2).strip())]
    texts += [(k, " ".join(random.Random(k).choice("xyz") for _ in range(90))) for k in range(10, 40)]
    rows = rows_of("op12_periodic_runs", folder(True, documents=texts))
    known = sorted(texts, key=str)
    for row, (doc_id, text) in zip(sorted(rows, key=lambda r: str((r["doc_id"],))), sorted(known, key=lambda t: str((t[0],)))):
        check_runs(row, doc_id, text)
    assert len(rows) == len(texts)


# Prefix tries


def nodes_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + v[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted((
        m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(children[p]), leaves[p], saved[p],
        hashlib.sha256(",".join(str(c) for c in m if len(rebuilt[c]) == len(p)).encode()).hexdigest(),
    ) for p, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(rows):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in rows)


def test_op13(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert nodes(r.asDict() for r in QUERIES["op13_prefix_trie"](spark, SMALL).collect()) == nodes_by_hand(rows)


@pytest.mark.parametrize("seed", range(3))
def test_op13_made_up(seed, folder, rows_of):
    """Few turns, so that prefixes are shared; equal conversations; a long one; ids, turns and texts that are null."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 900), 300):
        same = rng.random() < 0.3
        for t in range(9 if same else rng.randrange(1, 9)):
            rows.append((c, 2 * t, "user", "same" if same else rng.choice("ab") * rng.randrange(1, 3)))
    rows += [(1000 + k, t, "user", f"long {t}") for k in range(2) for t in range(300 + k)] + [(1500, t, None, "long") for t in range(200)]
    rows += [(None, 1, "user", "x"), (1200, None, "user", "n"), (1200, None, None, None), (1200, 1, "user", "n"), (1200, 1, "user", "n")]
    got = rows_of("op13_prefix_trie", folder(True, conversations=rows))
    assert nodes(got) == nodes_by_hand(rows)


@pytest.mark.parametrize("share", [1, 2, 5])
def test_double_array(share):
    rng = random.Random(share)
    paths = sorted({tuple(rng.randrange(1, 4 * share) for _ in range(rng.randrange(1, 6))) for _ in range(200)})
    symbols, sizes = np.array([s for p in paths for s in p]), np.array([len(p) for p in paths])
    trie = prefix_trie.DoubleArray(symbols, sizes)
    found = {}
    for level, (on, slots) in enumerate(trie.walk(symbols, sizes), 1):
        for k, slot in zip(on.tolist(), slots.tolist()):
            assert found.setdefault(paths[k][:level], slot) == slot
    assert len(set(found.values())) == len(found) == int((trie.check >= 0).sum())
    with pytest.raises(Exception):
        list(trie.walk(np.array([4 * share + 1]), np.array([1])))
