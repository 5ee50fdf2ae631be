"""Short benchmark items, and line de-duplication with ids of any size, against plain versions."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tilewright.llm import fingerprints
from tilewright.llm import line_dedup
from tilewright.llm.queries import ORACLES

from .test_operators import changed, lines_that_go

VOCABULARY = ["two", "plus", "name", "old", "of"]


def leaks_of(docs, items):
    """(doc_id, item_id): (windows, first, last), by comparing every window."""
    cut = lambda text: re.findall(r"[^\W_]+", (text or "").lower())
    found = {}
    for d, text in docs:
        words = cut(text)
        lines = [cut(x) for x in (text or "").split("\n")]
        for i, item in items:
            own = cut(item)
            n = min(len(own), 12)
            most = 2 if n == 12 else 1 if n >= 8 else 0
            hits = set()
            if 0 < n < 5:
                at = 0
                for line in lines:
                    hits |= {(0, at)} if line == own else set()
                    at += len(line)
            elif n:
                for q in range(len(own) - n + 1):
                    for at in range(len(words) - n + 1):
                        if sum(a != b for a, b in zip(own[q:q + n], words[at:at + n])) <= most:
                            hits.add((q, at))
            if hits:
                found[d, i] = (len({q for q, _ in hits}), min(a for _, a in hits), max(a for _, a in hits))
    return found


@pytest.mark.parametrize("seed", [0, 1])
def test_items_of_all_sizes(seed, folder, rows_of):
    rng = random.Random(seed)
    speak = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(k, speak(n)) for k, n in enumerate([0, 1, 2, 3, 4, 5, 7, 8, 9, 11, 12, 13, 16] if seed else [3, 20])]
    items.append((50, "Name the eight old wonders of ancient times"))
    docs = [(k, "\n".join(speak(rng.randint(0, 6)) for _ in range(8))) for k in range(30)]
    docs += [(100 + k, f"{speak(3)} {items[-1 - k % 3][1]} {speak(2)}") for k in range(6)]
    docs += [(200, "so name the eight new wonders of ancient times"), (201, None), (202, ""), (203, "two, plus; two!\n\nold\nTWO PLUS two"), (204, "two plus two")]
    items.append((51, "Two plus two?"))
    path = folder(documents=docs, benchmark=items)
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["first_at"], r["last_at"]) for r in rows_of("op8_benchmark_decontamination", path)}
    assert got == leaks_of(docs, items)
    assert got[200, 50] == (1, 1, 1) and got[203, 51] == (1, 0, 4) and got[204, 51] == (1, 0, 0)
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"create view {table} as select * from '{path}/{table}.parquet'")
    assert {r[:2]: r[2:] for r in duck.execute(ORACLES["op8_benchmark_decontamination"]).fetchall()} == got


def test_only_short_items(folder, rows_of):
    docs = [(1, "yes\nno"), (2, "yes no"), (2, "x\nno")]
    rows = rows_of("op8_benchmark_decontamination", folder(documents=docs, benchmark=[(1, "no"), (2, "No"), (None, "yes")]))
    assert {(r["doc_id"], r["item_id"]): r["first_at"] for r in rows} == {(1, 1): 1, (1, 2): 1, (1, None): 0, (2, 1): 1, (2, 2): 1}


def test_line_dedup_with_ids_of_any_size(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(8, 30))) for _ in range(8)]
    ids = [-(2**63), -7, -1, 0, 5, 2**31, 2**35 + 1, 2**39, 2**40, 2**62, 2**63 - 2, 2**63 - 1, None] + [rng.randint(-(2**62), 2**62) for _ in range(30)]
    docs = [(k, "\n".join(changed(rng, rng.choice(base)) for _ in range(rng.randint(1, 4)))) for k in ids]
    order = {k: n for n, k in enumerate(sorted(k for k in ids if k is not None))} | {None: -1}
    gone = lines_that_go([(order[k], t) for k, t in docs], 1, 6)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"_key": F.lit("x"), "_number": F.lit("y")})
    found = line_dedup.dedup(table, 1, 6)
    assert found.columns[:4] == table.columns
    got = {r.doc_id: r.text for r in found.collect()}
    assert got == {k: "\n".join(x for n, x in enumerate(t.split("\n")) if (order[k], n) not in gone) for k, t in docs}


def test_word_cache_of_fingerprints_is_small():
    """A Python worker keeps few words, and what it keeps changes no fingerprint."""
    cache, most = {}, 0
    for k in range(60):
        text = b" ".join(b"w%d" % (k * 2000 + i) for i in range(2000))
        assert fingerprints.weighted_simhash(text, cache) == fingerprints.weighted_simhash(text)
        most = max(most, len(cache))
    assert most <= 52_000
