"""Queries that SQL can express, and the pipeline's stages, against other computations."""

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tilewright.llm import bpe
from tilewright.llm.common import read, written
from tilewright.llm.queries import ORACLES, QUERIES

from .test_operators import fingerprint, lines_that_go, roots

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        duck.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(str([row[names.index(c)] for c in columns]) for row in result.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want


def test_pipeline(spark):
    """Each stage on what the one before kept."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]
    docs = read(spark, SMALL, "documents")
    good = written(stages["quality"](spark, docs, SMALL), "t")
    before = {r.doc_id: r.text for r in good.collect()}
    labels = {r.doc_id: r.quality for r in read(spark, SMALL, "labels").collect()}
    assert all(before.get(i) is None for i, q in labels.items() if q == 0) or sum(i in before for i, q in labels.items() if q == 0) <= 1

    lined = written(stages["line_dedup"](spark, good, SMALL), "t")
    gone = lines_that_go(sorted(before.items()), 2, 20)
    want = {}
    for i, text in before.items():
        kept = "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in gone)
        if kept.strip() or kept == text:
            want[i] = kept
    assert {r.doc_id: r.text for r in lined.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lined.collect() if r.text != before[r.doc_id])

    near = written(stages["near_dedup"](spark, lined, SMALL), "t")
    ids = sorted(want)
    found = roots([fingerprint(want[i], 5) for i in ids], 4)
    assert sorted(r.doc_id for r in near.collect()) == [i for k, i in enumerate(ids) if found[k] == k]

    clean = written(stages["decontamination"](spark, near, SMALL), "t")
    assert {r.doc_id for r in clean.collect()} <= {r.doc_id for r in near.collect()}

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in clean.collect()}
    last = stages["bpe"](spark, clean, SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in last} == {i: len(coder.encode_ordinary(t)) for i, t in texts.items()}
