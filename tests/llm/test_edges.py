"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: every query, every stage."""

import pytest

import corpus_pipeline
from tilewright.llm.queries import QUERIES

LONG = "word " * 20_000 + "\n" + "x" * 3_000
ODD = [
    (None, "a text without an id, but with words"), (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, LONG), (5, LONG),
    (6, "the same line of text stands here twice\nthe same line of text stands here twice"), (7, "über änder ça ñ 日本語 \U0001F600 ½"), (7, "a second row of document seven"),
    (8, "equal text"), (9, "equal text"), (9, "equal text"),
]
LABELS = [(k, k % 2, (k + 1) % 2) for k in range(10)] + [(3, None, None), (None, 1, 0), (4, 0, 1)]
PAGES = [
    (None, None, None), (1, "", ""), (2, "not a url ::", "<p>a<p>b"), (3, "http://h/a", "<article><h1>T</h1><p>x &amp; y"), (3, "http://h/a", "<article><h1>T</h1><p>x &amp; y"),
    (4, "http://h/b", "<nav>a b c</nav><article>" + "<p>" + "w " * 30_000 + "</article>"), (5, "http://h/c\r\nX: y", "<article>é\r\n\r\nWARC/1.1\r\n</article>"),
]
CONVERSATIONS = [
    (None, 0, "user", "no conversation"), (100, None, "user", "first"), (100, 1, None, None), (100, 1, None, None), (101, 0, "user", "own"), (101, 5, "user", LONG),
    (102, 0, "user", "own"), (7, None, None, None), (250, 3, "assistant", "without a base"), (250, 3, "assistant", "without a base"), (-5, 0, "user", "first"),
]
BENCHMARK = [(None, None), (1, ""), (2, "one"), (3, " ".join(f"w{k}" for k in range(14)))]


def same_count(name, rows, folder_rows):
    if name.startswith(("op1_", "op3_", "op5_", "op6_", "op7_", "op9_", "op10_", "op11_", "op12_")):
        assert len(rows) == folder_rows
    if name.startswith("op4_"):
        assert len(rows) == len(PAGES)


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(name, clashing, folder, rows_of):
    path = folder(clashing, documents=ODD, labels=LABELS, pages=PAGES, benchmark=BENCHMARK, conversations=CONVERSATIONS)
    same_count(name, rows_of(name, path), len(ODD))


def test_repeated_pages_are_captures_of_their_own(folder, rows_of):
    """Rows that repeat id and html, with other urls or none, and null ids with equal html."""
    pages = [(1, "http://h/a", "<p>x"), (1, "http://h/a", "<p>x"), (2, "http://h/b", "<p>x"), (None, "u", "<p>x"), (None, None, "<p>x"), (2, "http://h/c", "<p>x")]
    rows = rows_of("op4_warc_round_trip", folder(pages=pages))
    found = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["n_requests"]) for r in rows)
    assert found == [("1", "response", None, 4, 1)] * 2 + [("2", "revisit", 1, 4, 1)] * 2 + [("None", "response", None, 4, 1)] * 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(name, folder, rows_of):
    assert rows_of(name, folder()) == []


@pytest.mark.parametrize("clashing", [False, True])
def test_stages_on_odd_rows(spark, clashing, folder):
    path = folder(clashing, documents=ODD, labels=LABELS, benchmark=BENCHMARK)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, path)
        assert found.columns == docs.columns, name
        assert found.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == len(ODD)


def test_stages_on_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder()).count() == 0
