"""Registered queries of the corpus operators: one ``opN_<name>`` each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, decontamination, fingerprints, html_extraction, labelled, line_dedup, lm_scoring, near_dedup, periodic_runs, prefix_trie, quality, token_records, toxicity,
    warc,
)
from .common import new_folder, read, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    marks = written(near_dedup.fingerprints(read(spark, sf_dir, "documents")), "marks")
    found = near_dedup.near_duplicates(marks, radius=4)
    return found.select("doc_id", near_dedup.hex_of("fp").alias("fingerprint"), "component_id")


@query("op1_document_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the texts and their edited texts; for every hundredth document also how many others lie near."""
    docs = fingerprints.documents(read(spark, sf_dir, "documents"))
    starts = fingerprints.range_starts(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = fingerprints.edited_texts(fingerprints.with_fingerprint(docs), starts)
    marks = fingerprints.with_fingerprint(
        rows.select("doc_id", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp"), "edited", "edited_fp"
    ).drop("edited")
    marks = written(marks, "fingerprints")
    distinct = marks.groupBy("fp").agg(F.count("*").alias("copies"))
    asked = marks.where("doc_id % 100 = 0").select("fp").distinct()
    near = fingerprints.search(asked, distinct).groupBy("query_fp").agg(F.sum("copies").alias("n"))
    rows = marks.join(near, (F.col("fp") == F.col("query_fp")) & (F.col("doc_id") % 100 == 0), "left")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprints.hex_of("fp").alias("fingerprint"), fingerprints.hex_of("edited_fp").alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        (F.col("n") - 1).alias("n_near"),
    )


@query("op4_warc_round_trip", """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as n, sha1(payload) as h from p),
f as (select *, min(page_id) over (partition by h, n) as first from d),
b as (
  select *, list_transform(generate_series(0, 7), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::int) as v from f
)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(v, lambda x:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to,
  1 as n_requests
from b
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back and assembled."""
    path = new_folder(spark, "warc")
    warc.write_warc(warc.plan_captures(read(spark, sf_dir, "pages")), path)
    found = written(warc.assemble(warc.read_warc(spark, path, keep_block=False)), "captures")
    rows = found.select(
        F.col("metadata")[0]["fields"]["page-id"].cast("bigint").alias("page_id"), "record_id", "capture", F.size("requests").alias("n_requests")
    )
    names = rows.where("capture.warc_type = 'response'").select(F.col("record_id").alias("named"), F.col("page_id").alias("refers_to"))
    rows = rows.join(names, F.col("capture.refers_to") == F.col("named"), "left")
    return rows.select(
        "page_id", "capture.payload_bytes", F.coalesce("capture.found_digest", "capture.payload_digest").alias("payload_digest"),
        F.col("capture.warc_type").alias("record_type"), "refers_to", "n_requests",
    )


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model of the rows that are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.learn(docs, labels, labelled.fold(4) != 2)
    rows = labelled.score(docs, model, keep=["doc_id"])
    return rows.select(
        "doc_id", F.coalesce(labelled.fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by models of the rows that are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, labelled.fold(5) != 0)
    rows = labelled.score(docs, model, keep=["doc_id"])
    return rows.select(
        "doc_id", F.coalesce(labelled.fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encode(docs, path, public_tokenizers.PATTERN, decode=True)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_hidden_markov_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document by a model of the rows that are not held out."""
    return lm_scoring.score(read(spark, sf_dir, "documents"), labelled.fold(10) == 0)


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extract(read(spark, sf_dir, "pages"))


@query("op8_benchmark_decontamination", """
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from documents),
i as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from benchmark),
mask(m, places) as (values
  (0, [0, 1, 2, 3, 4, 5]), (1, [0, 1, 2, 6, 7, 8]), (2, [0, 1, 2, 9, 10, 11]),
  (3, [3, 4, 5, 6, 7, 8]), (4, [3, 4, 5, 9, 10, 11]), (5, [6, 7, 8, 9, 10, 11])),
dp as (select doc_id, p - 1 as p, w[p:p + 11] as part from (select doc_id, w, unnest(generate_series(1, len(w) - 11)) as p from d)),
ip as (select item_id, q - 1 as q, w[q:q + 11] as part from (select item_id, w, unnest(generate_series(1, len(w) - 11)) as q from i)),
ds as (select *, m, array_to_string(list_transform(places, lambda j: part[j + 1]), ' ') as seed from dp, mask),
iq as (select *, m, array_to_string(list_transform(places, lambda j: part[j + 1]), ' ') as seed from ip, mask),
far as (
  select ds.doc_id, iq.item_id, iq.q, ds.p from ds join iq on ds.m = iq.m and ds.seed = iq.seed
  where len(list_filter(generate_series(1, 12), lambda j: ds.part[j] <> iq.part[j])) <= 2
),
near as (
  select d.doc_id, s.item_id, 0 as q, p.at as p
  from (select * from i where len(w) between 5 and 11) s,
    d, lateral (select unnest(generate_series(0, len(d.w) - len(s.w))) as at) p
  where len(list_filter(generate_series(1, len(s.w)), lambda j: d.w[p.at + j] <> s.w[j])) <= case when len(s.w) >= 8 then 1 else 0 end
),
line as (
  select doc_id, n, regexp_extract_all(x, '[\\p{L}\\p{N}]+') as w
  from (select doc_id, generate_subscripts(l, 1) as n, unnest(l) as x from (select doc_id, string_split(lower(coalesce(text, '')), chr(10)) as l from documents))),
whole as (
  select doc_id, item_id, 0 as q, p
  from (select *, coalesce(sum(len(w)) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as p from line) x
    join (select item_id, w from i where len(w) between 1 and 4) s using (w)
),
hits as (select * from far union all select * from near union all select * from whole)
select doc_id, item_id, count(distinct q) as n_windows, cast(min(p) as int) as first_at, cast(max(p) as int) as last_at
from hits group by doc_id, item_id
""".replace("\\\\", "\\"))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold windows of benchmark items."""
    return decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without lines that come again, edited or not."""
    rows = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), equal_least=1)
    return rows.select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_removed"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op11_token_records")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as records in order of doc_id and read back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cuts = fingerprints.range_starts(docs, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = new_folder(spark, "token-records")
    rows = token_records.encode(docs, public_tokenizers.path("word_bpe_49k.json"), 1, cuts)
    token_records.write_records(rows, path, len(cuts))
    found = token_records.read_records(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").cast("bigint").alias("ids_crc32"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of every document, every tenth of which gets one planted, and what is left without them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", periodic_runs.with_planted_run("doc_id", "text").alias("text"))
    rows = periodic_runs.find_runs(docs, keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("_start"), (-r["period"]).alias("_period"), r.alias("run")
    )))["run"]
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    rows = rows.select("doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_words", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_prefix_trie")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations that were rebuilt on the first turns of their group's first one."""
    packs = prefix_trie.packs_of(read(spark, sf_dir, "conversations"))
    return prefix_trie.trie_nodes(prefix_trie.with_borrowed_heads(packs))
