"""The operators against plain versions of what they compute."""

import base64
import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import __spark_entry__ as contract
from tilewright.llm import bpe, common, fingerprints, html_extraction, labelled, line_dedup, lm_scoring, near_dedup, quality, toxicity, warc
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_registered():
    names = set(contract.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {n[: n.index("_") + 1] for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names


def test_op1(spark):
    texts = documents(spark)
    ids = sorted(texts)
    got = {r.doc_id: r for r in contract.queries()["op1_document_fingerprints"](spark, SMALL).collect()}
    prints = {i: fingerprints.weighted_simhash(texts[i].encode()) % 2**64 for i in ids}
    for k, i in enumerate(ids):
        after = texts[ids[(k + 1) % len(ids)]]
        n = len(texts[i])
        edited = texts[i][: n - n // 4] + after[: n // 4]
        assert got[i].n_chars == n
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == f"{prints[i]:016x}"
        assert got[i].edited_fingerprint == f"{fingerprints.weighted_simhash(edited.encode()) % 2**64:016x}"
        differ = (prints[i] ^ prints[ids[(k + 1) % len(ids)]]).bit_count()
        assert got[i].near_next == pytest.approx(max(0.0, math.cos(differ * math.pi / 64)))
        near = sum((prints[i] ^ p).bit_count() <= 3 for p in prints.values()) - 1
        assert got[i].n_near == (near if i % 100 == 0 else None)


@pytest.mark.parametrize("starts", [[0], [0, 5, 9], [0, 3, 4, 5]])
def test_edited_texts_across_ranges(spark, starts):
    rows = [(k, chr(97 + k) * 8, k) for k in range(10)]
    got = {r.doc_id: r.edited for r in fingerprints.edited_texts(spark.createDataFrame(rows, "doc_id bigint, text string, fp bigint"), starts).collect()}
    assert got == {k: chr(97 + k) * 6 + chr(97 + (k + 1) % 10) * 2 for k in range(10)}


@pytest.mark.parametrize("radius,blocks", [(3, 5), (2, 4), (3, 6)])
def test_search_finds_all(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for b in base for _ in range(6)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    marks = spark.createDataFrame([(p, 1) for p in signed], "fp bigint, copies bigint")
    got = Counter((r.query_fp, r.fp) for r in fingerprints.search(marks.select("fp"), marks, radius, blocks).collect())
    assert got == Counter((a, b) for a in signed for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= radius)


def test_op2(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r.text for r in contract.queries()["op2_html_extraction"](spark, SMALL).collect()}
    import re

    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br|div)[^>]*>", inner)]
        assert got[r.page_id] == " ".join(p for p in parts if p)


def test_blocks():
    page = (
        "<head><title>no</title></head><body><header>top</header><nav>menu</nav><script>var a='</p>';</script><!-- <p>no --><main><header>H</header>"
        "<p>a &lt; b&nbsp;<b>c</b>d<br>e</p><div class='comment-list'>said</div><form>f</form><p>last</main><div class=cookie-notice>ok</div><p>loose &copy;"
    )
    assert [t for t, main, gone in html_extraction.blocks_of(page) if main and not gone] == ["H", "a < b cd", "e", "last"]
    assert [t for t, main, gone in html_extraction.blocks_of(page) if not main and not gone] == ["loose ©"]


def test_repeated_runs_without_article(spark):
    notice = "please read these ten words that all pages repeat here"

    def own(k):
        return " ".join(f"word{k}x{j}" for j in range(9)) + " then two alike"

    pages = [(k, "http://h.example/x", f"<div>{notice}</div><p>{own(k)}</p>") for k in range(4)]
    pages.append((9, "http://other.example/", f"<div>{notice}</div>"))
    got = {r.page_id: r for r in html_extraction.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert all(got[k].text == own(k) for k in range(4))
    assert got[9].text == notice
    assert got[0].n_repeated == 10


def test_copied_pages_without_article(spark):
    notice = "please read these ten words that all pages repeat here"

    def own(k):
        return " ".join(f"word{k}x{j}" for j in range(12))

    pages = [(k, "http://h.example/x", f"<div>{notice}</div><p>{own(k // 3)}</p>") for k in range(6)]
    # Articles whose other text is the same on every page, and a copy of one of them.
    pages += [(10 + k, "http://a.example/", f"<article><p>{own(k // 2)}</p></article><div>{notice}</div>") for k in range(4)]
    # Copies only: nothing shows that a part is boilerplate.
    pages += [(20 + k, "http://c.example/", f"<p>{own(9)}</p>") for k in range(3)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == own(k // 3) for k in range(6))
    assert all(got[10 + k] == own(k // 2) for k in range(4))
    assert all(got[20 + k] == own(9) for k in range(3))


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def changed(rng, text, most=3, letters="abcdé"):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        at, kind = rng.randrange(max(len(out), 1)), rng.random()
        if kind < 0.4 and out:
            out[at] = rng.choice(letters)
        elif kind < 0.7 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, rng.choice(letters))
    return "".join(out)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    rng = random.Random(most)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 25))) for _ in range(10)]
    pairs = [(changed(rng, a), changed(rng, a)) for a in base for _ in range(20)] + [("", ""), ("", "ab"), ("a" * 200, "a" * 199 + "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), most).alias("d")).collect():
        assert r.d == min(edit_distance(r.a, r.b), most + 1), (r.a, r.b)


def lines_that_go(docs, edits, least):
    flat = sorted((-1 if d is None else d, n, x) for d, t in docs if t is not None for n, x in enumerate(t.split("\n")))
    gone, seen = set(), []
    for d, n, x in flat:
        if len(x) >= least:
            if any(abs(len(s) - len(x)) <= edits and edit_distance(x, s) <= edits for s in seen):
                gone.add((d, n))
            seen.append(x)
    return gone


def test_line_keys_are_compiled_and_whole(spark, capsys):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé日") for _ in range(n)) for n in (0, 1, 2, 3, 5, 20, 41, 63)]
    lines = spark.createDataFrame(list(enumerate(texts)), "place bigint, line string")
    found = line_dedup.keys(lines, 2)
    found.explain("codegen")
    # Methods of more bytes of code are interpreted.
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
    want = []
    for place, text in enumerate(texts):
        for delta, i, shift in [(0, i, 0) for i in (1, 2, 3)] + line_dedup.selection(2):
            n = len(text) - delta
            cuts = [n // 3 * k + max(0, k - (3 - n % 3)) for k in range(4)]
            at = cuts[i - 1] + shift
            if at >= 0 and at + cuts[i] - cuts[i - 1] <= len(text):
                want.append((i, n, text[at:at + cuts[i] - cuts[i - 1]], 2 * place + 1))
        # Own segments come as such once and not as probes.
        mine = [w for w in want if w[3] == 2 * place + 1 and w[1] == len(text)]
        for i in (1, 2, 3):
            first = next(w for w in mine if w[0] == i)
            want[want.index(first)] = (*first[:3], 2 * place)
            want.remove(first)
    hashed = spark.createDataFrame(want, "i int, n int, part string, member bigint").select(F.xxhash64("i", "n", "part").alias("key"), "member")
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, hashed.collect()))



@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_against_all_pairs(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(3, 30))) for _ in range(12)]
    docs = [(k, "\n".join(changed(rng, rng.choice(base)) for _ in range(rng.randint(1, 5)))) for k in range(80)] + [(300, None), (301, ""), (None, base[0])]
    # A group of many variants of one line.
    docs += [(400 + k, f"license text of the year {1900 + k} and no other words") for k in range(40)]
    gone = lines_that_go(docs, edits, 6)
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), edits, 6).collect()}
    for d, t in docs:
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (-1 if d is None else d, n) not in gone)
        assert got[d] == want


def test_short_equal_lines_go(spark, folder, rows_of):
    docs = [(1, "Page 1\n\nRead more\na"), (2, "Read more\n\n \na\nRead mora"), (3, "Page 1\nPage 2\n \n")]
    got = {r["doc_id"]: (r["n_removed"], r["kept_chars"]) for r in rows_of("op3_line_dedup", folder(documents=docs))}
    kept = {1: docs[0][1], 2: "\n \nRead mora", 3: "Page 2\n \n"}
    assert got == {k: (n, len(kept[k])) for k, n in ((1, 0), (2, 2), (3, 1))}


def test_warc_parts(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/b?c", "<p>é\r\n\r\nWARC/1.1</p>"), (2, "http://a/d", "<p>é\r\n\r\nWARC/1.1</p>"), (3, None, None), (4, "http://a/e", None)],
        "page_id bigint, url string, html string",
    )
    warc.write_warc(warc.plan_captures(pages), str(tmp_path / "w"), records_per_file=2)
    records = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert Counter(r.warc_type for r in records) == {"request": 4, "metadata": 4, "response": 2, "revisit": 2}
    body = next(r for r in records if r.warc_type == "response" and r.payload_bytes)
    assert body.block.endswith("<p>é\r\n\r\nWARC/1.1</p>".encode())
    assert body.payload_digest == body.found_digest == base64.b32encode(hashlib.sha1("<p>é\r\n\r\nWARC/1.1</p>".encode()).digest()).decode()
    found = warc.assemble(warc.read_warc(spark, str(tmp_path / "w"))).collect()
    assert sorted((len(r.requests), len(r.metadata)) for r in found) == [(1, 1)] * 4


def test_assemble_through_the_request(spark):
    rows = [("response", "r", None), ("request", "q", "r"), ("metadata", "m", "q"), ("metadata", "n", "r"), ("request", "lost", "nobody"), ("metadata", None, None)]
    found = warc.assemble(spark.createDataFrame(rows, "warc_type string, record_id string, concurrent_to string")).collect()
    assert [(r.record_id, len(r.requests), sorted(m.record_id for m in r.metadata)) for r in found] == [("r", 1, ["m", "n"])]


def accuracy(spark, name, label, modulus, rest):
    path = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [r for r in contract.queries()[name](spark, path).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    held = [r for r in rows if r.held_out]
    return np.array([labels[r.doc_id] for r in held]), np.array([r.score for r in held]), np.array([r.predicted for r in held])


def area(y, s):
    return np.mean((s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]))


def test_quality_held_out(spark):
    y, s, predicted = accuracy(spark, "op5_quality_classifier", "quality", 4, 2)
    assert area(y, s) > 0.95 and np.mean(predicted == y) > 0.9


def test_toxicity_held_out(spark):
    y, s, _ = accuracy(spark, "op7_toxicity", "toxic", 5, 0)
    assert area(y, s) > 0.8


def test_one_class_only():
    for model in (quality.fit([b"a b", b"c"], [1, 1]), toxicity.fit([b"a b", b"c"], [1, 1]), quality.fit([], []), toxicity.fit([], [])):
        assert 0.0 <= model.score(b"any text") <= 1.0 and model.score(b"") == model.score(b"any text")


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "t" * (k + 1)) for k in range(50)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id bigint, quality int")
    texts, found = labelled.sample(docs, labels, "quality", F.lit(True), 5, 1000)
    assert Counter(found) == {0: 5, 1: 5} and all((len(t) - 1) % 2 == y for t, y in zip(texts, found))


def test_op6(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = documents(spark)
    for r in contract.queries()["op6_byte_bpe"](spark, SMALL).collect():
        ids = np.array(coder.encode_ordinary(texts[r.doc_id]), "<u4")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_fold_and_decode(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = [" unbelievably", "zzzzzzz", "日本語テキスト", "\x00\x01", "é" * 40, "a" * 150, "", "\n\n\n"]
    table = bpe.rank_map(ranks)
    df = spark.createDataFrame([(w,) for w in words], "word string").select("word", bpe.merge_words(F.col("word"), table).alias("ids"))
    for r in bpe.decode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect():
        assert r.ids == ([] if not r.word else coder._encode_single_piece(r.word))
        assert bytes(r.decoded) == r.word.encode()


def test_op6_plans_hold_no_ranks(spark):
    store, context = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    docs = spark.createDataFrame([(1, "unbelievably odd wordings zzxqy")], "doc_id bigint, text string")
    bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    context.listenerBus().waitUntilEmpty()
    runs = store.executionsList(before, 100)
    assert runs.size() > 2
    for k in range(runs.size()):
        nodes = store.planGraph(runs.apply(k).executionId()).allNodes()
        assert sum(len(nodes.apply(i).desc()) for i in range(nodes.size())) < 100_000


def test_op6_groups_share_words(spark, monkeypatch):
    """Texts of several MB are one group, whose rare words are folded once."""
    folders, make = {}, bpe.new_folder
    monkeypatch.setattr(bpe, "new_folder", lambda session, name: folders.setdefault(name, make(session, name)))
    docs = spark.range(6000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(" unbelievably odd" * 70).alias("text"))
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, cache_words=0)
    assert spark.read.parquet(folders["references"]).count() == 1
    assert found.select("ids").distinct().count() == 1


def test_merge_lists(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["a", "", "x" * 70, "ab" * 33, " unbelievably", "日本語テキスト", "éa" * 9, *("a" * k for k in range(2, 9))]
    row, table = bpe.rank_row(spark, ranks)
    lists = spark.createDataFrame([(words,), ([],)], "words array<string>").crossJoin(row)
    found = lists.select(F.size("words").alias("n"), bpe.merge_lists(F.col("words"), table).alias("ids")).collect()
    assert {r.n: r.ids for r in found} == {0: [], len(words): [coder._encode_single_piece(w) if w else [] for w in words]}


def fingerprint(text, words=4):
    found = text.encode().lower().split()
    if not found:
        return 0
    grams = [b" ".join(found[k:k + words]) for k in range(max(len(found) - words + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, radius):
    parent = list(range(len(prints)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(k) for k in range(len(prints))]


def test_op9(spark):
    texts = documents(spark)
    ids = sorted(texts)
    prints = [fingerprint(texts[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots(prints, 4))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in contract.queries()["op9_simhash_near_dedup"](spark, SMALL).collect()}
    assert got == want


def similar_roots(texts, least=0.8):
    """Smallest position reachable over all pairs with a Jaccard similarity of five-word shingles of ``least`` or more."""
    sets = []
    for text in texts:
        found = text.encode().lower().split()
        sets.append({b" ".join(found[k:k + 5]) for k in range(max(len(found) - 4, 1))} if found else set())
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            union = len(sets[a]) + len(sets[b]) - common
            if label[a] != label[b] and (not union or 5 * common >= 4 * union):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def test_similar_documents_against_all_pairs(spark):
    rng = random.Random(5)
    texts = []
    for n in (6, 20, 60, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            for _ in range(8):
                copy = list(base)
                # Each edited word changes up to five shingles.
                for _ in range(rng.randint(0, max(1, n // 25))):
                    copy[rng.randrange(n)] = f"w{rng.randrange(5000)}"
                texts.append(" ".join(copy))
    texts += ["", " \n", "one", "One", "one two three four", "one two three"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = similar_roots(texts)
    assert {r.doc_id: r.component_id for r in near_dedup.similar_documents(docs).collect()} == dict(enumerate(want))
    assert sorted(r.doc_id for r in near_dedup.keep_first(docs).collect()) == [k for k, x in enumerate(want) if k == x]
    # Most of these are out of reach of a radius of 4 bits.
    assert len(set(roots([fingerprint(t, 5) for t in texts], 4))) > len(set(want))


def test_similar_documents_by_fingerprints(spark, monkeypatch):
    """The pigeonhole search by itself, without any band, links what lies within its radius and is similar; the exact check follows."""
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[:120])]
    bits = [(fingerprint(texts[k], 5) ^ fingerprint(texts[k + 1], 5)).bit_count() for k in range(0, 36, 3)]
    assert min(bits) <= 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(near_dedup, "band_keys", lambda found: np.zeros(0, np.int64))
    got = {r.doc_id: r.component_id for r in near_dedup.similar_documents(docs).collect()}
    assert got == {k: k - 1 if k % 3 == 1 and bits[k // 3] <= 4 else k for k in range(36)}


def test_components_in_few_rounds(spark):
    """A chain and a star, dealt over many files; each round is several shuffles."""
    rng = np.random.default_rng(3)
    chain, star = rng.permutation(3000).astype(int), rng.permutation(np.arange(5000, 6000)).astype(int)
    edges = [*zip(chain[:-1].tolist(), chain[1:].tolist()), *[(int(star[0]), int(x)) for x in star[1:]], (7000, 7000)]
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "a bigint, b bigint").repartition(30)
    want = {**{k: 0 for k in range(1, 3000)}, **{k: 5000 for k in range(5001, 6000)}}
    # As one task's edges, and as those of many tasks.
    for found in (common.components(df, max_rounds=1).collect(), common.components(df, max_rounds=12, at_once=700).collect()):
        assert len(found) == len(want) and {r.node: r.root for r in found} == want
    assert common.components(df.limit(0)).count() == 0


def test_bpe_cache_is_compact():
    """Words are found by hash and compared; their ids lie in flat arrays and not in an object per word."""
    rng = random.Random(1)
    words = list({"".join(rng.choices("abcdefgé", k=rng.randint(1, 12))) for _ in range(20_000)})
    known = bpe.KnownWords(["own", words[3]], bpe.pa.array(words))
    assert known.places(["own", words[3], words[0], words[-1], "not there", ""]).tolist() == [0, 1, 2, len(words) + 1, -1, -1]
    held = known.words.nbytes + known.hashes.nbytes + known.order.nbytes
    assert held < 40 * len(words)
    # Two words of one hash: the second one is not cached, and never mistaken for the first.
    known.hashes[:] = 7
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "_hashes", lambda x: np.full(len(x), 7, np.uint64))
        first = known.words[int(known.order[0])].as_py()
        assert known.places([first, "not there"]).tolist() == [known.order[0], -1]
    lists = bpe._lists(bpe.pa.array([[1, 2], [], [3]], bpe.pa.list_(bpe.pa.int32()))) + bpe._lists(bpe.pa.array([[4, 5]], bpe.pa.list_(bpe.pa.int32())))
    assert np.frombuffer(lists.joined(np.array([3, 1, 0, 0, 2])), "<u4").tolist() == [4, 5, 1, 2, 1, 2, 3]


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("pairs", [near_dedup.PAIRS, 50])
def test_links_for_any_partitioning(spark, monkeypatch, m, pairs):
    monkeypatch.setattr(near_dedup, "PAIRS", pairs)
    monkeypatch.setattr(near_dedup, "CELL", 20)
    rng = random.Random(m)
    radius = 4 if m > 1 else 2
    prints = sorted({rng.getrandbits(64) & (2**64 - 1 if k % 3 else 0xFFF) ^ sum(1 << rng.randrange(64) for _ in range(3)) for k in range(150)})
    docs = [(k, p - 2**64 if p >= 2**63 else p) for k, p in enumerate(prints)] + [(900, prints[0]), (None, prints[1] if prints[1] < 2**63 else 0)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, fp bigint"), radius, max(m, 2)).collect()}
    want = roots(prints, radius)
    assert all(got[k] == r for k, r in enumerate(want)) and got[900] == 0


def test_thresholds_cover_every_link():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**64, 200, dtype=np.uint64)
    groups = near_dedup.group_bits(np.eye(64) * 100, 200, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    blocks = tuple(tuple(tuple(g[k:k + 11]) for k in range(0, len(g), 11)) for g in groups)
    near = tuple(tuple(np.full((1 << len(b), 5), 0.2) for b in row) for row in blocks)
    parts = near_dedup.Partitioning(tuple(map(tuple, groups)), blocks, near, 4, 200)
    found = near_dedup.allocate(near_dedup._bits(fps), parts)
    assert (found.sum(axis=1) == 4 - 4 + 1).all() and found.min() >= -1


def test_hmm_counts_against_plain_recursion():
    rng = np.random.default_rng(2)
    states, n = 3, lm_scoring.SYMBOLS
    model = lm_scoring.first_guess(np.ones(n), states, 1)
    sequences = [rng.integers(0, 40, k).astype("<u2") for k in (1, 2, 7, 30)]
    got = lm_scoring.log_likelihoods(sequences, model)
    total = lm_scoring._zeros(states)
    lm_scoring.expected_counts(sequences, model, total)
    starts, moves = np.zeros(states), np.zeros((states, states))
    for s, value in zip(sequences, got):
        a = [model.start * model.emit[s[0]]]
        for x in s[1:]:
            a.append(a[-1] @ model.step * model.emit[x])
        assert value == pytest.approx(math.log10(a[-1].sum()))
        b = [np.ones(states)]
        for x in s[:0:-1]:
            b.insert(0, model.step @ (model.emit[x] * b[0]))
        starts += a[0] * b[0] / a[-1].sum()
        for t in range(len(s) - 1):
            moves += a[t][:, None] * model.step * (model.emit[s[t + 1]] * b[t + 1])[None, :] / a[-1].sum()
    assert np.allclose(total[0], starts, rtol=1e-3) and np.allclose(total[1], moves, rtol=1e-3, atol=1e-4)
    assert total[2].sum() == pytest.approx(sum(map(len, sequences)), rel=1e-4)


def test_hmm_emissions_of_pieces():
    """Texts of several pieces and of falling length in one block: emissions and log-likelihood against a plain recursion in 64 bits."""
    rng = np.random.default_rng(5)
    states, n = 3, lm_scoring.SYMBOLS
    model = lm_scoring.first_guess(np.ones(n), states, 1)
    sequences = [rng.integers(0, 40, k).astype("<u2") for k in (1, 5, lm_scoring.SEGMENT, 2 * lm_scoring.SEGMENT + 3)]
    total = lm_scoring._zeros(states)
    got = lm_scoring.expected_counts(sequences, model, total)
    emitted, likelihood = np.zeros((n, states)), 0.0
    for s in sequences:
        for k in range(0, len(s), lm_scoring.SEGMENT):
            piece = s[k:k + lm_scoring.SEGMENT]
            now, a = (model.stationary if k else model.start) * model.emit[piece[0]], []
            for x in piece[1:]:
                likelihood += math.log(now.sum())
                a.append(now / now.sum())
                now = a[-1] @ model.step * model.emit[x]
            likelihood += math.log(now.sum())
            a.append(now / now.sum())
            b = np.ones(states)
            for t in range(len(piece) - 1, -1, -1):
                emitted[piece[t]] += a[t] * b / (a[t] * b).sum()
                b = model.step @ (model.emit[piece[t]] * b)
                b /= b.sum()
    assert np.allclose(total[2], emitted, rtol=1e-4, atol=1e-6) and got == pytest.approx(likelihood, rel=1e-6)


def test_hmm_learns_from_long_texts_only(spark):
    rng = np.random.default_rng(3)
    totals = np.zeros(lm_scoring.SYMBOLS)
    sequences = []
    for _ in range(6):
        # Two kinds of stretches with words of their own.
        parts = [rng.integers(1, 20, 40) + 20 * (k % 2) for k in range(80)]
        sequences.append(np.concatenate([*parts, [0]]).astype("<u2"))
        totals += np.bincount(sequences[-1], minlength=lm_scoring.SYMBOLS)
    rows = [(k, len(x), x.tobytes()) for k, x in enumerate(sequences)]
    encoded = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, ids binary")
    model = lm_scoring.baum_welch(encoded, totals, 2)
    start = lm_scoring.first_guess(totals, 2, 3)
    gain = lm_scoring.log_likelihoods(sequences, model) - lm_scoring.log_likelihoods(sequences, start)
    assert (gain > 0.1 * 3201).all()


def test_op10(spark):
    texts = documents(spark)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: t.encode().lower().split() + [None] for i, t in texts.items()}
    counts = Counter(x for i, t in tokens.items() if not held[i] for x in t)
    n, v = sum(counts.values()), len(counts)
    got = contract.queries()["op10_hidden_markov_scoring"](spark, SMALL).collect()
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(x in counts for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
