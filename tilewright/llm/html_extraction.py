"""Main text of web pages by a suffix array per host.

A page is cut into blocks. What its markup declares as no text (menus, footers, forms, scripts, ...) goes, what it
declares as the article stays. All text outside an article joins the token stream of its page; the streams of a
host are one concatenation, whose suffixes are named by their first ``MIN_RUN`` tokens with prefix doubling. Two
suffixes of equal name are neighbours in the suffix array with a common prefix of at least that length; where they
belong to distinct pages, the substring is repeated boilerplate and covers its tokens. A longer repeated substring
is a chain of such windows, so deeper sorting would change nothing. Blocks that are covered for the most part go,
blocks with unique runs stay.

Equal streams of a host are merged before suffixes are made, and names are counted with partial aggregates, so a
host or a menu that a third of all pages share costs no more than its distinct streams.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

MIN_RUN = 8
# Window starts that are broadcast at most.
BROADCAST_NUMBERS = 2_000_000
COVERED = 0.5

# Element names of HTML and usual words in class and id names.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "button", "object", "math"}
DROPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
NOTICE = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|popup|modal|newsletter|subscribe|sidebar|menu|nav|navbar|"
    r"breadcrumbs?|comments?|replies|related|share|social|footer|header|masthead|toolbar|widget)(?:$|[-_\s])",
    re.IGNORECASE,
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.DOTALL)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"\s(?:hidden(?=[\s>=/])|aria-hidden\s*=\s*[\"']?true)", re.IGNORECASE)


def blocks_of(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in an article, dropped by markup) of each block that has text, in page order."""
    out: list[tuple[str, bool, bool]] = []
    # Open elements: (name, opens a dropped part, opens an article).
    stack: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    state = (False, False)

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, *state))

    at = 0
    while found := _TOKEN.match(page, at):
        token, at = found.group(), found.end()
        named = _NAME.match(token) if token[0] == "<" else None
        if token[0] != "<" or token == "<":
            held.append(token)
            continue
        if named is None:
            continue
        name = named.group(1).lower()
        if token[1] == "/":
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if name not in INLINE:
                flush()
            if depth is not None:
                if any(x[1] or x[2] for x in stack[depth:]):
                    flush()
                del stack[depth:]
                state = (any(x[2] for x in stack), any(x[1] for x in stack))
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            if not token.endswith("/>"):
                at = end.end() if end else len(page)
            if name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush()
        if name in VOID or token.endswith("/>"):
            continue
        if name in MAIN and not state[0]:
            # An article ends what was left open before it.
            stack = [(n, False, m) for n, _, m in stack]
        marks = " ".join(a or b or c for a, b, c in _MARKS.findall(token))
        outside = not state[0]
        dropped = name in DROPPED or bool(NOTICE.search(marks) and name not in MAIN | {"body", "html"}) or bool(_HIDDEN.search(token))
        dropped = dropped or (name == "header" and outside)
        if dropped or name in MAIN:
            flush()
        stack.append((name, dropped, name in MAIN))
        state = (any(x[2] for x in stack), any(x[1] for x in stack))
    flush()
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def parse(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, blocks`` with blocks ``text, article, dropped``; a null html has none."""
    fields = pages.select("page_id", "url").schema
    kind = "array<struct<text: string, article: boolean, dropped: boolean>>"
    arrow = pa.list_(pa.struct([("text", pa.string()), ("article", pa.bool_()), ("dropped", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = pa.array([host_of(x) for x in batch.column(1).to_pylist()], pa.string())
            found = [[{"text": t, "article": a, "dropped": d} for t, a, d in blocks_of(x)] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hosts, pa.array(found, arrow)], names=["page_id", "url", "host", "blocks"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return rows.mapInArrow(run, f"page_id {fields['page_id'].dataType.simpleString()}, url string, host string, blocks {kind}")


def name_suffixes(tokens, length: int):
    """Names (64-bit) of the first ``length`` tokens, a power of two, of each suffix that has so many, by prefix doubling."""
    names = F.transform(tokens, lambda t: F.xxhash64(t))
    h = 1
    while h < length:
        names = F.zip_with(
            F.slice(names, 1, F.greatest(F.size(names) - h, F.lit(0))), F.slice(names, h + 1, F.greatest(F.size(names) - h, F.lit(0))),
            lambda a, b: F.xxhash64(a, b),
        )
        h *= 2
    return names


def repeated_runs(streams: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``host, stream, starts`` of ``streams(host, stream, tokens, pages)``: where windows of ``min_run`` tokens begin
    that also stand in another page of the host.

    ``pages`` is the number of distinct pages with a stream, at least up to 2: a stream that pages of other articles
    have, too, is covered by itself, one of whole-page copies only is not. Streams with no repeated window are left out.
    """
    suffixes = streams.select("host", "stream", "pages", F.posexplode(name_suffixes(F.col("tokens"), min_run)).alias("at", "name"))
    # Only the smallest and largest stream of a name are kept, so partial sums absorb hot names.
    shared = suffixes.groupBy("host", "name").agg(F.min("stream").alias("low"), F.max("stream").alias("high"), F.max("pages").alias("most"))
    shared = shared.where("low < high or most > 1").select("host", "name")
    met = suffixes.join(shared, ["host", "name"])
    return met.groupBy("host", "stream").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def extract(pages: DataFrame, min_run: int = MIN_RUN, covered: float = COVERED) -> DataFrame:
    """``page_id, url, text, n_chars, n_removed, n_repeated`` per row of ``pages(page_id, url, html)``.

    ``n_removed`` counts the blocks left out, ``n_repeated`` the tokens outside articles that repeated runs cover. Null or empty html gives an empty text; a null or broken url
    belongs to the host without a name. Repeated rows count as one page and are all returned.
    """
    parsed = parse(pages)
    words = F.filter(F.split(F.array_join(F.transform(F.filter("blocks", lambda b: ~b["article"]), lambda b: b["text"]), " "), " "), lambda w: w != "")
    with_stream = parsed.withColumn("tokens", words).withColumn("stream", F.xxhash64("host", F.array_join("tokens", " ")))
    # Copies of a whole page are one page: they do not make each other boilerplate.
    with_page = with_stream.withColumn("page", F.xxhash64(F.transform("blocks", lambda b: F.struct(b["text"], b["article"]))))
    streams = with_page.where(F.size("tokens") > 0).groupBy("host", "stream").agg(
        F.first("tokens").alias("tokens"), F.when(F.min("page") < F.max("page"), 2).otherwise(1).alias("pages")
    )
    runs = written(repeated_runs(streams, min_run), "repeated-runs")
    # Distinct streams with repeats are few; beyond the bound it is a shuffle join.
    size = runs.agg(F.coalesce(F.sum(F.size("starts") + 10), F.lit(0)).alias("n")).first().n
    runs = F.broadcast(runs) if size <= BROADCAST_NUMBERS else runs

    asked = with_stream.join(runs.withColumnRenamed("host", "_h"), "stream", "left").select(
        "page_id", "url", "blocks", F.size("tokens").alias("n_tokens"), F.coalesce("starts", F.array().cast("array<int>")).alias("starts")
    )
    hit = F.filter(F.sequence(F.lit(0), F.col("n_tokens")), lambda i: (i < F.col("n_tokens")) & F.exists("starts", lambda w: (w <= i) & (i < w + min_run)))
    asked = asked.select("page_id", "url", "blocks", hit.alias("hit"))
    # Each block with the place of its first token in the page's stream.
    sized = F.transform("blocks", lambda b: F.struct(
        b["text"].alias("text"), b["article"].alias("article"), b["dropped"].alias("dropped"),
        F.when(b["article"], 0).otherwise(F.size(F.split(b["text"], " "))).alias("n"),
    ))
    placed = F.aggregate(
        sized, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,keep:boolean>>").alias("out")),
        lambda s, b: F.struct(
            (s["at"] + b["n"]).alias("at"),
            F.concat(s["out"], F.array(F.struct(
                b["text"].alias("text"),
                (~b["dropped"] & (b["article"] | (
                    F.size(F.filter("hit", lambda i: (i >= s["at"]) & (i < s["at"] + b["n"]))) < covered * b["n"]
                ))).alias("keep"),
            ))).alias("out"),
        ),
        lambda s: s["out"],
    )
    rows = asked.select("page_id", "url", "hit", placed.alias("out"))
    text = F.array_join(F.transform(F.filter("out", lambda b: b["keep"]), lambda b: b["text"]), " ")
    return rows.select(
        "page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"),
        F.size(F.filter("out", lambda b: ~b["keep"])).alias("n_removed"), F.size("hit").alias("n_repeated"),
    )
