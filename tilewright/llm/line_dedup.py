"""Line de-duplication by a segment-partition edit join, in DataFrame functions only.

A line goes if an earlier line of the corpus (by doc_id, then line number) is equal or within ``edits`` edits.
Lines of fewer than ``least`` characters are not compared by edits: so short, a few edits do not show a copy. Equal
lines that are not blank are copies from ``equal_least`` characters on.

Lines of length l are split into ``edits + 1`` segments. A line within ``edits`` edits holds one of them unchanged,
shifted by a bounded number of places, so each line probes the segments of lines of its own and the next shorter
lengths with few substrings (multi-match-aware selection). Equal lines are merged first. Candidates are verified
by a banded bit-parallel edit distance.

Groups of one key are not paired. Every member first meets the earliest line of its group; only members that do
not lie near it meet the others, after comparing letter counts. So a group of many variants costs about its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import bucketed_rank
from .common import fresh, written

EDITS, LEAST = 2, 20
# Rows of a few numbers that are broadcast at most.
BROADCAST = 1_000_000
# A place is a document's number * LINES + line number; twice a place is a 64-bit number. An array of LINES texts is
# beyond what a row of Spark holds.
LINE_BITS, NUMBERS = 27, 1 << 35
LINES = 1 << LINE_BITS
# Ranges of ids that are ranked apart.
RANGES = 256
LETTERS = "etaoinsrhludcwmgpbfyv .|,0123456789"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number below ``NUMBERS`` per doc_id that keeps their order, -1 for null.

    Ids that are such numbers number themselves. Others (hashed or negative ids) are ranked: ranges of ids in
    parallel, then added up by the counts of the ranges before.
    """
    ids = F.col("doc_id").cast("bigint")
    low, high = docs.agg(F.min(ids), F.max(ids)).first()
    if low is None or (low >= 0 and high < NUMBERS):
        return docs.withColumn(name, F.coalesce(ids, F.lit(-1)))
    key, bucket, kept = fresh(docs, "_key", "_bucket", "_kept")
    known = written(docs.select(ids.alias(key)).where(F.col(key).isNotNull()).distinct(), "doc-ids")
    bounds = known.stat.approxQuantile(key, [k / RANGES for k in range(1, RANGES)], 0.25 / RANGES) if low < high else []
    # Cuts near the quantiles; which ones does not change the numbers.
    cuts = F.array(*[F.lit(min(int(x), (1 << 63) - 1)) for x in sorted(set(bounds))]).cast("array<bigint>")
    ranked = bucketed_rank(known.withColumn(bucket, F.size(F.filter(cuts, lambda c: c <= F.col(key)))), bucket, [key], name=name)
    ranked = written(ranked.select(F.col(key).alias(kept), name), "doc-numbers")
    return docs.withColumn(key, ids).join(ranked, F.col(key) == F.col(kept), "left").withColumn(name, F.coalesce(name, F.lit(-1))).select(*docs.columns, name)


def split_lines(docs: DataFrame, number: str) -> DataFrame:
    """``place, line`` of every line; a null text has none. The number -1, of a null doc_id, comes before all others."""
    return docs.select(F.col(number).alias("_d"), F.posexplode(F.split("text", "\n", -1)).alias("_n", "line")).select(
        (F.col("_d") * LINES + F.col("_n")).alias("place"), "line"
    )


def selection(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of each substring that a line probes, segments from 1."""
    out = []
    for delta in range(edits + 1):
        for i in range(1, edits + 2):
            low = max(-(i - 1), delta - (edits + 1 - i))
            high = min(i - 1, delta + (edits + 1 - i))
            out += [(delta, i, shift) for shift in range(low, high + 1)]
    return out


def _segment(length: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment ``i``: even parts, the last ones longer by one."""
    parts = edits + 1
    base = F.floor(length / parts).cast("int")
    extra = length - base * parts
    size = base + F.when(i > parts - extra, 1).otherwise(0)
    start = F.lit(1) + base * (i - 1) + F.greatest(F.lit(0), i - 1 - (F.lit(parts) - extra))
    return start, size


def keys(lines: DataFrame, edits: int) -> DataFrame:
    """``key, member`` of ``lines(place, line)``: member is twice the place, plus 1 for a probe.

    A line is repeated for each of its substrings, and one expression makes all keys: one expression for each of them
    is more code than the virtual machine compiles in a method, which it then interprets.
    """
    own = [(0, i, 0, 0) for i in range(1, edits + 2)]
    # A line's own segment as a probe is there already: segments meet segments, too.
    probes = [(delta, i, shift, 1) for delta, i, shift in selection(edits) if delta or shift]
    names = ("_delta", "_i", "_shift", "_probe")
    parts = F.array(*[F.struct(*[F.lit(v).alias(name) for v, name in zip(part, names)]) for part in own + probes])
    each = lines.select("place", "line", F.length("line").alias("_n")).select("place", "line", "_n", F.inline(parts))
    length = F.col("_n") - F.col("_delta")
    start, size = _segment(length, F.col("_i"), edits)
    each = each.select("place", "line", "_n", "_i", "_probe", length.alias("_length"), (start + F.col("_shift")).alias("_at"), size.alias("_size"))
    fits = each.where("_at >= 1 and _at + _size - 1 <= _n")
    return fits.select(
        F.xxhash64("_i", "_length", F.substring("line", F.col("_at"), F.col("_size"))).alias("key"), (F.col("place") * 2 + F.col("_probe")).alias("member")
    )


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two texts if it is at most ``most``, else ``most + 1``: a band of ``2 * most + 1`` bits.

    Column j of the table holds rows j - most to j + most as the bits of a number. Sums with carry pass matches
    along the band; the distance is followed along the band's last row, then along the last row of the table.
    """
    top, full = 2 * most, (1 << (2 * most + 1)) - 1

    def shifted(x: Column) -> Column:
        return F.shiftright(x, 1)

    def inverse(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(full))

    def distance(rows: Column, columns: Column) -> Column:
        m = F.size(rows)

        def step(state: Column, j: Column) -> Column:
            vp, vn, d = state["vp"], state["vn"], state["d"]

            def with_char(c: Column) -> Column:
                match = sum((F.when(F.get(rows, j + (k - most - 1)) == c, 1 << k).otherwise(0) for k in range(top + 1)), F.lit(0))

                def with_match(x: Column) -> Column:
                    d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))

                    def with_d0(z: Column) -> Column:
                        hp = vn.bitwiseOR(inverse(z.bitwiseOR(vp)))

                        def with_hp(h: Column) -> Column:
                            hn = z.bitwiseAND(vp)
                            last = m - j + most
                            along = F.pmod(F.call_function("shiftright", h, last), F.lit(2)) - F.pmod(F.call_function("shiftright", hn, last), F.lit(2))
                            down = F.lit(1) - F.shiftright(z, top)
                            return F.struct(
                                hn.bitwiseOR(inverse(shifted(z).bitwiseOR(h))).alias("vp"), shifted(z).bitwiseAND(h).alias("vn"),
                                (d + F.when(j + most <= m, down).otherwise(along)).alias("d"),
                            )

                        return _let(hp, with_hp)

                    return _let(d0, with_d0)

                return _let(match, with_match)

            return _let(F.get(columns, j - 1), with_char)

        start = F.struct(F.lit((full << most) & full).alias("vp"), F.lit(0).alias("vn"), F.least(F.lit(most), m).alias("d"))
        end = F.aggregate(F.sequence(F.lit(1), F.size(columns)), start, step, lambda s: s["d"])
        return F.least(end, F.lit(most + 1))

    la, lb = F.length(a), F.length(b)
    return (
        F.when(F.abs(la - lb) > most, most + 1)
        .when((la == 0) | (lb == 0), F.least(F.greatest(la, lb), F.lit(most + 1)))
        .otherwise(_let(F.split(a, ""), lambda x: _let(F.split(b, ""), lambda y: distance(x, y))))
    )


def letter_counts(line: Column) -> Column:
    """How often some common characters occur: an edit changes the sum of all by 2 at most."""
    return F.array(*[F.length(line) - F.length(F.replace(line, F.lit(c))) for c in LETTERS])


def _near(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """``place`` of the later line of each pair ``place, earlier`` that is within ``edits`` edits."""
    own = lines.select(F.col("place").alias("_x"), "line")
    other = lines.select(F.col("place").alias("_y"), F.col("line").alias("other"))
    met = pairs.join(own, F.col("place") == F.col("_x")).join(other, F.col("earlier") == F.col("_y")).select("place", "line", "other")
    close = sum((F.abs(letter_counts(F.col("line"))[k] - letter_counts(F.col("other"))[k]) for k in range(len(LETTERS))), F.lit(0)) <= 2 * edits
    return met.where(close & (edit_distance(F.col("line"), F.col("other"), edits) <= edits)).select("place").distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def repeated_lines(docs: DataFrame, number: str, edits: int = EDITS, least: int = LEAST, equal_least: int = LEAST) -> DataFrame:
    """``place`` of all lines of documents with a ``number`` that go; a line is judged by what stands before it, not by what stays.

    Texts are not shuffled: equal lines meet by a 128-bit hash, and only the texts of candidates are gathered.
    """
    long = F.length("line") >= least
    rows = split_lines(docs, number).where(long | ((F.length("line") >= equal_least) & F.col("line").rlike(r"\S")))
    hashed = rows.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})
    equal = hashed.groupBy("h", "g").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    equal = _small(written(equal.drop("last"), "equal-lines"), BROADCAST)
    again = hashed.select("h", "g", "place").join(equal, ["h", "g"]).where("place > first").select("place")
    lines = hashed.join(equal, ["h", "g"], "left").where(long & F.expr("first is null or place = first")).select("place", "line")

    found = keys(lines, edits).repartition("key")
    probe = F.col("member") % 2 != 0
    own = F.col("member").bitwiseAND(F.lit(~1))
    sums = found.groupBy("key").agg(
        F.min(F.when(~probe, own)).alias("i_low"), F.max(F.when(~probe, own)).alias("i_high"),
        F.min(F.when(probe, own)).alias("p_low"), F.max(F.when(probe, own)).alias("p_high"),
    )
    # A key that only one line has, as its segment and its probe, links nothing.
    shared = sums.where("i_low is not null and least(i_low, p_low) < greatest(i_high, p_high)")
    members = written(found.join(shared.hint("shuffle_hash"), "key").select("key", "member", "i_low", "i_high", "p_low", "p_high"), "line-keys")
    # Segments meet segments and probes, probes meet segments.
    pivot = F.when(probe, F.col("i_low")).otherwise(F.least("i_low", "p_low"))
    place = F.shiftright(own, 1)
    asked = _small(written(members.select(place.alias("place")).distinct(), "asked-lines"), BROADCAST)
    texts = written(lines.join(asked, "place", "left_semi"), "candidate-lines")
    first = members.select(place.alias("place"), F.shiftright(pivot, 1).alias("earlier")).where("earlier < place").distinct()
    near = written(_near(first, texts, edits), "near-lines")

    # What is left of groups with more than the pivot: compared with every earlier line that it may meet.
    more = F.when(probe, F.col("i_high") > pivot).otherwise(F.greatest("i_high", "p_high") > pivot)
    open_members = members.where((pivot < own) & more).select("key", place.alias("place"), probe.alias("probe")).join(near, "place", "left_anti")
    keyed = members.join(open_members.select("key").distinct(), "key", "left_semi").select("key", place.alias("place"), probe.alias("probe"))
    counted = texts.select("place", F.length("line").alias("n"), letter_counts(F.col("line")).alias("counts"))
    left = open_members.join(counted, "place").alias("l")
    right = keyed.join(counted, "place").alias("r")
    apart = sum((F.abs(F.col("l.counts")[k] - F.col("r.counts")[k]) for k in range(len(LETTERS))), F.lit(0))
    met = left.join(
        right,
        (F.col("l.key") == F.col("r.key")) & ~(F.col("l.probe") & F.col("r.probe")) & (F.col("r.place") < F.col("l.place"))
        & (F.abs(F.col("l.n") - F.col("r.n")) <= edits) & (apart <= 2 * edits),
    )
    pairs = met.select(F.col("l.place").alias("place"), F.col("r.place").alias("earlier")).distinct()
    return again.union(near).union(_near(pairs, texts, edits)).distinct()


def dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST, equal_least: int | None = None) -> DataFrame:
    """``docs`` with ``text`` without the lines that go, and the counts ``_lines`` and ``_gone`` of its lines.

    The other columns are unchanged, but for ``_lines`` and ``_gone``, which are replaced; a null text stays null.
    All rows are returned. Lines that stay keep their order. Rows that repeat a doc_id are taken as one document:
    their n-th lines share a place, so equal ones do not remove each other.
    """
    number, key, cut_column = fresh(docs, "_number", "_d", "_cut")
    rows = numbered(docs, number)
    gone = repeated_lines(rows, number, edits, least, least if equal_least is None else equal_least)
    kept_columns = [c for c in docs.columns if c not in ("_lines", "_gone")]
    cut = gone.groupBy(F.shiftright("place", LINE_BITS).alias(key)).agg(
        F.collect_set(F.pmod(F.col("place"), F.lit(LINES)).cast("int")).alias(cut_column)
    )
    parts = F.split("text", "\n", -1)
    joined = rows.select(*kept_columns, number).join(cut, F.col(number) == F.col(key), "left").drop(number, key)
    kept = F.transform(
        F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(cut_column, s["i"])), lambda s: s["x"]
    )
    text = F.when(F.col(cut_column).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumns({
        "text": text, "_lines": F.coalesce(F.size(parts), F.lit(0)), "_gone": F.coalesce(F.size(cut_column), F.lit(0)),
    }).drop(cut_column)
