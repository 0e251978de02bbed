"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

Lines that are equal, or within `edits` edits (insert, delete, substitute a character), are duplicates; the earliest by
doc_id and line number stays. Distinct lines are joined as follows: a line is split into edits+1 segments, of which at
least one survives `edits` edits unchanged. Each line enters its segments in an index under (length, segment, content)
and probes the indexes of all lengths from its own down to `edits` less, with only those substrings whose position a
match within the threshold can have. Colliding pairs are verified by bit-parallel edit distance in a band of
2*edits+1 diagonals held in one 64-bit word.

A line is removed if its text has an earlier occurrence, or links to a text with an earlier first occurrence, also where
that one is removed for an earlier one itself; so of a chain of links the first line stays, and a later one may lie
further than the threshold from it. kept_from names the documents of the earlier lines, whether those stay or not.

Only hashes are dealt out: a distinct line travels as its id and the hashes of its segments, and texts are fetched for
those lines alone that met another. Segments that several lines share are found on a sample of line ids; their lines
are verified where they meet, so that a group with a common segment gives out its links and not its pairs. A group of more
than `most_group` lines is dealt out again by the segments of what its lines are without the common one. Which way a
segment goes changes no result.

Defined cases: a null text has no lines; blank lines are kept; lines shorter than `least_chars` are duplicates only if
equal; rows that repeat id and line number are the same place and keep each other; a null doc_id comes first; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import cut, stored


def document_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line): lines split at line feeds, from 0."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("line_no", "line"))


def lines_with_ids(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with two 64-bit hashes: id finds a text, both together stand for it."""
    return lines.where("trim(line) <> ''").withColumn("id", F.xxhash64("line")).withColumn("id2", F.xxhash64("line", F.lit(7)))


def _segment(n: Column, i: int, edits: int) -> tuple[Column, Column]:
    """(start from 0, size) of segment i of edits+1 even segments of a line of length n; later ones are longer."""
    k = edits + 1
    base = F.shiftright(n, k.bit_length() - 1) if k & (k - 1) == 0 else F.floor((n + F.lit(0.5)) * (1.0 / k)).cast("int")
    rest = n - base * k
    return base * i + F.greatest(F.lit(0), rest + (i - k)), base + F.when(rest >= k - i, 1).otherwise(0)


def _characters(line: Column, n: Column, start: Column, size: Column) -> Column:
    """Characters start (from 0) to start+size of a line of length n, as bytes. Of a line of one byte a character they are found without a walk."""
    return F.when(F.octet_length(line) == n, F.substring(line.cast("binary"), start + 1, size)).otherwise(F.substring(line, start + 1, size).cast("binary"))


def index_keys(line: Column, n: Column, edits: int) -> list[Column]:
    """Hashes of the segments of a line of length n, with length and number."""
    out = []
    for i in range(edits + 1):
        start, size = _segment(n, i, edits)
        out.append(F.xxhash64(n, F.lit(i), _characters(line, n, start, size)))
    return out


def probe_shifts(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of all substrings that a match within the threshold can come from."""
    out = []
    for d in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, d - (edits - i)), min(i, d + (edits - i))
            out += [(d, i, s) for s in range(low, high + 1)]
    return out


def probe_keys(line: Column, n: Column, edits: int) -> list[Column]:
    """Hashes of the selected substrings of a line of length n, as the index of each length has them; null where none fits."""
    out = []
    for d, i, s in probe_shifts(edits):
        start, size = _segment(n - d, i, edits)
        out.append(F.when((start + s >= 0) & (start + s + size <= n), F.xxhash64(n - d, F.lit(i), _characters(line, n, start + s, size))))
    return out


def code_points(text: Column) -> Column:
    """The text as binary of four bytes a character, of which any part is cut out without a scan."""
    return F.encode(text, "UTF-32")


def _part(code: Column, start: Column, size: Column) -> Column:
    """Characters start (from 0) to start+size of a binary of code points."""
    return F.substring(code, start * 4 + 1, size * 4)


def _shared(a: Column, b: Column, most: Column, part) -> Column:
    """The greatest length at which part(a, from, size) equals part(b, from, size) for all sizes up to it, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in range(24, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= most) & (part(a, p, s) == part(b, p, s)), p + s).otherwise(p))


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of texts a and b if it is at most `edits` (under 31), else a larger number."""
    return _let(F.struct(code_points(a).alias("a"), code_points(b).alias("b")), lambda x: code_distance(x["a"], x["b"], edits))


def code_distance(a: Column, b: Column, edits: int) -> Column:
    """The same for binaries of code points.

    Common ends are cut off first, and of edits+2 segments of what is left two must stand in the other text, at most
    `edits` places off. Then one word holds a column's band of 2*edits+1 cells: bit i is the cell `i` rows below the band's
    top. From one column to the next the band moves down by one, so words of vertical differences shift by one. `d`
    follows the band's lower edge to the last row, then that row.
    """
    m, n = (F.length(a) / 4).cast("int"), (F.length(b) / 4).cast("int")

    def cut_ends(size: Column) -> Column:
        ahead = _shared(a, b, F.least(size["m"], size["n"]), lambda x, p, s: _part(x, p, s))

        def without_ends(p: Column) -> Column:
            ends = ((a, size["m"]), (b, size["n"]))
            behind = F.aggregate(
                F.array(*[F.lit(1 << i) for i in range(24, -1, -1)]),
                F.lit(0),
                lambda q, s: F.when((p + q + s <= F.least(size["m"], size["n"])) & (_part(a, size["m"] - q - s, s) == _part(b, size["n"] - q - s, s)), q + s).otherwise(q),
            )
            middle = lambda q: F.struct(*[_part(x, p, k - p - q).alias(c) for (x, k), c in zip(ends, "ab")], (size["m"] - p - q).alias("m"), (size["n"] - p - q).alias("n"))
            # A byte-order mark in front keeps the decoder from taking the text's own first character for one.
            read = lambda code: F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), code), "UTF-32")
            judge = lambda x: F.when(_may_match(x, edits), _banded(read(x["a"]), read(x["b"]), edits)).otherwise(edits + 1)
            return _let(behind, lambda q: _let(middle(q), judge))

        return F.when(F.abs(size["m"] - size["n"]) > edits, edits + 1).otherwise(_let(ahead, without_ends))

    return _let(F.struct(m.alias("m"), n.alias("n")), cut_ends)


def _may_match(x: Column, edits: int) -> Column:
    """Whether two of edits+2 segments of x.a stand in x.b at most `edits` places off; true for short texts."""
    k = edits + 2
    m = x["m"]

    def stands(i: Column) -> Column:
        start = F.floor(m * i / k).cast("int")
        size = F.floor(m * (i + 1) / k).cast("int") - start
        own = _part(x["a"], start, size)
        return F.exists(F.array(*map(F.lit, range(-edits, edits + 1))), lambda s: (start + s >= 0) & (start + s + size <= x["n"]) & (_part(x["b"], start + s, size) == own))

    return (m < 4 * k) | (F.size(F.filter(F.array(*map(F.lit, range(k))), stands)) >= 2)


def _banded(a: Column, b: Column, edits: int) -> Column:
    width = 2 * edits + 1
    mask = F.lit((1 << width) - 1).cast("long")
    m, n = F.length(a), F.length(b)

    def scan(chars: Column) -> Column:
        def step(state: Column, j: Column) -> Column:
            vp, vn = state["vp"], state["vn"]

            def column(x: Column) -> Column:
                d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(mask)
                return _let(d0, finish)

            def finish(d0: Column) -> Column:
                def after(h: Column) -> Column:
                    below = F.shiftright(d0, 1)
                    at = F.least(F.greatest(chars["m"] - j + edits, F.lit(0)), F.lit(width - 1))
                    bit = lambda w: F.getbit(w, at).cast("int")
                    edge = F.lit(1) - F.shiftright(d0, width - 1).cast("int")
                    d = state["d"] + F.when(j <= chars["m"] - edits, edge).otherwise(bit(h["p"]) - bit(h["n"]))
                    return F.struct(h["n"].bitwiseOR(mask.bitwiseXOR(below.bitwiseOR(h["p"]))).alias("vp"), below.bitwiseAND(h["p"]).alias("vn"), d.cast("int").alias("d"))

                plus = vn.bitwiseOR(mask.bitwiseXOR(d0.bitwiseOR(vp)))
                return _let(F.struct(plus.alias("p"), d0.bitwiseAND(vp).alias("n")), after)

            here = F.get(chars["t"], j - 1)
            match = F.lit(0).cast("long")
            for i in range(width):
                match = match + F.when(F.get(chars["p"], j - 1 - edits + i) == here, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
            return _let(match, column)

        first = F.struct(F.lit(((1 << width) - 1) ^ ((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).cast("int").alias("d"))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars["t"])), first, step, lambda s: s["d"])

    code = lambda x: F.transform(F.split(x, ""), F.ascii)
    run = _let(F.struct(code(a).alias("p"), code(b).alias("t"), m.alias("m")), scan)
    return F.when((m <= edits) | (n == 0), F.levenshtein(a, b)).otherwise(run)


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def line_links(docs: DataFrame, key: str, text: str, edits: int = 2, least_chars: int = 12, hot_lines: int = 8, most_ids: int = 1_000_000, most_group: int = 1000) -> DataFrame:
    """(a, a2, b, b2): distinct lines (both hashes of each) within `edits` edits, each pair once."""
    least_chars = max(least_chars, 3 * (edits + 1))

    def body() -> DataFrame:
        return lines_with_ids(document_lines(docs, key, text)).withColumn("n", F.length("line")).where(F.col("n") >= least_chars)

    def sent(keys: list[Column], name: str) -> DataFrame:
        """A row per distinct line and hash, with the hash's number; equal lines are combined before the shuffle, with hashes as columns."""
        # The higher-order function keeps this projection out of whole-stage code, of which one method would be too long to be compiled.
        never = F.exists(F.array("n"), lambda x: x < 0)
        hashes = [F.when(never, F.lit(None).cast("long")).otherwise(k) if i == 0 else k for i, k in enumerate(keys)]
        names = [f"h{i}" for i in range(len(keys))]
        own = body().select("id", *[h.alias(c) for h, c in zip(hashes, names)]).distinct()
        return own.select(F.col("id").alias(name), F.posexplode(F.array(*names)).alias("pos", "h")).where("h is not null")

    share = 4
    some = body().where(F.pmod("id", F.lit(share)) == 0)
    seen = some.select("id", F.explode(F.array(*index_keys(F.col("line"), F.col("n"), edits))).alias("h")).groupBy("h").agg(F.count_distinct("id").alias("c")).where(F.col("c") >= max(2, hot_lines // share)).select("h")
    index, probe = sent(index_keys(F.col("line"), F.col("n"), edits), "a"), sent(probe_keys(F.col("line"), F.col("n"), edits), "b")
    hot = cut(seen)
    some_hot = hot.limit(1).count() > 0
    on_all = _small(hot, most_ids) if some_hot else None
    common_index, common_probe = (index.join(on_all, "h", "left_anti"), probe.join(on_all, "h", "left_anti")) if some_hot else (index, probe)
    met = common_probe.select("h", "b").join(common_index.select("h", "a").hint("shuffle_hash"), "h").where("a <> b")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if some_hot:
        # One job for both, so that the lines' hashes are computed and dealt out once.
        hot_index = index.join(on_all, "h", "left_semi").select("h", "pos", F.col("a").alias("id"), F.lit(True).alias("indexed"))
        hot_probe = probe.join(on_all, "h", "left_semi").select("h", "pos", F.col("b").alias("id"), F.lit(False).alias("indexed"))
        found = cut(pairs.unionByName(hot_index.unionByName(hot_probe), allowMissingColumns=True))
        pairs, hot_rows = found.where("h is null").select("a", "b"), found.where("h is not null").select("h", "pos", "id", "indexed")
    else:
        pairs = cut(pairs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    if some_hot:
        needed = needed.unionByName(hot_rows.select("id"))
    needed = cut(needed.distinct())
    texts = cut(body().join(_small(needed, most_ids), "id", "left_semi").groupBy("id", "id2").agg(F.first("line").alias("line")).select("id", "id2", code_points(F.col("line")).alias("code")))
    side = lambda c: texts.select(F.col("id").alias(c), F.col("id2").alias(f"{c}2"), F.col("code").alias(f"code_{c}"))
    near = code_distance(F.col("code_a"), F.col("code_b"), edits) <= edits
    out = pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "a2", "b", "b2")
    if some_hot:
        low = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("a2") < F.col("b2")))
        once = (F.length("code_a") < F.length("code_b")) | low  # of two lines of one length each finds the other
        turned = [F.when(low, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("a", "b"), ("a2", "b2"), ("b", "a"), ("b2", "a2"))]
        for rows in _dealt(hot_rows, texts, edits, most_group):
            one = lambda kind, c, rows=rows: rows.where(F.col("indexed") == kind).select("h", F.col("id").alias(c), F.col("id2").alias(f"{c}2"), F.col("code").alias(f"code_{c}"))
            x, y = one(True, "a"), one(False, "b")
            out = out.unionByName(x.join(y, (x.h == y.h) & once & near).select("a", "a2", "b", "b2").select(*turned))
    return out.distinct()


def _dealt(rows: DataFrame, texts: DataFrame, edits: int, most_group: int, depth: int = 4) -> Iterator[DataFrame]:
    """rows (h, pos, id, indexed) with texts (id, id2, code) in portions, whose rows meet by h.

    Of lines that are within the threshold and meet in a segment, what is left without the segment is within it too. So a
    group of more than `most_group` rows is dealt out again by the segments of what is left, and so on; the portion that
    is left after `depth` times is as it is.
    """
    shifts = probe_shifts(edits)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("pos"))
    n = (F.length("code") / 4).cast("int")
    d = F.when(F.col("indexed"), 0).otherwise(pick([d for d, _, _ in shifts]))
    # In the order of a line's own segments, or of the substrings that it probes.
    i = F.when(F.col("indexed"), F.col("pos")).otherwise(pick([i for _, i, _ in shifts]))
    start, size = _segment(n - d, i, edits)
    start = start + F.when(F.col("indexed"), 0).otherwise(pick([s for _, _, s in shifts]))
    held = rows.join(texts, "id").select("h", "id", "id2", "indexed", "code", d.alias("d"), F.col("code").alias("rest"), start.alias("start"), size.alias("size"))
    for _ in range(depth):
        large = cut(rows.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > most_group).select("h"))
        if not large.limit(1).count():
            break
        yield held.join(_small(large, 1_000_000), "h", "left_anti")
        without = F.concat(_part(F.col("rest"), F.lit(0), F.col("start")), F.substring("rest", (F.col("start") + F.col("size")) * 4 + 1, F.length("rest")))
        left = held.join(_small(large, 1_000_000), "h", "left_semi").withColumn("rest", without).withColumn("m", (F.length("rest") / 4).cast("int") - F.col("d"))

        def key(j: int, s: int) -> Column:
            start, size = _segment(F.col("m"), j, edits)
            inside = (start + s >= 0) & (start + s + size <= F.col("m") + F.col("d"))
            return F.when(inside, F.struct(F.xxhash64("h", F.lit(j), _part(F.col("rest"), start + s, size)).alias("h2"), (start + s).alias("start2"), size.alias("size2")))

        own = F.array(*[key(j, 0) for j in range(edits + 1)])
        probes = F.array(*[F.when(F.col("d") == dd, key(j, s)) for dd, j, s in shifts])
        again = left.select("id", "id2", "indexed", "code", "d", "rest", F.explode(F.filter(F.when(F.col("indexed"), own).otherwise(probes), lambda x: x.isNotNull())).alias("k"))
        rows = held = cut(again.select(F.col("k.h2").alias("h"), "id", "id2", "indexed", "code", "d", "rest", F.col("k.start2").alias("start"), F.col("k.size2").alias("size")))
    yield held


def _small(rows: DataFrame, most: int) -> DataFrame:
    """rows, to be broadcast if they are at most `most`; a plain join handles more."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", edits: int = 2, least_chars: int = 12) -> DataFrame:
    """Per document with lines: doc_id, n_lines, n_exact, n_near, n_links, removed_lines, kept_from.

    n_exact and n_near count lines removed as equal to, or within `edits` of, an earlier one; n_links is how many other
    texts its lines link to; removed_lines are line numbers; kept_from the documents of the earlier lines that they repeat.
    """
    lines = document_lines(docs, key, text)
    places = lines.select("doc_id", "line_no", F.when(F.expr("trim(line) <> ''"), F.xxhash64("line")).alias("id"), F.xxhash64("line", F.lit(7)).alias("id2"))
    first = stored(places.where("id is not null").groupBy("id", "id2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")), "lines")
    links = cut(line_links(docs, key, text, edits, least_chars))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("b2").alias("a2"), F.col("a").alias("b"), F.col("a2").alias("b2")))
    others = both.join(first.select(F.col("id").alias("b"), F.col("id2").alias("b2"), F.col("first").alias("other")), ["b", "b2"])
    linked = others.groupBy(F.col("a").alias("id"), F.col("a2").alias("id2")).agg(F.min("other").alias("least_other"), F.count("*").alias("links"))
    judged = first.join(linked, ["id", "id2"], "left").where("n > 1 or links > 0")
    judged = judged.select("id", "id2", "first", "links", F.when(F.col("least_other") < F.col("first"), F.col("least_other")).alias("near"))
    out = places.join(judged, ["id", "id2"], "left").withColumn("here", F.struct("doc_id", "line_no"))
    exact = F.col("first").isNotNull() & (F.col("here") > F.col("first"))
    near = F.col("near").isNotNull() & ~exact
    return out.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(exact).alias("n_exact"),
        F.count_if(near).alias("n_near"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
        F.array_sort(F.collect_list(F.when(exact | near, F.col("line_no")))).alias("removed_lines"),
        F.array_sort(F.collect_set(F.when(exact | near, F.coalesce(F.col("near.doc_id"), F.col("first.doc_id"))))).alias("kept_from"),
    )
