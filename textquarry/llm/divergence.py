"""How the sources of a language differ in the words that they use, by byte tries that are merged range by range.

A radix trie holds the terms of one language: an edge is a stretch of bytes, a leaf has the number of documents with the term
and a counter for each source that has it. It is kept in preorder, a row per leaf: how many bytes the leaf's path shares
with the path of the leaf before, and the rest of its bytes. Preorder is the byte order of UTF-8, so tries are merged by
merging their leaf rows, and a range of prefixes is a stretch of rows that is itself a trie.

Tasks count the terms of their documents into one trie per language and give it out in segments. The segments' first
terms, evenly far apart, tell where the ranges must be cut; segments are cut there, and each range meets in one place,
where counters add up and terms in too few documents go. Sums of the counters and the number of terms per language follow from
the merged ranges. A second walk over them, in byte order, adds up the divergence of each pair of sources and keeps each group's
best candidates; equal values stay in the order of the walk, which is the order of the ranks. All numbers are whole.

A range has one leaf row per task and term at most, whatever the number of occurrences, so common terms are no hot keys.
Work on pairs is terms times the square of a language's sources.

Defined cases: null text, language and source are ''; rows of a (language, source) without terms still make a group, with
pairs of value 0 where the language keeps no term; every row is a document, also with repeated or null ids; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import small_batches, stored, text_or_empty

#: Bytes that are no part of a term become spaces, A to Z small letters.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Leaves of a segment, and counters that a task holds before it gives out its tries and starts anew.
SEGMENT, MOST_COUNTERS = 4_000, 2_000_000
SCALE = 1_000_000_000


class Trie:
    """Leaves in byte order: terms, documents with each, and (leaf, source, count) of its counters, by leaf and source."""

    def __init__(self, terms: pa.Array, docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray):
        self.terms, self.docs, self.leaf, self.source, self.count = terms, docs, leaf, source, count

    @staticmethod
    def merged(terms: pa.Array, docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray) -> Trie:
        """A trie of rows in any order, equal terms and counters summed. `leaf` says which row a counter belongs to."""
        coded = terms.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)
        summed = np.zeros(len(order), np.int64)
        np.add.at(summed, at, docs)
        wide = int(source.max()) + 1 if len(source) else 1
        key = at[leaf] * wide + source
        by = np.argsort(key, kind="stable")
        key = key[by]
        starts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        total = np.add.reduceat(count[by], starts) if len(starts) else count[:0]
        return Trie(coded.dictionary.take(pa.array(order)), summed, key[starts] // wide, key[starts] % wide, total)

    def part(self, i: int, j: int) -> Trie:
        """The leaves from i to before j."""
        a, b = np.searchsorted(self.leaf, [i, j])
        return Trie(self.terms.slice(i, j - i), self.docs[i:j], self.leaf[a:b] - i, self.source[a:b], self.count[a:b])

    def kept(self, least: int) -> Trie:
        """Without leaves of fewer documents."""
        stay = self.docs >= least
        number = np.cumsum(stay) - 1
        own = stay[self.leaf]
        return Trie(self.terms.filter(pa.array(stay)), self.docs[stay], number[self.leaf[own]], self.source[own], self.count[own])

    def packed(self) -> dict:
        """Preorder: bytes shared with the leaf before, the rest of each path, and the counters."""
        shared = _shared(self.terms)
        rest = [t[n:] for t, n in zip(self.terms.to_numpy(zero_copy_only=False).tolist(), shared.tolist())]
        sizes = np.diff(np.searchsorted(self.leaf, np.arange(len(self.terms) + 1))).astype(np.int32)
        return {"shared": shared.tobytes(), "lengths": np.fromiter(map(len, rest), np.int32, len(rest)).tobytes(), "rest": b"".join(rest), "docs": self.docs.tobytes(), "sizes": sizes.tobytes(), "source": self.source.astype(np.int32).tobytes(), "count": self.count.tobytes()}

    @staticmethod
    def unpacked(row: dict) -> Trie:
        shared, lengths, sizes, source = (np.frombuffer(row[k], np.int32) for k in ("shared", "lengths", "sizes", "source"))
        terms, rest, at, before = [], row["rest"], 0, b""
        for n, m in zip(shared.tolist(), lengths.tolist()):
            before = before[:n] + rest[at : at + m]
            terms.append(before)
            at += m
        return Trie(pa.array(terms, type=pa.binary()), np.frombuffer(row["docs"], np.int64), np.repeat(np.arange(len(sizes)), sizes), source.astype(np.int64), np.frombuffer(row["count"], np.int64))


def _shared(terms: pa.Array) -> np.ndarray:
    """Bytes that each term has in common with the one before, found for all terms at once, a byte further each time."""
    out = np.zeros(len(terms), np.int32)
    if len(terms) < 2:
        return out
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    starts, sizes = offsets[:-1], np.diff(offsets)
    most, n = np.minimum(sizes[1:], sizes[:-1]), 0
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        same = open_[data[starts[open_ + 1] + n] == data[starts[open_] + n]]
        n += 1
        out[same + 1] = n
        open_ = same[most[same] > n]
    return out


PACKED = ("shared", "lengths", "rest", "docs", "sizes", "source", "count")
SEGMENTS = "lang string, sources array<string>, first binary, leaves long, " + ", ".join(f"{n} binary" for n in PACKED)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _segments(lang: str, sources: list[str], trie: Trie, size: int = SEGMENT) -> Iterator[dict]:
    """The trie in segments of equally many leaves; one without leaves for an empty trie, which tells of its sources."""
    for i in range(0, max(1, len(trie.terms)), size):
        part = trie.part(i, min(len(trie.terms), i + size))
        yield {"lang": lang, "sources": sources, "first": part.terms[0].as_py() if len(part.terms) else b"", "leaves": len(part.terms)} | part.packed()


class _Counting:
    """The tries that a task is filling: by language, rows of (terms, documents, leaf, source, count) and the sources by number."""

    def __init__(self):
        self.rows: dict[str, list] = {}
        self.sources: dict[str, dict[str, int]] = {}
        self.held = 0

    def add(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        groups: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            groups.setdefault(lang, []).append(i)
        for lang, mine in groups.items():
            known = self.sources.setdefault(lang, {})
            which = np.array([known.setdefault(sources[i], len(known)) for i in mine], dtype=np.int64)
            lists = pc.ascii_split_whitespace(pa.array([texts[i].translate(TERM_BYTES).strip() for i in mine], type=pa.large_binary()).cast(pa.large_string(), safe=False))
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            word = pc.not_equal(flat, "")  # a text without terms splits into one empty word
            if not pc.all(word).as_py():
                doc = np.repeat(np.arange(len(mine)), counts)[word.to_numpy(zero_copy_only=False)]
                flat = flat.filter(word)
            else:
                doc = np.repeat(np.arange(len(mine)), counts)
            coded = flat.cast(pa.large_binary()).dictionary_encode()
            terms, n = coded.dictionary.cast(pa.binary()), len(mine)
            pair, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n + doc, return_counts=True)  # by term, then document
            leaf, source = pair // n, which[pair % n]
            wide = len(known)
            key = leaf * wide + source
            by = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[by], prepend=-1))
            total = np.add.reduceat(times[by], starts) if len(starts) else times[:0]
            key = key[by][starts]
            self.rows.setdefault(lang, []).append((terms, np.bincount(leaf, minlength=len(terms)).astype(np.int64), key // wide, key % wide, total.astype(np.int64)))
            self.held += len(key)

    def squeeze(self) -> None:
        """One trie per language of all rows so far."""
        self.held = 0
        for lang, rows in self.rows.items():
            trie = _of(rows)
            self.rows[lang] = [(trie.terms, trie.docs, trie.leaf, trie.source, trie.count)]
            self.held += len(trie.count)

    def out(self) -> Iterator[dict]:
        for lang in self.sources:
            yield from _segments(lang, list(self.sources[lang]), _of(self.rows.get(lang, [])))
        self.__init__()


def _of(rows: list[tuple]) -> Trie:
    if not rows:
        none = np.zeros(0, np.int64)
        return Trie(pa.array([], type=pa.binary()), none, none, none, none)
    base = np.cumsum([0] + [len(r[0]) for r in rows[:-1]])
    return Trie.merged(pa.concat_arrays([r[0] for r in rows]), *(np.concatenate([r[1] for r in rows]), np.concatenate([r[2] + b for r, b in zip(rows, base)])), *(np.concatenate([r[i] for r in rows]) for i in (3, 4)))


def partial_tries(docs: DataFrame, *, text: str, lang: str, source: str) -> DataFrame:
    """The tries of each task, in segments."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting, kinds = _Counting(), _arrow(SEGMENTS)
        most = MOST_COUNTERS
        give = lambda: (pa.RecordBatch.from_pylist([s], schema=kinds) for s in counting.out())
        for batch in it:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t.as_py() for t in batch.column(2)]
            at, held = 0, 0
            for i, t in enumerate(texts, 1):
                held += len(t)
                if held >= 4 << 20 or i == len(texts):
                    counting.add(langs[at:i], sources[at:i], texts[at:i])
                    at, held = i, 0
            if counting.held > most:
                counting.squeeze()
                if counting.held > most // 2:
                    yield from give()
        yield from give()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    with small_batches(docs.sparkSession, 2000):
        return docs.select(empty(lang).alias("l"), empty(source).alias("s"), text_or_empty(text).cast("binary").alias("t")).mapInArrow(run, SEGMENTS)


def merged_tries(parts: DataFrame, *, least_docs: int, ranges: int) -> DataFrame:
    """The corpus's tries, cut into ranges of prefixes, without terms of fewer documents; in segments as well."""
    # The first terms of segments are evenly far apart, so every so many of them begin a range: at most `ranges` rows come to the driver.
    firsts = parts.where("leaves > 0").select(F.col("first").alias("f"))
    n = firsts.count()
    step = max(1, n // ranges)
    cuts = [bytes(r.f) for r in firsts.where(F.pmod(F.xxhash64("f", F.monotonically_increasing_id()), F.lit(step)) == 0).distinct().orderBy("f").limit(4 * ranges).collect()]

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _arrow("r int, " + SEGMENTS)
        for batch in it:
            for row in batch.to_pylist():
                trie = Trie.unpacked(row)
                terms = trie.terms.to_numpy(zero_copy_only=False)
                at = [0, *(int(np.searchsorted(terms, c)) if len(terms) else 0 for c in cuts), len(terms)]
                for r, (i, j) in enumerate(zip(at, at[1:])):
                    if i < j or (r == 0 and not len(terms)):
                        yield pa.RecordBatch.from_pylist([{"r": r, **s} for s in _segments(row["lang"], row["sources"], trie.part(i, j), 1 << 40)], schema=kinds)

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _arrow(SEGMENTS)

        def close(lang: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
            names: dict[str, int] = {}
            tries = []
            for row in rows:
                number = np.array([names.setdefault(s, len(names)) for s in row["sources"]], dtype=np.int64)
                t = Trie.unpacked(row)
                tries.append((t.terms, t.docs, t.leaf, number[t.source], t.count))
            for s in _segments(lang, list(names), _of(tries).kept(least_docs)):
                yield pa.RecordBatch.from_pylist([s], schema=kinds)

        key, rows = None, []
        for batch in it:
            for row in batch.to_pylist():
                if (row["r"], row["lang"]) != key:
                    if rows:
                        yield from close(key[1], rows)
                    key, rows = (row["r"], row["lang"]), []
                rows.append(row)
        if rows:
            yield from close(key[1], rows)

    with small_batches(parts.sparkSession, 4):
        dealt = parts.mapInArrow(deal, "r int, " + SEGMENTS)
        return dealt.repartitionById(len(cuts) + 1, F.col("r")).sortWithinPartitions("r", "lang").mapInArrow(merge, SEGMENTS)


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total) for count <= total, by long division in steps of a thousand, so that nothing overflows."""
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


WALK = "lang string, source string, part string, item binary, value long"


#: Sources of all languages up to which the totals are broadcast, so that segments stay where they are.
MOST_SOURCES = 200_000


def walked(tries: DataFrame, totals: DataFrame, *, most_ranks: int) -> DataFrame:
    """Each segment's sums for pairs of sources, and its candidates: at most `most_ranks` terms a group, in the order of the ranks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _arrow(WALK)
        for batch in it:
            for row in batch.to_pylist():
                trie, names, n = Trie.unpacked(row), row["all_sources"], np.array(row["n"], dtype=np.int64)
                number = {s: i for i, s in enumerate(names)}
                here = np.array([number[s] for s in row["sources"]], dtype=np.int64)
                terms, v = trie.terms.to_numpy(zero_copy_only=False), row["v"]
                pairs = np.zeros((len(names), len(names)), np.int64)
                best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                block = max(1, (4 << 20) // (8 * len(names)))
                for at in range(0, len(terms), block):
                    part = trie.part(at, min(len(terms), at + block))
                    c = np.zeros((len(part.terms), len(names)), np.int64)
                    c[part.leaf, here[part.source]] = part.count
                    p = shares(c + 1, n + v)
                    whole = shares(c.sum(axis=1) + 1, np.int64(n.sum() + v))
                    for i in range(len(names)):
                        pairs[i] += _divergence(p[:, i : i + 1], p).sum(axis=0)
                        more = np.flatnonzero((c[:, i] > 0) & (p[:, i] > whole))
                        value = _divergence(p[more, i], whole[more])
                        value, more = (np.concatenate(x) for x in zip(best.get(i, (value[:0], more[:0])), (value, more + at)))
                        order = np.argsort(-value, kind="stable")[:most_ranks]
                        best[i] = value[order], more[order]
                out: dict[str, list] = {k.name: [] for k in kinds}
                for i, name in enumerate(names):
                    others = [j for j in range(len(names)) if j != i]
                    value, more = best[i]
                    out["source"] += [name] * (len(others) + len(more))
                    out["part"] += ["pair"] * len(others) + ["term"] * len(more)
                    out["item"] += [names[j].encode() for j in others] + terms[more].tolist()
                    out["value"] += pairs[i, others].tolist() + value.tolist()
                out["lang"] = [row["lang"]] * len(out["item"])
                yield pa.RecordBatch.from_pydict(out, schema=kinds)

    few = (totals.agg(F.sum(F.size("all_sources"))).first()[0] or 0) <= MOST_SOURCES
    with small_batches(tries.sparkSession, 4):
        return tries.where("leaves > 0").join(F.broadcast(totals) if few else totals, "lang").mapInArrow(run, WALK)


def group_totals(tries: DataFrame) -> DataFrame:
    """Per language: its sources in byte order, occurrences of kept terms in each, and the number of kept terms."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                sums = np.zeros(len(row["sources"]), np.int64)
                np.add.at(sums, np.frombuffer(row["source"], np.int32), np.frombuffer(row["count"], np.int64))
                yield pa.RecordBatch.from_pylist([{"lang": row["lang"], "source": s, "n": int(n), "v": row["leaves"] if i == 0 else 0} for i, (s, n) in enumerate(zip(row["sources"], sums))])

    with small_batches(tries.sparkSession, 4):
        per = tries.mapInArrow(run, "lang string, source string, n long, v long").groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    rows = F.array_sort(F.collect_list(F.struct("source", "n")))  # as many as the language has sources
    return per.groupBy("lang").agg(rows.alias("g"), F.sum("v").alias("v")).select("lang", F.col("g.source").alias("all_sources"), F.col("g.n").alias("n"), "v")


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, most_ranks: int = 200) -> DataFrame:
    """Per (lang, source): its divergence from each other source (part `pair`, all ranks) and the terms that it has more often than its
    language (part `term`, `most_ranks` ranks): lang, source, part, item, value, rank."""
    parts = stored(partial_tries(docs, text=text, lang=lang, source=source), "partial-tries")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tries = stored(merged_tries(parts, least_docs=least_docs, ranges=ranges), "tries")
    totals = stored(group_totals(tries), "totals")
    found = stored(walked(tries, totals, most_ranks=most_ranks), "walked")
    one = totals.select("lang", F.explode("all_sources").alias("source"))
    pairs = one.join(one.withColumnRenamed("source", "item"), "lang").where("source <> item")  # as many rows as the result has
    summed = found.where("part = 'pair'").groupBy("lang", "source", F.col("item").cast("string").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("item", F.col("item").cast("string")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most_ranks)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)
