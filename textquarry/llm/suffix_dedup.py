"""Suffix-array dedup: remove every byte that lies in a `width`-byte string which also starts earlier.

A string of `width` bytes has an anchor in it (see minimizers), so only strings with equal bytes at their anchors can be
equal, and what must be sorted is the suffixes at anchors, not those at all bytes:

1. Scan: documents give a row of hashes per anchor: of the bytes at the anchor, and of all bytes that its strings cover.
   Of anchors with the same covered bytes the earliest stands for all; the strings of the others start earlier.
2. Anchors whose own bytes occur with different surroundings are open. Their suffixes are fetched and range-partitioned
   by their leading bytes with sampled splitters; splitters lie between different leading bytes, so what a bucket
   compares never lies on both sides of a boundary. A bucket takes its suffixes in order, cuts out their strings and
   sorts them by multikey quicksort: a string equal to its neighbour is a copy unless it is the first of its run.
3. Leading bytes with very many suffixes are split further: their strings are range-partitioned by themselves, each task
   sending a string once, and neighbours are compared in the sorted buckets.

Order is by doc_id, then start. Defined cases: a null text is empty; matches never cross documents; a text shorter than
`width` loses nothing; a null doc_id stands beside the least id there can be, in the order of a hash of its text; rows that repeat id and text are one document and have the same
result; rows that repeat the id alone are ordered by a hash of their texts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import cut, small_batches
from textquarry.llm.minimizers import BASE_2, RollingHash, anchors, mix

NO_ID = -(1 << 63)
SCAN_BYTES = 1 << 20
PARTS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("k", pa.int64()), ("th", pa.int64()), ("blob", pa.binary())])
PARTS_SQL = "kind int, bucket int, k long, th long, blob binary"
COPIED, OPEN, ANCHORS = 1, 2, 0
#: An anchor as it travels: hash of its bytes, hash of all that its strings cover, document, first start, starts, offset.
ANCHOR = np.dtype([("kh", "<u8"), ("ch", "<u8"), ("doc", "<u4"), ("s", "<u4"), ("n", "<u2"), ("o", "<u2")])
STARTS = np.dtype([("s", "<u4"), ("n", "<u2"), ("o", "<u2")])
SPAN = np.dtype([("a", "<u4"), ("b", "<u4")])


def _documents(it: Iterator[pa.RecordBatch], most: int = SCAN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    ks: list[int] = []
    ths: list[int] = []
    texts: list[bytes] = []
    held = 0
    for batch in it:
        columns = [batch.column(i).to_pylist() for i in range(2)]
        for k, th, t in zip(*columns, batch.column(2).cast(pa.binary())):
            ks.append(k)
            ths.append(th)
            texts.append(t.as_py())
            held += len(texts[-1])
            if held >= most:
                yield np.array(ks, dtype=np.int64), np.array(ths, dtype=np.int64), texts
                ks, ths, texts, held = [], [], [], 0
    if texts:
        yield np.array(ks, dtype=np.int64), np.array(ths, dtype=np.int64), texts


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted (n, 2) spans with touching ones united."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.concatenate([at[1:] - 1, [len(spans) - 1]])]], axis=1) if len(spans) else spans


def _span_rows(doc: np.ndarray, low: np.ndarray, high: np.ndarray, ks: np.ndarray, ths: np.ndarray, buckets: int) -> list[tuple]:
    """A COPIED row per document from spans of several."""
    order = np.argsort(doc, kind="stable")
    doc, spans = doc[order], np.stack([low[order], high[order]], axis=1).astype(np.int64)
    cuts = np.flatnonzero(np.diff(doc)) + 1
    out = []
    for part in np.split(np.arange(len(doc)), cuts) if len(doc) else []:
        own, d = merged(spans[part]), doc[part[0]]
        out.append((COPIED, int((int(ks[d]) ^ int(ths[d])) % buckets), int(ks[d]), int(ths[d]), own.astype("<u4").tobytes()))
    return out


def _open_rows(doc: np.ndarray, s: np.ndarray, n: np.ndarray, o: np.ndarray, ks: np.ndarray, ths: np.ndarray, buckets: int) -> list[tuple]:
    order = np.argsort(doc, kind="stable")
    packed = np.zeros(len(doc), dtype=STARTS)
    packed["s"], packed["n"], packed["o"] = s[order], n[order], o[order]
    doc = doc[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    parts = [(int(ks[doc[p[0]]]), int(ths[doc[p[0]]]), packed[p].tobytes()) for p in (np.split(np.arange(len(doc)), cuts) if len(doc) else [])]
    return [(OPEN, (k ^ th) % buckets, k, th, blob) for k, th, blob in parts]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), PARTS)], schema=PARTS)


def _ranks(ks: np.ndarray, ths: np.ndarray) -> np.ndarray:
    """Dense ranks of documents by (k, th); rows of one document have one rank."""
    order = np.lexsort((ths, ks))
    new = np.ones(len(ks), dtype=bool)
    new[1:] = (ks[order][1:] != ks[order][:-1]) | (ths[order][1:] != ths[order][:-1])
    out = np.empty(len(ks), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _classes(kh: np.ndarray, ch: np.ndarray, rank: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by (kh, ch, rank, s); in that order: new kh, new class, copies (those at a later place than their class's first)."""
    order = np.lexsort((s, rank, ch, kh))
    kh, ch, rank, s = kh[order], ch[order], rank[order], s[order]
    new_kh = np.ones(len(kh), dtype=bool)
    new_kh[1:] = kh[1:] != kh[:-1]
    new = new_kh.copy()
    new[1:] |= ch[1:] != ch[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(kh) else np.zeros(0, dtype=np.int64)
    copies = ~new & ((rank != rank[first]) | (s != s[first]))
    return order, new_kh, new, copies


def _scan(width: int, k: int, buckets: int, hot: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ks, ths, texts in _documents(it):
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            stops = np.cumsum([len(t) for t in texts])
            first, n, anchor, kh, rolling = anchors(data, stops, width, k)
            if not len(first):
                continue
            doc = np.searchsorted(stops, first, "right")
            s = first - np.concatenate([[0], stops[:-1]])[doc]
            offset = anchor - first
            ch = mix(rolling.of(first, first + n + width - 1) ^ (n.astype(np.uint64) << np.uint64(8)) ^ offset.astype(np.uint64))
            order, _, new, copies = _classes(kh, ch, _ranks(ks, ths)[doc], s)
            c = order[copies]
            rows = _span_rows(doc[c], s[c], s[c] + n[c] + width - 1, ks, ths, buckets)
            own = order[new]
            if len(hot):
                is_hot = np.isin(kh[own], hot)
                h, own = own[is_hot], own[~is_hot]
                rows += _open_rows(doc[h], s[h], n[h], offset[h], ks, ths, buckets)
            spread = kh[own] * np.uint64(BASE_2)  # hashes at anchors are small ones
            bucket = ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            own, bucket = own[by], bucket[by]
            for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(bucket)) + 1) if len(own) else []:
                at = own[part]
                docs, index = np.unique(doc[at], return_inverse=True)
                packed = np.zeros(len(at), dtype=ANCHOR)
                packed["kh"], packed["ch"], packed["doc"], packed["s"], packed["n"], packed["o"] = kh[at], ch[at], index, s[at], n[at], offset[at]
                rows.append((ANCHORS, int(bucket[part[0]]), 0, 0, struct.pack("<I", len(docs)) + ks[docs].tobytes() + ths[docs].tobytes() + packed.tobytes()))
            if rows:
                yield _table(rows)

    return run


def _settle(width: int, buckets: int):
    """A bucket of anchors: copies of whole classes are settled; anchors with several surroundings become open."""

    def run(table: pa.Table) -> pa.Table:
        ks, ths, parts, rows, base = [], [], [], [], 0
        for kind, k, th, blob in zip(*(table.column(c) for c in ("kind", "k", "th", "blob"))):
            if kind.as_py() != ANCHORS:
                rows.append((kind.as_py(), 0, k.as_py(), th.as_py(), blob.as_py()))
                continue
            raw = blob.as_py()
            (m,) = struct.unpack_from("<I", raw)
            ks.append(np.frombuffer(raw, dtype="<i8", count=m, offset=4))
            ths.append(np.frombuffer(raw, dtype="<i8", count=m, offset=4 + 8 * m))
            part = np.frombuffer(raw, dtype=ANCHOR, offset=4 + 16 * m)
            parts.append((part, base))
            base += m
        if parts:
            k, th = np.concatenate(ks), np.concatenate(ths)
            a = np.concatenate([p for p, _ in parts])
            doc = np.concatenate([p["doc"].astype(np.int64) + b for p, b in parts])
            s, n, o = a["s"].astype(np.int64), a["n"].astype(np.int64), a["o"].astype(np.int64)
            order, new_kh, new, copies = _classes(a["kh"], a["ch"], _ranks(k, th)[doc], s)
            c = order[copies]
            rows += _span_rows(doc[c], s[c], s[c] + n[c] + width - 1, k, th, buckets)
            group = np.cumsum(new_kh) - 1
            several = np.bincount(group, weights=new) > 1
            at = order[new & several[group]]
            rows += _open_rows(doc[at], s[at], n[at], o[at], k, th, buckets)
        return pa.Table.from_batches([_table(rows)]) if rows else PARTS.empty_table()

    return run


SUFFIX = "lead binary, bytes binary, k long, th long, s long, n int, o int"
STRING = "string binary, k long, th long, s long"


def _fetch(width: int, lead: int):
    """Open anchors of joined documents with the bytes that their strings cover and the suffix's leading bytes."""
    schema = pa.schema([("lead", pa.binary()), ("bytes", pa.binary()), ("k", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("o", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in it:
            for k, th, text, blobs in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("k", "th", "t", "blobs"))):
                body, k, th = text.as_py().encode(), k.as_py(), th.as_py()
                for s, n, o in np.unique(np.concatenate([np.frombuffer(b, dtype=STARTS) for b in blobs.as_py()])).tolist():
                    rows.append((body[s + o : s + o + lead], body[s : s + n + width - 1], k, th, s, n, o))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian words, and which rows differ from the one before.

    The multikey scheme, all groups at once: rows that are tied so far are split by their next word, and only groups that
    are tied still go on to the word after it. A split is a library sort of the group's words, not one ternary partition.
    """
    n, depth = words.shape
    order = np.arange(n)
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    active = np.arange(n)
    for d in range(depth):
        if not len(active):
            break
        group = np.cumsum(new)[active]
        key = words[order[active], d]
        by = np.lexsort((key, group))
        order[active] = order[active][by]
        key, group = key[by], group[by]
        split = np.zeros(len(active), dtype=bool)
        split[1:] = (group[1:] == group[:-1]) & (key[1:] != key[:-1])
        new[active[split]] = True
        sizes = np.diff(np.append(np.flatnonzero(new), n))
        active = np.flatnonzero(np.repeat(sizes > 1, sizes))
    return order, new


def _strings(flat: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The strings that start at `at` as rows of big-endian words."""
    padded = -(-width // 8) * 8
    out = np.zeros((len(at), padded), dtype=np.uint8)
    out[:, :width] = np.lib.stride_tricks.sliding_window_view(flat, width)[at]
    return out.view(">u8").astype(np.uint64)


def _unfold(rows: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of suffix rows end to end; then per string: where it is in them, its row, its start in its document."""
    n = np.array([r[5] for r in rows], dtype=np.int64)
    sizes = n + width - 1
    base = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(rows)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    flat = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8)
    return flat, base[row] + step, row, np.array([r[4] for r in rows], dtype=np.int64)[row] + step


def repeated_strings(rows: list[tuple], width: int) -> list[tuple]:
    """COPIED rows for the strings of these suffixes that also start earlier among them."""
    flat, at, row, start = _unfold(rows, width)
    rank = _ranks(np.array([r[2] for r in rows], dtype=np.int64), np.array([r[3] for r in rows], dtype=np.int64))
    rolling = RollingHash(flat, BASE_2)
    digest = rolling.of(at, at + width)
    by = np.argsort(digest, kind="stable")
    same = digest[by][1:] == digest[by][:-1]
    often = np.zeros(len(at), dtype=bool)
    often[by[1:][same]] = often[by[:-1][same]] = True
    at, row, start = at[often], row[often], start[often]
    if not len(at):
        return []
    order, new = multikey_order(_strings(flat, at, width))
    run = np.cumsum(new) - 1
    place = np.lexsort((start[order], rank[row[order]], run))
    order = order[place]
    first = order[np.flatnonzero(new)[run]]  # within a run the earliest comes first
    later = (rank[row[order]] != rank[row[first]]) | (start[order] != start[first])
    c = order[later]
    k, th = np.array([r[2] for r in rows], dtype=np.int64), np.array([r[3] for r in rows], dtype=np.int64)
    return _span_rows(row[c], start[c], start[c] + width, k, th, 1)


def _sort_bucket(width: int, most: int = 12_000):
    """Suffixes in order of their leading bytes, as many whole groups at a time as fit."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in it:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= most and r[0] != held[-1][0]:
                    if out := repeated_strings(held, width):
                        yield _table(out)
                    held = []
                held.append(r)
        if held and (out := repeated_strings(held, width)):
            yield _table(out)

    return run


def _each_string(width: int):
    """The strings of hot suffixes, each once for a stretch of rows with its earliest place; the rest are copies."""
    schema = pa.schema([("kind", pa.int32()), ("string", pa.binary()), ("k", pa.int64()), ("th", pa.int64()), ("s", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            flat, at, row, start = _unfold(held, width)
            k, th = np.array([r[2] for r in held], dtype=np.int64), np.array([r[3] for r in held], dtype=np.int64)
            rank = _ranks(k, th)
            order, new = multikey_order(_strings(flat, at, width))
            run_no = np.cumsum(new) - 1
            order = order[np.lexsort((start[order], rank[row[order]], run_no))]
            first = order[np.flatnonzero(new)[run_no]]
            later = (rank[row[order]] != rank[row[first]]) | (start[order] != start[first])
            views, raw = np.flatnonzero(new), flat.tobytes()
            out = [(OPEN, raw[at[i] : at[i] + width], int(k[row[i]]), int(th[row[i]]), int(start[i])) for i in order[views]]
            out += [(COPIED, None, int(k[row[i]]), int(th[row[i]]), int(start[i])) for i in order[later]]
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in it:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(r)
                if len(held) >= 4000:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return run


def _neighbours(width: int):
    """Sorted strings: all of a run but its first are copies. Each row is (string, k, th, s), in order."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, None
        for batch in it:
            out = []
            for string, k, th, s in zip(*(c.to_pylist() for c in batch.columns)):
                if string != last:
                    last, place = string, (k, th, s)
                elif (k, th, s) != place:
                    out.append((COPIED, 0, k, th, struct.pack("<II", s, s + width)))
            if out:
                yield _table(out)

    return run


def _finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = []
        for k, no_id, text, blobs in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("k", "no_id", "t", "blobs"))):
            body, digest, at, gone = text.as_py().encode(), hashlib.sha256(), 0, 0
            spans = merged(np.concatenate([np.frombuffer(b, dtype="<u4").reshape(-1, 2) for b in blobs.as_py()]).astype(np.int64)).tolist() if blobs.is_valid else []
            for a, b in spans:
                digest.update(body[at:a])
                at, gone = b, gone + b - a
            digest.update(body[at:])
            rows.append((None if no_id.as_py() else k.as_py(), len(body), gone, len(spans), digest.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def copied_spans(rows: DataFrame, *, width: int = 100, k: int = 32, bucket_anchors: int = 100_000, hot_rows: int = 10_000, sample_docs: int = 2000, most_hot: int = 2000) -> DataFrame:
    """(k, th, blob of spans) of rows (k, th, t): the bytes to remove, as parts that may overlap.

    The driver and each task hold at most `most_hot` hashes of very common bytes. Bytes that are less common than those go
    to a bucket as all others do, which holds what a 2000th of all anchors may be; which way they go changes no result.
    """
    with small_batches(rows.sparkSession):
        size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
        expected = 2 * size.b / (width - k + 2)
        buckets = max(1, math.ceil(expected / bucket_anchors))
        # Bytes that a bounded sample of documents meets again and again would fill a bucket alone: they are open at once.
        share = max(1, size.n // (sample_docs * max(1, buckets // 64)))
        sampled = rows.where(F.pmod(F.xxhash64("k", "th"), F.lit(share)) == 0).mapInArrow(_anchor_hashes(width, k), "kh long")
        hot = sampled.groupBy("kh").agg(F.count("*").alias("n")).where(F.col("n") >= max(20, sample_docs // 100)).orderBy(F.desc("n"), "kh").limit(most_hot).select("kh")
        hot_hashes = np.sort(np.array([r.kh for r in hot.collect()], dtype=np.int64).view(np.uint64))  # at most most_hot
        scanned = rows.mapInArrow(_scan(width, k, buckets, hot_hashes), PARTS_SQL)
        settled = cut(scanned.groupBy("bucket").applyInArrow(_settle(width, buckets), PARTS_SQL))
        opened = settled.where(F.col("kind") == OPEN).groupBy("k", "th").agg(F.collect_list("blob").alias("blobs"))
        suffixes = cut(rows.join(opened.hint("shuffle_hash"), ["k", "th"]).select("k", "th", "t", "blobs").mapInArrow(_fetch(width, k), SUFFIX))
        leads = suffixes.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("lead")
        leads = cut(leads)
        some_hot = leads.limit(1).count() > 0
        common = suffixes.join(leads, "lead", "left_anti") if some_hot else suffixes
        columns = [c.split()[0] for c in SUFFIX.split(", ")]
        sorted_rows = common.select(*columns).repartitionByRange("lead").sortWithinPartitions("lead")
        found = [settled.where(F.col("kind") == COPIED), sorted_rows.mapInArrow(_sort_bucket(width), PARTS_SQL)]
        if some_hot:
            strings = cut(suffixes.join(leads, "lead", "left_semi").select(*columns).mapInArrow(_each_string(width), "kind int, " + STRING))
            local = strings.where(F.col("kind") == COPIED).groupBy("k", "th").agg(F.collect_list("s").alias("ss"))
            found.append(local.select(F.lit(COPIED).alias("kind"), F.lit(0).alias("bucket"), "k", "th", _pack_spans("ss", width).alias("blob")))
            ranged = strings.where(F.col("kind") == OPEN).select("string", "k", "th", "s").repartitionByRange("string").sortWithinPartitions("string", "k", "th", "s")
            found.append(ranged.mapInArrow(_neighbours(width), PARTS_SQL))
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return cut(out.select("k", "th", "blob"))


def _pack_spans(starts: str, width: int):
    """Little-endian (start, stop) pairs of an array of starts."""

    def word(c):
        h = F.lpad(F.hex(c), 8, "0")
        return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))

    return F.unhex(F.array_join(F.transform(starts, lambda s: F.concat(word(s), word(s + width))), ""))


def _anchor_hashes(width: int, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _documents(it):
            _, _, _, kh, _ = anchors(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts]), width, k)
            yield pa.RecordBatch.from_arrays([pa.array(kh.view(np.int64))], names=["kh"])

    return run


def suffix_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 100, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Strings of 8 to 65,535 bytes; anchors have a third of that, 32 at most."""
    if not 8 <= width < 1 << 16:
        raise ValueError("width must lie between 8 and 65,535 bytes")
    options.setdefault("k", min(32, max(4, width // 3)))
    body, no_id = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(key).cast("long").isNull()
    # A row without an id is no document of the least id: another hash of its text keeps them apart.
    hashed = F.when(no_id, F.xxhash64(body, F.lit("no id"))).otherwise(F.xxhash64(body))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k"), hashed.alias("th"), body.alias("t"), no_id.alias("no_id"))
    spans = copied_spans(rows.select("k", "th", "t"), width=width, **options).groupBy("k", "th").agg(F.collect_list("blob").alias("blobs"))
    joined = rows.join(spans.hint("shuffle_hash"), ["k", "th"], "left")
    return joined.select("k", "no_id", "t", "blobs").mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
