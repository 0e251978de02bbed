"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits both lie within r bits of some common value, so each distinct
fingerprint stands for all variants within r bits, and fingerprints that share a variant are verified and linked. The
shuffle on variants goes by their leading bits: a fingerprint travels once to each leading value that its variants
have, and the remaining bits are expanded where they arrive, in slices of bounded size.

Defined cases: a null text is empty; texts without words have fingerprint zero, linked like any other; equal
fingerprints are one class before anything is expanded; rows with a null doc_id keep their fingerprint and take the
least doc_id of their component, or null if it has none; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import batches, cut, text_or_empty
from textquarry.llm.components import components

#: Variants that a bucket may hold on average, and that are sorted at once.
BUCKET_VARIANTS, SLICE_VARIANTS = 1 << 20, 2 << 20


def simhash(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint over word shingles, repeats included; A-Z are lower-cased first."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        first, last = starts[at:stop].tolist(), ends[np.minimum(np.arange(at, stop) + words - 1, len(tokens) - 1)].tolist()
        hashes = np.fromiter((digest(joined[i:j]) for i, j in zip(first, last)), dtype="<u8", count=stop - at)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in batches(it, "k", "t"):
            fps = np.array([simhash(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t")).mapInArrow(run, "doc_id long, fp long")


def flips(bits: int, most: int) -> list[list[int]]:
    """XOR masks over `bits` low bits by number of flips, 0 to most (most is 2 at the highest)."""
    one = [1 << i for i in range(bits)]
    return [[0], one, [a | b for i, a in enumerate(one) for b in one[:i]]][: most + 1]


def bucket_links(fps: np.ndarray, bucket: int, lead: int, radius: int, slice_variants: int = SLICE_VARIANTS) -> np.ndarray:
    """Links (i, j) that join all fingerprints with a common variant in this bucket, as a forest.

    Those with a common variant all lie within 2*radius of each other, so a chain along them loses no component and no
    group is expanded into its pairs.
    """
    low = 64 - lead
    rest = fps & np.uint64((1 << low) - 1) if lead else fps
    top = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(bucket)).astype(int) if lead else np.zeros(len(fps), int)
    masks = [np.array(sum(flips(low, r), []), dtype=np.uint64) for r in range(radius + 1)]
    # Slices by further leading bits of the variant bound what is sorted at once.
    total = sum(int((top == d).sum()) * len(masks[radius - d]) for d in range(radius + 1))
    extra = min(low, max(0, math.ceil(math.log2(max(1, total / slice_variants)))))
    found: list[np.ndarray] = []
    for s in range(1 << extra):
        values, owners = [], []
        for d in range(radius + 1):
            own = np.flatnonzero(top == d)
            if not len(own):
                continue
            m = masks[radius - d]
            if extra:
                head_low = np.uint64(low - extra)
                heads = rest[own] >> head_low
                for head in np.unique(heads):
                    m_here = m[(m >> head_low) == (head ^ np.uint64(s))]
                    if len(m_here):
                        o = own[heads == head]
                        values.append((rest[o][:, None] ^ m_here[None, :]).ravel())
                        owners.append(np.repeat(o.astype(np.int32), len(m_here)))
            else:
                values.append((rest[own][:, None] ^ m[None, :]).ravel())
                owners.append(np.repeat(own.astype(np.int32), len(m)))
        if not values:
            continue
        v, o = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        if len(same):
            found.append(np.unique(o[same].astype(np.int64) << 32 | o[same + 1].astype(np.int64)))
    if not found:
        return np.zeros((0, 2), dtype=np.int64)
    pairs = np.unique(np.concatenate(found))
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a[near].tolist(), b[near].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    members = np.array([i for i in range(len(fps)) if parent[i] != i], dtype=np.int64)
    return np.stack([np.array([root(i) for i in members], dtype=np.int64), members], axis=1) if len(members) else np.zeros((0, 2), dtype=np.int64)


def near_links(classes: DataFrame, distance: int = 4, bucket_variants: int = BUCKET_VARIANTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that differ in at most `distance` bits, as forests."""
    radius = distance // 2
    if distance % 2 or radius > 2:
        raise ValueError("distance must be 0, 2 or 4")
    variants = sum(map(len, flips(64, radius)))
    lead = min(24, max(0, math.ceil(math.log2(max(1, classes.count() * variants / bucket_variants)))))
    heads = F.array(*[F.lit(m).cast("long") for m in sum(flips(lead, radius), [])])
    sent = classes.select("fp", F.explode(heads).alias("m")).select("fp", (F.shiftrightunsigned("fp", 64 - lead) if lead else F.lit(0).cast("long")).bitwiseXOR(F.col("m")).alias("bucket"))

    def link(table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy().view(np.uint64))
        pairs = bucket_links(fps, table.column("bucket")[0].as_py(), lead, radius)
        signed = fps.view(np.int64)
        return pa.table({"a": signed[pairs[:, 0]], "b": signed[pairs[:, 1]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return sent.groupBy("bucket").applyInArrow(link, "a long, b long")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, distance: int = 4, hot_copies: int = 1000, hot_classes: int = 50_000) -> DataFrame:
    """Per row: doc_id, fp, component_id (the least doc_id that links reach)."""
    fps = cut(fingerprints(docs, key, text, words, seed))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    roots = components(near_links(classes, distance))
    joined = roots.join(classes, F.col("node") == F.col("fp"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("root_least"))
    named = roots.join(least, "root").select(F.col("node").alias("fp"), "root_least")
    by_class = classes.join(named, "fp", "left").select("fp", "n", F.coalesce("root_least", "least_id").alias("component_id"))
    # Copies beyond `hot_copies` meet a broadcast row of their class where they are; there are at most rows/hot_copies such classes.
    hot = cut(by_class.where(F.col("n") > hot_copies))
    if not 0 < hot.limit(hot_classes + 1).count() <= hot_classes:
        return fps.join(by_class, "fp").select("doc_id", "fp", "component_id")
    rest = fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(by_class, "fp")
    return rest.select("doc_id", "fp", "component_id").unionByName(fps.join(F.broadcast(hot), "fp").select("doc_id", "fp", "component_id"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the least id (a null one last), all columns.

    Rows with the same id are told apart by a hash of their texts, and equal rows by nothing: one of them stays.
    """
    k, th = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(text_or_empty(text))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.array([simhash((t.as_py() or "").encode(), words, seed) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["k", "th", "fp"])

    fps = docs.select(k.alias("k"), th.alias("th"), text_or_empty(text).alias("t")).mapInArrow(run, "k long, th long, fp long")
    classes = cut(fps.groupBy("fp").agg(F.min(F.struct("k", "th")).alias("least")))
    roots = components(near_links(classes, distance))
    named = classes.join(roots, F.col("node") == F.col("fp"), "left").withColumn("root", F.coalesce("root", "fp"))
    keep = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.k").alias("_k"), F.col("least.th").alias("_th"))
    kept = docs.withColumn("_k", k).withColumn("_th", th).join(keep, ["_k", "_th"], "left_semi")
    first = F.row_number().over(Window.partitionBy("_k", "_th").orderBy(F.lit(0)))
    return kept.withColumn("_n", first).where("_n = 1").select(*docs.columns)
