"""Document fingerprints: a Merkle tree over words, paragraphs and sections, with boundaries that follow the content.

A text splits into words at spaces and line ends; a word of more than LONG bytes is cut at places that its bytes
choose into pieces of at most LONG bytes, which are words. The end of a word has a rank: how many times a hash of the
word and the one before it divides by four. A paragraph's last word has two more. A node of level 0 is a word with the space or line end after it; a node of level j is
a stretch that ends after a word of rank j or more. So level 1 are phrases, level 2 paragraphs (lines; long lines are cut after
about 16 words), and from level 3 on sections, each level of about four of those below. An edit moves no boundary but those beside it.
A word's digest hashes its exact bytes, a node's digest its children's digests in order, so equal roots mean equal texts,
and of two trees only branches with different digests need to be entered to find the edits.

A fingerprint string holds the root, a letter (six bits of the digest) for each word, and the digests of all nodes from
paragraphs up with the number of their children: about two letters for each word, at every size. The likeness of two is the share
of words that both have. The walk from the roots finds equal nodes, in order among those of one name, and enters only what differs. Between
equal neighbours, what is left of one text lies beside what is left of the other: there the letters that agree from the
left and from the right count, and between these the words in runs of four letters that both sides have. That is one law at every size,
and one changed word costs one word.

Defined cases: a null text is the empty text; texts without characters have equal fingerprints and likeness 1; equal
texts, wherever they are, have equal fingerprints; a run of one word, and a text without spaces, are compared by letters like any other;
a table with one row is its own next document; an empty table
gives no rows; repeated doc_ids are ordered by a hash of their text; a null doc_id comes after all others; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b, sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import cut, text_or_empty

#: The level of paragraphs, the finest of which a fingerprint holds digests; hex digits of each; letters of words; a long word's bytes.
PARAGRAPHS, NODE_HEX, RUN, LONG = 2, 12, 4, 64
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", dtype=np.uint8)
#: A paragraph's end counts as this rank more than its last word's.
PARAGRAPH_RANK = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Tree:
    """levels[j]: (digests, first[j]), where node i's children in the level below are first[i] to first[i+1]; level 0 has
    byte offsets instead. `inner` marks words that go on in the next one. The root is over the last level."""

    root: str
    levels: list[tuple[np.ndarray, np.ndarray]]
    inner: np.ndarray


def _words(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The pieces between spaces and line ends, which of them end a paragraph, and which go on in the next."""
    lines = [line.split(b" ") for line in text.split(b"\n")]
    pieces = lines[0] if len(lines) == 1 else [w for line in lines for w in line]
    ends = np.zeros(len(pieces), dtype=bool)
    ends[np.cumsum([len(line) for line in lines[:-1]], dtype=np.int64) - 1] = True
    inner = np.zeros(len(pieces), dtype=bool)
    if max(map(len, pieces)) > LONG:
        cut = [_cut(w) if len(w) > LONG else [w] for w in pieces]
        last = np.cumsum([len(c) for c in cut]) - 1
        pieces, inner = [w for c in cut for w in c], np.ones(last[-1] + 1, dtype=bool)
        inner[last] = False
        spread = np.zeros(len(pieces), dtype=bool)
        spread[last[ends]] = True
        ends = spread
    return pieces, ends, inner


def _cut(word: bytes) -> list[bytes]:
    """A long word in pieces of at most LONG bytes: after bytes at which a hash of the last four has a zero in 32, and where the next such
    is too far, which is mostly in periodic stretches, after the byte of least hash in the second half of the next LONG."""
    x = np.frombuffer(word, dtype=np.uint8).astype(np.uint64)
    x = _mixed(x[3:] | x[2:-1] << np.uint64(8) | x[1:-2] << np.uint64(16) | x[:-3] << np.uint64(24))
    chosen, half = np.flatnonzero((x & np.uint64(31)) == 0) + 4, LONG // 2
    bounds = [0]
    for stop in [*chosen[chosen < len(word)].tolist(), len(word)]:
        while stop - bounds[-1] > LONG:
            at = bounds[-1] + half
            bounds.append(at + int(np.argmin(x[at - 4 : at - 4 + half])))
        bounds.append(stop)
    return [word[i:j] for i, j in zip(bounds, bounds[1:])]


def merkle_tree(text: bytes) -> Tree:
    """The whole tree, with byte offsets, to locate edits."""
    import xxhash

    pieces, ends, inner = _words(text)
    n = len(pieces)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces), dtype=np.uint64, count=n)
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
    # Of a hash over the word and the one before it, the lowest set bit is a power of two: a rank for each two bits.
    pairs = hashes.copy()
    pairs[1:] += hashes[:-1] * _ODD
    pairs = _mixed(pairs)
    low = (pairs & (~pairs + np.uint64(1))).astype(np.float64)
    rank = np.minimum(np.frexp(low)[1].clip(1) - 1 >> 1, 24) + PARAGRAPH_RANK * ends
    digests = _mixed(hashes ^ ((ends + 2 * inner).astype(np.uint64) * _ODD))
    levels = [(digests, np.concatenate([[0], np.cumsum(sizes + ~inner)]))]
    while len(digests) > 1:
        stop = rank >= len(levels)
        stop[-1] = True
        last = stop.nonzero()[0]
        first = np.zeros(len(last) + 1, dtype=np.int64)
        first[1:] = last + 1
        size = first[1:] - first[:-1]
        place = np.arange(len(levels), len(digests) + len(levels)) - first[:-1].repeat(size)
        parts = _mixed(digests + place.view(np.uint64) * _ODD)
        digests = _mixed(np.add.reduceat(parts, first[:-1]) ^ size.view(np.uint64))
        rank = rank[last]
        levels.append((digests, first))
    return Tree(blake2b(digests.tobytes() + len(text).to_bytes(8, "little"), digest_size=8).hexdigest(), levels, inner)


def edits(a: Tree, b: Tree, size: int) -> list[tuple[int, int]]:
    """Byte ranges of b's text (of `size` bytes) whose words a lacks. Only branches of b without an equal in a are entered."""
    if a.root == b.root:
        return []
    open_nodes = np.arange(len(b.levels[-1][0]))
    for level in range(len(b.levels) - 1, -1, -1):
        digests, first = b.levels[level]
        known = a.levels[level][0] if level < len(a.levels) else digests[:0]
        open_nodes = open_nodes[~np.isin(digests[open_nodes], known)]
        if level:
            below = [np.arange(first[i], first[i + 1]) for i in open_nodes.tolist()]
            open_nodes = np.concatenate(below) if below else open_nodes[:0]
    at = b.levels[0][1]
    out: list[tuple[int, int]] = []
    for i in open_nodes.tolist():
        start, stop = int(at[i]), min(int(at[i + 1]) - (not b.inner[i]), size)
        if out and out[-1][1] + 1 >= start:
            out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


def fingerprint(text: bytes) -> str:
    """root:letters:digests and, after a point, numbers of children of paragraphs;of the level above;... up to the top."""
    tree = merkle_tree(text)
    letters = LETTERS[(tree.levels[0][0] & np.uint64(63)).astype(np.int64)].tobytes().decode()
    shown, per = [], np.ones(len(letters), dtype=np.int64)
    for j, (digests, first) in enumerate(tree.levels[1:], 1):
        per = np.add.reduceat(per, first[:-1]) if j <= PARAGRAPHS else first[1:] - first[:-1]  # of a paragraph its words
        if j >= PARAGRAPHS:
            names = digests.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : NODE_HEX // 2].tobytes().hex()
            shown.append(names + "." + ".".join(map(str, per.tolist())))
    return f"{tree.root}:{letters}:{';'.join(shown)}"


@lru_cache(maxsize=4)
def _levels(shown: str) -> tuple[bytes, list[tuple[list[str], list[int]]], list[list[int]]]:
    """Letters; by level names and where each node's children begin (of paragraphs: words); and where each node begins in paragraphs."""
    _, letters, body = shown.split(":")
    out: list[tuple[list[str], list[int]]] = []
    for part in body.split(";") if body else ():
        names, *counts = part.split(".")
        out.append(([names[i : i + NODE_HEX] for i in range(0, len(names), NODE_HEX)], [0, *accumulate(map(int, counts))]))
    begins = [list(range(len(out[0][0]) + 1))] if out else []
    for _, first in out[1:]:
        begins.append([begins[-1][i] for i in first])
    return letters.encode(), out, begins


def _equal_paragraphs(x: list, y: list, at_x: list[list[int]], at_y: list[list[int]]) -> list[int]:
    """For each paragraph of x its equal in y or -1: by a walk from the tops that enters only nodes without an equal."""
    partner = [-1] * (len(x[0][0]) if x else 0)
    open_x, open_y = list(range(len(x[-1][0]) if x else 0)), list(range(len(y[-1][0]) if y else 0))
    for level in range(max(len(x), len(y)) - 1, -1, -1):
        if level < min(len(x), len(y)):
            waiting: dict[str, deque[int]] = defaultdict(deque)
            for j in open_y:
                waiting[y[level][0][j]].append(j)
            rest, taken = [], set()
            for i in open_x:
                same = waiting.get(x[level][0][i])
                if same:
                    j = same.popleft()
                    taken.add(j)
                    partner[at_x[level][i] : at_x[level][i + 1]] = range(at_y[level][j], at_y[level][j + 1])
                else:
                    rest.append(i)
            open_x, open_y = rest, [j for j in open_y if j not in taken]
        if level:
            open_x, open_y = (_children(nodes, side, level) if level < len(side) else nodes for nodes, side in ((open_x, x), (open_y, y)))
    return partner


def _children(nodes: list[int], side: list, level: int) -> list[int]:
    first = side[level][1]
    return [c for i in nodes for c in range(first[i], first[i + 1])]


def _agree(a: bytes, b: bytes) -> int:
    """Letters that agree from the left."""
    if a[:1] != b[:1]:
        return 0
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


#: The six bits of each letter, and a place for each run of letters.
_BITS = np.zeros(256, dtype=np.int64)
_BITS[LETTERS] = np.arange(64)
_RUNS = np.zeros(1 << 6 * RUN, dtype=bool)


def _in_runs(a: bytes, b: bytes) -> int:
    """Letters of a in runs of RUN that b has too, and of b in such of a: the lesser number."""
    if min(len(a), len(b)) < RUN:
        return 0
    codes = []
    for side in (a, b):
        x = _BITS[np.frombuffer(side, np.uint8)]
        codes.append(sum(x[k : len(x) - RUN + 1 + k] << 6 * k for k in range(RUN)))
    covered = []
    for p, q in (codes, codes[::-1]):
        _RUNS[q] = True
        at = np.flatnonzero(_RUNS[p])
        _RUNS[q] = False
        covered.append(int(np.minimum(np.diff(at, append=at[-1:] + RUN), RUN).sum()))
    return min(covered)


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints alone: twice the words that both have, of all words of both."""
    if a == b:
        return 1.0
    (p, x, at_x), (q, y, at_y) = _levels(a), _levels(b)
    partner = _equal_paragraphs(x, y, at_x, at_y)
    back = [-1] * (len(y[0][0]) if y else 0)
    for i, j in enumerate(partner):
        if j >= 0:
            back[j] = i
    ends_p, ends_q = (s[0][1] if s else [0, len(w)] for s, w in ((x, p), (y, q)))  # a text below a paragraph is one gap
    shared = sum(ends_p[i + 1] - ends_p[i] for i, j in enumerate(partner) if j >= 0)
    partner, back = partner or [-1], back or [-1]
    n, m, used = len(partner), len(back), defaultdict(int)
    i = 0
    while i < n:
        if partner[i] >= 0:
            i += 1
            continue
        stop = i
        while stop < n and partner[stop] < 0:
            stop += 1
        mine = p[ends_p[i] : ends_p[stop]]
        left, right = (partner[i - 1] + 1 if i else 0), (partner[stop] if stop < n else m)  # what lies beside the gap in b
        far, near = left, right
        while far < m and back[far] < 0:
            far += 1
        while near > 0 and back[near - 1] < 0:
            near -= 1
        after, before = q[ends_q[left] : ends_q[far]], q[ends_q[near] : ends_q[right]]
        k = min(_agree(mine, after), len(after) - used[left])
        used[left] += k
        t = min(_agree(mine[k:][::-1], before[::-1]), len(before) - used[near])
        used[near] += t
        shared += k + t
        if left == near and len(mine) - k - t >= RUN:
            shared += _in_runs(mine[k : len(mine) - t], after[k : len(after) - t])
        elif left == near and k + t == len(mine) == len(after):
            shared -= 1  # digests differ, so a word does, whose letters agree by chance
        i = stop
    return min(2 * shared / (len(p) + len(q)), 1 - 1e-9)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Rows (bucket, k, t, edge) dealt by key range, each bucket closed by the row that follows its last one, and the
    number of buckets.

    Rows are ordered by descending key. `edge` marks the borrowed row. What meets in one task, and what is broadcast, is
    a bucket's first key and text hash: a row per bucket, of which there are as many as shuffle partitions.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = rows.select("k")
    at = [i / n for i in range(1, n)]
    splits = sorted(set(ids.where("k is not null").agg(F.percentile_approx("k", at, 10_000)).first()[0] or [])) if at else []
    bucket = F.coalesce(_bucket(splits), F.lit(len(splits) + 1))
    held = rows.select(bucket.cast("int").alias("bucket"), "k", F.xxhash64("t").alias("th"), "t")
    # ~k turns the order around for every long; of rows of one key the least hash of a text comes first.
    first = cut(held.groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("k").alias("d"), "th")).alias("f")).select("bucket", F.bitwise_not("f.d").alias("k"), F.col("f.th").alias("th")))
    order = Window.orderBy("bucket")
    before = first.select("bucket", "k", "th", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("to"))
    own, first_rows = held.alias("own"), F.broadcast(before).alias("before")
    same = F.expr("own.bucket = before.bucket and own.k <=> before.k and own.th = before.th")
    borrowed = own.join(first_rows, same).select(F.col("to").alias("bucket"), "own.k", "own.th", "own.t").dropDuplicates(["bucket"])
    return held.withColumn("edge", F.lit(False)).unionByName(borrowed.withColumn("edge", F.lit(True))), len(splits) + 2


def _bucket(splits: list[int]) -> Column:
    """How many split points lie above k, by bisection; null for a null k."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(len(splits) - low)
        mid = (low + high) // 2
        return F.when(F.col("k") < splits[mid], tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(F.col("k").isNotNull(), tree(0, len(splits)))


def document_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness to the edited text and the next document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in it:
            for r in zip(*batch.columns):
                yield tuple(x.as_py() for x in r)

    def run_bucket(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, last = [], 0, None
        for bucket, k, t, edge in rows(it):
            now = (bucket, k, t, None if edge else fingerprint(t.encode()))
            if last is not None and last[0] == bucket:
                out.append(_pair(last, now))
                size += len(out[-1][3]) + len(out[-1][4])
            last = None if edge else now
            if size > 4 << 20:
                yield _batch(out, schema)
                out, size = [], 0
        if out:
            yield _batch(out, schema)

    held, n = with_next(docs, key, text)
    held = held.repartitionById(n, "bucket").sortWithinPartitions("bucket", "edge", F.col("k").desc_nulls_last(), "th").select("bucket", "k", "t", "edge")
    return held.mapInArrow(run_bucket, RESULT)


def _pair(doc: tuple, after: tuple) -> tuple:
    _, k, t, own = doc
    n = len(t)
    edited = (t[: n - n // 2] + after[2][: n // 2]).encode()
    changed = fingerprint(edited)
    following = after[3] or fingerprint(after[2].encode())
    return k, n, sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, following)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
