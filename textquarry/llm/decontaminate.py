"""Benchmark decontamination by spaced-seed hashing.

Test and training texts become word sequences. A mask selects some positions of a short stretch and ignores the others,
so a substituted word at an ignored position leaves the hash as it is. Training hashes are joined with those of the
test items; each hit fixes an alignment of a document with an item, and the words around it are compared: a document is
contaminated where `window` aligned words (the whole item, if it is shorter) agree in at least `agreement` of them.

The masks of SEEDS miss no window of 13 words with at most two substitutions (tests check every case). An item of fewer words
than the window is cut into one piece more than it may have substitutions, so one piece at least is met as it is; the
pieces are its seeds, whatever its length. The test items are
joined in blocks of about `block_words` words. Where they fill several, a worker takes texts in groups and each group
through one block after the other, so it holds one block at a time and texts are read once; blocks change no result.

Defined cases: null or empty texts and texts without words are clean; items without words match nothing; repeated items
and rows are judged one by one; with no items every document is clean; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import batches, text_or_empty

#: Positions that count ("1") and that are ignored ("0").
SEEDS = ("11101011", "11001111")
WORD = re.compile(r"[^\W_]+")
RESULT = "doc_id long, contaminated boolean, item_ids array<long>, first_word int, n_agreeing int, agreement double"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class SeedIndex:
    """The hashes of a block of items, and the comparison of a document with it."""

    def __init__(self, items: list[tuple[int | None, str]], seeds: tuple[str, ...], window: int, agreement: float):
        self.window, self.agreement = window, agreement
        self.masks = [np.flatnonzero([c == "1" for c in s]) for s in seeds]
        self.spans = [len(s) for s in seeds]
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                self.items.append((item_id, np.array(ids, dtype=np.int64)))
        self.lengths = np.array([len(ids) for _, ids in self.items], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = np.concatenate([ids for _, ids in self.items]) if self.items else np.zeros(0, dtype=np.int64)
        rng = np.random.RandomState(7)
        self.factors = rng.randint(1, 1 << 62, size=64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        hashes, places = [], []
        pieces = {n: self._pieces(n) for n in set(self.lengths.tolist()) if n < window}
        n_seeds = len(self.masks)
        sizes = sorted({stop - start for cuts in pieces.values() for start, stop in cuts})
        self.masks += [np.arange(size) for size in sizes]
        self.spans += sizes
        for n, (_, ids) in enumerate(self.items):
            cuts = pieces.get(len(ids))
            for m in range(n_seeds) if cuts is None else range(n_seeds, len(self.masks)):
                at, h = self._hashes(ids, m)
                if cuts is not None:
                    own = np.isin(at, [start for start, stop in cuts if stop - start == self.spans[m]])
                    at, h = at[own], h[own]
                hashes.append(h)
                places.append(np.stack([np.full(len(at), n), at], axis=1))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.places = (np.concatenate(places) if places else np.zeros((0, 2), dtype=np.int64))[order]
        self.bits = max(16, min(26, int(np.ceil(np.log2(max(1, len(flat)) * 16)))))
        self.filter = np.zeros(1 << self.bits, dtype=bool)
        self.filter[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def _least(self, size: int) -> int:
        """How many of `size` aligned words must agree."""
        return max(1, int(np.ceil(self.agreement * size - 1e-9)))

    def _pieces(self, n: int) -> list[tuple[int, int]]:
        """(start, stop) of the pieces of an item of n words, of which one at least holds no substitution."""
        k = n - self._least(n) + 1
        return [(n * i // k, n * (i + 1) // k) for i in range(k)]

    def _hashes(self, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the stretches whose counted words all occur in some item."""
        n = len(ids) - self.spans[m] + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        known = ids != 0
        at = np.flatnonzero(np.logical_and.reduce([known[p : p + n] for p in self.masks[m]]))
        h = np.full(len(at), m + 1, dtype=np.uint64)
        for p in self.masks[m]:
            h = (h + ids[at + p].astype(np.uint64)) * self.factors[p]
        return at, _mix(h)

    def alignments(self, ids: np.ndarray, most: int = 1 << 18) -> Iterator[np.ndarray]:
        """Distinct (item, shift) that hits suggest; item word j stands against document word shift + j.

        Hits are unfolded into at most about `most` places at a time, whatever words a text and the items repeat; an
        alignment comes again where its hits fall into several portions.
        """
        for m in range(len(self.masks)):
            at, h = self._hashes(ids, m)
            near = np.flatnonzero(self.filter[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            at, h = at[near], h[near]
            low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            met = np.flatnonzero(high > low)
            at, low, counts = at[met], low[met], (high - low)[met]
            portion = (np.cumsum(counts) - counts) // most
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(portion)) + 1) if len(at) else []:
                n = counts[part]
                which = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                places = self.places[which]
                yield self._may_agree(ids, np.unique(np.stack([places[:, 0], np.repeat(at[part], n) - places[:, 1]], axis=1), axis=0))

    def _may_agree(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The alignments without those of items shorter than the window that do not agree: short pieces are met by chance."""
        sizes = self.lengths[at[:, 0]]
        stays = sizes >= self.window
        for n in np.unique(sizes[~stays]).tolist():
            own = np.flatnonzero((sizes == n) & (at[:, 1] >= 0) & (at[:, 1] + n <= len(ids)))
            for i in range(0, len(own), 1 << 16):
                part = own[i : i + (1 << 16)]
                item, shift = at[part].T
                same = np.zeros(len(part), dtype=np.int64)
                for j in range(n):
                    same += ids[shift + j] == self.words[self.starts[item] + j]
                stays[part] = same >= self._least(n)
        return at[stays]

    def compare(self, ids: np.ndarray) -> list[tuple[int | None, int, int, float]]:
        """(item_id, first document word, agreeing words, share) of the best window of each item that is met."""
        best: dict[int, tuple[int | None, int, int, float]] = {}
        for n, shift in (pair for part in self.alignments(ids) for pair in part.tolist()):
            item_id, item = self.items[n]
            low, high = max(0, -shift), min(len(item), len(ids) - shift)
            size = min(self.window, len(item))
            if high - low < size:
                continue
            same = np.concatenate([[0], np.cumsum(item[low:high] == ids[shift + low : shift + high])])
            counts = same[size:] - same[:-size]
            i = int(counts.argmax())
            place = (int(counts[i]), -(shift + low + i))
            if counts[i] >= self.agreement * size - 1e-9 and (n not in best or place > (best[n][2], -best[n][1])):
                best[n] = (item_id, shift + low + i, int(counts[i]), float(counts[i] / size))
        return list(best.values())


def item_blocks(items: DataFrame, key: str, text: str, block_words: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    block: list[tuple[int | None, str]] = []
    held = 0
    rows = items.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t")).orderBy("k", "t")
    for r in rows.toLocalIterator():
        n = len(words_of(r.t))
        if block and held + n > block_words:
            yield block
            block, held = [], 0
        block.append((r.k, r.t))
        held += n
    if block:
        yield block


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    seeds: tuple[str, ...] = SEEDS,
    window: int = 13,
    agreement: float = 0.8,
    block_words: int = 400_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per document: contaminated, the items met, and the best window.

    With `keep`, the named columns of docs instead, for the clean documents alone. Nothing is shuffled.
    """
    blocks = _sent(docs.sparkSession, item_blocks(items, item_key, item_text, block_words))
    if keep is not None:
        return docs.mapInArrow(_filter(blocks, seeds, window, agreement, text), docs.schema).select(*keep)
    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(_judge(blocks, seeds, window, agreement), RESULT)


def _sent(spark: SparkSession, blocks: Iterator[list]) -> list:
    """A single block as it is, several as broadcasts, of which the driver holds files."""
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return [first]
    return [spark.sparkContext.broadcast(b) for b in chain([first, second], blocks)]


class _Matcher:
    """The items that each of a group of texts meets, over all blocks."""

    def __init__(self, blocks: list, seeds: tuple[str, ...], window: int, agreement: float):
        self.blocks, self.options = blocks, (seeds, window, agreement)
        self.only = SeedIndex(blocks[0], *self.options) if len(blocks) == 1 else None
        self.group_bytes = 4 << 20 if self.only else 32 << 20

    def indexes(self) -> Iterator[SeedIndex]:
        if self.only:
            yield self.only
            return
        for block in self.blocks:
            path = getattr(block, "_path", None)  # not set where broadcasts are encrypted
            yield SeedIndex(block.load_from_path(path) if path else block.value, *self.options)  # block.value stays in the worker

    def __call__(self, texts: Iterator[str]) -> list[list[tuple[int | None, int, int, float]]]:
        vocabulary: dict[str, int] = {}
        coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], dtype=np.int32) for t in texts]
        met: list[list] = [[] for _ in coded]
        for index in self.indexes():
            get = index.vocabulary.get
            own = np.fromiter((get(w, 0) for w in vocabulary), dtype=np.int64, count=len(vocabulary))
            for out, ids in zip(met, coded):
                out += index.compare(own[ids])
        return met


def _judge(blocks: list, seeds: tuple[str, ...], window: int, agreement: float):
    schema = pa.schema([("doc_id", pa.int64()), ("contaminated", pa.bool_()), ("item_ids", pa.list_(pa.int64())), ("first_word", pa.int32()), ("n_agreeing", pa.int32()), ("agreement", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Matcher(blocks, seeds, window, agreement)
        for keys, texts in batches(it, "k", "t", match.group_bytes):
            rows = []
            for k, met in zip(keys, match(t.decode("utf-8", "replace") for t in texts)):
                top = max(met, key=lambda x: (x[3], -x[1]), default=(None, None, 0, 0.0))
                rows.append((k, bool(met), sorted({x[0] for x in met if x[0] is not None}), top[1], top[2], top[3]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _filter(blocks: list, seeds: tuple[str, ...], window: int, agreement: float, text: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Matcher(blocks, seeds, window, agreement)
        held, size = [], 0

        def clean() -> Iterator[pa.RecordBatch]:
            met = match(t.as_py() or "" for batch in held for t in batch.column(batch.schema.get_field_index(text)))
            at = 0
            for batch in held:
                yield batch.filter(pa.array([not m for m in met[at : at + batch.num_rows]], type=pa.bool_()))
                at += batch.num_rows

        for batch in it:
            held.append(batch)
            size += batch.nbytes
            if size >= match.group_bytes:
                yield from clean()
                held, size = [], 0
        if held:
            yield from clean()

    return run
