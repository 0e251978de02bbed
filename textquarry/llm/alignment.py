"""Alignment of two tokenizers: which tokens of one cover the same bytes as which of the other, counted over a corpus.

Both spell a text's bytes after one space, so their tokens are stretches of one byte line. Where the ends of either kind cut
it, each piece lies in one token of A and one of B: the pieces are the links. Ends that both have cut it into groups.

A link's two ids are packed into an int64. Tasks count documents by key (np.unique within each document and over what a task
has read), the counts are range-partitioned by key and sorted, equal keys are summed run by run, and each range becomes a
count shard: an Arrow file with two sorted columns in the shared folder. A reader maps the shards into memory and finds
keys by searchsorted; where the folder is no local one, it loads the shards that it needs, a few at a time. The highest count of each A id is a
table of at most as many rows as A has ids, which goes to all tasks.

Texts are cut into chunks at single spaces: neither tokenizer has tokens over such a place, so both end there, and links
and groups of a chunk do not depend on what stands around it. Distinct chunks are encoded once, in long lines, and remembered;
a text with a space at an end, with white space before a space or with U+2581 is encoded whole. The texts are read twice, as links of all documents
would be several times as large as the texts.

Defined cases: a null or empty text, and one that a tokenizer does not spell back, has no tokens and zeros; every row is
a document, also with repeated or null ids; bytes that are no UTF-8 are read as U+FFFD; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import cut, fresh_dir, small_batches, stored, text_or_empty
from textquarry.llm.spaces import RUN, laid_out, space_chunks
from textquarry.llm.token_files import open_fs, pieces, tokenizer_path

#: Chunks that a worker remembers, and the longest such; distinct pairs that a task holds before it passes them on; bytes of a line.
MOST_CHUNKS, LONG_CHUNK, MOST_PAIRS, LINE = 1_000_000, 200, 2_000_000, 32_000
#: Texts that are encoded whole: they begin or end with a space, have white space before a space, or the sign that B writes for a space.
ODD = f"^ | $|{RUN}|▁"
SHARD = pa.schema([("key", pa.int64()), ("n", pa.int64())])
#: What is known of a chunk: whether both spell it, tokens of A and B, groups, links, links that are their A id's best, sum of counts.
FACTS = 7


class Pair:
    """The two tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, a: str, b: str):
        import json

        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(tokenizer_path(a)), SentencePieceProcessor(model_file=tokenizer_path(b))
        self.a.encode_special_tokens = True
        unicode_of = _byte_letters()
        spelt = json.loads(self.a.to_str())
        entries = {i: t for t, i in spelt["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spelt["added_tokens"]}
        self.bytes_a = [bytes(unicode_of.get(c, 63) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        marks = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := marks.fullmatch(p)) else p.replace("▁", " ").encode() for p in map(self.b.id_to_piece, range(len(self.b)))]
        self.table_a, self.table_b = (pa.array(x, type=pa.large_binary()) for x in (self.bytes_a, self.bytes_b))
        self.size_a, self.size_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.bits_b = len(self.bytes_b).bit_length()
        top = max(len(self.bytes_a), len(self.bytes_b))
        #: Decimal ids with what follows them in a spelled group: place 3 * id + 0, 1, 2.
        self.spelt = pa.array([b"%d%s" % (i, after) for i in range(top) for after in (b",", b"|", b";")], type=pa.large_binary())
        self.cuts = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.b)))

    def ids(self, line: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of A and B of a line that begins with a space (which B adds itself), and whether both spell it."""
        a = np.array(self.a.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=np.int64)
        b = np.array(self.b.encode(line[1:], num_threads=1), dtype=np.int64)
        raw = line.encode()
        return a, b, all(bytes(laid_out(t, x)[0]) == raw for t, x in ((self.table_a, a), (self.table_b, b)))


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: its own where that can be seen, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def _pair(a: str, b: str) -> Pair:
    return Pair(a, b)


def links(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed ids of each link, where each link's bytes end, where each group's bytes end) of one line."""
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    twice = both[1:] == both[:-1]
    ends = both[np.concatenate([[True], ~twice])]
    keys = ids_a[np.searchsorted(ends_a, ends)] << 32 | ids_b[np.searchsorted(ends_b, ends)]
    return keys, ends, both[1:][twice]


class Aligner:
    """What a worker knows of chunks. With a table of counts also how often their links occur, and their groups spelled out."""

    def __init__(self, a: str, b: str, counts: Counts | None = None):
        self.pair, self.counts = _pair(a, b), counts
        self.odd = ODD if self.pair.cuts else "(?s)."
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: list[str], texts: list[str]) -> dict[str, bytes]:
        """Facts (and keys, or spelled groups) of new chunks and beginnings of texts. What has no odd spaces is encoded in lines."""
        plain = [c for c in chunks if len(c) <= LONG_CHUNK and not c[-1].isspace()]
        plain += [c for c in texts if len(c) <= LONG_CHUNK and not c[-1].isspace() and not re.search(r"\s |▁", c[1:])]
        out: dict[str, bytes] = {}
        line: list[str] = []
        held = 0
        for c in plain:
            line.append(c)
            held += len(c)
            if held >= LINE:
                self._line(line, out)
                line, held = [], 0
        if line:
            self._line(line, out)
        for c in {*chunks, *texts} - out.keys():
            self._line([c], out)
        return out

    def _line(self, chunks: list[str], out: dict[str, bytes]) -> None:
        p = self.pair
        ids_a, ids_b, good = p.ids("".join(chunks))
        if not good:
            for c in chunks if len(chunks) > 1 else ():
                self._line([c], out)
            if len(chunks) == 1:
                out[chunks[0]] = np.zeros(FACTS, np.int64).tobytes()
            return
        stops = np.cumsum([len(c.encode()) for c in chunks])
        ends_a, ends_b = np.cumsum(p.size_a[ids_a]), np.cumsum(p.size_b[ids_b])
        keys, ends, groups = links(ids_a, ids_b, ends_a, ends_b)
        at = np.searchsorted(ends, stops, "right")
        if self.counts is None:
            facts, packed, upto = np.eye(1, FACTS, dtype=np.int64).tobytes(), keys.tobytes(), (8 * at).tolist()
            for c, i, j in zip(chunks, [0, *upto], upto):
                out[c] = facts + packed[i:j]
            return
        each = lambda x: np.diff(np.searchsorted(x, stops, "right"), prepend=0)
        over = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at], prepend=0)
        n = self.counts.of(keys)
        best = self.counts.best[keys >> 32]
        facts = np.stack([np.ones(len(chunks), np.int64), each(ends_a), each(ends_b), each(groups), np.diff(at, prepend=0), over(n == best), over(n)], axis=1)
        group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        after_a, after_b = 3 * ids_a + np.isin(ends_a, groups), 3 * ids_b + 2 * np.isin(ends_b, groups)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        spelt, upto = laid_out(p.spelt, np.concatenate([after_a, after_b])[order])
        tokens = np.cumsum(facts[:, 1] + facts[:, 2])
        for c, f, i, j in zip(chunks, facts, [0, *upto[tokens - 1]], upto[tokens - 1]):
            out[c] = f.tobytes() + bytes(spelt[i:j])

    def read(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """(facts of each chunk, the rest of what is known of it, each text's chunks by number, where each text's end)."""
        chunks, spaced, codes, ends = space_chunks(texts, self.odd)
        chunks[spaced:] = [" " + c for c in chunks[spaced:]]
        if len(self.known) + len(chunks) > MOST_CHUNKS:
            self.known.clear()
        fresh = self._learn(*([c for c in part if c not in self.known] for part in (chunks[:spaced], chunks[spaced:])))
        known = [self.known.get(c) or fresh[c] for c in chunks]
        self.known |= {c: f for c, f in fresh.items() if len(c) <= LONG_CHUNK}
        head = FACTS * 8
        facts = np.frombuffer(b"".join(k[:head] for k in known), dtype=np.int64).reshape(-1, FACTS)
        return facts, pa.array([k[head:] for k in known], type=pa.large_binary()), codes, ends


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("k"), F.make_valid_utf8(text_or_empty(text)).alias("t"))


def _unspelt(aligner: Aligner, texts: pa.Array, facts: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a text has no tokens: it is empty, or a tokenizer does not spell one of its chunks."""
    bad = np.concatenate([[0], np.cumsum(facts[codes, 0] == 0)])[np.concatenate([[0], ends])]
    return (np.diff(bad) > 0) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)


def document_counts(docs: DataFrame, *, key: str, text: str, a: str, b: str) -> DataFrame:
    """(key, n): in how many documents each pair is linked, partly counted by each task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held, size = _aligner(a, b, None), [], 0
        shift = aligner.pair.bits_b
        for _, texts in pieces(it, 4 << 20):
            facts, keys, codes, ends = aligner.read(texts)
            packed, upto = laid_out(keys, codes)
            per_doc = np.diff(np.concatenate([[0], upto])[np.concatenate([[0], ends])]) // 8
            doc = np.repeat(np.arange(len(texts)), per_doc)
            pair = np.frombuffer(packed, dtype=np.int64)
            keep = ~_unspelt(aligner, texts, facts, codes, ends)[doc]
            short = (pair >> 32 << shift | pair & 0xFFFFFFFF)[keep]
            wide = int(short.max()).bit_length() if len(short) else 0
            once = np.unique(doc[keep] << wide | short) & ((1 << wide) - 1)  # a pair counts once in a document
            held.append(np.unique(once, return_counts=True))
            size += len(held[-1][0])
            if size > MOST_PAIRS:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > MOST_PAIRS // 2:
                    yield _rows(held.pop(), shift)
                    size = 0
        if held:
            yield _rows(_summed(held), shift)

    with small_batches(docs.sparkSession):
        return _texts(docs, key, text).mapInArrow(run, "key long, n long")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _rows(counted: tuple[np.ndarray, np.ndarray], shift: int) -> pa.RecordBatch:
    keys, counts = counted
    return pa.RecordBatch.from_arrays([pa.array(keys >> shift << 32 | keys & ((1 << shift) - 1)), pa.array(counts.astype(np.int64))], schema=SHARD)


def count_shards(counts: DataFrame, out_dir: str) -> DataFrame:
    """Sum the counts of equal keys and write them in ascending order, a shard per range; a row (path, first, last, n) per shard."""

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = open_fs(out_dir)
        files.create_dir(folder, recursive=True)
        path, first, total = f"{folder}/counts-{uuid.uuid4().hex}.arrow", None, 0
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        with files.open_output_stream(path) as sink, ipc.new_file(sink, SHARD) as out:
            for batch in it:  # the last run may go on in the next batch
                keys, sums = _summed([(keys, sums), tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)])
                first = first if first is not None or not len(keys) else int(keys[0])
                if len(keys) > 1:
                    out.write_batch(pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(sums[:-1])], schema=SHARD))
                    total, keys, sums = total + len(keys) - 1, keys[-1:], sums[-1:]
            if len(keys):
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], schema=SHARD))
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"path": path, "first": first, "last": int(keys[-1]), "n": total + 1}])

    spark = counts.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "500000")  # rows of two numbers: a shard has few batches, so that a search looks into few
    try:
        return cut(counts.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(write, "path string, first long, last long, n long"))
    finally:
        spark.conf.set(key, before)


class Counts:
    """Lookup in count shards. Local shards are mapped, others are loaded, at most LOADED at a time."""

    LOADED = 4

    def __init__(self, shards: list[tuple[str, int, int]], root: str, best: np.ndarray):
        self.shards, self.best = sorted(shards, key=lambda s: s[1]), best
        self.files, _ = open_fs(root)
        self.open: dict[str, list] = {}

    def _batches(self, path: str) -> list[tuple[np.ndarray, np.ndarray]]:
        if path not in self.open:
            local = isinstance(self.files, fs.LocalFileSystem)
            if not local and len(self.open) >= self.LOADED:
                self.open.pop(next(iter(self.open)))
            file = ipc.open_file(pa.memory_map(path) if local else self.files.open_input_file(path))
            self.open[path] = [tuple(c.to_numpy(zero_copy_only=True) for c in file.get_batch(i).columns) for i in range(file.num_record_batches)]
        return self.open[path]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys, 0 for those that no document has."""
        asked, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(asked), np.int64)
        for path, first, last in self.shards:
            i, j = np.searchsorted(asked, first), np.searchsorted(asked, last, "right")
            if i < j:
                for held, n in self._batches(path):
                    lo, hi = i + np.searchsorted(asked[i:j], held[0]), i + np.searchsorted(asked[i:j], held[-1], "right")
                    place = np.searchsorted(held, asked[lo:hi])
                    out[lo:hi] = np.where(held[place] == asked[lo:hi], n[place], 0)
        return out[back]


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(a: str, b: str, table: tuple | None) -> Aligner:
    """This worker's aligner for a table of counts; one at a time is kept."""
    key = (a, b, table and table[1])
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a, b, table and Counts(*table))
    return _ALIGNERS[key]


def pair_table(manifest: DataFrame, root: str) -> DataFrame:
    """All pairs of a corpus: a, b, n (documents that link them), from the shards."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_fs(root)
        for batch in it:
            for path in batch.column(0).to_pylist():
                with files.open_input_file(path) as f:
                    file = ipc.open_file(f)
                    for i in range(file.num_record_batches):
                        keys, n = file.get_batch(i).columns
                        k = keys.to_numpy()
                        yield pa.RecordBatch.from_arrays([pa.array(k >> 32), pa.array(k & 0xFFFFFFFF), n], names=["a", "b", "n"])

    shards = manifest.select("path")
    return shards.repartition(max(1, shards.count()), "path").mapInArrow(read, "a long, b long, n long")


def count_pairs(docs: DataFrame, root: str, *, key: str = "doc_id", text: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """Count the corpus: shards below root, and their manifest."""
    return count_shards(stored(document_counts(docs, key=key, text=text, a=a, b=b), "pair-counts"), root)


def align(docs: DataFrame, *, key: str = "doc_id", text: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """Per document: tokens of A and B, groups, links, links that are the best of their A id, the sum of the links' counts, and a hash of
    the groups as `a1,a2|b1;a3|b2,b3`."""
    root = fresh_dir(docs.sparkSession, "alignment")
    manifest = count_pairs(docs, root, key=key, text=text, a=a, b=b)
    highest = pair_table(manifest, root).groupBy("a").agg(F.max("n").alias("n")).toPandas()  # at most a row per id of A
    best = np.zeros(len(_pair(a, b).bytes_a), np.int64)
    best[highest["a"].to_numpy(np.int64)] = highest["n"].to_numpy(np.int64)
    table = [tuple(r) for r in manifest.select("path", "first", "last").collect()], root, best  # a row per shard
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b, table)
        for keys, texts in pieces(it, 4 << 20):
            facts, spelt, codes, ends = aligner.read(texts)
            none = _unspelt(aligner, texts, facts, codes, ends)
            bounds = np.concatenate([[0], ends])
            sums = np.diff(np.concatenate([np.zeros((1, FACTS), np.int64), np.cumsum(facts[codes], axis=0)])[bounds], axis=0)
            sums[none] = 0
            line, upto = laid_out(spelt, codes)
            at = np.concatenate([[0], upto])[bounds]
            hashes = ["" if no else hashlib.sha256(line[i : j - 1]).hexdigest() for no, i, j in zip(none, at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), *(pa.array(sums[:, i + 1]) for i in range(6)), pa.array(hashes)], names=[key, *names, "groups_sha256"])

    with small_batches(docs.sparkSession):
        return _texts(docs, key, text).mapInArrow(run, f"{key} long, {', '.join(n + ' long' for n in names)}, groups_sha256 string")
