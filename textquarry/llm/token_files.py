"""Token-ID output: Arrow IPC files whose batches are fixed-size lists, so any sequence is read without a copy.

A shard is two Arrow IPC files. `*.seq.arrow` has batches of `batch_sequences` rows, each a fixed-size list of
`sequence_length` token ids and a fixed-size list of mask bits (true: a token, false: padding after the shard's last
one), both read as views into the mapped file, the bits as an Arrow array: sequence i is row i % batch_sequences of batch i // batch_sequences. `*.idx.arrow` has a row per document:
doc_id, start in the shard's stream, n_tokens. A manifest row per shard gives the shard's base in the whole stream.

Defined cases: a null or empty text is the end id alone; documents with a null doc_id come first; repeated doc_ids stay
side by side as separate documents, in the order of a hash of their texts; an empty table writes no shard; columns other than the two named are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import cut, fresh_dir, text_or_empty

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "seq_path string, idx_path string, part int, roll int, first_doc_id long, n_docs long, n_tokens long, n_sequences long"
#: Distinct words, and bytes of them and their ids, that a worker remembers before it starts anew.
REMEMBERED_WORDS, REMEMBERED_BYTES = 900_000, 48 << 20


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def splits_at_spaces(tokenizer) -> bool:
    """Whether a text's ids are its white-space words' ids in order, whatever stands between the words.

    That needs a pre-tokenizer that removes white space (so nothing is joined over it), no prefix or suffix that marks a
    place in the text, and no added token with white space in it.
    """
    import json

    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    removes = any(
        s.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and _no_space(s.get("pattern", {}).get("Regex", " "))
        for s in steps
    )
    marks = any(s.get("type") in ("Metaspace", "ByteLevel") and s.get("add_prefix_space", s.get("prepend_scheme", "always") != "never") for s in steps)
    return removes and not marks and not any(re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))


def _no_space(pattern: str) -> bool:
    """Whether no match of the pattern holds white space: tried on runs of letters, digits, signs and spaces."""
    import regex

    return not any(re.search(r"\s", m) for text in ("ab cd  12 .,\t!?\n 's x", " a ", "'s 't  \r\n", "1 2 ,") for m in (x.group() for x in regex.finditer(pattern, text)))


class WordEncoder:
    """Encodes texts by their distinct white-space words and remembers each word's ids over a worker's tasks.

    Only tokenizers of which `splits_at_spaces` says so are used that way; with others, or where `whole` asks for it, each
    text is encoded at once.
    """

    def __init__(self, name: str, dtype: str, whole: bool = False):
        self.tokenizer, self.dtype = _tokenizer(name), np.dtype(dtype)
        self.whole = whole or not splits_at_spaces(self.tokenizer)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        alone = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = alone[0] if len(alone) == 1 else None

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids end."""
        if self.whole:
            each = [np.asarray(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*each, np.zeros(0, self.dtype)]), np.cumsum([len(x) for x in each], dtype=np.int64)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        distinct, which = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        if len(self.known) > REMEMBERED_WORDS or self.known_bytes > REMEMBERED_BYTES:
            self.known.clear()
            self.known_bytes = 0
        new = [w for w in distinct if w not in self.known]
        self._learn(new)
        self.known_bytes += 3 * sum(map(len, new))  # about a word and its ids
        ids = list(map(self.known.__getitem__, distinct))
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.dtype.itemsize
        flat, starts = np.frombuffer(b"".join(ids), dtype=self.dtype), np.cumsum(sizes) - sizes
        own = sizes[which]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.repeat(starts[which] - (ends - own), own) + np.arange(total)]
        per_text = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        return out, np.concatenate([[0], ends])[per_text]

    def _learn(self, new: list[str]) -> None:
        """Encode words in long lines, a mark between each two, which costs a fraction of one call for each."""
        odd = [w for w in new if self.mark is None or MARK in w]
        plain = [w for w in new if MARK not in w] if self.mark is not None else []
        for w in odd:
            self.known[w] = np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids)
            stops = np.flatnonzero(ids == self.mark)
            raw, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            for w, i, j in zip(part, [0, *(stops + 1).tolist()], [*stops.tolist(), len(ids)]):
                self.known[w] = raw[i * size : j * size]


#: A character that stands alone as one id; words that contain it are encoded by themselves.
MARK = "\x01"


@lru_cache(maxsize=2)
def _encoder(name: str, dtype: str, whole: bool) -> WordEncoder:
    return WordEncoder(name, dtype, whole)


def pieces(it: Iterator[pa.RecordBatch], most: int = 12 << 20) -> Iterator[tuple[list, pa.StringArray]]:
    """(keys, texts) of at most about `most` bytes, or a single longer text."""
    for batch in it:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(keys):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield keys[at:stop], texts.slice(at, stop - at)
            at = stop


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Packs documents into equal-length sequences; files get names that no other task attempt uses."""

    def __init__(self, root: str, length: int, rows: int, dtype: str):
        self.files, self.dir = open_fs(root)
        self.files.create_dir(self.dir, recursive=True)
        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        item = pa.uint16() if self.dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("tokens", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.stem = f"{self.dir}/shard-{uuid.uuid4().hex}"
        self.sink = self.files.open_output_stream(f"{self.stem}.seq.arrow")
        self.writer = ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = self.sequences = 0
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.tokens, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        full = self.length * self.rows
        if self.held >= full:
            flat = np.concatenate(self.waiting)
            for at in range(0, len(flat) - full + 1, full):
                self._batch(flat[at : at + full], full)
            self.waiting, self.held = [flat[len(flat) - len(flat) % full :]], len(flat) % full

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), dtype=bool)
        mask[:real] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.sequences += len(flat) // self.length

    def close(self, part: int, roll: int) -> tuple:
        if self.held:
            flat = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, dtype=self.dtype)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.writer.close()
        self.sink.close()
        table = pa.table([pa.array(list(c), type=t.type) for c, t in zip(zip(*self.docs), INDEX)], schema=INDEX)
        with self.files.open_output_stream(f"{self.stem}.idx.arrow") as sink, ipc.new_file(sink, INDEX) as out:
            out.write_table(table)
        return f"{self.stem}.seq.arrow", f"{self.stem}.idx.arrow", part, roll, self.docs[0][0], len(self.docs), self.tokens, self.sequences


class ShardReader:
    """Random access to a shard. On a local file system the file is mapped and no token is copied."""

    def __init__(self, seq_path: str, idx_path: str | None = None, root: str = "file:/"):
        self.files, _ = open_fs(root)
        local = isinstance(self.files, fs.LocalFileSystem)
        self.source = pa.memory_map(seq_path) if local else self.files.open_input_file(seq_path)
        self.file = ipc.open_file(self.source)
        self.length = self.file.schema.field("tokens").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self.idx_path = idx_path

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Token ids and mask of sequence i, both views: nothing is copied, mask bits stay packed as the file has them."""
        batch, row = self.file.get_batch(i // self.rows), i % self.rows
        tokens, mask = (batch.column(c).values.slice((batch.column(c).offset + row) * self.length, self.length) for c in (0, 1))
        return tokens.to_numpy(zero_copy_only=True), mask

    def index(self) -> pa.Table:
        with self.files.open_input_file(self.idx_path) as f:
            return ipc.open_file(f).read_all()

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(doc_id, start, pieces of its ids in order); each piece is a view into one batch."""
        size = self.length * self.rows
        at, flat = -1, None

        def pieces(start: int, n: int) -> Iterator[np.ndarray]:
            nonlocal at, flat
            while n:
                if start // size != at:
                    at = start // size
                    flat = self.file.get_batch(at).column(0).flatten().to_numpy(zero_copy_only=True)
                piece = flat[start - at * size : min(size, start - at * size + n)]
                yield piece
                start, n = start + len(piece), n - len(piece)

        for k, start, n in zip(*(c.to_pylist() for c in self.index().columns)):
            yield k, start, pieces(start, n)


def write_token_files(
    docs: DataFrame,
    out_dir: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    sequence_length: int = 2048,
    batch_sequences: int = 128,
    shard_tokens: int = 16 << 20,
    dtype: str = "<u2",
    whole_texts: bool = False,
) -> DataFrame:
    """Write shards in ascending key order and return the manifest, with `base`: the tokens in all shards before.

    The rows are dealt out by ranges of the key, so the only shuffle is the sort that the order asks for; where one key has
    more rows than two tasks should, by ranges of key and text hash, so that they go to several. A task streams: it holds a few MB of texts and one batch of
    sequences. `dtype` "<u2" holds ids below 65,536; "<u4" holds any.
    """

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, rows, roll, part = _encoder(tokenizer, dtype, whole_texts), None, [], 0, TaskContext.get().partitionId()
        end = np.asarray([end_id], dtype=dtype)
        for keys, texts in pieces(it):
            ids, stops = encoder.encode(texts)
            for k, i, j in zip(keys, [0, *stops[:-1].tolist()], stops.tolist()):
                if writer and writer.tokens >= shard_tokens:
                    rows.append(writer.close(part, roll))
                    writer, roll = None, roll + 1
                writer = writer or ShardWriter(out_dir, sequence_length, batch_sequences, dtype)
                writer.add(k, np.concatenate([ids[i:j], end]))
        if writer:
            rows.append(writer.close(part, roll))
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)

    names = [c.split()[0] for c in MANIFEST.split(", ")]
    kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for n, c in zip(names, MANIFEST.split(", "))])
    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t")).withColumn("th", F.xxhash64("t"))
    most = rows.groupBy("k").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ["k", "th"] if (most[0] or 0) > 2 * (most[1] or 0) / tasks else ["k"]
    written = cut(rows.repartitionByRange(*ranges).sortWithinPartitions("k", "th").select("k", "t").mapInArrow(write, MANIFEST))
    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)  # ranges ascend with the partitions
    return written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # a row per shard


def read_document_digests(manifest: DataFrame, root: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 of its ids as little-endian 32-bit integers."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for shard in batch.to_pylist():
                reader, out = ShardReader(shard["seq_path"], shard["idx_path"], root), []
                for k, start, pieces in reader.documents():
                    crc = n = 0
                    for piece in pieces:
                        crc, n = zlib.crc32(piece.astype("<u4").tobytes(), crc), n + len(piece)
                    out.append((k, shard["base"] + start, n, crc))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("seq_path", "idx_path", "base")
    n = max(1, shards.count())
    return shards.repartitionByRange(n, "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, **options) -> DataFrame:
    """Write the files below the shared folder and read every document back from them."""
    out = fresh_dir(docs.sparkSession, "tokens")
    return read_document_digests(cut(write_token_files(docs, out, **options)), out)
