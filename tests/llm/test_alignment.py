"""Alignment of two tokenizers against plain loops over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.llm import alignment as AL
from textquarry.llm.queries import QUERIES

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, key long, n long, k string, t string, path string"


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path(B))


def plain(libraries, texts):
    """The contract, written out: one tuple per text."""
    a, b = libraries
    letters = AL._byte_letters()
    lines = []
    for text in texts:
        if not text:
            lines.append(None)
            continue
        of_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        of_b = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            of_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        if b"".join(x for _, x in of_a) != raw or b"".join(x for _, x in of_b) != raw:
            lines.append(None)
            continue
        at_a, at_b = ([(i, sum(len(y) for _, y in of[:k]), sum(len(y) for _, y in of[: k + 1])) for k, (i, x) in enumerate(of)] for of in (of_a, of_b))
        links = [(i, j) for i, s, e in at_a for j, p, q in at_b if s < q and p < e]
        ends = sorted({e for _, _, e in at_a} & {e for _, _, e in at_b})
        groups = [(",".join(str(i) for i, _, e in at_a if s < e <= t), ",".join(str(i) for i, _, e in at_b if s < e <= t)) for s, t in zip([0, *ends], ends)]
        lines.append((len(at_a), len(at_b), groups, links))
    held = Counter(pair for line in lines if line for pair in set(line[3]))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(0,) * 6 + ("",) if line is None else (line[0], line[1], len(line[2]), len(line[3]), sum(held[p] == best[p[0]] for p in line[3]), sum(held[p] for p in line[3]), hashlib.sha256(";".join(f"{x}|{y}" for x, y in line[2]).encode()).hexdigest()) for line in lines], held


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  ", "two  spaces here", "line\nbreak\r\n next", "a \n b", "tab\t x\x1c y", "▁ sign", "under▁ x", "<s> </s> <unk> <|endoftext|> <0x41>", "漢字 🙂🙃 é", "don't I'll", "x" * 500, "the  the", "　wide　 space", "\x85 a", "a same text", "a same text"]


def compare(spark, libraries, texts, **options):
    docs = spark.createDataFrame([(i if i % 5 else None, t, 1, 2, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = sorted((str(r[0]), *r[1:]) for r in AL.align(docs, **options).collect())
    want, _ = plain(libraries, texts)
    assert got == sorted((str(i if i % 5 else None), *w) for i, w in enumerate(want))


def test_odd_texts(spark, libraries):
    compare(spark, libraries, ODD)


def test_random_texts_and_bounds(spark, libraries, monkeypatch):
    rng = random.Random(3)
    letters = [" ", " ", " ", "\n", "▁", "e", "t", "th", "ing", "é", "漢", ".", "'s", "1", "　", "\t"]
    compare(spark, libraries, ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)])


def test_query_equals_plain_loops(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 3000).collect()
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    want, held = plain(libraries, [r.text for r in rows])
    assert {r[0]: tuple(r)[1:] for r in AL.align(docs).collect()} == {r.doc_id: w for r, w in zip(rows, want)}
    root = AL.fresh_dir(spark, "pairs")
    table = AL.pair_table(AL.count_pairs(docs, root), root)
    assert {(r.a, r.b): r.n for r in table.collect()} == dict(held)


def test_registered_query_has_a_row_for_each_document(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_alignment"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_empty_table(spark):
    assert AL.align(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in AL.align(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]


def test_runs_over_batches_are_summed(spark):
    counts = spark.range(30_000).select((F.col("id") % 97).alias("key"), F.lit(1).cast("long").alias("n")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = AL.fresh_dir(spark, "sums")
    shards = AL.count_shards(counts, root).collect()
    assert all(x.last < y.first for x, y in zip(sorted(shards, key=lambda s: s.first), sorted(shards, key=lambda s: s.first)[1:]))
    table = AL.Counts([tuple(s)[:3] for s in shards], root, np.zeros(1, np.int64))
    keys = np.array([96, 5, 5, 0, 97, -1, 1 << 40])
    assert table.of(keys).tolist() == [sum(1 for i in range(30_000) if i % 97 == k) for k in keys]
    held, n = table._batches(shards[0].path)[0]
    assert not held.flags.owndata and not n.flags.owndata  # views into the mapped file


def test_chunks_are_forgotten_and_texts_of_a_batch_are_apart(monkeypatch):
    monkeypatch.setattr(AL, "MOST_CHUNKS", 5)
    one, other = AL.Aligner(A, B), AL.Aligner(A, B)
    texts = [f"some words {i} and a line\nmore {i * i}" for i in range(30)]
    facts, keys, codes, ends = one.read(pa.array(texts))
    apart = [AL.laid_out(k, c)[0].tobytes() for k, c in ((x[1], x[2]) for x in (other.read(pa.array([t])) for t in texts))]
    line, upto = AL.laid_out(keys, codes)
    assert b"".join(apart) == line.tobytes() and len(one.known) <= 200 and facts[:, 0].all()


def test_links_of_one_line():
    ids = np.array
    keys, ends, groups = AL.links(ids([1, 2]), ids([7, 8, 9]), ids([3, 5]), ids([1, 4, 5]))
    assert [(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in keys] == [(1, 7), (1, 8), (2, 8), (2, 9)] and ends.tolist() == [1, 3, 4, 5] and groups.tolist() == [5]
