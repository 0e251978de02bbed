"""Byte-level BPE against the library that it must equal, and against plain merging."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm import bpe_transducer as B
from textquarry.llm import spaces
from textquarry.llm.queries import QUERIES

RANKS = "byte_bpe_multi_50k.tiktoken"
SCHEMA = "doc_id long, text string, ids int, k string, t string, lang string"


@pytest.fixture(scope="module")
def coder():
    return B.codec(RANKS, None)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.machine.ranks, special_tokens={})


def encoded(coder, texts):
    ids, ends = coder.encode(pa.array(texts, type=pa.string()))
    return [ids[i:j].tolist() for i, j in zip([0, *ends], ends)]


ODD = ["", " ", "  ", "a", " a", "a ", "a  ", "  a", "a  b", "a \n b", "a\n b", "a\x1c b", "a!\x1c b", "a　 b　c", "don't I'll 's  'S", "<|endoftext|> x", "漢字 🙂🙃", "é É", "\x00 \x00", "x" * 5000, "ab" * 3000 + " c", "12 345  6", "  \x85 z", "a\r\n\r\n b"]


def test_equals_the_library_on_odd_texts(coder, library):
    assert encoded(coder, ODD) == [library.encode_ordinary(t) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\taeiost'é漢🙂　.,!19"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40), min_size=1, max_size=4))
def test_equals_the_library_on_any_text(texts):
    coder = B.codec(RANKS, None)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.machine.ranks, special_tokens={})
    assert encoded(coder, texts) == [library.encode_ordinary(t) for t in texts]


def merged(ranks, data):
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, B.NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == B.NEVER:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("seed", range(30))
def test_any_ranks_not_only_trained_ones(seed, monkeypatch):
    """Rank files whose entries no merges reach, with few letters so that merges cross each other; few states, so that they are forgotten."""
    monkeypatch.setattr(B, "MOST_STATES", 20)
    rng = random.Random(seed)
    entries = [b"a", b"b", b"c"]
    while len(entries) < 30:
        e = bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6)))
        if e not in entries:
            entries.append(e)
    order = entries[3:]
    rng.shuffle(order)
    ranks = {e: i for i, e in enumerate(entries[:3] + order)}
    machine = B.Transducer(ranks)
    for _ in range(200):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25)))
        assert list(machine.stream([data[:3], b"", data[3:]])) == merged(ranks, data)
        assert machine.encode(data) == ([ranks[data]] if data in ranks else merged(ranks, data))


def test_tokens_come_after_bounded_lookahead(coder):
    """While a long match is read, no more bytes wait than some tokens' lengths."""
    word, spelt, longest = b"interoperabilitythethereof" * 400, 0, 0
    read = 0

    def bytes_one_by_one():
        nonlocal read
        for b in word:
            read += 1
            yield bytes([b])

    for token in coder.machine.stream(bytes_one_by_one()):
        spelt += len(coder.machine.bytes_of[token])
        longest = max(longest, read - spelt)
    assert spelt == len(word) and longest <= 4 * max(map(len, coder.machine.ranks))


def test_utf8_stream_gives_whole_characters():
    text = "a é 漢 🙂 \U0010ffff".encode()
    for size in (1, 2, 3, 5):
        stream, out = B.Utf8Stream(), []
        for at in range(0, len(text), size):
            out.append(bytes(stream.feed(text[at : at + size])))
            out[-1].decode()  # never half a character
        assert b"".join(out) + stream.finish() == text
    broken = b"\xe6\xbcx\x80\xf0\x9f\xff\xc3"
    stream = B.Utf8Stream()
    assert b"".join(bytes(stream.feed(broken[i : i + 1])) for i in range(len(broken))) + stream.finish() == broken


def test_chunks_spell_the_texts():
    chunks, spaced, codes, ends = spaces.space_chunks(pa.array(ODD))
    assert ["".join(chunks[c] for c in codes[i:j]) for i, j in zip([0, *ends], ends)] == ODD
    assert all(c.startswith(" ") for c in chunks[:spaced]) and np.all(np.diff(ends) >= 1)


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(B, "MOST_CHUNKS", 3)
    monkeypatch.setattr(B, "MOST_PAIRS", 5)
    coder = B.Codec(RANKS, None)
    texts = [f"word{i} and others{i * 7} " + "long" * i for i in range(60)]
    assert encoded(coder, texts) == [library.encode_ordinary(t) for t in texts] and len(coder.known) <= 3 and len(coder.machine.pairs) <= 5


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: digests(library, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_byte_bpe"](spark, sf).collect()} == want


def test_awkward_rows(spark, library):
    rows = [(5, None), (5, ""), (None, "no id"), (7, "two  spaces"), (7, "two  spaces"), (8, "word " * 30_000), *((i, t.replace("\x00", "")) for i, t in enumerate(ODD))]
    docs = spark.createDataFrame([(i, t, 1, "x", "y", None) for i, t in rows], SCHEMA)
    got = B.round_trip_digests(docs).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted((str(i), *digests(library, t)) for i, t in rows)
    both = B.decode_ids(B.encode_texts(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in both) == sorted((str(i), t or "") for i, t in rows)
    assert B.round_trip_digests(docs.limit(0)).count() == 0 and B.encode_texts(docs.limit(0)).count() == 0


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text")
    assert B.decode_ids(B.encode_texts(docs)).first().text == "a�b"


def test_ids_that_the_file_lacks_and_nulls(spark):
    rows = spark.createDataFrame([(1, [64, None, 10**8, -1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in B.decode_ids(rows).collect()} == {1: B.codec(RANKS, None).token[64].as_py().decode(), 2: "", 3: ""}


def test_another_pattern_reads_whole_texts(spark):
    docs = spark.createDataFrame([(1, "ab cd  ef")], "doc_id long, text string")
    coder = B.codec(RANKS, None)
    whole = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=coder.machine.ranks, special_tokens={})
    assert B.encode_texts(docs, pattern=r"(?s).+").first().ids == whole.encode_ordinary("ab cd  ef")
