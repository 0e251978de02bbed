"""The source audit against plain Python and its SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import difference, type_difference

from textquarry.llm import divergence as DV
from textquarry.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n long, v long, r int, value long, item string, first string"


def plain(rows, least=3, ranks=200):
    """The contract, written out in Python's own whole numbers. rows: (text, lang, source)."""
    held, occurs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = (x or "" for x in (text, lang, source))
        groups[lang].add(source)
        raw = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.encode())
        terms = [bytes(b + 32 if 65 <= b <= 90 else b for b in t).decode() for t in raw]
        held[lang].update(set(terms))
        occurs[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        own = {s: {t: occurs[lang, s][t] for t in kept} for s in sources}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(own[s]) for s in sources}
        q = share({t: sum(own[s][t] for s in sources) for t in kept})
        f = lambda x, y: (x - y) * (x - y) // y
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                best = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, o, v, k) for k, (o, v) in enumerate(best, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def run(spark, rows, parts=4, **options):
    docs = spark.createDataFrame([(1, *r, 1, 2, 3, 4, "x", "y") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in DV.audit(docs, **options).collect())


ODD = [(None, None, None), ("", "en", "a"), ("The the THE tHe", "en", "a"), ("the of and", "en", "b"), ("the of", "en", "b"), ("of The", "en", None), ("12 !! ??", "en", "none"), ("straße ÄÖÜ äöü É é", "de", "a"), ("straße äöü\x00é É", "de", "a"), ("STRAße Äöü 漢字x", "de", "b"), ("straße x", "de", "c"), ("straße 🙂", "de", "c"), ("only here", "fr", "a"), (None, "fr", "z"), ("one two", None, "a"), ("one two", "", "a"), ("two one one", None, "b"), ("x" * 3000 + " y", "xx", "a")]


def test_odd_rows(spark):
    got = run(spark, ODD)
    assert got == plain(ODD)
    assert ("fr", "a", "pair", "z", 0, 1) in got  # a language that keeps no term has its pairs


def test_empty_table(spark):
    assert run(spark, [], 1) == []


@pytest.mark.parametrize("seed", range(3))
def test_many_small_segments(spark, monkeypatch, seed):
    """Segments of few leaves, tasks that start anew: many ranges, cut inside of segments."""
    monkeypatch.setattr(DV, "SEGMENT", 5)
    monkeypatch.setattr(DV, "MOST_COUNTERS", 40)
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(15))), rng.choice(["en", "en", "de"]), f"s{rng.randrange(4)}") for _ in range(120)]
    assert run(spark, rows, 6, most_ranks=7) == plain(rows, ranks=7)


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = QUERIES["op12_divergence"](spark, sf)
    assert not type_difference(df, ORACLES["op12_divergence"], sf)
    assert not difference(df, ORACLES["op12_divergence"], sf)


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in QUERIES["op12_divergence"](spark, sf).collect()) == plain(rows)


def trie(terms):
    n = len(terms)
    return DV.Trie.merged(pa.array(terms, type=pa.binary()), np.ones(n, np.int64), np.arange(n), np.arange(n) % 3, np.arange(n) + 1)


def test_tries_are_kept_in_preorder():
    words = [b"tea", b"ten", b"te", b"a", b"tea", "é".encode(), b"inn", b"in"]
    t = trie(words)
    back = DV.Trie.unpacked(t.packed())
    assert back.terms.to_pylist() == sorted(set(words)) and back.docs.tolist() == t.docs.tolist()
    assert [(a, b) for a, b in zip(back.leaf.tolist(), back.count.tolist())] == [(a, b) for a, b in zip(t.leaf.tolist(), t.count.tolist())]
    assert np.frombuffer(t.packed()["shared"], np.int32).tolist() == [0, 0, 2, 0, 2, 2, 0]
    half = t.part(2, 5)
    assert half.terms.to_pylist() == sorted(set(words))[2:5] and DV.Trie.unpacked(half.packed()).docs.tolist() == half.docs.tolist()
    assert t.docs[sorted(set(words)).index(b"tea")] == 2


def test_shares_of_large_counts_are_exact():
    rng = random.Random(1)
    for _ in range(500):
        total = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(total + 1)
        assert DV.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total
