"""Patterns by the trigram index against the scan, and strongly connected components against reach."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textquarry.operators import graph as G
from textquarry.operators import search as S
from textquarry.operators import trigrams as T
from textquarry.storage import fresh_dir

PATTERNS = [
    "token", "the", "ab", "", "worthless [a-z]+", "(worth|value)less", "idiots?", "(?i)THE of", "t.e", "^The", "and$", r"\bof the\b", "[abc]def", "tion{2}", "(tion)+", "(?:tion)*x?", "an(d|t) ?the", "x|y", "foo|the and|of in",
    "é", "straße", r"\d{3}-\d{4}", r"\w+@\w+\.com", r"\Qthe\E", r"\p{L}{20}", "(?=the)the", "(?!the)and", "a{0}the", "th(?:e|at) (?:of|and)", "(?i)İ", "token|", "(?<x>the) (?:in|on)", "the\tof", "th[e]re", r"in\.", r"\.\nT", ".*", "the.*and", "(a|b)(c|d)(e|f)the", "(?iu)ſ", "zzzz", "thtion", "(?s)the.of", r"\x74he", r"\vx", "lorem ipsum", "(one|two|three|four|five|six) of", "[tT]he end", "ing, ", "as (if|it|is)",
]


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return docs.union(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "ab"), (10**6 + 3, "THE OF İ Straße ſ the\tof")], "doc_id long, text string"))


@pytest.fixture(scope="module")
def index(spark, texts):
    return T.TrigramIndex.write(texts, "doc_id", "text", fresh_dir(spark, "trigrams"), buckets=8, blocks=16)


def test_fifty_patterns_find_what_the_scan_finds(spark, texts, index):
    assert len(PATTERNS) >= 50
    kept = texts.where("text is not null").cache()
    unions = lambda of: [f for i, p in enumerate(PATTERNS) for f in [of(p).withColumn("p", F.lit(i))]]
    collect = lambda frames: sorted(tuple(r) for k in range(0, len(frames), 10) for r in _union(frames[k : k + 10]).collect())
    got = collect(unions(lambda p: index.texts(p).where(F.col("text").rlike(p)).select("doc_id")))
    assert got == collect(unions(lambda p: kept.where(F.col("text").rlike(p)).select("doc_id")))


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


@pytest.mark.parametrize("pattern,options", [("token", {"fixed": True}), ("idiot|moron", {"word": True}), ("(", {"fixed": True}), ("worthless [a-z]+", {})])
def test_lines_equal_grep(texts, index, pattern, options):
    want = [tuple(r) for r in S.grep(texts, "doc_id", "text", pattern, 300, **options).collect()]
    assert [tuple(r) for r in index.grep(pattern, 300, **options).collect()] == want


def rows_read(df):
    """Rows that the scans of texts give in the plan that ran."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        for name in ("executedPlan", "plan"):  # inside adaptive plans and their stages
            if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec",) and name == "executedPlan" or node.getClass().getSimpleName().endswith("QueryStageExec") and name == "plan":
                todo.append(getattr(node, name)())
        if "FileSourceScan" in node.getClass().getSimpleName() and "texts" in node.toString():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_only_blocks_of_candidates_are_read(texts, index):
    total = texts.where("text is not null").count()
    assert rows_read(index.texts(".*")) == total
    assert rows_read(index.texts("zzzz qqq")) == 0
    assert 0 < rows_read(index.texts("THE OF İ Straße", fixed=True)) < total / 4


def test_what_patterns_need():
    assert T.needed("abcd") == [{"abc", "bcd"}] and T.needed("ab") is None and T.needed("abc|xyz") is not None
    assert T.needed("abc|xy") is None and T.needed("(abc)?") is None and T.needed("(ABC)+d") == [{"abc"}]
    for p in PATTERNS:  # what is needed is in every text that matches, by the reading that both engines share
        for way_text in ("the and of in token worthless abc idiots ", "of the thatof"):
            try:
                hit = re.search(p, way_text)
            except re.error:
                continue
            ways = T.needed(p)
            assert not hit or ways is None or any(all(g in way_text.lower() for g in w) for w in ways)


def brute(edges):
    nodes = {x for e in edges for x in e}
    out = {n: {d for s, d in edges if s == n and d != n} for n in nodes}

    def reach(n):
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return seen

    far = {n: reach(n) for n in nodes}
    return {n: max(m for m in far[n] if n in far[m]) for n in nodes if n in far[n]}


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_reach(spark, seed):
    """Random graphs of which most edges are on no cycle."""
    rng = random.Random(seed)
    edges = [(a, b) for a, b in ((rng.randrange(40), rng.randrange(40, 90)) for _ in range(60))] + [(a, a + rng.randrange(1, 4)) for a in range(100, 140)]
    edges += [(rng.randrange(x, x + 6), rng.randrange(x, x + 6)) for x in (0, 50, 100, 120) for _ in range(9)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == brute(edges)


def test_components_of_nothing_and_of_names(spark):
    assert G.components(spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d")], "src string, dst string")).count() == 0
    got = G.components(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "b")], "src string, dst string")).collect()
    assert {r.node: r.component for r in got} == {"a": "b", "b": "b"}
    assert {r.component for r in G.cyclic_edges(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)], "src int, dst int")).collect()} == {2, 4}


def test_cycles_with_and_without_components(spark):
    rng = random.Random(9)
    edges = spark.createDataFrame([(rng.randrange(14), rng.randrange(14)) for _ in range(30)] + [(a, a + 20) for a in range(14)], "src int, dst int")
    rows = [sorted((tuple(r.cycle), r.cycle_type) for r in G.cycles(edges, 5, few=few).collect()) for few in (0, 50_000)]
    assert rows[0] == rows[1] and rows[0]


def test_texts_that_share_a_trigram_are_listed_together(spark, index):
    held = spark.read.parquet(f"{index.path}/grams")
    assert held.count() < held.select(F.explode("keys")).count() / 2
