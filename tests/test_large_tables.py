"""What keeps steps in proportion to their tables: plans without the exchange that they had, and equal results on odd rows."""

from collections import Counter

from pyspark.sql import functions as F

from textquarry.functions.text import tokens
from textquarry.operators import search as S
from textquarry.operators.segments import SegmentedIndex
from textquarry.storage import fresh_dir

TEXTS = [(1, "the cat the Dog"), (2, None), (3, ""), (4, "camelCase snake_case 42"), (5, "ΑΣ'Α ΟΔΟΣ Ⓐ ½ straße"), (6, "?! --"), (7, "a " * 700 + "b")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_need_no_shuffle(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = S.postings(docs, "doc_id", "text")
    assert "Exchange" not in plan(got)
    words = {r.doc_id: r.ws for r in docs.select("doc_id", tokens(F.col("text")).alias("ws")).collect()}
    want = {(k, w): (len(ws), n, [i for i, x in enumerate(ws) if x == w]) for k, ws in words.items() for w, n in Counter(ws).items()}
    assert {(r.doc_id, r.term): (r.doc_len, r.tf, list(r.positions)) for r in got.collect()} == want


def test_index_reads_the_words_of_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    docs = spark.createDataFrame([(i, f"one two t{i}") for i in range(300)], "doc_id long, text string").repartition(8, "doc_id").withColumn("text", seen("text"))
    path = fresh_dir(spark, "once")
    S.Index.write(docs, "doc_id", "text", path)
    index = S.Index(spark, path, "doc_id")
    assert (index.n, index.average) == (300, 3.0)
    assert read.value == 300


def test_symbols_are_the_first_words_of_odd_texts(spark, tmp_path):
    from textquarry.plans.registry import Tables
    from textquarry.plans.search_queries import _symbol_docs

    docs = spark.createDataFrame([(i, x, "en", "s") for i, x in [*TEXTS, (8, " ".join(f"fooBar{i}Σ'_x" for i in range(40))), (9, "_".join("abcdefghijklmnopq"))]], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = docs.select("doc_id", F.array_distinct(F.slice(tokens(F.col("text")), 1, 12)).alias("symbols"))
    assert sorted(_symbol_docs(Tables(spark, str(tmp_path))).select("doc_id", "symbols").collect()) == sorted(whole.collect())


def test_batches_put_only_repeated_keys_in_order(spark):
    index = SegmentedIndex.create(spark, fresh_dir(spark, "repeated"), "doc_id")
    rows = [("A", 1, 1, "old words"), ("M", 2, 1, "new words here"), ("A", 1, 2, "lone"), ("A", 1, 3, "gone"), ("D", 2, 3, None), ("A", 1, None, "no key"), ("A", 1, 4, None)]
    index.apply(spark.createDataFrame(rows, "change string, seq int, doc_id long, text string"))
    asked = spark.createDataFrame([(x,) for x in ("old", "words", "new", "lone", "gone", "no")], "term string")
    assert sorted((r.doc_id, r.term) for r in index.of(asked).collect()) == [(1, "new"), (1, "words"), (2, "lone")]
    assert (index.n, index.total) == (3, 4)


def test_similar_sets_share_a_first_token_also_where_hashes_are_equal():
    import numpy as np
    import pyarrow as pa

    from textquarry.operators.similarity import COUNTERS, _first_tokens

    draw = np.random.RandomState(3)
    sets = [sorted(draw.choice(40, size=draw.randint(1, 14), replace=False).tolist()) for _ in range(150)]
    hashed = [sorted(x // 2 for x in s) for s in sets]  # every two words have one hash
    counters = np.zeros(COUNTERS, np.int64)
    counters[:20] = draw.randint(0, 9, 20)
    n = len(sets)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array([5] * n, pa.int64()), pa.array(hashed, pa.list_(pa.int64()))], names=["x", "y", "g", "hs"])
    out = next(_first_tokens(counters, 0.7)(iter([batch]))).to_pylist()
    for a in range(n):
        for b in range(n):
            x, y = set(sets[a]), set(sets[b])
            if a != b and (len(x), a) < (len(y), b) and len(x & y) / len(x | y) >= 0.7 - 1e-9:
                met = [(r, q) for r in out if r["x"] == a and r["own"] for q in out if q["x"] == b and q["t"] == r["t"]]
                bound = 0.7 / 1.7 * (len(x) + len(y)) - 1e-9
                assert any(min(r["n"] - r["i"], q["n"] - q["i"]) >= bound for r, q in met), (x, y)


def test_similar_pairs_are_those_of_brute_force_with_copies_and_no_words(spark):
    import random

    from textquarry.operators import similarity as SIM

    random.seed(4)
    texts = [" ".join(random.sample([f"word{i}" for i in range(30)], random.randint(1, 12))) for _ in range(120)] + ["same old text here"] * 40 + [None, "", "a b", "x"]
    rows = [(i, x, f"g{i % 2}") for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, text string, g string")
    got = {(r.g, r.a, r.b): round(r.jaccard, 9) for r in SIM.similar_pairs(docs, "g", "id", SIM.similarity_tokens(F.col("text")), 0.7).collect()}
    sets = {i: {w for w in (x or "").split() if len(w) > 2} for i, x, _ in rows}
    want = {(f"g{i % 2}", i, j): round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 9) for i in sets for j in sets if i < j and i % 2 == j % 2 and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7 - 1e-9}
    assert got == want


def test_inverted_lists_score_blocks_as_rows(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(S, "VECTORS_AT_ONCE", 16)
    monkeypatch.setattr(S, "QUERIES_AT_ONCE", 4)
    draw = np.random.RandomState(2)
    v = draw.normal(size=(90, 6)).round(3)
    v[40:60] = v[3]  # ties go to the lesser key
    rows = spark.createDataFrame([(i, i % 3, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, list int, embedding array<float>")
    centres = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(3)], "list int, centre array<double>")
    asked = rows.where("vec_id % 9 = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = S.ivf_search(rows, centres, asked, "vec_id", "embedding", k=5, probes=3)
    assert "MapInArrow" in plan(got)
    want = S.top_k(S.vector_scores(rows.drop("list"), asked, "vec_id", "embedding"), 5, key="vec_id")
    assert sorted(map(tuple, got.select("query_id", "vec_id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "vec_id", "score", "rank").collect()))


def test_ways_of_two_edges_are_no_rows(spark):
    import random

    from textquarry.operators import graph as G

    random.seed(6)
    pairs = {(random.randint(1, 40), random.randint(1, 40)) for _ in range(220)}
    tree = G.neighbourhood(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs] + [("n1", "n1"), ("n90", None)], "src string, dst string"))
    assert "FlatMapCoGroupsInArrow" in plan(tree)
    out: dict = {}
    into: dict = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(f"n{a}", set()).add(f"n{b}")
            into.setdefault(f"n{b}", set()).add(f"n{a}")
    far = lambda side, x: sorted({m for n in side.get(x, ()) for m in side.get(n, ())} - side.get(x, set()) - {x})
    want = {x: (sorted(out.get(x, ())), sorted(into.get(x, ())), far(out, x), far(into, x)) for x in out.keys() | into.keys()}
    assert {r.root: (r.direct_out, r.direct_in, r.indirect_out, r.indirect_in) for r in tree.collect()} == want


def test_lists_of_a_community_go_to_few_blocks(spark, monkeypatch):
    """Twelve complete graphs whose keys alternate: a list goes to the blocks of its own graph, and no list that is done is shuffled."""
    from textquarry.operators import graph as G

    kept, cut = [], G.cut

    def seen(df):
        kept.append(cut(df))
        return kept[-1]

    monkeypatch.setattr(G, "cut", seen)
    monkeypatch.setattr(G, "ROOTS_AT_ONCE", 20)
    edges = spark.createDataFrame([(12 * a + k, 12 * b + k) for k in range(12) for a in range(20) for b in range(20) if a != b], "src long, dst long")
    tree = G.neighbourhood(edges)
    got = {r.root: r for r in tree.collect()}
    assert len(got) == 240 and all(r.direct_out == r.direct_in == [12 * a + x % 12 for a in range(20) if 12 * a + x % 12 != x] and not r.indirect_out and not r.indirect_in for x, r in got.items())
    assert "Join" not in plan(tree).split("FlatMapCoGroupsInArrow")[0]
    blocks = next(df for df in kept if "block" in df.columns).selectExpr("n % 12 as k", "block").distinct().groupBy("k").count().collect()
    assert len(blocks) == 12 and max(r["count"] for r in blocks) <= 4


def test_sets_of_a_family_are_not_sent_once_a_pair(spark, monkeypatch):
    from textquarry.operators import similarity as SIM

    monkeypatch.setattr(SIM, "SETS_AT_ONCE", 7, raising=False)
    common = [f"word{i}" for i in range(40)]
    rows = [("g", i, " ".join([*common, f"own{i}", f"third{i % 3}"])) for i in range(60)]
    out = SIM.similar_pairs(spark.createDataFrame(rows, "g string, id long, text string"), "g", "id", SIM.similarity_tokens(F.col("text")), 0.7)
    got = {(r.a, r.b): round(r.jaccard, 9) for r in out.collect()}
    assert got == {(a, b): round((40 + (a % 3 == b % 3)) / (44 - (a % 3 == b % 3)), 9) for a in range(60) for b in range(a + 1, 60)}
    assert "FlatMapCoGroupsInArrow" in plan(out)


def test_sketches_lose_no_pair_and_keep_unlike_sets_apart(spark, monkeypatch):
    import random

    from textquarry.operators import similarity as SIM

    random.seed(8)
    common = [f"word{i}" for i in range(60)]
    rows = [("g", i, " ".join(random.sample(common, random.randint(30, 50)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "g string, id long, text string")
    words = {i: set(t.split()) for _, i, t in rows}
    want = {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= 0.7 * len(words[a] | words[b]) - 1e-9}
    kept, cut = [], SIM.cut

    def seen(df):
        kept.append(cut(df))
        return kept[-1]

    monkeypatch.setattr(SIM, "cut", seen)
    out = SIM.similar_pairs(docs, "g", "id", SIM.similarity_tokens(F.col("text")), 0.7).collect()
    assert {(r.a, r.b) for r in out} == want and len(want) > 20
    counts = [df.count() for df in kept if df.columns == ["x", "y", "x2", "y2"]]
    assert len(counts) == 2 and counts[1] < counts[0] / 2
